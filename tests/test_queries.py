"""Every registered query of the reference's operators against its SQL."""

import glob
import os

import duckdb
import pytest

from sourcegrain.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_sql(spark, name):
    rows = queries.QUERIES[name](spark, SF).toPandas()
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = con.sql(queries.SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(rows.columns) == columns

    def values(frame):
        return sorted(map(tuple, frame[columns].astype(object).where(frame[columns].notna(), None).astype(str).values.tolist()))

    assert values(rows) == values(want)
