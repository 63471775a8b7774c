"""Text that arrives in pieces, as it may be shown so far: without emphasis, and with an open marker at its end held back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.prompts import without_emphasis

STATE = "text string"


def shown(so_far: Column) -> Column:
    """The text so far without emphasis and leading white space, and without what follows its last "<" if that began within the last 12 characters."""
    return F.regexp_replace(F.regexp_replace(without_emphasis(so_far), r"(?U)^\s+", ""), r"(?s)<[^<]{0,11}\z", "")


def _told(rows: DataFrame) -> DataFrame:
    return rows.select("key", "seq", shown(F.col("so_far")).alias("partial")).filter(F.col("partial") != "")


def partial_texts(pieces: DataFrame) -> DataFrame:
    """key, seq, partial: what is shown of a key's text after each piece, where there is anything. pieces: key, seq, piece (null: empty)."""
    until = W.partitionBy("key").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return _told(pieces.select("key", F.col("seq").cast("long").alias("seq"), F.array_join(F.collect_list(F.coalesce("piece", F.lit(""))).over(until), "").alias("so_far")))


def partial_texts_stream(pieces: DataFrame) -> DataFrame:
    """The same for a stream whose batches follow each other in seq; a key's text so far is its state."""
    rows = pieces.select("key", F.col("seq").cast("long").alias("seq"), F.coalesce("piece", F.lit("")).alias("piece"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text = state.get[0] if state.exists else ""
        batch = pd.concat(list(batches)).sort_values("seq")
        so_far = []
        for piece in batch["piece"]:
            text += piece
            so_far.append(text)
        state.update((text,))
        yield pd.DataFrame({"key": [key[0]] * len(so_far), "seq": batch["seq"].to_numpy(), "so_far": so_far})

    return _told(rows.groupBy("key").applyInPandasWithState(run, f"key {kind}, seq long, so_far string", STATE, "append", GroupStateTimeout.NoTimeout))
