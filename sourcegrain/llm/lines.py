"""Line dedup: lines that many documents hold go from all of them but one.

Every long line is exploded with a 128-bit hash of its normalised form and its
place. Documents are counted a hash, those over the threshold meet the lines
again, and the places to drop come back to their document, whose other lines
are reassembled in order. Texts travel once, at most; lines travel as hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, bind, cut

MIN_CHARS, MIN_DOCS = 40, 5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    """The lines of a text; a null text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """A line without white space around it, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), _UPPER, _LOWER)


def long_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, th (a hash of the text), place, h1, h2, first: every line whose key has min_chars code points or more;
    first: no line before it in the text has its hash."""
    key = lambda line, place: bind(line_key(line), lambda k: F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"), place.alias("place"))))
    ranked = F.sort_array(F.filter(F.transform(lines_of(F.col("text")), key), lambda x: x.isNotNull()))
    # Equal hashes stand together, the first place first.
    fresh = lambda all_: lambda x, i: x.withField("first", (i == 0) | (F.get(all_, i - 1)["h1"] != x["h1"]) | (F.get(all_, i - 1)["h2"] != x["h2"]))
    marked = bind(ranked, lambda all_: F.transform(all_, fresh(all_)))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text")).alias("th"), F.inline(marked))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text of every row of docs, and the columns of `carry` with "_" before their names.

    A text is split at line feeds. A line's key is the line without ASCII white
    space around it, A-Z in lower case. A key of min_chars code points or more
    that min_docs documents or more hold stays in the largest doc_id that
    holds it, with all its lines there; elsewhere its lines go.

    Every row is a document, also where it repeats a doc_id; if rows share the
    largest doc_id that holds a key, it stays in each. A null doc_id ranks below all numbers.
    A null or empty text is one empty line. Very long texts take time
    linear in their lines but for sorting their hashes. Only doc_id, text and
    `carry` are read. Empty docs: no rows.
    """
    lines = long_lines(docs, min_chars)
    # One row a hash: a task sums its own rows first, so a line of many documents is no large group.
    spread = lines.filter("first").groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper")).filter(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper")
    # The hashes are a table of their own: between two plain shuffles adaptive execution splits the partition of a very common
    # line, whose lines are many while its hash stands there once, or sends few hashes to all lines.
    gone = lines.join(cut(spread, "common-lines"), ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    places = gone.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("place")).alias("gone")).withColumnsRenamed({"doc_id": "g_id", "th": "g_th"})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text")).alias("th"), *[F.col(c).alias(f"_{c}") for c in carry])
    found = rows.join(places, rows["doc_id"].eqNullSafe(places["g_id"]) & (rows["th"] == places["g_th"]), "left")

    def without(lines: Column, gone: Column) -> Column:
        """The lines between the places in turn."""
        ends = F.concat(gone, F.array(F.size(lines)))
        pieces = bind(ends, lambda e: F.transform(e, lambda z, i: bind(F.when(i == 0, F.lit(0)).otherwise(F.get(e, i - 1) + 1), lambda a: F.slice(lines, a + 1, z - a))))
        return F.flatten(pieces)

    kept = F.when(F.col("gone").isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(bind(lines_of(F.col("text")), lambda x: F.array_join(without(x, F.col("gone")), "\n")))
    n_lines = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit("\n")) + 1
    return found.select("doc_id", n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"), *[f"_{c}" for c in carry])


SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
e AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM d),
k AS MATERIALIZED (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
s AS (SELECT key, max(doc_id) AS keeper FROM (SELECT DISTINCT r, doc_id, key FROM k WHERE length(key) >= 40) GROUP BY key HAVING count(*) >= 5),
f AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id IS DISTINCT FROM s.keeper AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY r, doc_id
"""
