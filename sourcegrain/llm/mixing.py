"""Mixing sources to target weights along a time-varying curriculum [native].

Each source s has a weight schedule over training time t in [0, 1],

    w_s(t) = target_s * (1 + a_s * (1 - 2 t)),

whose integral over [0, 1] is the source's target. Its cumulative token demand
is D_s(t) = target_s * (t + a_s * (t - t^2)). The k-th copy of a document
covers an interval of its source's token stream; inverting D_s at the middle
of that interval gives the copy's training position. A copy whose middle lies
beyond the demand of the whole training has no position and isn't taken; the
mix is the other copies, range-sorted by position.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import n_words

#: A source is summed in 16^d slices by the first d digits of the ordering digest, so that no source is one
#: group: the fewest digits, from MIN_DIGITS, for which a slice of all rows together holds SLICE_ROWS at most.
MIN_DIGITS, SLICE_ROWS = 3, 50_000


def source_targets(per_source: DataFrame, weights, slopes, share: float, cap: float) -> DataFrame:
    """per_source (no_source, src, source_size) with the columns target and slope.

    Sources rank by code point, null last, and take `weights` and `slopes` in
    turn. The targets share `share` times all words by weight; none exceeds
    `cap` times its source. With sources in order of cap / weight, those before
    the first one that stays below its cap are full, and the rest of the budget
    is level over the weights of the others: the end point of resharing.
    """
    one = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.col("rank") - 1, F.lit(len(values))) + 1).cast("int"))
    ranked = per_source.withColumn("rank", F.row_number().over(W.orderBy("no_source", "src"))).select(
        "no_source", "src", "source_size", one(weights).cast("long").alias("weight"), one(slopes).cast("double").alias("slope"),
    )
    fill = W.orderBy(F.col("source_size") / F.col("weight"), "no_source", "src")
    level = (
        ranked.withColumn("limit", F.col("source_size") * F.lit(cap))
        .withColumn("full", F.coalesce(F.sum("limit").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        # What is left from here on, as all less a running sum: a frame to the end is summed anew for each row.
        .withColumn("open_weight", F.sum("weight").over(W.partitionBy()) - F.coalesce(F.sum("weight").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("budget", F.sum("source_size").over(W.partitionBy()) * F.lit(share))
        .withColumn("level", (F.col("budget") - F.col("full")) / F.col("open_weight"))
    )
    below = F.when(F.col("weight") * F.col("level") < F.col("limit"), F.col("level"))
    return level.withColumn("level", F.max(below).over(W.partitionBy())).select(
        "no_source", "src", "source_size", "slope",
        F.coalesce(F.least(F.col("weight") * F.col("level"), F.col("limit")), F.col("limit")).alias("target"),
    )


def positioned(docs: DataFrame, weights=(5, 2, 1), slopes=(0.5, 0.0, -0.5), share: float = 1.5, cap: float = 2.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, positions (of the copies that are taken, ascending) of every row of docs,
    the columns no_source, src, slice, nth that name the row, and those of `carry` with "_" before their names.

    Reads doc_id, text, source and `carry`. The stream of a source repeats its
    documents in the order of a digest of doc_id and text. Null text: size 0.
    Null source: a source of its own, last. Null doc_id: ordered by the text.
    Repeated rows are separate documents, equal rows in any order. Empty docs:
    no rows. Reruns agree, as nothing depends on partitions or random numbers.
    """
    n_rows, digits = docs.count(), MIN_DIGITS
    while n_rows > SLICE_ROWS * 16**digits:
        digits += 1
    rows = docs.select(
        "doc_id", F.col("source").isNull().alias("no_source"), F.coalesce(F.col("source"), F.lit("")).alias("src"), n_words(F.col("text")).alias("size"),
        F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit(""))))).alias("order"), *[F.col(c).alias(f"_{c}") for c in carry],
    ).withColumn("slice", F.substring("order", 1, digits))
    # One row a slice: at most 16^digits a source, whatever its share of the rows.
    slices = rows.groupBy("no_source", "src", "slice").agg(F.sum("size").alias("slice_size"))
    before = W.partitionBy("no_source", "src").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    targets = source_targets(slices.groupBy("no_source", "src").agg(F.sum("slice_size").alias("source_size")), weights, slopes, share, cap)
    slices = slices.withColumn("slice_start", F.coalesce(F.sum("slice_size").over(before), F.lit(0))).join(targets, ["no_source", "src"])
    inside = W.partitionBy("no_source", "src", "slice").orderBy("order", "size")
    placed = (
        rows.withColumn("nth", F.row_number().over(inside))
        .withColumn("run", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)))
        .join(slices, ["no_source", "src", "slice"])
        .withColumn("start", F.col("slice_start") + F.col("run") - F.col("size"))
    )

    def position(copy: Column) -> Column:
        """Where the middle of a copy (from 0) meets the source's cumulative demand; null beyond it."""
        middle = copy * F.col("source_size") + F.col("start") + F.col("size") / 2
        c, rise = middle / F.col("target"), F.lit(1.0) + F.col("slope")
        return F.when(middle < F.col("target"), 2 * c / (rise + F.sqrt(F.greatest(F.lit(0.0), rise * rise - 4 * F.col("slope") * c))))

    copies = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(math.ceil(cap) - 1).cast("long")), position)
    return placed.select("no_source", "src", "slice", "nth", "doc_id", "size", "source_size", "target", F.filter(copies, lambda p: p.isNotNull()).alias("positions"), *[f"_{c}" for c in carry])


def curriculum_mix(docs: DataFrame, weights=(5, 2, 1), slopes=(0.5, 0.0, -0.5), share: float = 1.5, cap: float = 2.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """The copies of documents that the mix takes, range-sorted by position: the columns of positioned(),
    with copy (from 1) and position for positions."""
    mix = positioned(docs, weights, slopes, share, cap, carry)
    own = [c for c in mix.columns if c != "positions"]
    mix = mix.select(*own, F.posexplode("positions").alias("copy", "position")).withColumn("copy", F.col("copy") + 1)
    return mix.orderBy("position", "src", "slice", "nth", "copy")


def taken_words(positioned_rows: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken (words, repeats counted)."""
    return positioned_rows.select("doc_id", "size", "source_size", "target", (F.size("positions") * F.col("size")).cast("long").alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT] AS weight FROM s),
l AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap,
         (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget,
         coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
         sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS open_weight
  FROM r),
v AS (SELECT max((budget - filled) / open_weight) FILTER (WHERE weight * ((budget - filled) / open_weight) < cap) AS level FROM l),
t AS (SELECT source, source_size, coalesce(least(weight * level, cap), cap) AS target FROM l, v),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (CASE WHEN start + size / 2.0::DOUBLE < target THEN 1 ELSE 0 END + CASE WHEN source_size + start + size / 2.0::DOUBLE < target THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p
"""
