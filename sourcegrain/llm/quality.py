"""Quality rules by distribution divergence [native].

A document's histograms of character classes and of common words are compared
with those of its language by Jensen-Shannon distance. The references are the
summed histograms of all documents of the language that pass the base rules;
documents too short for a histogram are guarded from the comparison.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, bind, cut, ranked_id, words_of

#: The commonest words by language.
COMMON = {
    "de": ("der", "die", "das", "und", "den", "zu", "mit", "ein", "ist", "nicht", "von", "auf", "für", "im", "dem", "sich"),
    "en": ("the", "of", "and", "to", "in", "is", "it", "that", "for", "with", "as", "was", "on", "are", "by", "this"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "una", "para"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"),
}
_ALL_COMMON = sorted({w for words in COMMON.values() for w in words})
BINS = max(map(len, COMMON.values()))

SYMBOLS = r"[#*$%&|<>]"
#: Character classes; what remains of a text's code points are lower-case ASCII letters and rare controls.
CLASSES = (r"[A-Z]", r"[0-9]", r"[.,;:!?'\x22()-]", r"[#*$%&|<>@+=_/\x5c^~\x60{}\[\]]", r"[^\x00-\x7F]")

#: Below these sizes a histogram says little and isn't compared.
MIN_CHARS, MIN_WORDS = 200, 50
#: Largest Jensen-Shannon distances (base 2) that are kept, beyond what a sample of the text's size has by itself: a
#: histogram of n counts in k bins drawn from its reference is expected at a squared distance of (k - 1) / (8 n ln 2).
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.20, 0.28


def _count(text: Column, keep: str) -> Column:
    negated = f"[^{keep[1:]}" if not keep.startswith("[^") else f"[{keep[2:]}"
    return F.length(F.regexp_replace(text, negated + "+", ""))


def n_repeat_words(words: Column) -> Column:
    """Words in 3-word windows that the text holds twice or more."""

    def windows(w: Column) -> Column:
        return F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))

    def covered(ordered: Column) -> Column:
        twin = lambda x, k: F.get(ordered, k)["h"].eqNullSafe(x["h"])
        again = F.filter(ordered, lambda x, k: twin(x, k - 1) | twin(x, k + 1))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    def count(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bind(ordered, covered))

    return bind(words, lambda w: bind(windows(w), count))


def features(docs: DataFrame) -> DataFrame:
    """One row per document: the base counts and both histograms."""
    rows = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("lang_key"), F.coalesce(F.col("text"), F.lit("")).alias("body"))
    rows = rows.select(
        "doc_id", "lang_key", F.xxhash64("body").alias("th"), words_of(F.col("body")).alias("words"), F.length("body").alias("n_chars_all"),
        F.length(F.regexp_replace("body", SPACE, "")).alias("word_chars"), _count(F.col("body"), SYMBOLS).alias("n_symbols"),
        F.filter(F.split("body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"), *[_count(F.col("body"), c).alias(f"c{i}") for i, c in enumerate(CLASSES)],
    )
    common = F.coalesce(*[F.when(F.col("lang_key") == k, F.array(*map(F.lit, w))) for k, w in COMMON.items()], F.array_repeat(F.lit(""), BINS))
    hits = F.filter("words", lambda w: w.isin(_ALL_COMMON))
    word_bins = bind(F.struct(hits.alias("hits"), common.alias("common")), lambda s: F.transform(s["common"], lambda c: F.size(F.filter(s["hits"], lambda w: w == c)).cast("long")))
    rows = rows.select(
        "doc_id", "lang_key", "th", F.size("words").cast("long").alias("n_words"), F.col("word_chars").cast("long"), F.col("n_symbols").cast("long"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), n_repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.array(*[F.col(f"c{i}").cast("long") for i in range(len(CLASSES))], (F.col("n_chars_all") - F.col("word_chars")).cast("long"), (F.col("word_chars") - sum(F.col(f"c{i}") for i in range(len(CLASSES)))).cast("long")).alias("char_hist"),
        word_bins.alias("bins"),
    )
    rows = rows.withColumn("word_hist", F.concat("bins", F.array(F.col("n_words") - _total(F.col("bins")))))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.drop("bins").withColumn("base_failed", failed)


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two count arrays; null where one is empty."""
    shares = lambda a: bind(F.struct(a.alias("a"), _total(a).alias("n")), lambda s: F.transform(s["a"], lambda x: x / s["n"]))
    term = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    parts = F.zip_with(shares(p), shares(q), lambda a, b: term(a, (a + b) / 2) + term(b, (a + b) / 2))
    return F.when((_total(p) > 0) & (_total(q) > 0), F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / 2)))


def references(rows: DataFrame) -> DataFrame:
    """Per language the summed histograms of the documents that pass the base rules."""
    good = rows.filter(~F.col("base_failed"))
    bins = {"char_hist": len(CLASSES) + 2, "word_hist": BINS + 1}
    sums = good.groupBy("lang_key").agg(*[F.sum(F.get(h, F.lit(i))).alias(f"{h}{i}") for h, n in bins.items() for i in range(n)])
    return sums.select("lang_key", *[F.array(*[F.col(f"{h}{i}") for i in range(n)]).alias(f"ref_{h}") for h, n in bins.items()])


def quality(docs: DataFrame, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance.

    One row per row of docs; doc_id, text and lang are read. Null text counts
    as empty, so base_failed. A null lang is a language of its own without
    common words. A document below MIN_CHARS or MIN_WORDS has no distance and
    is judged by the base rules alone; so is one whose language has no
    document that passes them. Repeated rows each count. Empty docs: no rows.
    """
    rows = cut(features(docs), "quality")
    out = rows.join(references(rows), "lang_key", "left")
    long_enough = (_total(F.col("char_hist")) >= MIN_CHARS) & (F.col("n_words") >= MIN_WORDS)
    out = out.withColumn("char_distance", F.when(long_enough, js_distance(F.col("char_hist"), F.col("ref_char_hist"))))
    out = out.withColumn("word_distance", F.when(long_enough, js_distance(F.col("word_hist"), F.col("ref_word_hist"))))
    near = F.lit(True)
    for name, hist, bins, most in (("char_distance", "char_hist", len(CLASSES) + 2, max_char), ("word_distance", "word_hist", BINS + 1, max_word)):
        d = F.coalesce(name, F.lit(0.0))
        near = near & (d * d <= F.lit(most * most) + F.lit(_noise(bins)) / F.greatest(_total(F.col(hist)), F.lit(1)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & near).alias("kept"), "char_distance", "word_distance", "lang_key", "th")


def _noise(bins: int) -> float:
    return (bins - 1) / (8 * math.log(2))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that quality() keeps; all columns of docs, whatever their names."""
    good = quality(docs).filter("kept").select(ranked_id(F.col("doc_id")).alias("rid"), F.col("lang_key").alias("lang"), "th")
    named = docs.select(F.struct(*docs.columns).alias("row")).withColumns({"rid": ranked_id(F.col("row.doc_id")), "lang": F.coalesce(F.col("row.lang"), F.lit("")), "th": F.xxhash64(F.coalesce(F.col("row.text"), F.lit("")))})
    return named.join(good, ["rid", "lang", "th"], "left_semi").select("row.*")


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sql_count(keep: str) -> str:
    negated = f"[^{keep[1:]}" if not keep.startswith("[^") else f"[{keep[2:]}"
    pattern = negated.replace("'", "\\x27")
    return f"length(regexp_replace(body, '{pattern}+', '', 'g'))"


def _sql_distance(p: str, q: str) -> str:
    a, b = f"({p}[i] / list_sum({p})::DOUBLE)", f"({q}[i] / list_sum({q})::DOUBLE)"
    term = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({a} + {b}) / 2)) ELSE 0 END"
    return f"sqrt(greatest(0, list_sum([{term(a)} + {term(b)} for i in range(1, len({p}) + 1)]) / 2))"


_N, _M = len(CLASSES) + 2, BINS + 1
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang_key, coalesce(text, '') AS body FROM documents),
t AS (SELECT *, regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+') AS words, [x for x in str_split(body, chr(10)) if regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS lines,
  CASE {" ".join(f"WHEN lang_key = '{k}' THEN {_sql_list(w)}" for k, w in COMMON.items())} ELSE [] END AS common FROM d),
g AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM t WHERE len(words) >= 3)),
m AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, w) AS c FROM g) WHERE c > 1),
v AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM m) GROUP BY r),
b AS (SELECT r, u.w, count(*) AS c FROM (SELECT r, common, unnest(words) AS w FROM t) u WHERE list_contains(common, u.w) GROUP BY 1, 2),
h AS (SELECT r, map(list(w), list(c)) AS counts FROM b GROUP BY r),
f AS (
  SELECT t.r, doc_id, lang_key, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, {_sql_count(SYMBOLS)}::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(v.n, 0)::BIGINT AS n_repeat_words, length(body) AS n_chars_all,
    [{", ".join(_sql_count(c) for c in CLASSES)}] AS classes,
    [CASE WHEN k <= len(common) THEN coalesce(element_at(counts, common[k])[1], 0) ELSE 0 END for k in range(1, {BINS + 1})] AS bins
  FROM t LEFT JOIN v USING (r) LEFT JOIN h ON h.r = t.r),
s AS (
  SELECT *, list_concat(classes, [n_chars_all - word_chars, word_chars - list_sum(classes)::BIGINT]) AS ch, list_concat(bins, [n_words - list_sum(bins)::BIGINT]) AS wh,
    n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
q AS (SELECT lang_key, [{", ".join(f"sum(ch[{i + 1}])" for i in range(_N))}] AS rch, [{", ".join(f"sum(wh[{i + 1}])" for i in range(_M))}] AS rwh FROM s WHERE NOT base_failed GROUP BY lang_key),
z AS (
  SELECT s.*, CASE WHEN n_chars_all >= {MIN_CHARS} AND n_words >= {MIN_WORDS} AND rch IS NOT NULL THEN {_sql_distance("ch", "rch")} ELSE 0 END AS dc,
    CASE WHEN n_chars_all >= {MIN_CHARS} AND n_words >= {MIN_WORDS} AND rwh IS NOT NULL THEN {_sql_distance("wh", "rwh")} ELSE 0 END AS dw
  FROM s LEFT JOIN q USING (lang_key))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND dc * dc <= {MAX_CHAR_DISTANCE * MAX_CHAR_DISTANCE}::DOUBLE + {_noise(_N)}::DOUBLE / greatest(n_chars_all, 1)
  AND dw * dw <= {MAX_WORD_DISTANCE * MAX_WORD_DISTANCE}::DOUBLE + {_noise(_M)}::DOUBLE / greatest(n_words, 1) AS kept FROM z
"""
