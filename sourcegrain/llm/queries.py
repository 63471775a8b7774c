"""The queries of the training-data operators, as registered for the whole tables."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from . import html, jaccard, licenses, lines, mixing, packing, passages, periodic, quality, repair, suffixes, toxicity, vectors
from .common import table

RESULT_1 = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op1_quality_rules(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents")).select(*RESULT_1)


def op2_suffix_dedup(spark, sf_dir):
    kept = suffixes.dedup_bytes(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_source_mixing(spark, sf_dir):
    return mixing.taken_words(mixing.positioned(table(spark, sf_dir, "documents")))


def op4_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")


def op6_exact_top_k(spark, sf_dir):
    return vectors.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_html_extraction(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages"))


def op8_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op9_substring_dedup(spark, sf_dir):
    kept = passages.dedup_passages(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_license_scan(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op11_line_dedup(spark, sf_dir):
    kept = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op12_conversation_repair(spark, sf_dir):
    return repair.repair_conversations(repair.damaged(table(spark, sf_dir, "conversations")))


def planted_tail(doc_id, n_words):
    """Where and with which period the contract of op13 makes the end of a text repeat itself: in a tenth of the documents."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n_words:
        return None
    g = h // 10
    a = g % n_words
    return a, 1 + (n_words - a) // (3 + g % 8)


def op13_periodic_runs(spark, sf_dir):
    found = periodic.periodic_runs(table(spark, sf_dir, "documents"), planted_tail)
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"), F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"),
    )


def queries():
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql():
    return {"op1_quality_rules": quality.SQL, "op3_source_mixing": mixing.SQL, "op6_exact_top_k": vectors.SQL, "op10_license_scan": licenses.SQL, "op11_line_dedup": lines.SQL}
