"""Candidates for shared passages by minimizers.

Every window (of bytes or words) is assigned to its anchor, the n-gram in it
with the smallest hash. Equal windows have equal anchors at equal places, so
only windows whose anchor occurs elsewhere can be repeated. Consecutive
windows with one anchor are a run; runs, not windows, are compared later.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix64, ranked_id, small_batches, tidy
from .grams import window_minima

#: Anchors that a task gathers before it hands them on.
FLUSH = 1_000_000
#: Runs with one anchor that one task may compare; the windows of anchors with more are dealt one by one.
HOT = 20_000
#: Hot anchors are broadcast; HOT rises until there are at most so many.
MAX_HOT = 1_000_000
BATCH_BYTES = 2 << 20


@dataclass
class Runs:
    """Runs of windows of a batch of texts: the text, the first and last window, the place and the 48-bit hash of the anchor."""

    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    at: np.ndarray
    key: np.ndarray


def runs_of(grams: np.ndarray, bounds: np.ndarray, gram: int, window: int) -> Runs:
    """grams[i]: hash of the gram at unit i of the concatenated texts; bounds: where texts start and the last ends."""
    low = window_minima(grams, window - gram + 1)
    n = len(bounds) - 1
    lengths = np.diff(bounds)
    many = np.maximum(lengths - window + 1, 0)
    start = np.repeat(bounds[:-1], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    text = np.repeat(np.arange(n), many)
    at = low[start] if len(start) else np.zeros(0, np.int64)
    edge = np.ones(len(start), bool)
    edge[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(edge)
    tail = np.append(head[1:], len(start)) - 1 if len(head) else head
    return Runs(text[head], start[head], start[tail], at[head], (grams[at[head]] >> np.uint64(16)).astype(np.int64))


ROW = "part int, name long, rid long, th long, n_units long, sequence binary, anchor long, many long, payload binary"
_NAMES = ["part", "name", "rid", "th", "n_units", "sequence", "anchor", "many", "payload"]
_TYPES = [pa.int32(), *[pa.int64()] * 4, pa.binary(), pa.int64(), pa.int64(), pa.binary()]


def _rows(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(_NAMES, _TYPES, strict=True)], _NAMES)


def names_of(rid: np.ndarray, th: np.ndarray) -> np.ndarray:
    """40-bit names of rows by id and text, so that rows with a null or repeated id have names of their own.
    Texts that share a name by chance share their candidates, which costs time only."""
    return (mix64(rid.astype(np.uint64) ^ mix64(th.astype(np.uint64))) >> np.uint64(24)).astype(np.int64)


def _pack(key: np.ndarray, name: np.ndarray, many: np.ndarray) -> bytes:
    """Anchors in 6 bytes each, names in 5, counts in 1 where all are small, else in 4."""
    small = int(many.max()) < 256
    bytes_of = lambda x, n: x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :n].tobytes()
    return np.array([len(key), small], "<i8").tobytes() + bytes_of(key, 6) + bytes_of(name, 5) + np.minimum(many, 2**31).astype("u1" if small else "<u4").tobytes()


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, small = np.frombuffer(raw, "<i8", 2).tolist()
    key, name = np.zeros((n, 8), np.uint8), np.zeros((n, 8), np.uint8)
    key[:, :6] = np.frombuffer(raw, np.uint8, 6 * n, 16).reshape(n, 6)
    name[:, :5] = np.frombuffer(raw, np.uint8, 5 * n, 16 + 6 * n).reshape(n, 5)
    return key.view("<i8").ravel(), name.view("<i8").ravel(), np.frombuffer(raw, "u1" if small else "<u4", n, 16 + 11 * n).astype(np.int64)


def digests(texts: list[bytes]) -> list[bytes]:
    """128-bit digests, by which whole copies are known."""
    return [hashlib.blake2b(text, digest_size=16).digest() for text in texts]


def keyed(docs: DataFrame) -> DataFrame:
    """rid (doc_id, null last) and th, which name a row up to repeats, and text (null: empty)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(ranked_id(F.col("doc_id")).alias("rid"), F.xxhash64(text).alias("th"), text.alias("text"))


def find(rows: DataFrame, scan: Callable[[pa.Array], tuple[np.ndarray, list[bytes], Runs]], name: str, per_text: bool) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(texts, candidates, hot) of keyed rows.

    scan gives a column's units a text, a digest of each text's units, and its
    runs. texts: name, rid, th, n_units, sequence (the digest). candidates:
    (name, anchor) whose anchor occurs twice or more (per_text: in two texts).
    hot: the anchors with more than HOT runs (per_text: texts). Anchors travel as binary columns of a hash range; a task
    sends one row an anchor, so that an anchor of any frequency stays spread.
    """
    n_parts = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, names, texts, held, n_texts = [], [], [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, own, text = np.concatenate(keys), np.concatenate(names), np.concatenate(texts)
            order = np.lexsort((text, key))
            key, own, text = key[order], own[order], text[order]
            if per_text:
                fresh = np.ones(len(key), bool)
                fresh[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
                key, own = key[fresh], own[fresh]
            head = np.ones(len(key), bool)
            head[1:] = key[1:] != key[:-1]
            at = np.flatnonzero(head)
            many = np.diff(np.append(at, len(key)))
            again = np.repeat(many, many) > 1
            found = np.unique(np.stack([own[again], key[again]]), axis=1)
            yield _rows(part=(found[0] % n_parts).astype(np.int32), name=found[0], anchor=found[1])
            key, own = key[at], own[at]
            part = (key * n_parts) >> 48 if n_parts < 1 << 15 else key % n_parts
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(n_parts + 1)).tolist()
            full = [p for p in range(n_parts) if cuts[p] < cuts[p + 1]]
            some = [order[cuts[p] : cuts[p + 1]] for p in full]
            yield _rows(part=full, payload=[_pack(key[s], own[s], many[s]) for s in some])

        for batch in batches:
            for piece in small_batches(iter([batch]), "text", BATCH_BYTES):
                n_units, sequence, runs = scan(piece.column("text"))
                rid, th = piece.column("rid").to_numpy(), piece.column("th").to_numpy()
                own = names_of(rid, th)
                yield _rows(part=(own % n_parts).astype(np.int32), name=own, rid=rid, th=th, n_units=n_units, sequence=sequence)
                keys.append(runs.key)
                names.append(own[runs.text])
                texts.append(runs.text + n_texts)
                held, n_texts = held + len(runs.key), n_texts + len(own)
                if held >= FLUSH:
                    yield from flush()
                    keys, names, texts, held, n_texts = [], [], [], 0, 0
        if held:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            blob = batch.column("payload")
            plain = batch.filter(blob.is_null())
            if plain.num_rows:
                yield plain
            parts += [_unpack(raw.as_buffer()) for raw in blob.drop_null()]
        if parts:
            key, own, many = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(key, kind="stable")
            key, own, many = key[order], own[order], many[order]
            at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            total = np.add.reduceat(many, at)
            kept = np.repeat(total > 1, np.diff(np.append(at, len(key))))
            hot = total > HOT
            yield _rows(part=np.zeros(int(kept.sum()), np.int32), name=own[kept], anchor=key[kept])
            yield _rows(part=np.zeros(int(hot.sum()), np.int32), anchor=key[at[hot]], many=total[hot])

    found = cut(rows.mapInArrow(tidy(spread), ROW).repartition(n_parts // 4, "part").mapInArrow(tidy(meet), ROW).drop("part", "payload"), name)
    texts = found.filter(F.col("sequence").isNotNull()).select("name", "rid", "th", "n_units", "sequence")
    candidates = found.filter(F.col("sequence").isNull() & F.col("name").isNotNull()).select("name", "anchor")
    hot = found.filter(F.col("many").isNotNull()).select("anchor", "many").orderBy(F.col("many").desc(), "anchor").limit(MAX_HOT).toArrow()
    return texts, candidates, np.sort(hot.column("anchor").to_numpy())


def with_candidates(rows: DataFrame, texts: DataFrame, candidates: DataFrame) -> DataFrame:
    """rid, th, text, anchors of the texts that hold candidates. texts: name, rid, th."""
    lists = candidates.groupBy("name").agg(F.collect_set("anchor").alias("anchors"))
    return rows.join(texts.join(lists, "name").groupBy("rid", "th").agg(F.first("anchors").alias("anchors")), ["rid", "th"])
