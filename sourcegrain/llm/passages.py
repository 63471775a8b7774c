"""Substring dedup by words with a compressed FM-index per shard.

Candidate runs of windows (see anchors) are dealt to shards by anchor. A shard
indexes its distinct runs: the Burrows-Wheeler transform in a wavelet matrix,
with the documents of the suffixes under a range minimum. Runs are streamed
through it by backward search, all lanes in step; a match is extended while
its interval holds a document with a smaller id, which gives the matching
statistics, and intervals of the threshold's length or more are reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors
from .common import cut, small_batches, tidy
from .grams import buffers, gram_hashes, word_hashes

WINDOW, GRAM = 13, 5
#: Bytes of a word's hash that a shard sees.
WORD_BYTES = 5
#: Different pieces that a task compares before it hands them on.
HELD = 100_000
#: Runs that one index holds.
INDEX_RUNS = 4_000


def scan(column: pa.Array, window: int = WINDOW):
    data, offsets = buffers(column)
    words, _, _, first = word_hashes(data, offsets)
    n_units = np.diff(first)
    raw = data.tobytes()
    sequence = anchors.digests([b" ".join(raw[a:z].split()) for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
    return n_units, sequence, anchors.runs_of(gram_hashes(words, GRAM), first, GRAM, window)


class FMIndex:
    """Occurrences of words in a set of pieces, each with the smallest document that holds it."""

    def __init__(self, pieces: list[np.ndarray], docs: np.ndarray):
        lengths = np.array([len(p) for p in pieces])
        self.symbols, coded = np.unique(np.concatenate(pieces), return_inverse=True)
        # The text: every piece followed by a separator, which is symbol 0.
        self.start = np.cumsum(lengths + 1) - lengths - 1
        n = self.n = int((lengths + 1).sum())
        text = self.text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[self.start + lengths] = False
        text[inside] = coded + 1
        doc = np.repeat(docs, lengths + 1)
        # Suffix order by prefix doubling; separators are told apart by place.
        rank = np.where(inside, text + len(pieces), np.cumsum(~inside))
        step = 1
        while True:
            ahead = np.zeros(n, np.int64)
            ahead[: n - step] = rank[step:] + 1 if step < n else 0
            key = rank * (n + len(self.symbols) + len(pieces) + 2) + ahead
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            fresh = np.append(False, ordered[1:] != ordered[:-1])
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(fresh)
            if rank[order[-1]] == n - 1 or step >= n:
                break
            step *= 2
        bwt = text[order - 1]
        self.before = np.searchsorted(np.sort(text), np.arange(len(self.symbols) + 2))
        # The wavelet matrix: a bit vector a level, with the ones before each word of 64 bits.
        self.levels = max(1, int(len(self.symbols)).bit_length())
        self.bits, self.ones, self.zeros = [], [], []
        row = bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (row >> level) & 1
            packed = np.packbits(np.append(bit, np.zeros(64 + -n % 64, np.int64)).astype(np.uint8), bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.ones.append(np.append(0, np.cumsum(np.bitwise_count(packed).astype(np.int64))))
            self.zeros.append(int(n - bit.sum()))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        self.base = self._descend(np.arange(len(self.symbols) + 1), np.zeros(len(self.symbols) + 1, np.int64))
        # Range minimum of the documents in suffix order.
        self.low = [doc[order]]
        while 2 << (len(self.low) - 1) <= n:
            half = 1 << (len(self.low) - 1)
            self.low.append(np.minimum(self.low[-1][:-half], self.low[-1][half:]))

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            word = i >> 6
            mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.ones[k][word] + np.bitwise_count(self.bits[k][word] & mask).astype(np.int64)
            i = np.where((symbol >> (self.levels - 1 - k)) & 1, self.zeros[k] + ones, i - ones)
        return i

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the intervals of symbol + match, from those of match."""
        both = self._descend(np.concatenate([symbol, symbol]), np.concatenate([low, high])).reshape(2, -1)
        return self.before[symbol] + both[0] - self.base[symbol], self.before[symbol] + both[1] - self.base[symbol]

    def smallest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest document in each interval that isn't empty."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level).tolist():
            some = level == k
            out[some] = np.minimum(self.low[k][low[some]], self.low[k][high[some] - (1 << k)])
        return out

    def matches(self, lane: np.ndarray, docs: np.ndarray, lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lane, first, last) of maximal runs of windows of the pieces `lane` that occur in a document below docs[lane]."""
        out = []
        end = lengths[lane] - 1
        place, low, high = end + 1, np.zeros(len(lane), np.int64), np.full(len(lane), self.n)
        while len(lane):
            symbol = self.text[self.start[lane] + place - 1]
            new_low, new_high = self.extend(symbol, low, high)
            ok = new_high > new_low
            ok[ok] = self.smallest(new_low[ok], new_high[ok]) < docs[lane[ok]]
            place, low, high = np.where(ok, place - 1, place), np.where(ok, new_low, low), np.where(ok, new_high, high)
            over = ~ok | (place == 0)
            long = over & (end - place + 1 >= window)
            out.append(np.stack([lane[long], place[long], end[long] - window + 1]))
            # What failed is the word before place; later windows with it end before the match does.
            end = np.where(over, np.where(place == 0, -1, np.minimum(end - 1, place - 1 + window - 1)), end)
            place, low, high = np.where(over, end + 1, place), np.where(over, 0, low), np.where(over, self.n, high)
            stay = end >= window - 1
            lane, end, place, low, high = lane[stay], end[stay], place[stay], low[stay], high[stay]
        return tuple(np.concatenate(out, axis=1)) if out else (np.zeros(0, np.int64),) * 3


def _narrow(words: np.ndarray) -> bytes:
    return np.ascontiguousarray(words).astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - WORD_BYTES :].tobytes()


def _widen(raw: bytes) -> np.ndarray:
    narrow = np.frombuffer(raw, np.uint8).reshape(-1, WORD_BYTES)
    wide = np.zeros((len(narrow), 8), np.uint8)
    wide[:, :WORD_BYTES] = narrow
    return wide.view("<i8").ravel()


PIECE = "shard long, rid long, th long, start long, words binary, first long, last long"
_PIECE_NAMES = ["shard", "rid", "th", "start", "words", "first", "last"]
_PIECE_TYPES = [pa.int64()] * 4 + [pa.binary()] + [pa.int64()] * 2


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PIECE_TYPES, strict=True)], _PIECE_NAMES)


def joined(settled: list[tuple]) -> list[tuple]:
    """Rows of settled spans, those of a text that touch as one."""
    out: list[tuple] = []
    for row in sorted(settled, key=lambda r: (r[1], r[2], r[5])):
        if out and out[-1][1:3] == row[1:3] and row[5] <= out[-1][6] + 1:
            out[-1] = (*out[-1][:6], max(out[-1][6], row[6]))
        else:
            out.append(row)
    return out


def repeated_windows(rows: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """texts, and spans: (rid, th, first, last) ranges of window starts that also occur in a text with a smaller rid.
    All columns of rows (rid, th, text, ...) travel with the texts that are asked, see dedup_passages."""
    text = F.col("text").cast("string").alias("text")
    texts, candidates, hot = anchors.find(rows.select("rid", "th", text), lambda column: scan(column, window), "passages", True)
    texts = texts.groupBy("name", "rid", "th", "n_units", "sequence").agg(F.lit(1).alias("one")).drop("one")
    lowest = texts.groupBy("sequence", "n_units").agg(F.min("rid").alias("lowest"))
    texts = cut(texts.join(lowest, ["sequence", "n_units"]).select("name", "rid", "th", "n_units", (F.col("rid") > F.col("lowest")).alias("copy")), "texts")
    asked = anchors.with_candidates(rows, texts.filter(~F.col("copy")), candidates).withColumn("text", text)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of equal pieces, a task hands on that of the smallest document, and settles the others.
        best: dict[tuple, tuple] = {}
        for batch in batches:
            for part in small_batches(iter([batch]), "text", anchors.BATCH_BYTES):
                data, offsets = buffers(part.column("text"))
                words, _, _, first = word_hashes(data, offsets)
                runs = anchors.runs_of(gram_hashes(words, GRAM), first, GRAM, window)
                rids, ths = part.column("rid").to_pylist(), part.column("th").to_pylist()
                lists = part.column("anchors")
                cuts = np.searchsorted(runs.text, np.arange(part.num_rows + 1))
                wanted = np.concatenate([np.isin(runs.key[cuts[i] : cuts[i + 1]], lists[i].values.to_numpy()) for i in range(part.num_rows)] or [np.zeros(0, bool)])
                is_hot = np.isin(runs.key, hot)
                out = []
                for i in np.flatnonzero(wanted).tolist():
                    t = int(runs.text[i])
                    a, z = int(runs.first[i]), int(runs.last[i])
                    for s, e in [(s, s) for s in range(a, z + 1)] if is_hot[i] else [(a, z)]:
                        raw = _narrow(words[s : e + window])
                        shard = int(gram_hashes(words[s : s + window], window)[0] >> np.uint64(2)) if is_hot[i] else int(runs.key[i])
                        row = (shard, rids[t], ths[t], s - int(first[t]), raw, None, None)
                        old = best.get((shard, raw))
                        if old is None:
                            best[shard, raw] = row
                        elif old[1] < row[1]:
                            out.append((None, *row[1:4], None, row[3], row[3] + e - s))
                        else:
                            if old[1] > row[1]:
                                out.append((None, *old[1:4], None, old[3], old[3] + e - s))
                                best[shard, raw] = row
                            elif old[2:4] != row[2:4]:
                                best[shard, raw, row[2], row[3]] = row
                yield _pieces(joined(out))
                if len(best) >= HELD:
                    yield _pieces(list(best.values()))
                    best = {}
        yield _pieces(list(best.values()))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, waiting, n_waiting = None, [], [], 0

        def close() -> list[tuple]:
            """Settle what equals a piece of a smaller document; return the rows left to search."""
            nonlocal group
            low: dict[bytes, int] = {}
            for _, rid, _, _, raw in group:
                low[raw] = min(rid, low.get(raw, rid))
            left = {}
            for _, rid, th, start, raw in group:
                if rid > low[raw]:
                    done.append((rid, th, start, start + len(raw) // WORD_BYTES - window))
                elif len(low) > 1:
                    left.setdefault(raw, []).append((rid, th, start))
            group = []
            return list(left.items())

        def solve() -> Iterator[pa.RecordBatch]:
            nonlocal waiting, n_waiting, done
            if waiting:
                pieces = [_widen(raw) for raw, _ in waiting]
                docs = np.array([owners[0][0] for _, owners in waiting], np.int64)
                lengths = np.array([len(p) for p in pieces])
                lane, first, last = FMIndex(pieces, docs).matches(np.arange(len(pieces)), docs, lengths, window)
                for i, a, z in zip(lane.tolist(), first.tolist(), last.tolist(), strict=True):
                    done.extend((rid, th, start + a, start + z) for rid, th, start in waiting[i][1])
            waiting, n_waiting = [], 0
            columns = list(zip(*done, strict=True)) or [[]] * 4
            done = []
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["rid", "th", "first", "last"])

        done: list[tuple] = []
        for batch in batches:
            settled = batch.filter(batch.column("shard").is_null())
            if settled.num_rows:
                yield settled.select(["rid", "th", "first", "last"])
            for row in zip(*(batch.filter(batch.column("shard").is_valid()).column(c).to_pylist() for c in _PIECE_NAMES[:5]), strict=True):
                if row[0] != key:
                    waiting += (more := close())
                    n_waiting += len(more)
                    key = row[0]
                    if n_waiting >= INDEX_RUNS:
                        yield from solve()
                group.append(row)
        waiting += close()
        yield from solve()

    dealt = asked.mapInArrow(tidy(emit), PIECE).repartition(F.coalesce("shard", F.xxhash64("rid"))).sortWithinPartitions("shard")
    return texts, dealt.mapInArrow(tidy(search), "rid long, th long, first long, last long")


def dedup_passages(docs: DataFrame, window: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space), row by row of docs,
    and the columns of `carry` with "_" before their names.

    Removes each word covered by a window of words that also starts in a
    document with a smaller doc_id. Null or empty text: no words. A null doc_id
    ranks last; rows with one doc_id aren't smaller than each other, so repeats
    of a row are all kept. Texts shorter than the window are kept. Words are
    compared by 40-bit hashes within groups that share an anchor; texts with
    the same words (by a 128-bit digest) as one with a smaller id go whole. Other columns are not
    read. Empty docs: no rows.
    """
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # The search and the result read the same columns dealt by the same key, so that whole texts are shuffled once for both.
    keyed = docs.select(anchors.ranked_id(F.col("doc_id")).alias("rid"), F.xxhash64(body).alias("th"), F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(c).alias(f"_{c}") for c in carry if c != "text"])
    texts, spans = repeated_windows(keyed, window)
    marks = spans.groupBy("rid", "th").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    verdict = texts.filter("copy").select("rid", "th", "copy").join(marks, ["rid", "th"], "full")
    joined = keyed.join(verdict, ["rid", "th"], "left").select("doc_id", body.alias("text"), F.coalesce("copy", F.lit(False)).alias("copy"), "spans", *[F.col("text" if c == "text" else f"_{c}").alias(f"_{c}") for c in carry])
    carried = [f"_{c}" for c in carry]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(iter([batch]), "text", anchors.BATCH_BYTES):
                counts, removed, kept = [], [], []
                for text, copy, found in zip(part.column("text").to_pylist(), part.column("copy").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    words = text.encode().split()
                    n, gone = len(words), 0
                    if copy and n >= window:
                        words, gone = [], n
                    elif found:
                        mark = np.zeros(n + 1, np.int64)
                        for s in found:
                            mark[s["first"]] += 1
                            mark[s["last"] + window] -= 1
                        covered = np.cumsum(mark[:n]) > 0
                        gone = int(covered.sum())
                        words = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
                    counts.append(n)
                    removed.append(gone)
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), *[part.column(c) for c in carried]], ["doc_id", "n_words", "n_removed", "kept_text", *carried])

    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name in carried)
    return joined.mapInArrow(tidy(keep), "doc_id long, n_words long, n_removed long, kept_text string" + kinds)
