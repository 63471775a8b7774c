"""Substring dedup by bytes with a hash-compared suffix sort.

Candidate runs of windows (see anchors) are dealt by anchor. The runs of an
anchor are sorted by the suffix that starts at the anchor, and by the reversed
prefix that ends there: a mergesort whose comparisons find the common
extension of two suffixes by binary search on prefix polynomial hashes, so a
comparison takes logarithmic time. The sorted neighbours are then compared
byte by byte, which settles hash collisions. A window with l bytes before the
anchor is repeated where two runs agree in l bytes before and W - l after it:
both are ranges of the sorted orders, read off the neighbours' extensions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors
from .common import cut, mix64, small_batches, tidy
from .grams import buffers, powers, prefix_hashes

WINDOW, GRAM = 400, 48
#: Bytes of different pieces that a task compares before it hands them on.
HELD_BYTES = 32 << 20
#: Runs that are sorted together; a group of runs is never divided.
SORT_RUNS = 2_000


def byte_grams(data: np.ndarray, k: int) -> np.ndarray:
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = prefix_hashes(data)
    return mix64((sums[k:] - sums[:n]) * powers(n)[1])


def scan(column: pa.Array, window: int = WINDOW):
    data, offsets = buffers(column)
    raw = data.tobytes()
    sequence = anchors.digests([raw[a:z] for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
    return np.diff(offsets), sequence, anchors.runs_of(byte_grams(data, GRAM), offsets, GRAM, window)


class SuffixSort:
    """Strings in order within their groups, and the common extension of each with the one before."""

    def __init__(self, strings: list[bytes], group: np.ndarray):
        self.strings, self.group = strings, group
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        self.length = np.array([len(s) for s in strings], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.sums, self.inverse = prefix_hashes(self.data), powers(len(self.data) + 1)[1]
        self.order = self._mergesort()
        x, y = self.order[:-1], self.order[1:]
        self.common = np.append(0, np.where(group[x] == group[y], self.extension(x, y), 0)) if len(strings) else np.zeros(0, np.int64)
        self._verify()

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common prefix of strings x and y, by binary search on prefix hashes."""
        a, b = self.start[x], self.start[y]
        low, high = np.zeros(len(x), np.int64), np.minimum(self.length[x], self.length[y])
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = (self.sums[a + mid] - self.sums[a]) * self.inverse[a] == (self.sums[b + mid] - self.sums[b]) * self.inverse[b]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether string x comes before y; a prefix comes first."""
        n = self.extension(x, y)
        inner = (n < self.length[x]) & (n < self.length[y])
        out = self.length[x] < self.length[y]
        out[inner] = self.data[self.start[x[inner]] + n[inner]] < self.data[self.start[y[inner]] + n[inner]]
        return out

    def _mergesort(self) -> np.ndarray:
        """Bottom-up: in each round every string finds its rank in the sibling run by binary search."""
        n = len(self.strings)
        order = np.arange(n)
        at = np.flatnonzero(np.append(True, self.group[1:] != self.group[:-1])) if n else np.zeros(0, np.int64)
        size = np.diff(np.append(at, n))
        start, end = np.repeat(at, size), np.repeat(at + size, size)
        place = np.arange(n)
        width = 1
        while n and width < size.max():
            run = (place - start) // width
            sibling = np.minimum(start + (run ^ 1) * width, end)
            low, high = sibling.copy(), np.minimum(sibling + width, end)
            right = run % 2 == 1
            while True:
                some = np.flatnonzero(low < high)
                if not len(some):
                    break
                mid = (low[some] + high[some]) // 2
                own, other = order[some], order[mid]
                # Strings of the left run go before equal ones of the right run.
                after = np.where(right[some], ~self.less(own, other), self.less(other, own))
                low[some] = np.where(after, mid + 1, low[some])
                high[some] = np.where(after, high[some], mid)
            merged = np.empty(n, np.int64)
            merged[start + (run // 2) * 2 * width + (place - start) % width + (low - sibling)] = order
            order, width = merged, width * 2
        return order

    def _verify(self) -> None:
        """Compare neighbours byte by byte; where a hash lied, sort that group by its bytes."""
        wrong = set()
        for k in range(1, len(self.order)):
            x, y, n = self.order[k - 1], self.order[k], int(self.common[k])
            if self.group[x] == self.group[y]:
                s, t = self.strings[x], self.strings[y]
                if s[:n] != t[:n] or s > t:
                    wrong.add(int(self.group[x]))
        for g in wrong:
            spots = np.flatnonzero(self.group[self.order] == g)
            own = sorted(self.order[spots].tolist(), key=self.strings.__getitem__)
            self.order[spots] = own
            for k, x, y in zip(spots[1:].tolist(), own, own[1:], strict=False):
                s, t = np.frombuffer(self.strings[x], np.uint8), np.frombuffer(self.strings[y], np.uint8)
                n = min(len(s), len(t))
                differ = np.flatnonzero(s[:n] != t[:n])
                self.common[k] = differ[0] if len(differ) else n

    def classes(self, depth: int) -> np.ndarray:
        """A number for each string, equal where strings of a group agree in `depth` bytes."""
        own = self.group[self.order]
        fresh = (self.common < depth) | np.append(True, own[1:] != own[:-1])
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(fresh)
        return out


def repeated(pieces: list[tuple[bytes, int, int]], group: np.ndarray, window: int) -> np.ndarray:
    """Per piece (bytes, place of the anchor, number of windows) and window start: whether
    another piece of its group holds the window at the same place before its anchor."""
    place = np.array([p for _, p, _ in pieces], np.int64)
    many = np.array([n for _, _, n in pieces], np.int64)
    after = SuffixSort([raw[p:] for raw, p, _ in pieces], group)
    before = SuffixSort([raw[:p][::-1] for raw, p, _ in pieces], group)
    found = np.zeros((len(pieces), int(many.max())), bool)
    for l in range(int((place - many + 1).min()), int(place.max()) + 1):
        own = np.flatnonzero((place - l >= 0) & (place - l < many))
        if len(own) < 2:
            continue
        key = after.classes(window - l)[own] * (len(pieces) + 1) + before.classes(l)[own]
        order = np.argsort(key, kind="stable")
        twin = key[order][1:] == key[order][:-1]
        both = np.append(False, twin) | np.append(twin, False)
        some = own[order[both]]
        found[some, place[some] - l] = True
    return found


PIECE = "shard long, rid long, th long, start long, many long, place long, raw binary, twice boolean"
_NAMES = ["shard", "rid", "th", "start", "many", "place", "raw", "twice"]
_TYPES = [pa.int64()] * 6 + [pa.binary(), pa.bool_()]


def merged(spans: list[list[int]]) -> list[list[int]]:
    """Spans (rid, th, start, many) of window starts, those that touch as one."""
    out: list[list[int]] = []
    for rid, th, start, many in sorted(spans):
        if out and out[-1][:2] == [rid, th] and start <= out[-1][2] + out[-1][3]:
            out[-1][3] = max(out[-1][3], start + many - out[-1][2])
        else:
            out.append([rid, th, start, many])
    return out


def repeated_windows(rows: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """texts, and spans: (rid, th, first, last) ranges of window starts whose window starts elsewhere too."""
    texts, candidates, hot = anchors.find(rows, lambda column: scan(column, window), "suffixes", False)
    texts = texts.groupBy("name", "rid", "th", "n_units", "sequence").agg(F.count("*").alias("times"))
    same = texts.groupBy("sequence", "n_units").agg(F.sum("times").alias("times"), F.min(F.struct("rid", "th")).alias("lowest"))
    texts = texts.drop("times").join(same, ["sequence", "n_units"])
    texts = cut(texts.select("name", "rid", "th", "n_units", (F.col("times") > 1).alias("copy"), (F.struct("rid", "th") == F.col("lowest")).alias("stands")), "texts")
    asked = anchors.with_candidates(rows, texts.filter("stands"), candidates)

    def pieces(out: list) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * 8
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of equal pieces, a task hands on the first, and settles all of them.
        first: dict[tuple, list] = {}
        held = 0
        for batch in batches:
            for part in small_batches(iter([batch]), "text", anchors.BATCH_BYTES):
                data, offsets = buffers(part.column("text"))
                raw_all = data.tobytes()
                runs = anchors.runs_of(byte_grams(data, GRAM), offsets, GRAM, window)
                rids, ths, lists = part.column("rid").to_pylist(), part.column("th").to_pylist(), part.column("anchors")
                cuts = np.searchsorted(runs.text, np.arange(part.num_rows + 1))
                wanted = np.concatenate([np.isin(runs.key[cuts[i] : cuts[i + 1]], lists[i].values.to_numpy()) for i in range(part.num_rows)] or [np.zeros(0, bool)])
                is_hot = np.isin(runs.key, hot)
                settled = []
                for i in np.flatnonzero(wanted).tolist():
                    t, a, z = int(runs.text[i]), int(runs.first[i]), int(runs.last[i])
                    if is_hot[i]:
                        some = [(s, 1, 0, hashlib.blake2b(raw_all[s : s + window], digest_size=16).digest()) for s in range(a, z + 1)]
                    else:
                        some = [(a, z - a + 1, int(runs.at[i]) - a, raw_all[a : z + window])]
                    for s, many, place, raw in some:
                        key = int.from_bytes(raw[:8], "little", signed=True) if is_hot[i] else int(runs.key[i])
                        row = [key, rids[t], ths[t], s - int(offsets[t]), many, place, raw, False]
                        old = first.setdefault((key, raw), row)
                        held += len(raw) if old is row else 0
                        if old is not row:
                            settled.append(row[1:5])
                            if not old[7]:
                                old[7] = True
                                settled.append(old[1:5])
                yield pieces([[None, *x, None, None, None] for x in merged(settled)])
                if held >= HELD_BYTES:
                    yield pieces(list(first.values()))
                    first, held = {}, 0
        yield pieces(list(first.values()))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}
        done: list[tuple] = []
        waiting: list[tuple] = []
        group: list[int] = []
        n_groups = 0

        def close() -> None:
            """Settle equal pieces; where several remain, leave them to the suffix sort."""
            nonlocal held, n_groups
            for owners in held.values():
                if len(owners) > 1 or owners[0][4]:
                    done.extend((rid, th, start, start + many - 1) for rid, th, start, many, twice, _ in owners if not twice)
            if len(held) > 1:
                for raw, owners in held.items():
                    waiting.append((raw, owners[0][5], owners[0][3], None if len(owners) > 1 or owners[0][4] else owners[0][:3]))
                    group.append(n_groups)
                n_groups += 1
            held = {}

        def solve() -> pa.RecordBatch:
            nonlocal waiting, group, done
            if waiting:
                found = repeated([w[:3] for w in waiting], np.array(group), window)
                for (_, _, many, owner), marks in zip(waiting, found, strict=True):
                    if owner is not None and marks.any():
                        edges = np.flatnonzero(np.diff(np.concatenate([[0], marks[:many].astype(np.int8), [0]])))
                        done.extend((owner[0], owner[1], owner[2] + a, owner[2] + z - 1) for a, z in edges.reshape(-1, 2).tolist())
            columns = list(zip(*done, strict=True)) or [[]] * 4
            waiting, group, done = [], [], []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["rid", "th", "first", "last"])

        for batch in batches:
            settled = batch.filter(batch.column("shard").is_null())
            if settled.num_rows:
                start, many = settled.column("start").to_numpy(), settled.column("many").to_numpy()
                yield pa.RecordBatch.from_arrays([settled.column("rid"), settled.column("th"), pa.array(start), pa.array(start + many - 1)], ["rid", "th", "first", "last"])
            for shard, rid, th, start, many, place, raw, twice in zip(*(batch.filter(batch.column("shard").is_valid()).column(c).to_pylist() for c in _NAMES), strict=True):
                if shard != key:
                    close()
                    key = shard
                    if len(waiting) >= SORT_RUNS:
                        yield solve()
                held.setdefault(raw, []).append((rid, th, start, many, twice, place))
        close()
        yield solve()

    dealt = asked.mapInArrow(tidy(emit), PIECE).withColumn("deal", F.coalesce(F.col("shard"), F.xxhash64("rid"))).repartition("deal").sortWithinPartitions("shard").drop("deal")
    return texts, dealt.mapInArrow(tidy(search), "rid long, th long, first long, last long")


def dedup_bytes(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes left, joined), row by row of docs.

    Removes each byte covered by a string of `window` bytes that starts
    anywhere else too, in the same or another row; overlaps count, and strings
    are judged on the input. Null text: empty. Shorter texts are kept. Repeated
    rows are separate documents, so long ones go whole. Null or repeated
    doc_ids need no care, as ids aren't compared. Whole copies, and windows of
    anchors with more than HOT runs, are known by 128-bit digests; everything
    else is compared byte by byte. Other columns are not read.
    Empty docs: no rows. What is left of a text may break UTF-8 sequences.
    """
    rows = anchors.keyed(docs)
    texts, spans = repeated_windows(rows, window)
    marks = spans.groupBy("rid", "th").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    verdict = texts.filter("copy").select("rid", "th", "copy").join(marks, ["rid", "th"], "full")
    keyed = docs.select("doc_id", "text").withColumn("rid", anchors.ranked_id(F.col("doc_id"))).withColumn("body", F.coalesce(F.col("text").cast("string"), F.lit(""))).withColumn("th", F.xxhash64("body"))
    joined = keyed.join(verdict, ["rid", "th"], "left").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("body").alias("text"), F.coalesce("copy", F.lit(False)).alias("copy"), "spans")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(iter([batch]), "text", anchors.BATCH_BYTES):
                sizes, removed, n_spans, kept = [], [], [], []
                for text, copy, found in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("copy").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    n, gone, count, left = len(text), 0, 0, text
                    if copy and n >= window:
                        gone, count, left = n, 1, b""
                    elif found:
                        mark = np.zeros(n + 1, np.int64)
                        np.add.at(mark, [s["first"] for s in found], 1)
                        np.add.at(mark, [s["last"] + window for s in found], -1)
                        covered = np.cumsum(mark[:n]) > 0
                        gone, count = int(covered.sum()), int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum())
                        left = np.frombuffer(text, np.uint8)[~covered].tobytes()
                    sizes.append(n)
                    removed.append(gone)
                    n_spans.append(count)
                    kept.append(left)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(tidy(keep), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
