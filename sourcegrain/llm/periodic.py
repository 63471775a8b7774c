"""Periodic runs of words by a suffix automaton with link-cut access.

The suffix links of a text's automaton form a tree. Its paths from the root
are kept as a link-cut tree, a splay tree a path; every node of a path was
last seen at the same end. Appending a word accesses the node of the prefix:
the segments between it and the root are the suffixes by where they occurred
last. If the longest suffix of a segment has m words and ended d words ago,
the m + d words up to here have smallest period d, and no word before them
continues it; m >= d is a square. As that is told of every end of a run from
its second period on, the last end with a start and period is the run's own.

Only stretches of words that can lie in runs are read by automata: in a run
every 8 words come again one period away in the same stretch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, small_batches, tidy
from .grams import buffers, gram_hashes, word_hashes

MIN_WORDS, MIN_TIMES = 24, 3
#: Words that come again one period away within a run: a run of length >= max(24, 3 q) has 2 q + GRAM - 1 words or more.
GRAM = 8


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix links (0: none; the root is 1) and lengths of the states, and the state of every prefix."""
    nexts, link, length, ends, last = [{}, {}], [0, 0], [0, 0], [], 1
    for word in words:
        state = len(link)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(1)
        p = last
        while p and word not in nexts[p]:
            nexts[p][word] = state
            p = link[p]
        if p:
            q = nexts[p][word]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                split = len(link)
                nexts.append(nexts[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p and nexts[p].get(word) == q:
                    nexts[p][word] = split
                    p = link[p]
                link[q] = link[state] = split
        ends.append(state)
        last = state
    return link, length, ends


class Paths:
    """A tree whose root paths are accessed in turn: a splay tree by depth for each path, a colour at its root."""

    def __init__(self, parent: list[int]):
        # up: the parent in the splay tree, or at its root the tree node above the path.
        self.up, self.left, self.right, self.seen = parent[:], [0] * len(parent), [0] * len(parent), [0] * len(parent)

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b:
            up[b] = p
        up[p], up[x] = x, g
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        while p and (left[p] == x or right[p] == x):
            g, top = up[p], p
            if g and (left[g] == p or right[g] == p):
                top = g
                self._rotate(p if (left[g] == p) == (left[p] == x) else x)
            self._rotate(x)
            p = up[x]
            if not (p and (left[p] == x or right[p] == x)):
                self.seen[x] = self.seen[top]

    def access(self, node: int, colour: int) -> list[tuple[int, int]]:
        """(deepest node, colour) of each coloured segment from node to the root, which all get `colour`."""
        up, right, seen, found, below, x = self.up, self.right, self.seen, [], 0, node
        while x:
            self._splay(x)
            old = seen[x]
            if old:
                found.append((x, old))
                if right[x]:
                    seen[right[x]] = old
            right[x] = below
            below, x = x, up[x]
        seen[below] = colour
        return found


def runs_of(words: list[int], min_words: int = MIN_WORDS, times: int = MIN_TIMES) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every maximal run of min_words words or more that holds its period `times` times (2 or more), by start and period."""
    link, length, ends = automaton(words)
    paths, last = Paths(link), {}
    for end, state in enumerate(ends, 1):
        for node, seen in paths.access(state, end):
            d, m = end - seen, length[node]
            if m >= (times - 1) * d and m + d >= min_words:
                last[end - m - d, d] = end
    return sorted((start, end - start, d) for (start, d), end in last.items())


def stretches(words: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the stretches of words in which every 8 words come twice; no stretch crosses texts, which begin at `first`.

    Hashes may meet by chance, which only adds stretches."""
    grams = gram_hashes(words, GRAM)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(text[: len(grams)] == text[GRAM - 1 :]) if len(grams) else np.zeros(0, np.int64)
    group = text[at].astype(np.uint64)
    while True:
        key = mix64(grams[at] + group * np.uint64(0x9E3779B97F4A7C15))
        ordered = np.sort(key)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if not len(twice):
            return []
        kept = twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key
        at = at[kept]
        # Grams that touch, or overlap, in one text cover one stretch.
        fresh = np.ones(len(at), bool)
        fresh[1:] = (np.diff(at) > GRAM) | (np.diff(text[at]) > 0)
        group = np.cumsum(fresh).astype(np.uint64)
        if kept.all():
            break
    starts = at[fresh]
    ends = np.append(at[np.flatnonzero(fresh)[1:] - 1], at[-1]) + GRAM
    long = ends - starts >= MIN_WORDS
    return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words), bool)
    for start, length, period in runs:
        gone[start + period : start + length] = True
    return [words[i] for i in np.flatnonzero(~gone).tolist()]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RESULT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, strongest struct<start:long,length:long,period:long>, kept_text string"


def periodic_runs(docs: DataFrame, tail: Callable[[int | None, int], tuple[int, int] | None] | None = None) -> DataFrame:
    """doc_id, n_words, runs (by start and period), strongest (greatest length / period; ties: smallest start, then period), kept_text of every row of docs.

    Words are those between ASCII white space. A run is a stretch of at least
    MIN_WORDS words and MIN_TIMES times its smallest period that no
    neighbour extends; kept_text joins by one space the words that no run
    holds after its first period. tail(doc_id, n_words) may name (a, p): the
    words from a on then repeat the p words from a, as a planted run.

    A null or empty text has no words, no runs and an empty kept_text; a null
    doc_id stays null. Repeated rows are told alike. Very long texts take n log n time and
    memory in proportion to their longest stretch. Other columns are
    not read. Empty docs: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            ids = batch.column("doc_id").to_pylist()
            data, offsets = buffers(batch.column("text"))
            hashes, _, _, first = word_hashes(data, offsets)
            raw, first_, offsets = data.tobytes(), first.tolist(), offsets.tolist()
            tails = [tail(doc_id, first_[k + 1] - first_[k]) if tail else None for k, doc_id in enumerate(ids)]
            for start, end, planted in zip(first_, first_[1:], tails, strict=False):
                if planted:
                    a, p = planted
                    hashes[start + a : end] = hashes[start + a + np.arange(end - start - a) % p]
            found: dict[int, list[tuple[int, int]]] = {}
            for start, end in stretches(hashes, first):
                found.setdefault(int(np.searchsorted(first, start, "right")) - 1, []).append((start, end))
            out = []
            for k, (doc_id, planted) in enumerate(zip(ids, tails, strict=True)):
                words, runs = raw[offsets[k] : offsets[k + 1]].split(), []
                if planted:
                    a, p = planted
                    words[a:] = (words[a : a + p] * (-(-(len(words) - a) // p)))[: len(words) - a]
                for start, end in found.get(k, ()):
                    low, high = max(0, start - first_[k] - 1), min(len(words), end - first_[k] + 1)
                    symbols: dict[bytes, int] = {}
                    part = [symbols.setdefault(w, len(symbols)) for w in words[low:high]]
                    runs += [(low + s, n, q) for s, n, q in runs_of(part)]
                runs.sort(key=lambda r: (r[0], r[2]))
                strongest = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None
                out.append((doc_id, len(words), runs, strongest, b" ".join(collapsed(words, runs)).decode("utf-8", "replace")))
            named = lambda r: r and dict(zip(("start", "length", "period"), r, strict=True))
            doc_ids, n_words, runs, strongest, kept = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array([[named(r) for r in x] for x in runs], pa.list_(RUN)), pa.array([named(r) for r in strongest], RUN), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "runs", "strongest", "kept_text"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), RESULT)
