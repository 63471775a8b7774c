"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Labelled examples (a bounded sample) become TF-IDF vectors over the terms that
tell the labels apart: words and word beginnings chosen by chi-square. They
are kept in an inverted index whose postings carry the largest weight of each
block of examples; a query scores the blocks with the highest bounds and then
only those that can reach its k-th similarity. Votes weigh by similarity, and
the smoothed share of the toxic ones is the score. The number of neighbours,
the weight of word beginnings and the share that becomes a score of 0.5 are
chosen by cross-validation among the folds that aren't held out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Labelled rows that are learnt from, at most: the first by hash of doc_id.
MAX_LABELLED = 20_000
#: The fewest labelled documents that must hold a kept term.
MIN_DOCS = 5
#: Least chi-square of a kept term (one degree of freedom).
MIN_CHI2 = 30.0
#: Examples of a block, and blocks that are scored before any is left out.
BLOCK, FIRST_BLOCKS = 64, 16
#: Tried by cross-validation, ties to the first: neighbours, and weights of word beginnings beside whole words.
NEIGHBOURS, PREFIX_WEIGHTS = (15, 8, 25, 40, 60), (1.0, 0.5, 0.25)
#: Weight of the prior share of toxic examples in a vote.
PRIOR_WEIGHT = 0.5
PREFIXES = (4, 5, 6, 7)

#: ASCII punctuation and capitals, as bytes, to blanks and small letters.
_FOLD = bytes(32 if chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else c + 32 if 65 <= c <= 90 else c for c in range(128)) + bytes(range(128, 256))


def term_counts(text: str, vocabulary: frozenset | dict | None = None) -> dict[str, int]:
    """Counts of a text's words ("w") and word beginnings ("w*"); only those of the vocabulary, if given."""
    words = Counter(text.lower().encode("utf-8", "replace").translate(_FOLD).split())
    out: dict[str, int] = {}
    for raw, n in words.items():
        word = raw.decode("utf-8", "replace")
        if vocabulary is None or word in vocabulary:
            out[word] = out.get(word, 0) + n
        for k in PREFIXES:
            if len(word) <= k:
                break
            start = word[:k] + "*"
            if vocabulary is None or start in vocabulary:
                out[start] = out.get(start, 0) + n
    return out


class BlockMaxIndex:
    """Unit vectors of examples by term: postings in the order of examples, and their largest weight in each block of examples."""

    def __init__(self, examples: list[dict[str, int]], idf: dict[str, float]):
        self.idf, self.n = idf, len(examples)
        self.n_blocks = -(-self.n // BLOCK)
        postings: dict[str, tuple[list[int], list[float]]] = {}
        for i, counts in enumerate(examples):
            for term, weight in self.vector(counts).items():
                at, weights = postings.setdefault(term, ([], []))
                at.append(i)
                weights.append(weight)
        self.postings = {term: (np.array(at, np.int32), np.array(weights)) for term, (at, weights) in postings.items()}
        self.place = {term: i for i, term in enumerate(self.postings)}
        self.most = np.zeros((len(self.place), self.n_blocks))
        for i, (at, weights) in enumerate(self.postings.values()):
            np.maximum.at(self.most[i], at // BLOCK, weights)

    def vector(self, counts: dict[str, int]) -> dict[str, float]:
        raw = {t: (1 + math.log(n)) * self.idf[t] for t, n in sorted(counts.items()) if t in self.idf}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {t: x / norm for t, x in raw.items()} if norm else {}

    def nearest(self, vector: dict[str, float], k: int) -> list[tuple[float, int]]:
        """The k largest cosines above 0 as (cosine, example); ties to the smaller number.

        The blocks with the highest bounds are scored first; of the others, only
        those whose bound reaches the k-th cosine found there."""
        known = [(t, q) for t, q in vector.items() if t in self.place]
        if not known:
            return []
        bound = np.array([q for _, q in known]) @ self.most[[self.place[t] for t, _ in known]]
        at = np.concatenate([self.postings[t][0] for t, _ in known])
        part = np.concatenate([q * self.postings[t][1] for t, q in known])
        wanted = np.zeros(self.n_blocks, bool)
        wanted[np.argsort(-bound, kind="stable")[:FIRST_BLOCKS]] = True
        some = wanted[at // BLOCK]
        scores = np.bincount(at[some], part[some], self.n)
        held = np.flatnonzero(scores > 0)
        least = np.partition(scores[held], len(held) - k)[len(held) - k] if len(held) >= k else 0.0
        rest = ~wanted & (bound > 0) & (bound >= least - 1e-12)
        if rest.any():
            some = rest[at // BLOCK]
            scores += np.bincount(at[some], part[some], self.n)
            held = np.flatnonzero(scores > 0)
        if len(held) > k:
            held = held[scores[held] >= np.partition(scores[held], len(held) - k)[len(held) - k]]
        order = np.lexsort((held, -scores[held]))[:k]
        return [(float(scores[i]), i) for i in held[order].tolist()]


def weights_of(df: dict[str, int], n: int, prefix_weight: float) -> dict[str, float]:
    """Inverse document frequencies of terms; those of word beginnings are lowered."""
    return {t: math.log((1 + n) / (1 + m)) * (prefix_weight if t.endswith("*") else 1.0) for t, m in df.items()}


def all_nearest(index: BlockMaxIndex, vectors: list[dict[str, float]], k: int) -> Iterator[list[tuple[float, int]]]:
    """index.nearest of many vectors in single precision, by products of matrices: some vectors with all examples."""
    place = index.place
    examples = np.zeros((len(place), index.n), np.float32)
    for t, (at, weights) in index.postings.items():
        examples[place[t], at] = weights
    for start in range(0, len(vectors), BLOCK):
        some = np.zeros((len(vectors[start : start + BLOCK]), len(place)), np.float32)
        for i, vector in enumerate(vectors[start : start + BLOCK]):
            for t, q in vector.items():
                if t in place:
                    some[i, place[t]] = q
        # Of equal vectors, products differ in the last places only.
        for scores in np.round(some @ examples, 5):
            found = np.flatnonzero(scores > 0)
            if len(found) > k:
                found = found[scores[found] >= np.partition(scores[found], len(found) - k)[len(found) - k]]
            order = np.lexsort((found, -scores[found]))[:k]
            yield [(float(scores[i]), i) for i in found[order].tolist()]


def best_cut(scores: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """(F1, cut) of the cut with the largest F1, halfway to the next lower score; ties to the higher cut."""
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], toxic[order]
    f1 = 2 * np.cumsum(y) / (np.arange(1, len(s) + 1) + max(1, y.sum()))
    f1[:-1][s[1:] == s[:-1]] = -1.0
    at = int(np.argmax(f1))
    return float(f1[at]), float((s[at] + (s[at + 1] if at + 1 < len(s) else 0.0)) / 2)


def calibrated(share: float, cut: float) -> float:
    """A share as a score that is 0.5 at the cut: the odds divided by those of the cut."""
    return share * (1 - cut) / (share * (1 - cut) + cut * (1 - share)) if 0 < share < 1 else share


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def sample_labelled(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """doc_id, text, toxic of at most `limit` labelled documents outside fold 0; one row an id, the least text of a repeated one."""
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))


#: The folds that are learnt from.
FOLDS = (1, 2, 3, 4)


def cross_validate(spark, rows: list[tuple[int, int, dict[str, int]]], terms: dict[int, dict[str, int]], sizes: dict[int, tuple[int, int]]) -> tuple[int, float, float]:
    """(neighbours, prefix weight, cut) of the largest F1 over rows (fold, toxic, counts), each fold scored by the other ones.

    terms and sizes: by the fold left out, the document frequencies of the terms
    that the others choose, and their numbers of rows and of toxic ones.
    """
    tries = [(g, w) for w in PREFIX_WEIGHTS for g in FOLDS if sizes[g][0] and any(f == g for f, _, _ in rows)]
    if not tries:
        return NEIGHBOURS[0], PREFIX_WEIGHTS[0], 0.5
    shared = spark.sparkContext.broadcast((rows, terms, sizes))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, terms, sizes = shared.value
        for batch in batches:
            for i in batch.column("id").to_pylist():
                left_out, weight = tries[i]
                n, n_toxic = sizes[left_out]
                marks = [(0, y) for f, y, _ in rows if f != left_out]
                index = BlockMaxIndex([h for f, _, h in rows if f != left_out], weights_of(terms[left_out], n, weight))
                blank = [y for (_, y), held in zip(marks, (bool(index.vector(h)) for f, _, h in rows if f != left_out), strict=True) if not held]
                floor = (sum(blank) + n_toxic / n) / (len(blank) + 1)
                asked = [tuple(sorted((t, m) for t, m in h.items() if t in index.idf)) for f, _, h in rows if f == left_out]
                toxic = [y for f, y, _ in rows if f == left_out]
                keys = sorted(set(asked))
                found = all_nearest(index, [index.vector(dict(key)) for key in keys], max(NEIGHBOURS))
                known = {key: [vote(near[:k], marks, n_toxic / n) if near else floor for k in NEIGHBOURS] for key, near in zip(keys, found, strict=True)}
                out = [known[key] for key in asked]
                for j, k in enumerate(NEIGHBOURS):
                    yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([k], pa.int64()), pa.array([[s[j] for s in out]], pa.list_(pa.float64())), pa.array([toxic], pa.list_(pa.int64()))], ["weight", "k", "scores", "toxic"])

    # A score a labelled row and try, so 15 times `limit` numbers at most.
    found = spark.range(0, len(tries), 1, len(tries)).mapInArrow(score, "weight double, k long, scores array<double>, toxic array<long>").collect()
    best = (-1.0, NEIGHBOURS[0], PREFIX_WEIGHTS[0], 0.5)
    for weight in PREFIX_WEIGHTS:
        for k in NEIGHBOURS:
            own = [r for r in found if r.weight == weight and r.k == k]
            toxic = np.array([y for r in own for y in r.toxic])
            f1, cut = best_cut(np.array([s for r in own for s in r.scores]), toxic) if toxic.any() else (0.0, 0.5)
            if f1 > best[0]:
                best = (f1, k, weight, cut)
    return best[1:]


def learn(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> tuple[BlockMaxIndex, list[tuple[int, int]], float, int, float] | None:
    """The index of the examples, their (doc_id, toxic), the toxic share, neighbours and cut; None without labelled rows."""
    sample = sample_labelled(docs, labels, limit).withColumn("fold", fold(F.col("doc_id")).cast("int"))
    per_class = {(r.fold, r.toxic): r.n for r in sample.groupBy("fold", (F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    if not per_class:
        return None
    # By the fold left out (0: none), the rows and toxic rows of the others.
    sizes = {g: (sum(m for (f, _), m in per_class.items() if f != g), sum(m for (f, y), m in per_class.items() if f != g and y)) for g in (0, *FOLDS)}
    n, n_toxic = sizes[0]

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            total, toxic = Counter(), Counter()
            for text, y, f in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "fold")), strict=True):
                held = [(t, f) for t in term_counts(text)]
                total.update(held)
                if y > 0:
                    toxic.update(held)
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in total], pa.string()), pa.array([f for _, f in total], pa.int32()), pa.array(list(total.values()), pa.int64()), pa.array([toxic[t] for t in total], pa.int64())], ["term", "fold", "df", "pos"])

    found = sample.select("text", "toxic", "fold").mapInArrow(terms, "term string, fold int, df long, pos long")
    others = lambda column, g: F.sum(F.when(F.col("fold") != g, F.col(column)).otherwise(0))
    counts = found.groupBy("term").agg(*[others(c, g).alias(f"{c}{g}") for g in sizes for c in ("df", "pos")])

    def chosen(g: int) -> Column:
        n, n_toxic = sizes[g]
        df, a, b = F.col(f"df{g}"), F.col(f"pos{g}").cast("double"), (F.col(f"df{g}") - F.col(f"pos{g}")).cast("double")
        c, d = F.lit(float(n_toxic)) - a, F.lit(float(n - n_toxic)) - b
        below = (a + b) * (c + d) * (a + c) * (b + d)
        chi2 = F.when(below > 0, F.lit(float(n)) * F.pow(a * d - b * c, 2) / below)
        return (df >= MIN_DOCS) & F.coalesce(chi2 >= MIN_CHI2, F.lit(False)) & (a * F.lit(float(n)) > df * F.lit(float(n_toxic)))

    kept = counts.select("term", F.array(*[F.when(chosen(g), F.col(f"df{g}")) for g in sizes]).alias("df")).filter(F.exists("df", lambda x: x.isNotNull())).collect()
    df = {g: {r.term: r.df[g] for r in sorted(kept) if r.df[g] is not None} for g in sizes}
    every = frozenset(r.term for r in kept)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            held = [term_counts(text, every) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), batch.column("fold"), pa.array([list(h.items()) for h in held], pa.map_(pa.string(), pa.int64()))], ["doc_id", "toxic", "fold", "terms"])

    # At most `limit` rows of a few terms each come to the driver.
    rows = sample.select("doc_id", F.col("toxic").cast("long").alias("toxic"), "fold", "text").mapInArrow(vectors, "doc_id long, toxic long, fold int, terms map<string,long>").collect()
    rows.sort(key=lambda r: r.doc_id)
    k, prefix_weight, cut = cross_validate(docs.sparkSession, [(r.fold, int(r.toxic > 0), dict(r.terms)) for r in rows], df, sizes)
    index = BlockMaxIndex([dict(r.terms) for r in rows], weights_of(df[0], n, prefix_weight))
    return index, [(r.doc_id, int(r.toxic > 0)) for r in rows], n_toxic / n, k, cut


def vote(near: list[tuple[float, int]], marks: list[tuple[int, int]], prior: float) -> float:
    weight = sum(s for s, _ in near)
    return (sum(s * marks[i][1] for s, i in near) + PRIOR_WEIGHT * prior) / (weight + PRIOR_WEIGHT)


def score_toxicity(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (doc_id, similarity, toxic of the neighbours).

    One row per row of docs. A text that shares no term with an example, or a
    null or empty one, has the toxic share of such examples as its score (of
    all examples if there are none). Scores are calibrated to 0.5 at the cut. Without labelled rows every score is 0. Null doc_id: not held
    out. Labels repeated for a document: toxic if any says so. Equal
    similarities: the smaller doc_id first. Other columns are not read.
    """
    model = learn(docs, labels, limit)
    index, marks, prior, k, cut = model or (BlockMaxIndex([], {}), [], 0.0, NEIGHBOURS[0], 0.5)
    holding = {i for at, _ in index.postings.values() for i in at.tolist()}
    blank = [y for i, (_, y) in enumerate(marks) if i not in holding]
    floor = (sum(blank) + prior) / (len(blank) + 1) if marks else 0.0
    shared = docs.sparkSession.sparkContext.broadcast((index, marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, marks = shared.value
        known: dict[tuple, tuple[float, list[dict]]] = {}
        for batch in small_batches(batches, "text"):
            scores, evidence = [], []
            for text in batch.column("text").to_pylist():
                counts = term_counts(text or "", index.idf)
                key = tuple(sorted(counts.items()))
                if key not in known:
                    near = index.nearest(index.vector(counts), k)
                    if len(known) > 100_000:
                        known.clear()
                    known[key] = (calibrated(vote(near, marks, prior) if near else floor, cut), [{"doc_id": marks[i][0], "similarity": s, "toxic": marks[i][1]} for s, i in near])
                score, found = known[key]
                scores.append(min(1.0, max(0.0, score)))
                evidence.append(found)
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(evidence, kind)], ["doc_id", "held_out", "score", "predicted", "evidence"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, evidence array<struct<doc_id:long,similarity:double,toxic:int>>")
