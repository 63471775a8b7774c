"""N-gram Jaccard join with signature trees.

Documents with one shingle set are one node. Pairs that can link are confined
to blocks, exactly: a set is split by hash range into more parts than a linked
pair can have differing shingles, so linked sets share a whole part (see
`Scheme`). Nodes that share a part are joined to a block; within a block, a
signature tree (OR-combined bitmaps and size ranges) is traversed against
itself, pruning node pairs by the largest overlap they allow, and what is
left is verified on the sets. Blocks too large for one task are taken in chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, cut, mix64, ranked_id, small_batches, tidy
from .components import UnionFind, components, forest
from .grams import FOLDED, buffers, gram_hashes, word_hashes

#: Signatures that a task gathers before it hands them on.
FLUSH = 1_000_000
#: Weight of the members that one task joins at once, in longs: a set weighs its shingles and its bitmap.
CHUNK = 16_000_000
#: Words of the bitmap of a set: 64 * 64 bits; of the folded one that is looked at first.
BITMAP, FOLDED_BITMAP = 64, 16
LEAF, FANOUT = 64, 4
#: Pairs of tree nodes that are looked at together.
SLICE = 20_000
#: A signature's last bits hold its class of sizes.
CLASS_BITS = np.uint64(127)
BATCH_BYTES = 2 << 20
#: Hashes of names of rows that are broadcast, at most: 2^21 longs.
BUCKETS = 1 << 21
#: Common shingles are learnt from about so many texts, of which so many shingles each at most; they are in so many of those texts or more,
#: and there are at most so many.
SAMPLED, SAMPLED_SHINGLES, COMMON_TEXTS, MAX_COMMON = 8_000, 2_048, 4, 1 << 17
_A, _B = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


#: Largest chance that a set has fewer parts with a shingle than it needs.
RARE = 1e-7


def enough_parts(size: int, need: int) -> int:
    """The fewest parts of which `size` shingles fill `need` but with a chance of RARE; 4 * size at most."""
    if need == 1:
        return 1
    for m in range(need + 1, 4 * size + 1):
        if size > 400:
            # Empty parts are about normal around m e^(-size / m), and fewer spread than independent ones.
            empty = m * np.exp(-size / m)
            if m - need >= empty + 5.2 * np.sqrt(empty) + 4:
                return m
            continue
        # Chance of j filled parts after each shingle.
        filled = np.zeros(need + 1)
        filled[0] = 1.0
        j = np.arange(need + 1)
        for _ in range(size):
            step = filled * (1 - j / m)
            filled = filled * j / m
            filled[1:] += step[:-1]
            filled[need] += step[need]
        if filled[:need].sum() <= RARE:
            return m
    return max(need, 4 * size)


class Scheme:
    """Size classes and parts for a threshold of num / den.

    Linked sets of a <= b shingles have a / b >= t and differ in at most
    (1 - t) / (1 + t) * (a + b) shingles. Class i holds the sizes from low[i]
    to low[i + 1] - 1, wide enough that b is in a's class or the next; both
    emit the parts of a's class. With D + 1 or more parts that hold a shingle,
    some part holds no differing one. A set with fewer such parts has an own
    signature, which all such sets of its class share; there are so many parts
    that a random set of the class has too few with a chance of RARE at most
    (up to four parts a shingle).

    The same holds of the parts with a shingle that isn't common: a set that
    has D + 1 of them leaves out its parts of common shingles alone, so a
    passage that many texts hold puts none of those in one block. A set that
    has fewer emits all its parts. Which shingles are common is free, as long
    as all sets are held against the same.
    """

    def __init__(self, num: int, den: int, common: np.ndarray | None = None):
        self.num, self.den = num, den
        #: Sorted hashes.
        self.common = np.zeros(0, np.uint64) if common is None else common
        self.low, self.parts, self.need = [1], [], []

    def reach(self, size: int) -> int:
        while len(self.parts) <= 1 or self.low[-1] <= size:
            low = self.low[-1]
            self.low.append(low * self.den // self.num + 1)
            a = self.low[-1] - 1
            differ = (self.den - self.num) * (a + a * self.den // self.num) // (self.den + self.num)
            self.need.append(differ + 1)
            self.parts.append(enough_parts(low, differ + 1))
        return int(np.searchsorted(self.low, size, side="right")) - 1

    def signatures(self, shingles: np.ndarray) -> np.ndarray:
        """The signatures of a sorted set."""
        own = self.reach(len(shingles))
        sums = np.zeros(len(shingles) + 1, np.uint64)
        np.cumsum(mix64(shingles ^ _A), out=sums[1:])
        high = shingles >> np.uint64(32)
        at = np.searchsorted(self.common, shingles)
        rare = at == len(self.common)
        rare[~rare] = self.common[at[~rare]] != shingles[~rare]
        out = []
        for i in (own, own - 1) if own else (own,):
            m = self.parts[i]
            part = (high * np.uint64(m)) >> np.uint64(32)
            edge = np.flatnonzero(part[1:] != part[:-1]) + 1
            start, end = np.concatenate([[0], edge]), np.concatenate([edge, [len(part)]])
            label = np.uint64(i * int(_B) % (1 << 64)) + part[start] * _A
            sig = [mix64((sums[end] - sums[start]) ^ mix64(label))]
            telling = np.logical_or.reduceat(rare, start)
            if telling.sum() >= self.need[i]:
                sig = [sig[0][telling]]
            elif len(start) < self.need[i]:
                sig.append(mix64(np.array([i], np.uint64) ^ _B))
            out += [(x & ~CLASS_BITS) | np.uint64(i % 128) for x in sig]
        return np.concatenate(out)


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    data, offsets = buffers(column)
    words, _, _, first = word_hashes(data, offsets, FOLDED)
    grams = gram_hashes(words, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        out.append(np.unique(grams[a : b - k + 1]) if b - a >= k else gram_hashes(words[a:b], b - a) if b > a else words[:0])
    return out


def node_of(shingles: np.ndarray) -> int:
    """A 63-bit name of a set; -1 for the empty set."""
    if not len(shingles):
        return -1
    length = np.array([len(shingles)], np.uint64) * _A
    return int(mix64(np.add.reduce(mix64(shingles ^ _B), keepdims=True) + length)[0] >> np.uint64(1))


def _edges_of(sig: np.ndarray, node: np.ndarray):
    """Of rows with equal signatures, those of other nodes joined to the smallest: the distinct signatures
    with their smallest node, and per class of sizes a forest of the edges (node, smallest, class)."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    first = np.ones(len(sig), bool)
    first[1:] = sig[1:] != sig[:-1]
    low = node[first][np.cumsum(first) - 1]
    other = node != low
    a, b, kind = node[other], low[other], (sig[other] & CLASS_BITS).astype(np.int64)
    edges = [np.zeros((3, 0), np.int64)]
    for c in np.unique(kind).tolist():
        some = kind == c
        x, y = forest(a[some], b[some])
        edges.append(np.stack([x, y, np.full(len(x), c)]))
    return sig[first], node[first], *np.concatenate(edges, axis=1)


ROW = "part int, doc_id long, th long, n_shingles long, node long, other long, class long, payload binary"
_NAMES = ["part", "doc_id", "th", "n_shingles", "node", "other", "class", "payload"]
_TYPES = [pa.int32(), *[pa.int64()] * 6, pa.binary()]


def _rows(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(_NAMES, _TYPES, strict=True)], _NAMES)


def common_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """Sorted hashes of the shingles that are in many texts of a sample of docs (th, text), the commonest MAX_COMMON at most.

    They only decide which signatures are spared, so a sample will do. It is
    drawn by hash, one of each text, and bounded; one task counts it.
    """
    step = max(1, docs.count() // SAMPLED)
    some = docs.filter(F.pmod("th", F.lit(step)) == 0).select("th", F.substring(F.col("text").cast("string"), 1, 8 * SAMPLED_SHINGLES).alias("text")).dropDuplicates(["th"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in small_batches(iter([batch]), "text", BATCH_BYTES):
                yield pa.RecordBatch.from_arrays([pa.array([s[:SAMPLED_SHINGLES].tobytes() for s in shingle_sets(piece.column("text"), k)], pa.binary())], ["payload"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = {raw for batch in batches for raw in batch.column("payload").to_pylist()}
        found, many = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_counts=True)
        often = np.flatnonzero(many >= COMMON_TEXTS)
        often = often[np.argsort(-many[often], kind="stable")[:MAX_COMMON]]
        yield pa.RecordBatch.from_arrays([pa.array(np.sort(found[often]).view(np.int64))], ["shingle"])

    return some.mapInArrow(tidy(spread), "payload binary").repartition(1).mapInArrow(tidy(count), "shingle long").toArrow().column("shingle").to_numpy().view(np.uint64)


def nodes_and_edges(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Rows of two kinds: (doc_id, n_shingles, node) of every document, and the candidate edges (node, other, class).

    Signatures travel as binary columns of a hash range each. A task keeps one
    node for each of its signatures, so a group of any size sends at most one
    row a task.
    """
    n_parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    common = common_shingles(docs, k)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme, sigs, names, held = Scheme(num, den, common), [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            sig, node, a, b, kind = _edges_of(np.concatenate(sigs), np.repeat(np.array([n for n, _ in names], np.int64), [c for _, c in names]))
            if len(a):
                yield _rows(part=(a % n_parts).astype(np.int32), node=a, other=b, **{"class": kind})
            part = ((sig >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int64)
            cuts = np.searchsorted(part, np.arange(n_parts + 1)).tolist()
            full = [p for p in range(n_parts) if cuts[p] < cuts[p + 1]]
            yield _rows(part=full, payload=[sig[cuts[p] : cuts[p + 1]].tobytes() + node[cuts[p] : cuts[p + 1]].tobytes() for p in full])

        for batch in batches:
            for piece in small_batches(iter([batch]), "text", BATCH_BYTES):
                sets = shingle_sets(piece.column("text"), k)
                ids = [node_of(s) for s in sets]
                yield _rows(part=[i % n_parts for i in ids], doc_id=piece.column("doc_id").to_pylist(), th=piece.column("th").to_pylist(), n_shingles=[len(s) for s in sets], node=ids)
                for i, s in zip(ids, sets, strict=True):
                    if i >= 0:
                        own = scheme.signatures(s)
                        sigs.append(own)
                        names.append((i, len(own)))
                        held += len(own)
                if held >= FLUSH:
                    yield from flush()
                    sigs, names, held = [], [], 0
        if held:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, nodes = [], []
        for batch in batches:
            blob = batch.column("payload")
            plain = batch.filter(blob.is_null())
            if plain.num_rows:
                yield plain
            for raw in blob.drop_null():
                both = np.frombuffer(raw.as_buffer(), np.int64)
                sigs.append(both[: len(both) // 2].view(np.uint64))
                nodes.append(both[len(both) // 2 :])
        if sigs:
            _, _, a, b, kind = _edges_of(np.concatenate(sigs), np.concatenate(nodes))
            yield _rows(part=np.zeros(len(a), np.int32), node=a, other=b, **{"class": kind})

    spreads = docs.select("doc_id", "th", F.col("text").cast("string").alias("text")).mapInArrow(tidy(spread), ROW)
    return spreads.repartition(n_parts // 4, "part").mapInArrow(tidy(meet), ROW).drop("part", "payload")


class SignatureTree:
    """Levels of nodes over sets in order of size; a node's bitmap is the OR of its children's."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        self.bits = np.zeros((len(sets), BITMAP), np.uint64)
        for row, s in zip(self.bits, sets, strict=True):
            bit = s & np.uint64(BITMAP * 64 - 1)
            np.bitwise_or.at(row, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        self.excess = self.size - np.bitwise_count(self.bits).sum(axis=1)
        self.folded = np.bitwise_or.reduce(self.bits.reshape(len(sets), BITMAP // FOLDED_BITMAP, FOLDED_BITMAP), axis=1)
        self.folded_excess = self.size - np.bitwise_count(self.folded).sum(axis=1)
        #: Per level: bitmap, smallest and largest size, largest excess; level 0 has LEAF sets a node.
        self.levels = []
        width, bits, low, high, excess = LEAF, self.bits, self.size, self.size, self.excess
        while True:
            at = np.arange(0, len(bits), width)
            bits = np.bitwise_or.reduceat(bits, at, axis=0)
            low, high, excess = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(excess, at)
            self.levels.append((bits, low, high, excess))
            if len(bits) == 1:
                break
            width = FANOUT

    def can_link(self, level: int, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
        """Whether any pair of sets under node pairs (i, j) of a level can reach the threshold."""
        bits, low, high, excess = self.levels[level]
        out = [np.zeros(0, bool)]
        for k in range(0, len(i), SLICE):
            x, y = i[k : k + SLICE], j[k : k + SLICE]
            out.append(reachable(bits[x] & bits[y], low[x], low[y], high[x], high[y], excess[x], excess[y], num, den))
        return np.concatenate(out)

    def pairs(self, a: int, b: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of sets of leaves a and b whose bitmaps allow the threshold: folded bitmaps first."""
        rows, columns = np.arange(a * LEAF, min(len(self.size), a * LEAF + LEAF)), np.arange(b * LEAF, min(len(self.size), b * LEAF + LEAF))
        x, y = rows[:, None], columns[None, :]
        keep = reachable(self.folded[x] & self.folded[y], self.size[x], self.size[y], self.size[x], self.size[y], self.folded_excess[x], self.folded_excess[y], num, den)
        at = np.nonzero(keep & (x < y))
        x, y = rows[at[0]], columns[at[1]]
        keep = reachable(self.bits[x] & self.bits[y], self.size[x], self.size[y], self.size[x], self.size[y], self.excess[x], self.excess[y], num, den)
        return x[keep], y[keep]


def reachable(common, low_i, low_j, high_i, high_j, excess_i, excess_j, num: int, den: int) -> np.ndarray:
    """An overlap has at most as many shingles as common bits, plus those that share a bit in one set."""
    most = np.minimum(np.minimum(high_i, high_j), np.bitwise_count(common).sum(axis=-1).astype(np.int64) + np.minimum(excess_i, excess_j))
    return (most * (num + den) >= num * (low_i + low_j)) & (low_i * num <= high_j * den) & (low_j * num <= high_i * den)


def tree_links(sets: list[np.ndarray], group: list[int], queries: list[bool] | None, num: int, den: int) -> list[tuple[int, int]]:
    """Links between sets of different groups that join them: a spanning forest of all such links.
    With `queries`, only pairs with a query count. Sets must be in order of size."""
    tree, union = SignatureTree(sets), UnionFind(len(sets))
    heads: dict[int, int] = {}
    for i, g in enumerate(group):
        union.union(i, heads.setdefault(g, i))
    asks = np.ones(len(sets), bool) if queries is None else np.array(queries)
    out = []
    i = j = np.zeros(1, np.int64)
    for level in range(len(tree.levels) - 1, -1, -1):
        keep = tree.can_link(level, i, j, num, den)
        i, j = i[keep], j[keep]
        if level:
            n = len(tree.levels[level - 1][0])
            step = np.arange(FANOUT)
            i, j = (np.repeat(i * FANOUT, FANOUT * FANOUT).reshape(-1, FANOUT, FANOUT) + step[:, None]).ravel(), (np.repeat(j * FANOUT, FANOUT * FANOUT).reshape(-1, FANOUT, FANOUT) + step).ravel()
            inside = (i < n) & (j < n) & (i <= j)
            i, j = i[inside], j[inside]
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = tree.pairs(a, b, num, den)
        wanted = asks[x] | asks[y]
        for p, q in zip(x[wanted].tolist(), y[wanted].tolist(), strict=True):
            if union.find(p) != union.find(q):
                both = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
                if den * both >= num * (len(sets[p]) + len(sets[q]) - both):
                    union.union(p, q)
                    out.append((p, q))
    return out


def _block_links(members: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b) found among the members of each task_key: task_key, node, grp, asks, text."""

    def solve(block: list[tuple]) -> Iterator[tuple[int, int]]:
        block.sort(key=lambda m: (len(m[3]), m[0]))
        nodes = [m[0] for m in block]
        asks = [m[2] for m in block]
        for p, q in tree_links([m[3] for m in block], [m[1] for m in block], None if all(asks) else asks, num, den):
            yield nodes[p], nodes[q]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, {}
        for batch in batches:
            for piece in small_batches(iter([batch]), "text", BATCH_BYTES):
                found: list[tuple[int, int]] = []
                sets = shingle_sets(piece.column("text"), k)
                for own, node, group, asks, s in zip(piece.column("task_key").to_pylist(), piece.column("node").to_pylist(), piece.column("grp").to_pylist(), piece.column("asks").to_pylist(), sets, strict=True):
                    if own != key:
                        found += solve(list(block.values())) if len(block) > 1 else []
                        key, block = own, {}
                    if node_of(s) != node:  # another text of the same hash under the same doc_id
                        continue
                    old = block.get(node)
                    block[node] = (node, group, asks or bool(old and old[2]), s)
                yield _pairs(found)
        if len(block) > 1:
            yield _pairs(list(solve(list(block.values()))))

    dealt = members.repartition("task_key").sortWithinPartitions("task_key")
    return dealt.select("task_key", "node", "grp", "asks", "text").mapInArrow(tidy(run), "a long, b long")


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])


def _large_links(members: DataFrame, sizes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links among the members (block, node, own_weight, text) of blocks that weigh more than CHUNK.

    Two rounds over random chunks find most links. What isn't in a block's
    largest component by then is a query set, compared with all members of the
    block in pairs of chunks, so that every link between components is found.
    """
    members = cut(members.join(sizes, "block").withColumn("chunks", F.ceil(2 * F.col("weight") / CHUNK).cast("long")), "large")
    rounds = []
    for salt in range(2):
        chunk = F.xxhash64("block", F.pmod(F.xxhash64("node", F.lit(salt)), F.col("chunks")), F.lit(salt))
        rounds.append(members.select(chunk.alias("task_key"), "node", F.col("node").alias("grp"), F.lit(True).alias("asks"), "text"))
    links = cut(_block_links(rounds[0].unionByName(rounds[1]), k, num, den), "links")
    roots = components(links)
    group = cut(members.select("node", "block", "own_weight").join(roots, "node", "left").select("node", "block", "own_weight", F.coalesce("root", "node").alias("grp")), "groups")
    per_group = group.groupBy("block", "grp").agg(F.sum("own_weight").alias("n"))
    largest = per_group.groupBy("block").agg(F.max_by("grp", F.struct("n", "grp")).alias("largest"), (F.sum("n") - F.max("n")).alias("rest")).filter("rest > 0")
    asked = group.drop("own_weight").join(largest, "block").withColumn("asks", F.col("grp") != F.col("largest"))
    placed = members.join(asked, ["block", "node"]).withColumn("ask_chunks", F.ceil(2 * F.col("rest") / CHUNK).cast("long"))
    row, column = F.pmod(F.xxhash64("node", F.lit(2)), F.col("chunks")), F.pmod(F.xxhash64("node", F.lit(3)), F.col("ask_chunks"))
    spans = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    all_rows = placed.withColumn("i", row).withColumn("j", spans("ask_chunks")).withColumn("asks", F.lit(False))
    asked = placed.filter("asks").withColumn("j", column).withColumn("i", spans("chunks"))
    pairs = all_rows.unionByName(asked).select(F.xxhash64("block", "i", "j").alias("task_key"), "node", "grp", "asks", "text")
    return links.unionByName(_block_links(pairs, k, num, den))


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, node (documents of one set), root (the same for one component), component_id of every row of docs.

    A set holds the distinct k-word shingles of the text, A-Z lower-cased; a
    text of fewer words is one shingle; without words the set is empty and its
    document alone. Documents link when den * intersection >= num * union;
    component_id is the smallest doc_id reachable by links. Null text: empty.
    A null doc_id ranks last; its component_id is null where nothing else is
    reachable. Repeated rows link with each other. Only doc_id and text are
    read. Empty docs: no rows. Sets are held as 64-bit shingle hashes.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("th"), "text")
    found = cut(nodes_and_edges(rows, k, num, den), "jaccard")
    nodes = found.filter(F.col("other").isNull()).select("doc_id", "th", "n_shingles", "node")
    # Sets of one class of sizes, or of two that meet, make blocks of their own.
    edges = found.filter(F.col("other").isNotNull())
    edges = cut(edges.select("node", "other", "class", F.xxhash64("node", "class").alias("a"), F.xxhash64("other", "class").alias("b")), "candidates")
    placed = edges.select("node", F.col("a").alias("id")).unionByName(edges.select(F.col("other").alias("node"), F.col("b").alias("id"))).distinct()
    blocks = placed.join(components(edges.select("a", "b")).withColumnRenamed("node", "id"), "id").groupBy("node").agg(F.collect_set("root").alias("blocks"))
    # One text a node stands for its set, named by id and hash: many rows may share a null or repeated id.
    firsts = nodes.groupBy("node").agg(F.min(F.struct(ranked_id(F.col("doc_id")).alias("first_id"), F.col("th").alias("first_th"))).alias("row"), (F.first("n_shingles") + BITMAP).alias("own_weight")).select("node", "row.*", "own_weight")
    chosen = cut(firsts.join(blocks, "node"), "chosen")
    # Texts of other documents are mostly left out before the shuffle, by at most BUCKETS hashes of the chosen names.
    bucket = F.pmod(F.xxhash64("first_id", "first_th"), F.lit(BUCKETS))
    hashes = chosen.select(bucket.alias("bucket")).distinct()
    texts = rows.withColumns({"first_id": ranked_id(F.col("doc_id")), "first_th": F.col("th")}).select("first_id", "first_th", "text", bucket.alias("bucket"))
    texts = cut(texts.join(F.broadcast(hashes), "bucket", "left_semi").select("first_id", "first_th", "text").join(chosen.hint("merge"), ["first_id", "first_th"]), "candidates")
    texts = texts.withColumn("block", F.explode("blocks")).drop("blocks")
    sizes = chosen.select(F.explode("blocks").alias("block"), "own_weight").groupBy("block").agg(F.sum("own_weight").alias("weight"))
    sizes = cut(sizes.filter(F.col("weight") > CHUNK), "sizes")
    large = not sizes.isEmpty()
    small = texts.join(sizes, "block", "left_anti") if large else texts
    links = _block_links(small.select(F.col("block").alias("task_key"), "node", F.col("node").alias("grp"), F.lit(True).alias("asks"), "text"), k, num, den)
    if large:
        links = links.unionByName(_large_links(texts.select("block", "node", "own_weight", "text"), sizes, k, num, den))
    roots = cut(components(links), "roots")
    # The empty set links with nothing: such documents are nodes of their own.
    own = F.when(F.col("node") < 0, F.struct(F.lit(-1).cast("long").alias("root"), ranked_id(F.col("doc_id")).alias("alone")))
    placed = nodes.join(roots, "node", "left").select("doc_id", "th", "n_shingles", "node", F.coalesce(own, F.struct(F.coalesce("root", "node").alias("root"), F.lit(0).cast("long").alias("alone"))).alias("comp"))
    lowest = placed.groupBy("comp").agg(F.min(ranked_id(F.col("doc_id"))).alias("low"))
    return placed.join(lowest, "comp").select("doc_id", "th", "n_shingles", "node", F.col("comp.root").alias("root"), F.when(F.col("low") != NO_ID, F.col("low")).alias("component_id"))


def keep_one_a_group(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of docs without near duplicates: of each component the row with the smallest doc_id stays; all columns
    of docs, whatever their names. Rows without words stay, but for exact repeats."""
    found = jaccard_components(docs, k, num, den).withColumn("rid", ranked_id(F.col("doc_id")))
    # Components whose ids are all null are told apart by their root.
    group = F.struct(F.coalesce("component_id", F.lit(NO_ID)).alias("id"), F.when(F.col("component_id").isNull(), F.col("root")).alias("root"))
    alone = F.when(F.col("n_shingles") == 0, F.struct("rid", "th"))
    stays = found.groupBy(group.alias("group"), alone.alias("alone")).agg(F.min(F.struct("rid", "th")).alias("low")).select("low.*")
    named = docs.select(F.struct(*docs.columns).alias("row")).withColumns({"rid": ranked_id(F.col("row.doc_id")), "th": F.xxhash64(F.coalesce(F.col("row.text"), F.lit("")))})
    return named.join(stays, ["rid", "th"]).dropDuplicates(["rid", "th"]).select("row.*")
