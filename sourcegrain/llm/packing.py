"""Best-fit packing of tokenized documents by the sum-of-squares rule.

Documents are tokenized where they are read; only ids' lengths and checksums
travel on. A shard places its pieces one by one: the bin is the one for which
the sum over gaps of the squared number of open bins with that gap becomes
smallest. The state of a shard is its open bins, so memory stays bounded.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, text_bytes, tidy

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
END_ID = 0
#: Pieces that one shard packs; a shard's waste doesn't grow with its pieces.
SHARD_ROWS = 100_000
#: Distinct words whose ids a task remembers, and those that a worker keeps after it: the first ones, which are the common ones.
CACHE_WORDS, KEPT_WORDS = 500_000, 150_000
#: Bytes of text whose words are looked up together.
BATCH_BYTES = 2 << 20

_TAIL = b".,!?;:"


class WordTokenizer:
    """Ids of a text as the joined ids of its words.

    The tokenizer drops white space and splits text there, so a text's ids
    are those of its words in turn; each distinct word is encoded once. A
    letters-only word is one pre-token whose last id alone carries the mark of
    a word's end, so that many such words can be encoded in one call.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one thread
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.cache: dict[bytes, bytes] = {}

    def _encode(self, words: list[bytes]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encoded]

    def _encode_ascii(self, words: list[bytes]) -> list[bytes]:
        """Ids of lower-case ASCII words: neither normalizing nor splitting nor the byte alphabet changes them, so the model reads them at once."""
        tokenize = self.tokenizer.model.tokenize
        return [b"".join([t.id.to_bytes(4, "little") for t in tokenize(w.decode())]) for w in words]

    def _encode_letters(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for k in range(0, len(words), 256):
            part = words[k : k + 256]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) != len(part):
                out += self._encode(part)
                continue
            raw, start = ids.tobytes(), 0
            for end in (last * 4).tolist():
                out.append(raw[start:end])
                start = end
        return out

    def learn(self, missing: set[bytes]) -> None:
        """Encode words that aren't known; "Word," as the known or new "word" and its tail."""
        cache, split, cores, other = self.cache, [], set(), []
        for word in missing:
            core = word.rstrip(_TAIL)
            if core.isalpha():
                key = core.lower()
            elif core.isascii() or not (letters := core.decode("utf-8", "replace")).isalpha() or len(letters.lower()) != len(letters):
                other.append(word)  # also where a letter in lower case is several characters, which the tail could join
                continue
            else:
                key = core
            if key not in cache:
                cores.add(key)
            if key != word:
                split.append((word, key, word[len(core) :]))
        plain, new = [w for w in cores if w.isascii()], [w for w in cores if not w.isascii()]
        cache.update(zip(plain, self._encode_ascii(plain), strict=True))
        cache.update(zip(new, self._encode_letters(new), strict=True))
        tails = list({tail for _, _, tail in split if tail})
        tail_ids = dict(zip(tails, self._encode(tails), strict=True)) | {b"": b""}
        cache.update((word, cache[key] + tail_ids[tail]) for word, key, tail in split)
        cache.update(zip(other, self._encode(other), strict=True))

    def trim(self) -> None:
        self.cache = dict(itertools.islice(self.cache.items(), KEPT_WORDS))

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        split = [text.split() for text in texts]
        unknown = lambda: set(itertools.filterfalse(self.cache.__contains__, itertools.chain.from_iterable(split)))
        missing = unknown()
        if len(self.cache) + len(missing) > CACHE_WORDS:
            self.trim()
            missing = unknown()
        if missing:
            self.learn(missing)
        get = self.cache.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), "<u4") for words in split]


_loaded: dict[str, WordTokenizer] = {}


def _tokenizer(name: str) -> WordTokenizer:
    if name not in _loaded:
        import public_tokenizers

        _loaded[name] = WordTokenizer(public_tokenizers.path(name))
    return _loaded[name]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, carry: tuple[str, ...] = ()) -> DataFrame:
    """The pieces of every document: its ids and END_ID, cut every `capacity` ids, with the columns of `carry`."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    kinds = "".join(f", `{c}` {read.schema[c].dataType.simpleString()}" for c in carry)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tokenizer(tokenizer)
        end = np.array([END_ID], "<u4")
        for batch in small_batches(batches, "text", BATCH_BYTES):
            rows, of = [], []
            for at, (doc_id, ids) in enumerate(zip(batch.column("doc_id").to_pylist(), encoder.ids(text_bytes(batch.column("text"))), strict=True)):
                ids = np.concatenate([ids, end])
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((doc_id, k, start, len(part), zlib.crc32(part.tobytes())))
                    of.append(at)
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            own = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*own, *[batch.column(c).take(pa.array(of, pa.int64())) for c in carry]], ["doc_id", "piece", "start", "length", "ids_crc32", *carry])
        encoder.trim()

    return read.mapInArrow(tidy(cut_up), PIECES + kinds)


class SumOfSquares:
    """Open bins by gap; place() gives the bin and offset of a piece."""

    def __init__(self, capacity: int):
        self.capacity, self.count, self.made = capacity, np.zeros(capacity + 1, np.int64), 0
        self.bins: list[deque[int]] = [deque() for _ in range(capacity + 1)]
        self.far = np.int64(1) << np.int64(60)

    def place(self, size: int) -> tuple[int, int]:
        gap = self.capacity
        if size < self.capacity:
            # Change of the sum when a bin of gap g takes the piece, for g = size .. capacity - 1:
            # N[g] loses one bin and N[g - size] gains one (a full bin has no gap and isn't counted).
            held = self.count[size : self.capacity]
            gain = 2 * self.count[: self.capacity - size] + 1
            gain[0] = 0
            change = np.where(held > 0, gain - 2 * held + 1, self.far)
            best = int(change.argmin())
            fresh = 2 * int(self.count[self.capacity - size]) + 1
            if change[best] <= fresh:
                gap = size + best
        if gap == self.capacity:
            bin_id, self.made = self.made, self.made + 1
        else:
            bin_id = self.bins[gap].popleft()
            self.count[gap] -= 1
        left = gap - size
        if left:
            self.bins[left].append(bin_id)
            self.count[left] += 1
        return bin_id, self.capacity - gap


def pack(parts: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, order: tuple[str, ...] = ()) -> DataFrame:
    """parts with sequence_id and offset. Shards take the pieces by hash, or by ranges of the columns of `order`, so that sequence_id
    rises with them from shard to shard; within one the longest come first, ties in the order of the hash, so reruns agree."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = SumOfSquares(capacity)
        shard = TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [state.place(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array([shard + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    shards = max(1, -(-parts.count() // shard_rows))
    named = parts.withColumn("_hash", F.xxhash64("doc_id", "piece", "ids_crc32"))
    dealt = named.repartitionByRange(shards, *order) if order else named.repartition(shards, "_hash")
    return dealt.sortWithinPartitions(F.col("length").desc(), "_hash", "doc_id", "piece", "ids_crc32").select("doc_id", "piece", "start", "length", "ids_crc32").mapInArrow(tidy(fill), PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, shard_rows: int = SHARD_ROWS, order: tuple[str, ...] = ()) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    order: columns by whose ranges documents share sequences (the positions of a curriculum), for the whole of docs.

    Null or empty text: one piece, the end id alone. Long texts are cut into
    whole sequences and a rest. Repeated rows and rows with a null doc_id are
    packed as documents of their own. Other columns are not read. Empty docs:
    no rows.
    """
    return pack(cut(pieces(docs, capacity, tokenizer, order), "pieces"), capacity, shard_rows, order)
