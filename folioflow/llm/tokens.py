"""Encoding of texts with a public byte-level BPE vocabulary (problem 6).

Every distinct pre-token of an Arrow batch becomes one row of a padded matrix of
symbol ids; rows are bucketed by length. In each round every row merges the
leftmost of its pairs of minimum rank (and, as a merge cannot create a pair of
that rank or a lower one, the pair's other places from left to right). Pairs are
looked up in an open-addressing hash table held in numpy arrays; after each round
the matrix is compacted: the gaps close and finished rows leave it.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .tables import read, spread, tokenizer_path

#: Fixed value: the published split pattern of the vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: No pair: larger than every rank.
NONE = np.int32(2**31 - 1)
#: Pieces whose ids a worker remembers; only speed depends on it.
REMEMBERED = 400_000
#: A piece of more characters is split at once instead of being remembered.
LONG = 40


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Merge rules as a hash table over pairs of symbol ids."""

    def __init__(self, start: np.ndarray, left: np.ndarray, right: np.ndarray, made: np.ndarray):
        self.start = start
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 4))))
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.rank = np.full(size, NONE, np.int32)
        self.made = np.zeros(size + 1, np.int32)
        todo = np.arange(len(left))
        keys = (left.astype(np.int64) << 20) | right
        slot = self._slot(keys)
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.keys[slot] == -1
            first = np.unique(slot[free], return_index=True)[1]
            put = np.flatnonzero(free)[first]
            self.keys[slot[put]] = keys[todo[put]]
            self.rank[slot[put]] = todo[put]
            self.made[slot[put]] = made[todo[put]]
            rest = np.ones(len(todo), bool)
            rest[put] = False
            todo, slot = todo[rest], (slot[rest] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where there is no rule; negative ids are padding."""
        shape = left.shape
        left, right = left.ravel(), right.ravel()
        out = np.full(len(left), NONE, np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        keys = (left[at].astype(np.int64) << 20) | right[at]
        slot = self._slot(keys)
        for _ in range(self.probes):
            seen = self.keys[slot]
            hit = seen == keys
            out[at[hit]] = self.rank[slot[hit]]
            on = ~hit & (seen != -1)
            if not on.any():
                break
            at, keys, slot = at[on], keys[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out.reshape(shape)

    def products(self, count: int) -> None:
        """Index the made symbols by rank."""
        self.by_rank = np.zeros(count, np.int32)
        used = self.rank != NONE
        self.by_rank[self.rank[used]] = self.made[:-1][used]


def load(path: str) -> Merges:
    """Merge rules of a vocabulary file in the ``tokenizers`` format."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, symbols = model["vocab"], byte_symbols()
    start = np.zeros(256, np.int32)
    for char, byte in symbols.items():
        start[byte] = vocab[char]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    rules = Merges(
        start,
        np.array([vocab[a] for a, _ in pairs], np.int32),
        np.array([vocab[b] for _, b in pairs], np.int32),
        np.array([vocab[a + b] for a, b in pairs], np.int32),
    )
    rules.products(len(pairs))
    return rules


def merge_matrix(ids: np.ndarray, rules: Merges) -> list[np.ndarray]:
    """Merge the rows of a matrix padded with -1 until no row has a rule left."""
    done: list[np.ndarray | None] = [None] * len(ids)
    row = np.arange(len(ids))
    while len(ids):
        rank = rules.find(ids[:, :-1], ids[:, 1:]) if ids.shape[1] > 1 else np.full((len(ids), 1), NONE, np.int32)
        least = rank.min(axis=1)
        over = least == NONE
        if over.any():
            for r, x in zip(row[over], ids[over]):
                done[r] = x[x >= 0]
            ids, rank, least, row = ids[~over], rank[~over], least[~over], row[~over]
            if not len(ids):
                break
        hit = rank == least[:, None]
        # Of overlapping places (the pair of a symbol with itself) every second one counts.
        place = np.arange(hit.shape[1])
        before = np.where(hit, -1, place)
        run = place - np.maximum.accumulate(before, axis=1) - 1
        hit &= run % 2 == 0
        ids = ids.copy()
        r, c = np.nonzero(hit)
        ids[r, c] = rules.by_rank[least[r]]
        ids[r, c + 1] = -2
        # Compaction: what is left moves to the front of its row.
        left = ids >= 0
        lengths = left.sum(axis=1)
        packed = np.full((len(ids), int(lengths.max())), -1, np.int32)
        packed[np.arange(packed.shape[1]) < lengths[:, None]] = ids[left]
        ids = packed
    return done  # type: ignore[return-value]


def encode_words(words: list[bytes], rules: Merges) -> list[np.ndarray]:
    """Ids of each pre-token."""
    out: list[np.ndarray | None] = [None] * len(words)
    sizes = np.fromiter((len(w) for w in words), np.int64, len(words))
    bucket = np.where(sizes > 0, np.ceil(np.log2(np.maximum(sizes, 1))), 0).astype(int)
    for b in np.unique(bucket):
        inside = np.flatnonzero(bucket == b)
        step = max(1, (1 << 22) >> int(b))
        for i in range(0, len(inside), step):
            some = inside[i : i + step]
            width = int(sizes[some].max())
            ids = np.full((len(some), max(width, 1)), -1, np.int32)
            flat = np.frombuffer(b"".join(words[j] for j in some), np.uint8)
            ids[np.arange(max(width, 1)) < sizes[some][:, None]] = rules.start[flat]
            for j, x in zip(some, merge_matrix(ids, rules)):
                out[j] = x
    return out  # type: ignore[return-value]


class Encoder:
    """Encodes batches of texts; remembers the ids of pieces between batches.

    A text is cut at its single spaces into pieces (whole pre-tokens with the
    space before them), or by ``CUT`` where other white space stands beside a
    space. Only pieces not met before are split by ``SPLIT`` and merged.
    """

    def __init__(self, rules: Merges):
        import regex

        self.rules = rules
        self.split = regex.compile(SPLIT).findall
        self.cut = regex.compile(r" ?\S+|\s+(?!\S)|\s+").findall
        self.beside = re.compile(r" (?:(?<=\s )|(?=\s))").search
        self._forget()

    def _forget(self) -> None:
        # A string stands for the piece after a space, a tuple for its string as it is.
        self.number: dict[str | tuple[str], int] = {}
        self.flat = np.zeros(0, np.int32)
        self.first = np.zeros(1, np.int64)

    def _add(self, keys: list, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.number.update(zip(keys, range(len(self.number), len(self.number) + len(keys))))
        self.flat = np.concatenate([self.flat, flat])
        self.first = np.concatenate([self.first, np.cumsum(sizes, dtype=np.int64) + self.first[-1]])

    def _gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces with these numbers, one after another, and where each ends."""
        first, size = self.first[which], self.first[which + 1] - self.first[which]
        after = np.concatenate([[0], np.cumsum(size)])
        return self.flat[np.repeat(first - after[:-1], size) + np.arange(after[-1])], after

    def _learn(self, keys: list) -> None:
        parts = [self.split(k[0] if isinstance(k, tuple) else " " + k) for k in keys]
        words = list(set(zip(itertools.chain.from_iterable(parts))) - self.number.keys())
        ids = encode_words([w[0].encode("utf-8", "surrogatepass") for w in words], self.rules)
        self._add(words, np.concatenate([self.flat[:0], *ids]), np.fromiter(map(len, ids), np.int64, len(ids)))
        left = [i for i, k in enumerate(keys) if k not in self.number]
        keys, parts = [keys[i] for i in left], [parts[i] for i in left]
        which = np.fromiter(map(self.number.__getitem__, zip(itertools.chain.from_iterable(parts))), np.int64)
        flat, after = self._gather(which)
        ends = after[np.concatenate([[0], np.cumsum([*map(len, parts)], dtype=np.int64)])]
        self._add(keys, flat, np.diff(ends))

    def _pieces(self, text: str) -> list:
        if self.beside(text):
            return list(zip(self.cut(text)))
        first, *rest = text.split(" ")
        if max(map(len, rest), default=0) <= LONG:
            return [*zip(self.split(first)), *rest] if len(first) > LONG else [(first,), *rest]
        out: list = list(zip(self.split(first)))
        for piece in rest:
            if len(piece) > LONG:
                out += zip(self.split(" " + piece))
            else:
                out.append(piece)
        return out

    def __call__(self, texts: Iterable[str | None]) -> pa.ListArray:
        pieces: list = []
        ends = [0]
        for t in texts:
            if t:
                pieces += self._pieces(t)
            ends.append(len(pieces))
        new = set(pieces) - self.number.keys()
        if len(new) + len(self.number) > REMEMBERED and self.number:
            self._forget()
            new = set(pieces)
        if new:
            self._learn(list(new))
        which = np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
        flat, after = self._gather(which)
        return pa.ListArray.from_arrays(pa.array(after[np.array(ends)], pa.int32()), pa.array(flat, pa.int32()))


def _rules(spark: SparkSession, path: str | None):
    """The merge rules as a broadcast: their size is that of the vocabulary, whatever the corpus."""
    return spark.sparkContext.broadcast(load(path or tokenizer_path("byte_bpe_50k.json")))


def encode(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the token ids of ``text`` by the vocabulary at ``path``, without special tokens.

    One row for each input row, repeated ones too. Null and empty texts give an
    empty array. The strings of special tokens are ordinary text. Other columns
    are left out, whatever their names. An empty table gives an empty one.
    """
    rules = _rules(docs.sparkSession, path)
    rows = spread(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    key_type = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(rules.value)
        for batch in batches:
            # A few MB at a time: long texts do not pile up in a worker.
            for part in pieces(batch, 1):
                ids = encoder(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["key", "ids"])

    schema = StructType([StructField("key", key_type), StructField("ids", ArrayType(IntegerType()))])
    return rows.mapInArrow(run, schema).select(F.col("key").alias(key), "ids")


def count(docs: DataFrame, path: str | None = None, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of ``text``, 0 for null and empty texts."""
    rules = _rules(docs.sparkSession, path)
    @F.pandas_udf(LongType())
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(rules.value)
        for s in batches:
            yield pd.Series(np.diff(encoder(s.tolist()).offsets.to_numpy()), dtype="int64")

    return docs.withColumn(name, tokens(F.coalesce(F.col(text), F.lit(""))))


def pieces(batch: pa.RecordBatch, column: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``most`` bytes of text in ``column``, one row at least."""
    texts = batch.column(column)
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    i = 0
    while i < len(sizes):
        base = sizes[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(sizes, base + most, side="right")))
        yield batch.slice(i, j - i)
        i = j


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by byte_bpe_50k."""
    return encode(read(spark, sf_dir, "documents"))
