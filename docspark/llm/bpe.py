"""Byte-level BPE encoding and decoding with two-tier lookup.

A text is cut by the tokenizer's pattern. A piece that is itself in the
vocabulary is found by a minimal perfect hash; any other is merged from its
bytes, with a heap of candidate pairs over a linked list. Results of pieces are
kept per task in two generations of bounded size.

The vocabulary file is read by the driver and broadcast (its size is that of the
vocabulary); texts are handled where Spark has put them.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from docspark.llm import common

# Pieces kept per generation and the longest one kept.
KEPT_PIECES = 200_000
KEPT_BYTES = 64
# Texts above this many characters are cut lazily, so many pieces at a time.
LONG_TEXT = 1 << 20
PIECES_AT_A_TIME = 1 << 16


def read_ranks(path: str) -> list[bytes]:
    """Tokens in the order of their ids, from lines of base64 token and id."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class PerfectHash:
    """Minimal perfect hash of a fixed set of byte strings: each has a slot of its own, none is free.

    Keys are dealt to buckets. A bucket, large ones first, gets the first seed
    that puts its keys on free slots; a bucket of one key names its slot.
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 2):
        self.size = max(1, len(keys))
        self.buckets = max(1, self.size // per_bucket)
        dealt: list[list[int]] = [[] for _ in range(self.buckets)]
        for n, key in enumerate(keys):
            dealt[xxhash.xxh64_intdigest(key) % self.buckets].append(n)
        self.slots = [-1] * self.size
        self.seeds = [0] * self.buckets
        order = sorted(range(self.buckets), key=lambda b: -len(dealt[b]))
        single = [b for b in order if len(dealt[b]) == 1]
        for b in order:
            if len(dealt[b]) < 2:
                break
            seed = 1
            while True:
                slots = [xxhash.xxh64_intdigest(keys[n], seed) % self.size for n in dealt[b]]
                if len(set(slots)) == len(slots) and all(self.slots[s] < 0 for s in slots):
                    break
                seed += 1
            self.seeds[b] = seed
            for n, slot in zip(dealt[b], slots, strict=True):
                self.slots[slot] = n
        free = (s for s in range(self.size) if self.slots[s] < 0)
        for b in single:
            slot = next(free)
            self.seeds[b] = -slot - 1
            self.slots[slot] = dealt[b][0]

    def __call__(self, key: bytes) -> int:
        """Number of the only key that `key` can equal."""
        seed = self.seeds[xxhash.xxh64_intdigest(key) % self.buckets]
        return self.slots[-seed - 1 if seed < 0 else xxhash.xxh64_intdigest(key, seed) % self.size]


class Pieces(dict):
    """Ids of pieces; when full the older half is dropped."""

    def __init__(self, encode, limit: int = KEPT_PIECES):
        super().__init__()
        self.encode, self.limit, self.older = encode, limit, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.encode(piece.encode("utf-8", "surrogatepass"))
            if len(piece) > KEPT_BYTES:
                return ids
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Encoder:
    """Tokenizer of a vocabulary whose ids are merge ranks."""

    def __init__(self, tokens: list[bytes], pattern: str, limit: int = KEPT_PIECES):
        self.tokens = tokens
        self.ranks = {token: n for n, token in enumerate(tokens)}
        self.whole = PerfectHash(tokens)
        self.cut = regex.compile(pattern)
        self.pieces = Pieces(self.piece, limit)
        self.written = [str(n) for n in range(len(tokens))]

    def piece(self, piece: bytes) -> tuple[int, ...]:
        found = self.whole(piece)
        if self.tokens[found] == piece:
            return (found,)
        return self.merged(piece)

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """Merges the pair of least rank, the first of equals, until no pair is in the vocabulary."""
        n, ranks = len(piece), self.ranks
        after = list(range(1, n + 1))  # start of the next part
        before = list(range(-1, n - 1))
        alive = [True] * n
        heap = []
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                heap.append((rank, i, i + 2))
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i]:
                continue
            j = after[i]
            if j >= n or after[j] != end:
                continue  # the pair has changed since
            alive[j] = False
            after[i] = end
            if end < n:
                before[end] = i
                rank = ranks.get(piece[i : after[end]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, after[end]))
            left = before[i]
            if left >= 0:
                rank = ranks.get(piece[left:end])
                if rank is not None:
                    heapq.heappush(heap, (rank, left, end))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : after[i]]])
            i = after[i]
        return tuple(ids)

    def parts(self, text: str) -> Iterator[list[int]]:
        """Ids of a text, a bounded number of pieces at a time."""
        if len(text) <= LONG_TEXT:
            yield self._ids(self.cut.findall(text))
            return
        found = (match.group() for match in self.cut.finditer(text))
        while pieces := list(islice(found, PIECES_AT_A_TIME)):
            yield self._ids(pieces)

    def _ids(self, pieces: list[str]) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, pieces)))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.parts(text)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, digest of the ids as decimals and of the bytes they decode to."""
        count, ids_sha, bytes_sha = 0, hashlib.sha256(), hashlib.sha256()
        for ids in self.parts(text):
            written = " ".join(map(self.written.__getitem__, ids))
            ids_sha.update((" " + written if count and ids else written).encode())
            bytes_sha.update(self.decode(ids))
            count += len(ids)
        return count, ids_sha.hexdigest(), bytes_sha.hexdigest()


@lru_cache(maxsize=2)
def _encoder(tokens: tuple[bytes, ...], pattern: str) -> Encoder:
    return Encoder(list(tokens), pattern)


def _vocabulary(spark: SparkSession, path: str) -> Broadcast:
    return spark.sparkContext.broadcast(tuple(read_ranks(path)))


def _mapped(docs: DataFrame, text_col: str, path: str, pattern: str, fields: list[T.StructField], rows) -> DataFrame:
    """`docs` with columns that `rows(encoder, values)` makes of the column `text_col`.

    A new column replaces one of its name.
    """
    tokens = _vocabulary(docs.sparkSession, path)
    names = {f.name.lower() for f in fields}
    kept = [c for c in docs.columns if c.lower() not in names]
    schema = T.StructType([*[docs.schema[c] for c in kept], *fields])
    types = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokens.value, pattern)
        for batch in batches:
            made = rows(encoder, (v.as_py() for v in batch.column(batch.schema.get_field_index(text_col))))
            columns = [pa.array(c, type=f.type) for c, f in zip(made, types, strict=True)]
            old = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*old, *columns], names=[*kept, *types.names])

    return common.map_in_arrow(docs, run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return {"long": pa.int64(), "integer": pa.int32(), "string": pa.string(), "binary": pa.binary()}[kind.typeName()]


def encoded(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """`docs` with the ids of each text; a null text has none, like an empty one.

    Every row is handled alone: repeated rows get the same ids, an empty table
    gives no rows, and a column that is already called `ids_col` is replaced.
    """
    fields = [T.StructField(ids_col, T.ArrayType(T.IntegerType()))]
    make = lambda encoder, texts: ([encoder.encode(t or "") for t in texts],)
    return _mapped(docs, text_col, path, pattern, fields, make)


def decoded(docs: DataFrame, path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """`docs` with the bytes that each row's ids stand for; null ids stand for none."""
    fields = [T.StructField(bytes_col, T.BinaryType())]
    make = lambda encoder, rows: ([encoder.decode(ids or []) for ids in rows],)
    return _mapped(docs, ids_col, path, pattern, fields, make)


def token_digests(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """`docs` with `n_tokens`, `ids_sha256` and `decoded_sha256`: encoded and decoded in one pass.

    The ids are not kept. Nulls, repeated rows and names as in `encoded`.
    """
    fields = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]

    def make(encoder: Encoder, texts: Iterator[str | None]):
        found = [encoder.digests(t or "") for t in texts]
        return tuple(map(list, zip(*found, strict=True))) if found else ([], [], [])

    return _mapped(docs, text_col, path, pattern, fields, make)
