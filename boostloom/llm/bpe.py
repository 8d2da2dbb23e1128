"""Byte-level BPE: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boostloom.llm import words as W

#: Bytes of text that are encoded at once.
SLICE = 2 << 20
#: Pre-tokens of a text that are looked up at once.
AT_ONCE = 200_000
#: Pre-tokens whose ids a worker keeps; the memory is emptied when it is full.
REMEMBERED = 400_000
_MASK = 2**64 - 1


class PerfectHash:
    """A minimal perfect hash of n different byte strings onto 0..n-1, by hash and displace.

    Keys fall into buckets; the larger buckets first look for a displacement that sends all their keys to
    free slots; a bucket of one key names its slot.  Look-ups compare the key, so that others give -1.
    """

    def __init__(self, keys: list[bytes]):
        n = max(1, len(keys))
        self.n, self.n_buckets = n, n // 3 + 1
        buckets: list[list[int]] = [[] for _ in range(self.n_buckets)]
        hashed = [xxhash.xxh3_64_intdigest(k) for k in keys]
        for h in hashed:
            buckets[(h >> 32) % self.n_buckets].append(h)
        self.shift = [0] * self.n_buckets
        taken = bytearray(n)
        order = sorted(range(self.n_buckets), key=lambda b: -len(buckets[b]))
        free = None
        for b in order:
            hs = buckets[b]
            if not hs:
                break
            if len(hs) == 1:
                if free is None:
                    free = iter([i for i in range(n) if not taken[i]])
                self.shift[b] = -1 - next(free)
                continue
            d = 0
            while True:
                slots = [self._slot(h, d) for h in hs]
                if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                    break
                d += 1
            for s in slots:
                taken[s] = 1
            self.shift[b] = d
        self.keys: list[bytes | None] = [None] * n
        self.values = [-1] * n
        for value, (k, h) in enumerate(zip(keys, hashed, strict=True)):
            at = self._at(h)
            self.keys[at], self.values[at] = k, value

    def _slot(self, h: int, d: int) -> int:
        return ((((h ^ (d * 0x9E3779B97F4A7C15)) & _MASK) * 0xD6E8FEB86659FD93 & _MASK) >> 32) % self.n

    def _at(self, h: int) -> int:
        d = self.shift[(h >> 32) % self.n_buckets]
        return -1 - d if d < 0 else self._slot(h, d)

    def get(self, key: bytes) -> int:
        """The position of the key among those given at first, or -1."""
        at = self._at(xxhash.xxh3_64_intdigest(key))
        return self.values[at] if self.keys[at] == key else -1


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the pair of least rank, leftmost first, is merged until none is left."""
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank = [ranks.get(word[i : i + 2], -1) for i in range(n - 1)]
    rank.append(-1)
    heap = [r << 40 | i for i, r in enumerate(rank) if r >= 0]
    heapq.heapify(heap)
    while heap:
        top = heapq.heappop(heap)
        i, r = top & 0xFFFFFFFFFF, top >> 40
        if rank[i] != r:
            continue  # one of the pair has been merged since
        j = after[i]
        k = after[j]
        after[i] = k
        rank[j] = -1
        if k < n:
            before[k] = i
            rank[i] = r = ranks.get(word[i : after[k]], -1)
            if r >= 0:
                heapq.heappush(heap, r << 40 | i)
        else:
            rank[i] = -1
        p = before[i]
        if p >= 0:
            rank[p] = r = ranks.get(word[p:k], -1)
            if r >= 0:
                heapq.heappush(heap, r << 40 | p)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return out


class Encoder(dict):
    """Pre-token to ids, which it works out when they are first asked for."""

    def __init__(self, tokens: list[tuple[bytes, int]], pattern: str):
        import regex

        super().__init__()
        self.ranks = dict(tokens)
        self.hash = PerfectHash([t for t, _ in tokens])
        self.id_at = [i for _, i in tokens]
        self.bytes_of = {i: t for t, i in tokens}
        self.pattern = regex.compile(pattern)

    def __missing__(self, piece: str) -> tuple[int, ...]:
        key = piece.encode()
        at = self.hash.get(key)
        out = (self.id_at[at],) if at >= 0 else tuple(merge(key, self.ranks))
        if len(self) >= REMEMBERED:
            self.clear()
        self[piece] = out
        return out

    def encode(self, text: str) -> np.ndarray:
        if len(text) < AT_ONCE:
            return np.fromiter(chain.from_iterable(map(self.__getitem__, self.pattern.findall(text))), np.int32)
        found, parts = (m.group() for m in self.pattern.finditer(text)), []
        while pieces := list(islice(found, AT_ONCE)):
            parts.append(np.fromiter(chain.from_iterable(map(self.__getitem__, pieces)), np.int32))
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    """(token, rank) of each line of a rank file."""
    with open(path, "rb") as f:
        return [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, f) if a]


_encoders: dict[tuple[int, str], Encoder] = {}


def _encoder(broadcast, pattern: str) -> Encoder:
    """One encoder for each worker and vocabulary."""
    raw = broadcast.value
    key = (xxhash.xxh3_64_intdigest(raw), pattern)
    if key not in _encoders:
        _encoders.clear()
        pairs = [line.split() for line in raw.splitlines()]
        _encoders[key] = Encoder([(base64.b64decode(a), int(b)) for a, b in (p for p in pairs if p)], pattern)
    return _encoders[key]


def _share(spark, path: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))


def _encode_part(encoder: Encoder, texts: pa.Array) -> list[np.ndarray]:
    return [encoder.encode(x) if x else np.zeros(0, np.int32) for x in texts.to_pylist()]


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", id_col: str = "doc_id", decoded: bool = False) -> DataFrame:
    """Encode each whole text: doc_id, ids array<int>; with `decoded`, also the bytes that decode() makes of them.

    Each match of `pattern` is encoded separately, without special tokens, by the ranks of the file
    `ranks_path`, which the driver reads and broadcasts (its size is that of the vocabulary, not of the
    data).  A null or empty text gives an empty array.  Repeated rows give equal rows, other columns are
    ignored, an empty table gives no rows.  Memory grows with one text at most.
    """
    shared = _share(docs.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, pattern)
        for batch in batches:
            for rows, _, _ in W.slices(batch, "text", SLICE):
                ids = _encode_part(encoder, rows.column(1))
                columns = [rows.column(0), _lists(ids)]
                if decoded:
                    columns.append(pa.array([encoder.decode(x.tolist()) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """Decode each list of ids: doc_id, ids, decoded binary (bytes: ids may stop inside a character).

    Null or empty ids give empty bytes; an id that the vocabulary lacks is an error.
    """
    shared = _share(encoded.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, "")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [encoder.decode(x.values.to_pylist()) if x.is_valid else b"" for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])

    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
