"""Vectorised word scanning and polynomial hashing over Arrow string columns.

Every function works on whole texts.  Temporary memory is bounded by `PIECE` bytes of text,
except that one word longer than that is taken in one piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once.
PIECE = 1 << 19

_RNG = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _RNG.integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]
_MUL = [np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)]
_WINDOW_BASE = [np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)]


def _table(separators: bytes, fold: bool) -> np.ndarray:
    """Byte to byte, 0 for separators."""
    out = np.arange(256, dtype=np.uint8)
    if fold:
        out[65:91] += 32
    out[np.frombuffer(separators, dtype=np.uint8)] = 0
    return out


#: Words are maximal runs without U+0020 and U+0009..U+000D, unchanged.
PLAIN = _table(b" \t\n\x0b\x0c\r", False)
#: The same with A-Z in lower case.
PLAIN_LOWER = _table(b" \t\n\x0b\x0c\r", True)
#: Words are runs of ASCII letters, digits and non-ASCII bytes; A-Z in lower case.
ALNUM_LOWER = _table(bytes(b for b in range(128) if not (chr(b).isalnum())), True)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads each bit over all others."""
    x = x ^ (x >> np.uint64(33))
    x = x * _MUL[0]
    x ^= x >> np.uint64(33)
    x *= _MUL[1]
    x ^= x >> np.uint64(33)
    return x


_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _power(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of both bases and of their inverses modulo 2**64, n of each at least."""
    if not _powers or len(_powers[0][0]) < n:
        _powers.clear()
        for base in _BASE:
            both = []
            for b in (base, pow(base, -1, 2**64)):
                x = np.full(max(n, PIECE + 4096), b, dtype=np.uint64)
                x[0] = 1
                both.append(np.cumprod(x, dtype=np.uint64))
            _powers.append((both[0], both[1]))
    return _powers


@dataclass
class Words:
    """Words of consecutive documents: 64-bit hashes, byte spans in the scanned buffer, document of each."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    n_docs: int

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)


def _hashes(folded: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.zeros(len(start), dtype=np.uint64)
    power = _power(len(folded) + 1)
    for k in range(2):
        total = np.zeros(len(folded) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[k][folded] * power[k][0][: len(folded)], out=total[1:], dtype=np.uint64)
        out = mix(out + (total[end] - total[start]) * power[k][1][start])
    return out


def scan(buffer: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    """Words of the documents whose bytes are buffer[offsets[i]:offsets[i + 1]]."""
    first, last = int(offsets[0]), int(offsets[-1])
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    cuts = np.unique(offsets).astype(np.int64)
    at = first
    while at < last:
        stop = min(last, at + PIECE)
        if stop < last:
            inside = np.searchsorted(cuts, stop, side="right") - 1
            if cuts[inside] > at:  # a border of documents
                stop = int(cuts[inside])
            else:  # one long document: stop after a separator, however far it is
                border = int(cuts[inside + 1])
                back = np.flatnonzero(table[buffer[at:stop]] == 0)
                if len(back):
                    stop = at + int(back[-1]) + 1
                else:
                    while stop < border and table[buffer[stop]]:
                        stop += 1
        piece = table[buffer[at:stop]]
        word = np.zeros(len(piece) + 2, dtype=np.int8)
        word[1:-1] = piece != 0
        step = np.diff(word)
        begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        inner = offsets[(offsets > at) & (offsets < stop)] - at
        if len(inner):  # documents may touch without a separator between them
            inner = np.unique(inner)
            split = inner[(piece[inner] != 0) & (piece[inner - 1] != 0)]
            if len(split):
                begin, end = np.sort(np.concatenate([begin, split])), np.sort(np.concatenate([end, split]))
        parts.append((_hashes(piece, begin, end), begin + at, end + at))
        at = stop
    if parts:
        hashes, begin, end = (np.concatenate(x) for x in zip(*parts, strict=True))
    else:
        hashes, begin, end = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.searchsorted(offsets, begin, side="right") - 1
    return Words(hashes, begin, end, doc.astype(np.int64), len(offsets) - 1)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    where = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), where


def slices(batch: pa.RecordBatch, text: str, limit: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Consecutive rows with about `limit` bytes of text (one row at least), with the text's bytes and offsets."""
    buffer, offsets = buffers(batch.column(batch.schema.get_field_index(text)))
    at, n = 0, batch.num_rows
    while at < n:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        stop = min(n, stop)
        yield batch.slice(at, stop - at), buffer, offsets[at : stop + 1]
        at = stop


def windows(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of each run of `width` words within a document.

    The hash is the Rabin-Karp polynomial of the word hashes modulo 2**64, for two bases, mixed into
    64 bits; the polynomial of a wide window is put together from those of its halves.
    """
    n = len(words.hash) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = np.flatnonzero(words.doc[width - 1 :] == words.doc[:n])
    out = np.zeros(n, dtype=np.uint64)
    for base in _WINDOW_BASE:
        out = mix(out + _polynomial(words.hash, width, base)[:n])
    return out[inside], inside


def _polynomial(values: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """Sum of values[i + j] * base ** (width - 1 - j), for each i."""
    total, have = None, 0
    block, size = values, 1
    left = width
    while True:
        if left & 1:
            if total is None:
                total, have = block, size
            else:  # total stands before block
                n = len(values) - have - size + 1
                total = total[:n] * np.uint64(pow(int(base), size, 2**64)) + block[have : have + n]
                have += size
        left >>= 1
        if not left:
            return total
        n = len(values) - 2 * size + 1
        block = block[:n] * np.uint64(pow(int(base), size, 2**64)) + block[size : size + n]
        size *= 2


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes under zstd; sorted values are best passed as differences."""
    import zstandard

    values = np.ascontiguousarray(values, dtype=np.uint64)
    planes = values.view(np.uint8).reshape(-1, 8).T
    top = int(values.max()) if len(values) else 0
    used = max(1, (top.bit_length() + 7) // 8)
    body = np.ascontiguousarray(planes[:used]).tobytes()
    return np.array([len(values), used], dtype=np.uint32).tobytes() + zstandard.ZstdCompressor(level=1).compress(body)


def unpack(blob: bytes) -> np.ndarray:
    """What pack() packed."""
    import zstandard

    n, used = np.frombuffer(blob, dtype=np.uint32, count=2)
    body = zstandard.ZstdDecompressor().decompress(blob[8:], max_output_size=int(n) * int(used) + 1) if n else b""
    out = np.zeros((int(n), 8), dtype=np.uint8)
    out[:, : int(used)] = np.frombuffer(body, dtype=np.uint8).reshape(int(used), int(n)).T
    return out.view(np.uint64).reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned integers as differences."""
    values = np.asarray(values, dtype=np.uint64)
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=np.uint64)
