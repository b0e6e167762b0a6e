"""Vectorised text layouts and hashes shared by the operators that run on Arrow batches.

Rolling hashes (span_hash, gram_hash) are polynomials modulo 2**64 over random values, finished by a bit mixer. Long
strings of two bytes can be made that collide in all such polynomials, so over bytes they only choose places and gather
candidates, whose bytes are compared. What two texts are told apart by is content_hash(): eight bytes at a time through
the mixer, in two chains independent of each other, and a cryptographic digest from LONG bytes on. Windows of words
are polynomials over those, of a fixed length that is too short for such strings.

All hashes are the same in every process, so keys of different tasks can be compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd, so that every power has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
#: Bytes from which on content is digested, and the keys of each chain's steps.
LONG = 256
_KEYS = np.random.Generator(np.random.PCG64(20250301)).integers(1, 1 << 63, (2, LONG // 8 + 1), dtype=np.uint64) * U64(2) + U64(1)
_HEADS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_HIGH = U64(0xFFFFFFFF00000000)
_LOW = U64(0xFFFFFFFF)

#: Bytes handled at once; one longer text makes one larger chunk.
CHUNK_BYTES = 1 << 19

#: Spans that are hashed together.
SPANS = 1 << 16

#: Rows of an Arrow batch that are turned into Python objects together.
SLICE_ROWS = 256

_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _tables.get(base)
    if have is None or len(have) < n:
        full = np.full(max(n, 1 << 16), base, dtype=U64)
        full[0] = 1
        have = _tables[base] = np.cumprod(full, dtype=U64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of value * base**position; element i covers the first i values."""
    out = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * _powers(_BASE, len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], the same wherever the span stands."""
    return mix((prefix[end] - prefix[start]) * _powers(_INVERSE, len(prefix))[start])


def gram_hash(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive values."""
    m = len(values) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=U64)
    prefix = prefix_sums(values)
    return mix((prefix[n:] - prefix[:m]) * _powers(_INVERSE, m))


def byte_values(data: np.ndarray) -> np.ndarray:
    """Random values of bytes."""
    return _BYTE_VALUES[data]


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on, as one number; zeros stand behind the end."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    return np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))


def content_hash(data: np.ndarray, eight: np.ndarray, start: np.ndarray, size: np.ndarray, chain: int = 0) -> np.ndarray:
    """Hash of the bytes data[start : start + size]; eight is lanes(data). Spans of one size of up to eight bytes never collide."""
    size = np.broadcast_to(size, start.shape)
    if len(start) > SPANS:  # a long text has many, and each needs some eighty bytes here
        cuts = range(0, len(start), SPANS)
        return np.concatenate([content_hash(data, eight, start[i : i + SPANS], size[i : i + SPANS], chain) for i in cuts])
    keys = _KEYS[chain]
    out = mix((eight[start] & _HEADS[np.minimum(size, 8)]) ^ keys[0])
    live = np.flatnonzero((size > 8) & (size < LONG))
    for j in range(1, LONG // 8):
        if not len(live):
            break
        rest = size[live] - 8 * j
        out[live] = mix((out[live] + keys[j]) ^ (eight[start[live] + 8 * j] & _HEADS[np.minimum(rest, 8)]))
        live = live[rest > 8]
    out = mix(out + size.astype(np.uint64) * keys[-1])
    for i in np.flatnonzero(size >= LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : start[i] + size[i]].tobytes(), digest_size=16).digest()[8 * chain : 8 * chain + 8], "little")
    return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values."""
    have, low = 1, values
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        shift = width - have
        low = np.minimum(low[:-shift], low[shift:])
    return low


def owners(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of width hashes, the position of its smallest (of equal ones the first).

    The choice depends on the content of the run only, so equal runs choose the same relative position.
    """
    if len(hashes) < width:
        return np.zeros(0, dtype=np.int64)
    packed = (hashes & _HIGH) | np.arange(len(hashes), dtype=U64)
    return (sliding_min(packed, width) & _LOW).astype(np.int64)


def chunks(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most about most bytes together."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def text_slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, list[bytes]]]:
    """A batch's texts as UTF-8 in parts of about CHUNK_BYTES, each with its first row's number; null is empty."""
    data = batch.column(column).cast(pa.binary())
    for at in range(0, len(data), SLICE_ROWS):
        texts = [t or b"" for t in data.slice(at, SLICE_ROWS).to_pylist()]
        for a, b in chunks(texts):
            yield at + a, texts[a:b]


def concatenated(texts: list[bytes], gap: bytes = b" ") -> tuple[np.ndarray, np.ndarray]:
    """All bytes with a gap byte behind each text, and where each text starts (one more at the end)."""
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(sizes, out=starts[1:])
    return np.frombuffer(gap.join(texts) + gap if texts else b"", dtype=np.uint8), starts


def _table(of: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(of.encode("latin-1"))] = True
    return out


#: The bytes \x20 and \x09-\x0D. All of UTF-8's other bytes belong to words.
SPACE = _table(" \t\n\x0b\x0c\r")


class Words:
    """The words of several texts: start and end byte, text index and hash of each."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.data, self.starts = concatenated(texts)
        data = self.data
        if lower:
            upper = (data >= 65) & (data <= 90)
            data = np.where(upper, data + 32, data).astype(np.uint8)
        gap = SPACE[data]
        before = np.ones(len(gap), dtype=bool)
        before[1:] = gap[:-1]
        self.start = np.flatnonzero(~gap & before)
        self.end = np.flatnonzero(gap & ~before)
        self.doc = np.searchsorted(self.starts, self.start, side="right") - 1
        self._content = data, lanes(data)
        self.hash = self.hashes(0)
        #: Of the words, where each text's begin; one more at the end.
        self.first = np.searchsorted(self.start, self.starts)

    def hashes(self, chain: int) -> np.ndarray:
        return content_hash(*self._content, self.start, self.end - self.start, chain)

    def whole(self, n: int) -> np.ndarray:
        """For each run of n words: whether one text holds it all."""
        m = len(self.doc) - n + 1
        return self.doc[n - 1 :] == self.doc[:m] if m > 0 else np.zeros(0, dtype=bool)


def distinct_pairs(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Where each different pair of hashes stands first."""
    order = np.lexsort((h2, h1))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    return order[new]


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
