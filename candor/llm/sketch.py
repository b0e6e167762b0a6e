"""Count-min sketches made by tasks, merged by block, and used as a filter by a second pass.

Every task counts the keys of its rows into a sketch of its own and emits the cells that it touched, in
compressed blocks. Merging adds blocks of the same place. The driver gets two bits' worth of every merged
cell only: whether it reached 2 (if asked for, 1), and whether it reached `heavy`. So its size is fixed by `bits`, never by the
input. Estimates never fall below true counts: a key found in two rows always passes `repeated`.

A sketch of the largest size lets almost all through once a corpus has several times its cells in keys. From there on
(too_many) operators ask marked() instead: keys travel as rows of 20 bytes to where they are counted, and the places of
repeated ones back to their document. The results are the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.llm import hashing as H
from candor.llm.shared import giving_back

U64 = np.uint64
ROWS = 2
#: log2 of a row's cells at least and at most: a bitmap of two rows takes at most 32 MB.
LEAST_BITS, MOST_BITS = 16, 27
#: Blocks of a row.
SPLIT = 6
#: Keys that a task holds before it hands them on, and windows or lines.
HELD, HELD_ROWS = 4_000_000, 1_000_000
_MULTIPLIERS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def _cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (keys * U64(_MULTIPLIERS[row])) >> U64(64 - bits)


class Sketch:
    """Merged cells as bitmaps; small enough to be broadcast."""

    def __init__(self, bits: int, heavy: int = 0, single: bool = False):
        self.bits, self.heavy = bits, heavy
        self.one = np.zeros((ROWS, 1 << (bits - 3)), dtype=np.uint8) if single else None
        self.two = np.zeros((ROWS, 1 << (bits - 3)), dtype=np.uint8)
        self.many = np.zeros((ROWS, 1 << (bits - 3)), dtype=np.uint8) if heavy else None

    def _test(self, maps: np.ndarray, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), dtype=bool)
        for row in range(ROWS):
            c = _cells(keys, row, self.bits)
            out &= ((maps[row][c >> U64(3)] >> (U64(7) - (c & U64(7))).astype(np.uint8)) & 1).astype(bool)
        return out

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        """True for every key counted twice or more, and for few others."""
        return self._test(self.two, keys)

    def present(self, keys: np.ndarray) -> np.ndarray:
        """True for every key counted at all, and for few others."""
        return self._test(self.one, keys)

    def is_heavy(self, keys: np.ndarray) -> np.ndarray:
        """True for every key counted `heavy` times or more; the same answer in every task."""
        return self._test(self.many, keys) if self.heavy else np.zeros(len(keys), dtype=bool)


def too_many(keys: float) -> bool:
    """Whether the largest sketch has fewer cells than keys."""
    return keys > 1 << MOST_BITS


def marked(docs: DataFrame, places: Callable[[list[bytes]], Iterator[tuple[np.ndarray, np.ndarray]]], heavy: int = 0) -> DataFrame:
    """docs(doc_id, text) with `marks` and `heavy`: sorted places whose key occurs twice or more in all texts (in all:
    repeated rows of one place count once), and `heavy` times or more. places() gives each text's places and keys."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in H.text_slices(batch):
                found = list(places(texts))
                ids = batch.column("doc_id").take(pa.array(np.repeat(np.arange(a, a + len(texts)), [len(p) for p, _ in found])))
                yield pa.RecordBatch.from_arrays([pa.array(H.signed(np.concatenate([k for _, k in found]))), ids, pa.array(np.concatenate([p for p, _ in found]).astype(np.int32))], names=["k", "doc_id", "at"])

    keys = docs.select("doc_id", "text").mapInArrow(emit, "k long, doc_id long, at int")
    counted = keys.groupBy(F.col("k").alias("known")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    often = F.col("n") >= (heavy or 1 << 62)
    back = keys.join(counted, keys.k == counted.known).groupBy(F.col("doc_id").alias("marked_id"))
    marks = back.agg(F.array_sort(F.collect_set("at")).alias("marks"), F.array_sort(F.collect_set(F.when(often, F.col("at")))).alias("heavy"))
    return docs.select("doc_id", "text").join(marks, F.col("doc_id") == F.col("marked_id"), "left").drop("marked_id")


def flags(column: pa.Array, first: np.ndarray, n: int) -> np.ndarray:
    """Of n places of several texts in a row, each beginning at first, those in the texts' lists."""
    out = np.zeros(n, dtype=bool)
    if len(column):
        sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.repeat(first[: len(column)], sizes) + column.flatten().to_numpy(zero_copy_only=False)
        out[at[at < n]] = True
    return out


def width_for(keys: float) -> int:
    """Bits for about two cells a key, within fixed bounds."""
    return int(min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(keys, 1))) + 1)))


PARTIAL = "place int, cells binary"


def partial(keys: np.ndarray, bits: int, counted: bool = False, local: int = 1) -> tuple[list[int], list[bytes]]:
    """A task's sketch: places of blocks and their compressed cells. counted: cells hold counts even if all are 1.
    local: leaves out keys that this task has fewer times (then estimates are no upper bounds any more)."""
    top = bits - SPLIT
    weights = None
    if local > 1:
        keys, weights = np.unique(keys, return_counts=True)
        keys, weights = keys[weights >= local], weights[weights >= local]
    press = zstandard.ZstdCompressor(level=1)
    places, payloads = [], []
    for row in range(ROWS):
        if weights is None:  # the way back from cells to keys would take several times the memory of the keys
            cell, times = np.unique(_cells(keys, row, bits), return_counts=True)
        else:
            cell, back = np.unique(_cells(keys, row, bits), return_inverse=True)
            times = np.bincount(back, weights, len(cell)).astype(np.int64)
        edges = np.searchsorted(cell, np.arange((1 << SPLIT) + 1, dtype=U64) << U64(top))
        for k in range(1 << SPLIT):
            a, b = edges[k], edges[k + 1]
            if a < b:
                body = np.diff(cell[a:b], prepend=U64(k << top)).astype(np.uint32).tobytes()
                if counted or times[a:b].max() > 1:
                    body += np.minimum(times[a:b], 65535).astype(np.uint16).tobytes()
                places.append(row << SPLIT | k)
                payloads.append(int(b - a).to_bytes(4, "little") + press.compress(body))
    return places, payloads


def merged(parts: DataFrame, bits: int, heavy: int = 0, single: bool = False) -> Sketch:
    """The sketch that all tasks' parts (place, cells) make together; single: it can tell which keys are present. A place's parts pass one task as a stream, so what
    it holds is one block, however many parts there are."""
    top = bits - SPLIT

    @giving_back
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block() -> pa.RecordBatch:
            maps = [np.packbits(total >= n).tobytes() if n else b"" for n in (int(single), 2, heavy)]
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), *(pa.array([m], pa.binary()) for m in maps)], names=["place", "one", "two", "many"])

        expand, at, total = zstandard.ZstdDecompressor(), None, np.zeros(1 << top, dtype=np.int64)
        for batch in batches:
            for place, payload in zip(batch.column("place").to_pylist(), batch.column("cells"), strict=True):
                if place != at:
                    if at is not None:
                        yield block()
                    at = place
                    total[:] = 0
                payload = payload.as_py()
                n = int.from_bytes(payload[:4], "little")
                body = expand.decompress(payload[4:])
                cell = np.cumsum(np.frombuffer(body, dtype=np.uint32, count=n).astype(np.int64))
                total[cell] += np.frombuffer(body, dtype=np.uint16, offset=4 * n).astype(np.int64) if len(body) > 4 * n else 1
        if at is not None:
            yield block()

    out = Sketch(bits, heavy, single)
    wide = 1 << (top - 3)
    sorted_parts = parts.repartition("place").sortWithinPartitions("place")
    for r in sorted_parts.mapInArrow(merge, "place int, one binary, two binary, many binary").collect():  # bitmaps of a fixed size
        row, k = r["place"] >> SPLIT, r["place"] & ((1 << SPLIT) - 1)
        out.two[row, k * wide : (k + 1) * wide] = np.frombuffer(r["two"], dtype=np.uint8)
        if single:
            out.one[row, k * wide : (k + 1) * wide] = np.frombuffer(r["one"], dtype=np.uint8)
        if heavy:
            out.many[row, k * wide : (k + 1) * wide] = np.frombuffer(r["many"], dtype=np.uint8)
    return out


def build(docs: DataFrame, keys: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, heavy: int = 0, single: bool = False) -> Sketch:
    """Counts what keys() gives for the batches of docs; a task holds some HELD keys (8 bytes each) at once."""

    def part(found: list[np.ndarray]) -> pa.RecordBatch:
        places, payloads = partial(np.concatenate(found), bits, bool(heavy))
        return pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(payloads, pa.binary())], names=["place", "cells"])

    @giving_back
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            for k in keys(batch):
                found.append(k)
                held += len(k)
                if held >= HELD:
                    yield part(found)
                    found, held = [], 0
        if held:
            yield part(found)

    return merged(docs.mapInArrow(count, PARTIAL), bits, heavy, single)


def total_bytes(docs: DataFrame, column: str = "text") -> int:
    return int(docs.agg(F.sum(F.octet_length(column))).first()[0] or 0)
