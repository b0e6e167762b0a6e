"""Line dedup by a segment-partition edit join.

A line is what newlines separate; edit distance counts UTF-8 bytes. Lines of `least` bytes or more take part; with
`short`, lines below that which aren't blank (bytes \\x20 and \\x09-\\x0D alone) take part as equal lines only. A line
goes if an equal one, or one within `edits` edits, stands earlier (smaller doc_id, then smaller line number). All
lines are judged on the input, not on what is left.

Equal lines are found by two independent hashes of their contents, 128 bits together, which stand for a line
everywhere below: each task keeps the first of its own and gives one row a line to an
aggregation. For the others each line is cut into edits + 1 segments. Lines within the distance share a segment: one
holds it whole, at a place that the other's length and the number of edits leave few choices for. A line indexes
(length, segment, content) keys, edits + 1 of them, and probes for more (12 at 2 edits). One merged sketch counts what
is indexed; what a second scan probes for and may be indexed by another line goes into another one; only lines that
probe for such a key, or index a key that may be probed for, leave the third scan, with those keys. The smallest line on a key's list is its hub, to which every line on the list goes once.
At a hub lines are searched from short to long in a length-aware substring index, and candidates are verified by
banded bit-parallel edit distance, until an earlier line is found. Hubs of more than `block` lines are cut into chunks
of which every pair is searched on its own.

Defined results: null texts have no lines and stay null; an empty text has one empty line; rows without a doc_id keep
all lines; of rows that share a doc_id, each loses the lines found for that id; an empty table gives an empty result;
extra columns are kept by dedup_lines() and ignored by line_decisions().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candor.llm import hashing as H
from candor.llm import sketch as S
from candor.llm.shared import giving_back, unused, written

#: Bytes of a line that takes part, at least; edits at most.
LEAST, EDITS = 24, 2
#: Lines at a hub that one task searches at once.
BLOCK = 4096


def probes(edits: int) -> list[tuple[int, int, int]]:
    """(difference in length, segment, shift): where a line can hold a segment of a shorter or equal line whole.

    The shift is from the segment's place in the shorter line. Before segment i there are at most i edits, behind it
    at most edits - i; the two ranges that follow are intersected.
    """
    found = []
    for less in range(edits + 1):
        for i in range(edits + 1):
            for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1):
                found.append((less, i, shift))
    return found


def segment(length, i: int, edits: int):
    """Start and size of segment i of a line of this length (or of each): sizes differ by one at most, longer ones last."""
    n = edits + 1
    size, longer = length // n, n - length % n
    return i * size + np.maximum(i - longer, 0), size + (i >= longer)


class Lines:
    """The lines of several texts: start, size, text index and number of each."""

    def __init__(self, texts: list[bytes]):
        self.data, starts = H.concatenated(texts, b"\n")
        ends = np.flatnonzero(self.data == 10)
        self.start = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if len(ends) else ends
        self.size = ends - self.start
        self.doc = np.searchsorted(starts, self.start, side="right") - 1
        first = np.searchsorted(self.start, starts)
        self.number = np.arange(len(ends)) - first[self.doc]
        self.count = np.diff(first)
        self.prefix = H.prefix_sums(H.byte_values(self.data))
        self.eight = H.lanes(self.data)

    def filled(self) -> np.ndarray:
        """Whether a line has more than white space."""
        before = np.concatenate([[0], np.cumsum(~H.SPACE[self.data])])
        return before[self.start + self.size] > before[self.start]

    def hashes(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(H.content_hash(self.data, self.eight, self.start[rows], self.size[rows], chain) for chain in (0, 1))

    def keys(self, rows: np.ndarray, edits: int) -> np.ndarray:
        """One column for each probe; those with no difference and no shift are the index keys of the lines themselves."""
        start, size = self.start[rows], self.size[rows]
        out = []
        for less, i, shift in probes(edits):
            at, wide = segment(size - less, i, edits)
            at = at + shift
            fits = (at >= 0) & (at + wide <= size)
            at = np.where(fits, start + at, start)
            h = H.span_hash(self.prefix, at, at + wide)
            h = H.mix(h ^ ((size - less).astype(np.uint64) << np.uint64(8)) ^ np.uint64(i))
            # a place that doesn't exist gets a key of its own
            out.append(np.where(fits, h, H.mix(start.astype(np.uint64) ^ np.uint64(0x5BD1E995 + len(out)))))
        return np.stack(out, axis=1)


def indexed(edits: int) -> np.ndarray:
    """Which of the probes are the index keys of the line itself."""
    return np.array([not less and not shift for less, _, shift in probes(edits)])


def distinct_in_rows(keys: np.ndarray) -> np.ndarray:
    """The keys of all lines, each once a line: a key of two lines stands there twice, wherever the lines stand."""
    keys = np.sort(keys, axis=1)
    first = np.ones(keys.shape, dtype=bool)
    first[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return keys[first]


def within(a: bytes, b: bytes, edits: int) -> bool:
    """Whether two byte strings are within so many edits of each other.

    Bit-parallel over a diagonal band: a bit stands for one of the 2 * edits + 2 rows around the diagonal, whose
    vertical differences (+1, -1) are held in two words. The value on the band's lowest diagonal is followed until it
    reaches the last row, then along that row.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > edits:
        return False
    if len(b) <= edits:
        return _plain(a, b) <= edits
    wide = 2 * edits + 2
    mask, top = (1 << wide) - 1, 1 << (wide - 1)
    where: dict[int, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << k)
    lift = wide - 1 - edits
    plus, minus, value = mask & ~((1 << lift) - 1), 0, edits
    turn, row = len(a) - edits, top >> 1
    for j, c in enumerate(b):
        match = ((where.get(c, 0) << lift) >> j) & mask
        diagonal = ((((match & plus) + plus) ^ plus) | match | minus) & mask
        right_plus = (minus | ~(diagonal | plus)) & mask
        right_minus = diagonal & plus
        if j < turn:
            value += not diagonal & top
            if value > 2 * edits:
                return False
        else:
            value += bool(right_plus & row) - bool(right_minus & row)
            row >>= 1
        down = diagonal >> 1
        plus = (right_minus | ~(down | right_plus)) & mask
        minus = down & right_plus
    return value <= edits


def _plain(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


#: Numbers of 64 bits in a line's profile.
PROFILE = 2


def profiles(texts: list[bytes]) -> np.ndarray:
    """For each of 64 * PROFILE buckets, whether a text has an odd number of byte pairs in it. An edit takes away two
    pairs and adds two at most, so it changes four bits at most."""
    data, starts = H.concatenated(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    code = (data[:-1].astype(np.uint32) * np.uint32(257) + data[1:]) * np.uint32(2654435761) >> np.uint32(33 - (64 * PROFILE).bit_length())
    inside = owner[1:] == owner[:-1]
    odd = np.bincount(owner[:-1][inside] * 64 * PROFILE + code[inside], minlength=len(texts) * 64 * PROFILE) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64).reshape(-1, PROFILE)


class _List:
    """Numbers of lines, which grow in place."""

    def __init__(self) -> None:
        self.held, self.n = np.empty(4, dtype=np.int64), 0

    def add(self, x: int) -> None:
        if self.n == len(self.held):
            self.held = np.concatenate([self.held, self.held])
        self.held[self.n] = x
        self.n += 1


def repeated_in_block(lines: list[tuple[tuple, bytes, int]], edits: int, apart: bool = False) -> list[int]:
    """Of lines (place, text, chunk) with distinct texts, those with another of an earlier place within the distance.

    apart: only lines of different chunks are compared. Candidates are verified whose profiles allow it.
    """
    index: dict[tuple, _List] = {}
    ways, n = probes(edits), len(lines)
    order = np.empty(n, dtype=np.int64)
    order[sorted(range(n), key=lambda k: lines[k][0])] = np.arange(n)
    chunk, gone, profile = np.array([c for _, _, c in lines]), np.zeros(n, dtype=bool), profiles([t for _, t, _ in lines])
    for x in sorted(range(n), key=lambda k: len(lines[k][1])):
        text, met = lines[x][1], []
        for less, i, shift in ways:
            at, wide = segment(len(text) - less, i, edits)
            at += shift
            if at >= 0 and (found := index.get((len(text) - less, i, text[at : at + wide]))):
                met.append(found.held[: found.n])
        if met:
            y = met[0]
            if len(met) > 1:
                candidate = np.zeros(n, dtype=bool)
                for found in met:
                    candidate[found] = True
                y = np.flatnonzero(candidate)
            y = y[np.bitwise_count(profile[y] ^ profile[x]).sum(axis=1) <= 4 * edits]
            if apart:
                y = y[chunk[y] != chunk[x]]
            for k in y.tolist():
                late = x if order[k] < order[x] else k
                if not gone[late] and within(text, lines[k][1], edits):
                    gone[late] = True
        for i in range(edits + 1):
            at, wide = segment(len(text), i, edits)
            index.setdefault((len(text), i, text[at : at + wide]), _List()).add(x)
    return np.flatnonzero(gone).tolist()


_FIRST = pa.schema([("kind", pa.int8()), ("doc_id", pa.int64()), ("line", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("place", pa.int32()), ("cells", pa.binary())])
_FIRST_DDL = "kind byte, doc_id long, line long, h1 long, h2 long, place int, cells binary"
#: Kinds of rows of the first scan: a document with its number of lines, a line to be judged, a line that the task found again, a part of the sketch.
DOCUMENT, JUDGED, AGAIN, PART = range(4)


def _rows(kind: int, n: int, **columns) -> pa.RecordBatch:
    arrays = [pa.array(np.full(n, kind, np.int8))] + [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in list(_FIRST)[1:]]
    return pa.RecordBatch.from_arrays(arrays, schema=_FIRST)


def _first_scan(docs: DataFrame, least: int, edits: int, bits: int, short: bool) -> DataFrame:
    def handed_on(found: list[list[np.ndarray]], keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h1, h2, doc, line = (np.concatenate(c) for c in found)
        order = np.lexsort((line, doc, h2, h1))
        h1, h2, doc, line = h1[order], h2[order], doc[order], line[order]
        again = np.zeros(len(h1), dtype=bool)
        again[1:] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
        for kind, some in ((JUDGED, np.flatnonzero(~again)), (AGAIN, np.flatnonzero(again))):
            for i in range(0, len(some), 1 << 16):
                k = some[i : i + (1 << 16)]
                yield _rows(kind, len(k), doc_id=doc[k], line=line[k], h1=H.signed(h1[k]), h2=H.signed(h2[k]))
        places, payloads = S.partial(np.concatenate(keys), bits)
        yield _rows(PART, len(places), place=places, cells=payloads)

    @giving_back
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[np.ndarray]] = [[], [], [], []]
        keys, held = [], 0
        for batch in batches:
            doc_ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            null = batch.column("text").is_null().to_numpy(zero_copy_only=False)
            for a, texts in H.text_slices(batch):
                lines = Lines(texts)
                yield _rows(DOCUMENT, len(texts), doc_id=doc_ids[a : a + len(texts)], line=np.where(null[a : a + len(texts)], 0, lines.count))
                rows = np.flatnonzero((lines.size >= least) | lines.filled() if short else lines.size >= least)
                h1, h2 = lines.hashes(rows)
                for column, x in zip(found, (h1, h2, doc_ids[a + lines.doc[rows]], lines.number[rows]), strict=True):
                    column.append(x)
                once = rows[H.distinct_pairs(h1, h2)]
                keys.append(distinct_in_rows(lines.keys(once[lines.size[once] >= least], edits)[:, indexed(edits)]))
                held += len(keys[-1]) + len(rows)
                if held >= S.HELD_ROWS:
                    yield from handed_on(found, keys)
                    found, keys, held = [[], [], [], []], [], 0
        if keys:
            yield from handed_on(found, keys)

    return written(docs.select("doc_id", "text").mapInArrow(scan, _FIRST_DDL), "lines")


def _distinct_lines(batch: pa.RecordBatch, least: int) -> Iterator[tuple[Lines, np.ndarray, np.ndarray, np.ndarray]]:
    """Lines of each slice of a batch, and the first of its equal long lines with their hashes."""
    for _, texts in H.text_slices(batch):
        lines = Lines(texts)
        rows = np.flatnonzero(lines.size >= least)
        h1, h2 = lines.hashes(rows)
        at = H.distinct_pairs(h1, h2)
        yield lines, rows[at], h1[at], h2[at]


def _met(keys: np.ndarray, own: np.ndarray, index: S.Sketch) -> np.ndarray:
    """Of lines' keys, those that another line may index."""
    flat = keys.ravel()
    return np.where(own[None, :], index.repeated(flat).reshape(keys.shape), index.present(flat).reshape(keys.shape))


def _probed(docs: DataFrame, least: int, edits: int, index, bits: int) -> S.Sketch:
    """What lines probe for and others may index."""

    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        own = indexed(edits)
        for lines, rows, _, _ in _distinct_lines(batch, least):
            made = lines.keys(rows, edits)
            yield made[_met(made, own, index.value)]

    return S.build(docs.select("text"), keys, bits, single=True)


def _candidates(docs: DataFrame, least: int, edits: int, index, probed) -> DataFrame:
    """(h1, h2, keys, line): lines with keys that other lines may index, or probe for."""

    @giving_back
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = indexed(edits)
        for batch in batches:
            for lines, rows, h1, h2 in _distinct_lines(batch, least):
                keys = lines.keys(rows, edits)
                maybe = _met(keys, own, index.value)
                maybe[:, own] |= probed.value.present(keys[:, own].ravel()).reshape(-1, int(own.sum()))
                keep = np.flatnonzero(maybe.any(axis=1))
                chosen = [H.signed(np.unique(keys[k][maybe[k]])) for k in keep]
                body = [lines.data[lines.start[r] : lines.start[r] + lines.size[r]].tobytes() for r in rows[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(H.signed(h1[keep])), pa.array(H.signed(h2[keep])), pa.array(chosen, pa.list_(pa.int64())), pa.array(body, pa.binary())], names=["h1", "h2", "keys", "line"])

    return written(docs.select("text").mapInArrow(scan, "h1 long, h2 long, keys array<long>, line binary"), "candidates")


def removed_lines(docs: DataFrame, least: int = LEAST, edits: int = EDITS, block: int = BLOCK, bits: int | None = None, short: bool = False) -> tuple[DataFrame, DataFrame]:
    """(counts(doc_id, n_lines), removed(doc_id, lines array<long>))."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    # a few keys in each line of some 200 bytes, and four cells for each
    bits = bits or S.width_for(S.total_bytes(docs) / 33)
    first = _first_scan(docs, least, edits, bits, short)
    context = docs.sparkSession.sparkContext
    index = context.broadcast(S.merged(first.where(F.col("kind") == PART).select("place", "cells"), bits, single=True))
    candidates = _candidates(docs, least, edits, index, context.broadcast(_probed(docs, least, edits, index, bits)))

    judged = first.where(F.col("kind") == JUDGED).select("doc_id", "line", "h1", "h2")
    # one exchange for all that asks which line is the first of its equals; of those, a task hands on one
    equals = Window.partitionBy("h1", "h2").orderBy("doc_id", "line")
    ranked = judged.select("*", F.row_number().over(equals).alias("nth"), F.first(F.struct("doc_id", "line")).over(equals).alias("earliest"))
    earliest = ranked.where("nth = 1").select("h1", "h2", "earliest")
    keys = candidates.select("h1", F.explode("keys").alias("key"))
    hubs = keys.groupBy(F.col("key").alias("shared")).agg(F.min("h1").alias("hub"), F.max("h1").alias("most")).where("hub < most").drop("most")
    # hubs and their members have no bound that would let them be broadcast
    member = written(keys.join(hubs.hint("merge"), keys.key == hubs.shared).select("h1", "hub").distinct(), "members")
    chunked = member.groupBy("hub").count().where(F.col("count") > block).select("hub", F.ceil(F.col("count") / block).cast("int").alias("parts"))
    dealt = member.join(chunked, "hub", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("h1"), F.col("parts")).cast("int"))
    places = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct("hub", F.least(x, "part").alias("i"), F.greatest(x, "part").alias("j"), "part"))
    sent = dealt.select("h1", F.explode(places).alias("to"))
    # of lines that share h1 alone, all go to the hubs of any; texts travel of lines that are at a hub only
    wanted = candidates.select("h1", "h2", "line").join(member.select("h1").distinct().hint("merge"), "h1", "left_semi")
    texts = wanted.groupBy("h1", "h2").agg(F.first("line").alias("text"))
    placed = earliest.select("h1", "h2", F.col("earliest").alias("at"))

    @giving_back
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: list, ids: list, key: tuple) -> Iterator[pa.RecordBatch]:
            if len(rows) > 1 and (gone := repeated_in_block(rows, edits, key[1] != key[2])):
                yield pa.RecordBatch.from_arrays([pa.array([ids[k][c] for k in gone], pa.int64()) for c in (0, 1)], names=["h1", "h2"])

        at, rows, ids = None, [], []
        for batch in batches:
            for hub, i, j, part, h1, h2, doc_id, line, text in zip(*(batch.column(c).to_pylist() for c in ("hub", "i", "j", "part", "h1", "h2", "doc_id", "line", "text")), strict=True):
                if (hub, i, j) != at:
                    yield from found(rows, ids, at)
                    at, rows, ids = (hub, i, j), [], []
                rows.append(((doc_id, line), text, part))
                ids.append((h1, h2))
        yield from found(rows, ids, at)

    blocks = sent.join(texts, "h1").join(placed, ["h1", "h2"]).select("to.*", "h1", "h2", "at.*", "text").repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    near = blocks.mapInArrow(search, "h1 long, h2 long").distinct()

    late = ranked.where("nth > 1 and struct(doc_id, line) > earliest").select("doc_id", "line")
    close = earliest.join(near, ["h1", "h2"]).select("earliest.doc_id", "earliest.line")
    again = first.where(F.col("kind") == AGAIN).select("doc_id", "line")
    removed = late.unionByName(close).unionByName(again).groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    return first.where(F.col("kind") == DOCUMENT).select("doc_id", F.col("line").alias("n_lines")), removed


def line_decisions(docs: DataFrame, least: int = LEAST, edits: int = EDITS, block: int = BLOCK, bits: int | None = None, short: bool = False) -> DataFrame:
    """doc_id, n_lines, n_removed, removed_lines (numbers from 0, ascending)."""
    counts, removed = removed_lines(docs, least, edits, block, bits, short)
    lines = F.coalesce("lines", F.array().cast("array<long>"))
    return counts.join(removed, "doc_id", "left").select("doc_id", "n_lines", F.size(lines).cast("long").alias("n_removed"), lines.alias("removed_lines"))


def dedup_lines(docs: DataFrame, least: int = LEAST, edits: int = EDITS, block: int = BLOCK) -> DataFrame:
    """docs with shortened texts, without documents that lost lines and have nothing but white space left."""
    _, removed = removed_lines(docs, least, edits, block)
    cut_id, lines = unused(docs, "cut_id"), unused(docs, "lines")
    removed = removed.select(F.col("doc_id").alias(cut_id), F.col("lines").alias(lines))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(lines, i.cast("long"))), "\n")
    joined = docs.join(removed, docs["doc_id"] == removed[cut_id], "left")
    cut = joined.withColumn("text", F.when(F.col(lines).isNull(), F.col("text")).otherwise(kept))
    return cut.where(F.col(lines).isNull() | F.col("text").isNull() | F.col("text").rlike("[^ \\t\\n\\r]")).drop(cut_id, lines)
