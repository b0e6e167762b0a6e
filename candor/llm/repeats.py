"""Suffix-array dedup: maximal repeats of `size` bytes or more, found in the common-prefix interval tree.

Every window of `size` bytes chooses one anchor in it, the first of its smallest k-byte hashes, so equal windows
choose the same place. Only anchors that a merged count-min sketch counts twice or more leave the scan, each with the
bytes around it: the suffix from the anchor on (up to `size`) and the reversed bytes before it (up to size - k). Anchors
of one hash meet in one task, sorted by suffix: a sparse suffix array. With the common-prefix lengths of neighbours
it is an enhanced one, and a scan with a stack yields its interval tree. In each interval the bytes to the left are
tested for diversity by a second such scan: where they differ, a repeat can't be extended to the left either, so it is
maximal, and all members of the (sub)interval are its occurrences. All but the first occurrence can go.

A hash that the sketch counts `heavy` times or more isn't gathered in a task: windows around such anchors are
compared by 128 bits of independent content hashes in an aggregation with partial sums, and an equi-join. So no task's group exceeds
`heavy` rows, and nothing is dropped. Where anchors are too many for a sketch (sketch.too_many), their hashes are
shuffled and counted; the result is the same.

Defined results: null and empty texts have no bytes; repeats never cross documents; a repeat inside one document
counts; earlier means smaller doc_id, then smaller start; rows without a doc_id take no part; documents are expected
under one row each (of rows sharing a doc_id, each loses the places found for that id); an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.llm import hashing as H
from candor.llm import sketch as S
from candor.llm.shared import written

#: Bytes of an anchor.
ANCHOR = 24
#: From this count on, a hash's anchors aren't gathered.
HEAVY = 32768


def _anchors(texts: list[bytes], size: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, text starts, hash of each k bytes, and for each window its anchor (-1: no window)."""
    data, starts = H.concatenated(texts)
    grams = H.gram_hash(H.byte_values(data), k)
    own = H.owners(grams, size - k + 1)
    n = len(own)
    at = np.searchsorted(starts, np.arange(n), side="right") - 1 if n else np.zeros(0, np.int64)
    inside = np.arange(n) + size < starts[at + 1]  # the gap byte isn't of the text
    return data, starts, grams, np.where(inside, own, -1)


def anchor_sketch(docs: DataFrame, size: int, k: int, heavy: int, bits: int | None = None) -> S.Sketch | None:
    """None where anchors are too many for one."""

    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, texts in H.text_slices(batch):
            _, _, grams, own = _anchors(texts, size, k)
            yield grams[np.unique(own[own >= 0])]

    expected = S.total_bytes(docs) * 2 / (size - k + 2)
    if not bits and S.too_many(expected):
        return None
    return S.build(docs.select("text"), keys, bits or S.width_for(expected), heavy)


def _chosen(docs: DataFrame, size: int, k: int, heavy: int, bits: int | None) -> tuple[DataFrame, S.Sketch | None]:
    """docs and the sketch of their anchors; or docs with the places of repeated and of heavy ones, written as they are
    read twice, and None."""

    def places(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        _, starts, grams, own = _anchors(texts, size, k)
        chosen = np.unique(own[own >= 0])
        cuts = np.searchsorted(chosen, starts)
        for t in range(len(texts)):
            at = chosen[cuts[t] : cuts[t + 1]]
            yield at - starts[t], grams[at]

    sketch = anchor_sketch(docs, size, k, heavy, bits)
    if sketch is None:
        return written(S.marked(docs, places, heavy), "marked"), None
    return docs.select("doc_id", "text"), sketch


def _known(shared, batch: pa.RecordBatch, a: int, n: int, starts: np.ndarray, grams: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of anchors at pos: which may be repeated, and which are heavy."""
    sketch = shared.value
    if sketch is not None:
        h = grams[pos]
        return sketch.repeated(h), sketch.is_heavy(h)
    return tuple(S.flags(batch.column(c).slice(a, n), starts, int(starts[-1]) + 1)[pos] for c in ("marks", "heavy"))


def _binary(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _contexts(docs: DataFrame, size: int, k: int, shared) -> DataFrame:
    """(h, around, after, before, doc_id, pos): anchors that may repeat and aren't heavy, with the bytes around them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, left = np.arange(size), -1 - np.arange(size - k)
        for batch in batches:
            doc_ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for a, texts in H.text_slices(batch):
                data, starts, grams, own = _anchors(texts, size, k)
                pos = np.unique(own[own >= 0])
                repeated, heavy = _known(shared, batch, a, len(texts), starts, grams, pos)
                pos = pos[repeated & ~heavy]
                h = grams[pos]
                if not len(pos):
                    continue
                doc = np.searchsorted(starts, pos, side="right") - 1
                after = np.minimum(size, starts[doc + 1] - 1 - pos)
                before = np.minimum(size - k, pos - starts[doc])
                around = np.concatenate([data[np.minimum(pos[:, None] + right, len(data) - 1)] * (right < after[:, None]), data[pos[:, None] + left] * (-left <= before[:, None])], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(H.signed(h)), _binary(around.astype(np.uint8)), pa.array(after.astype(np.int16)), pa.array(before.astype(np.int16)), pa.array(doc_ids[a + doc]), pa.array((pos - starts[doc]).astype(np.int32))],
                    names=["h", "around", "after", "before", "doc_id", "pos"],
                )

    return docs.mapInArrow(scan, "h long, around binary, after short, before short, doc_id long, pos int")


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int, int]]:
    """(first, last, depth, depth of the parent or least - 1) of the interval tree, for depths of at least least.

    lcp[i] is the common-prefix length of rows i and i + 1. One scan with a stack of open intervals.
    """
    stack: list[tuple[int, int]] = []  # first row, depth
    for i, depth in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][1] > depth:
            first, open_depth = stack.pop()
            parent = max(depth, stack[-1][1] if stack else -1, least - 1)
            yield first, i, open_depth, parent
        if depth >= least and (not stack or stack[-1][1] < depth):
            stack.append((first, depth))


def _common(rows: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of neighbouring rows; no longer than what both hold."""
    differ = rows[1:] != rows[:-1]
    out = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.minimum(out, np.minimum(most[1:], most[:-1]))


def _maximal(around: np.ndarray, after: np.ndarray, before: np.ndarray, size: int, k: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """(members, bytes before, bytes after) of the maximal repeats of one anchor's rows, which are sorted and distinct."""
    lefts = around[:, size:]
    for first, last, depth, parent in intervals(_common(around[:, :size], after).tolist(), k):
        least, most = size - depth, min(size - k, size - 1 - parent)
        members = np.arange(first, last + 1)
        members = members[before[members] >= least]
        if len(members) < 2:
            continue
        order = np.argsort(np.ascontiguousarray(lefts[members]).view(f"S{size - k}").ravel(), kind="stable")
        members = members[order]
        shared = _common(lefts[members], before[members])
        for a, b, extent, outer in intervals(shared.tolist(), least):
            if outer < most:  # else the parent's windows are all that reach this far to the left
                yield members[a : b + 1], extent, depth


def _groups(docs: DataFrame, size: int, k: int, shared, listed: bool) -> DataFrame:
    """Of each anchor that a smaller occurrence repeats: (doc_id, lo, hi), the bytes that its repeats cover.
    listed: instead (repeat, doc_id, lo, hi), every maximal repeat with its occurrences; those that agree in
    all bytes around the anchor are listed once, under the longest repeat they share."""

    def judge(table: pa.Table) -> Iterator[pa.RecordBatch]:
        n = table.num_rows
        h, doc, pos, after, before = (table.column(c).to_numpy() for c in ("h", "doc_id", "pos", "after", "before"))
        around = np.frombuffer(b"".join(table.column("around").to_pylist()), dtype=np.uint8).reshape(n, 2 * size - k)
        after, before, pos = after.astype(np.int64), before.astype(np.int64), pos.astype(np.int64)
        same = np.zeros(n, dtype=bool)
        same[1:] = (h[1:] == h[:-1]) & (after[1:] == after[:-1]) & (before[1:] == before[:-1]) & (around[1:] == around[:-1]).all(axis=1)
        reach_left, reach_right = np.where(same, before, -1), np.where(same, after, -1)
        rows: list[tuple] = []
        if listed:
            at = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
            for i in np.flatnonzero(same & (before + after >= size)):
                key = hashlib.sha256(around[i].tobytes()).hexdigest()
                rows += [(key, int(doc[j]), int(pos[j] - before[j]), int(pos[j] + after[j])) for j in ((at[i], i) if not same[i - 1] else (i,))]
        only = np.flatnonzero(~same)  # sorted, distinct contexts; each with its first place
        edges = np.flatnonzero(np.concatenate([[True], h[only][1:] != h[only][:-1], [True]]))
        sizes = np.diff(edges)
        pairs = edges[:-1][sizes == 2]
        if len(pairs) and not listed:  # two rows: one interval, no tree needed
            x, y = only[pairs], only[pairs + 1]
            differ = around[x] != around[y]
            right, left = differ[:, :size], differ[:, size:]
            lcp = np.minimum(np.where(right.any(axis=1), right.argmax(axis=1), size), np.minimum(after[x], after[y]))
            lcs = np.minimum(np.where(left.any(axis=1), left.argmax(axis=1), size - k), np.minimum(before[x], before[y]))
            hit = lcp + lcs >= size
            late = np.where((doc[x] > doc[y]) | ((doc[x] == doc[y]) & (pos[x] > pos[y])), x, y)[hit]
            reach_left[late], reach_right[late] = np.maximum(reach_left[late], lcs[hit]), np.maximum(reach_right[late], lcp[hit])
        for begin, end in zip(edges[:-1][sizes > (1 if listed else 2)], edges[1:][sizes > (1 if listed else 2)], strict=True):
            some = only[begin:end]
            for members, extent, depth in _maximal(around[some], after[some], before[some], size, k):
                at = some[members]
                least = at[np.lexsort((pos[at], doc[at]))[0]]
                if listed:
                    key = hashlib.sha256(around[least, size : size + extent][::-1].tobytes() + around[least, :depth].tobytes()).hexdigest()
                    rows += [(key, int(doc[i]), int(pos[i] - extent), int(pos[i] + depth)) for i in at]
                else:
                    late = at[at != least]
                    reach_left[late], reach_right[late] = np.maximum(reach_left[late], extent), np.maximum(reach_right[late], depth)
        if listed:
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["repeat", "doc_id", "lo", "hi"])
        else:
            found = np.flatnonzero((reach_left >= 0) & (reach_left + reach_right >= size))
            yield pa.RecordBatch.from_arrays([pa.array(doc[found]), pa.array(pos[found] - reach_left[found]), pa.array(pos[found] + reach_right[found])], names=["doc_id", "lo", "hi"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < 8192:
                continue
            table = pa.Table.from_batches(held)
            h = table.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1]))  # the last hash may go on
            if cut:
                yield from judge(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held:
            yield from judge(pa.Table.from_batches(held))

    sorted_suffixes = _contexts(docs, size, k, shared).repartition("h").sortWithinPartitions("h", "around", "after", "before", "doc_id", "pos")
    return sorted_suffixes.mapInArrow(scan, "repeat string, doc_id long, lo long, hi long" if listed else "doc_id long, lo long, hi long")


def _heavy_ranges(docs: DataFrame, size: int, k: int, shared) -> DataFrame:
    """(doc_id, lo, hi) of repeated windows around heavy anchors."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = [[], [], [], []]
        held = 0
        for batch in batches:
            doc_ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for a, texts in H.text_slices(batch):
                data, starts, grams, own = _anchors(texts, size, k)
                at = np.flatnonzero(own >= 0)
                used, back = np.unique(own[at], return_inverse=True)
                at = at[_known(shared, batch, a, len(texts), starts, grams, used)[1][back]]
                if len(at):
                    doc, eight = np.searchsorted(starts, at, side="right") - 1, H.lanes(data)
                    columns = (*(H.content_hash(data, eight, at, np.int64(size), chain) for chain in (0, 1)), doc_ids[a + doc], at - starts[doc])
                    for column, found in zip(kept, columns, strict=True):
                        column.append(found)
                    held += len(at)
                    if held >= S.HELD_ROWS:
                        yield from settled(kept)
                        kept, held = [[], [], [], []], 0
        if held:
            yield from settled(kept)

    def settled(kept: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        wh, h, doc, pos = (np.concatenate(c) for c in kept)
        order = np.lexsort((pos, doc, h, wh))
        wh, h, doc, pos = wh[order], h[order], doc[order], pos[order]
        new = np.ones(len(wh), dtype=bool)
        new[1:] = (wh[1:] != wh[:-1]) | (h[1:] != h[:-1])
        ranges = pa.schema([("wh", pa.int64()), ("h", pa.int64()), ("doc_id", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])
        none = np.zeros(int(new.sum()), np.int64)
        yield from _batches(ranges, H.signed(wh[new]), H.signed(h[new]), doc[new], pos[new], none)
        doc, pos = doc[~new], pos[~new]
        order = np.lexsort((pos, doc))
        doc, pos = doc[order], pos[order]
        if len(doc):
            starts = np.concatenate([[True], (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1)])
            first, last = np.flatnonzero(starts), np.append(np.flatnonzero(starts)[1:], len(doc)) - 1
            spread = H.signed(H.mix(doc[first].view(np.uint64) ^ pos[first].astype(np.uint64)))
            yield from _batches(ranges, spread, spread, doc[first], pos[first], pos[last] + size)

    # read twice: by the aggregation and by the join
    windows = written(docs.mapInArrow(scan, "wh long, h long, doc_id long, lo long, hi long"), "windows")
    least = windows.where("hi = 0").groupBy(F.col("wh").alias("wh1"), F.col("h").alias("h1")).agg(F.min(F.struct("doc_id", "lo")).alias("least"), F.count("*").alias("n")).where("n > 1")
    found = windows.join(least, (windows.wh == least.wh1) & (windows.h == least.h1), "left").where("hi > 0 or struct(doc_id, lo) > least")
    return found.select("doc_id", "lo", F.when(F.col("hi") > 0, F.col("hi")).otherwise(F.col("lo") + size).alias("hi"))


def _batches(schema: pa.Schema, *columns: np.ndarray, most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), most):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + most], f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def repeat_groups(docs: DataFrame, size: int = 100, k: int = ANCHOR, bits: int | None = None) -> DataFrame:
    """(repeat, doc_id, lo, hi, first): the maximal repeats around each anchor, cut to `size` bytes after the anchor
    and size - k before it, with all their occurrences."""
    docs = docs.where("doc_id is not null")
    docs, sketch = _chosen(docs, size, k, 0, bits)
    found = _groups(docs, size, k, docs.sparkSession.sparkContext.broadcast(sketch), listed=True).distinct()
    # an anchor that only some occurrences have chosen lists those; the repeat's own anchor lists all
    least = found.groupBy("repeat").agg(F.min(F.struct("doc_id", "lo")).alias("least"))
    return found.join(least, "repeat").select("repeat", "doc_id", "lo", "hi", F.expr("struct(doc_id, lo) = least").alias("first"))


def repeated_ranges(docs: DataFrame, size: int = 100, k: int = ANCHOR, heavy: int = HEAVY, bits: int | None = None) -> DataFrame:
    """(doc_id, ranges): byte ranges, which may overlap, covered by repeats that also start earlier."""
    docs = docs.where("doc_id is not null")
    docs, sketch = _chosen(docs, size, k, heavy, bits)
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    found = _groups(docs, size, k, shared, listed=False)
    if sketch is None or (sketch.many is not None and sketch.many.any()):
        found = found.unionByName(_heavy_ranges(docs, size, k, shared))
    return found.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))


def remove_repeats(docs: DataFrame, size: int = 100, k: int = ANCHOR, heavy: int = HEAVY, bits: int | None = None, kept: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept binary, the remaining bytes)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, found = batch.column("doc_id"), batch.column("ranges")
            for a, texts in H.text_slices(batch):
                out: list[list] = [[], [], [], [], []]
                for text, ranges in zip(texts, found.slice(a, len(texts)).to_pylist(), strict=True):
                    spans: list[list[int]] = []
                    for lo, hi in sorted((r["lo"], min(r["hi"], len(text))) for r in ranges or ()):
                        if spans and lo <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], hi)
                        elif lo < hi:
                            spans.append([lo, hi])
                    edges = [0, *(x for s in spans for x in s), len(text)]
                    rest = b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)) if spans else text
                    for column, x in zip(out, (len(text), len(text) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest), strict=True):
                        column.append(x)
                names, kinds = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 4 + kept], [pa.int64()] * 3 + [pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([doc_ids.slice(a, len(texts)), *(pa.array(c, t) for c, t in zip(out[: 4 + kept], kinds, strict=False))], names=["doc_id", *names])

    joined = docs.select("doc_id", "text").join(repeated_ranges(docs, size, k, heavy, bits), "doc_id", "left")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if kept else ""))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, length(hex(encode(coalesce(text, '')))) // 2 AS n FROM documents),
win AS (SELECT doc_id, i, substr(x, 2 * i + 1, 200) AS g FROM (SELECT doc_id, x, unnest(range(0, n - 99)) AS i FROM d WHERE n >= 100)),
dup AS (SELECT win.doc_id, win.i FROM win JOIN (SELECT g, min((doc_id, i)) AS least FROM win GROUP BY g HAVING count(*) > 1) f ON win.g = f.g WHERE (win.doc_id, win.i) <> f.least),
cut AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM dup)),
runs AS (SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi FROM cut GROUP BY doc_id, run),
gaps AS (SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS a, lo AS b FROM runs UNION ALL SELECT doc_id, max(hi), NULL FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' ORDER BY a) AS t FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
gone AS (SELECT doc_id, sum(hi - lo) AS k, count(*) AS spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(k, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(t, x))) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
