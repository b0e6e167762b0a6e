"""Substring dedup over word windows with a count-min prefilter.

A window is `size` consecutive words of one document. Pass one counts, in one sketch per task, the sub-window
that each window chooses (its smallest hash, so that equal windows choose the same place); the merged sketch
overestimates how often a window occurs. Pass two emits only windows whose sub-window may be repeated and groups
them exactly: by two independent hashes of 64 bits over the contents of their words. No repeated window is lost. Where
sub-windows are too many for a sketch (sketch.too_many), their hashes are shuffled and counted; the result is the same.

Defined results: a null or blank text has no words and loses none; a text of fewer than `size` words loses none;
of rows that share a doc_id, each loses what a smaller id holds at the places found for that id, and windows of
equal ids never remove each other; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candor.llm import hashing as H
from candor.llm import sketch as S

#: Words of the sub-window that stands for a window in the sketch.
SUB_WINDOW = 20


def _candidates(texts: list[bytes], size: int, sub: int) -> tuple[H.Words, np.ndarray, np.ndarray]:
    """Words, sub-window hashes, and for each window start its sub-window (-1: no window starts there)."""
    words = H.Words(texts)
    grams = H.gram_hash(words.hash, sub)
    own = H.owners(grams, size - sub + 1)
    whole = words.whole(size)
    return words, grams, np.where(whole, own[: len(whole)], -1) if len(whole) else np.zeros(0, np.int64)


def window_sketch(docs: DataFrame, size: int, sub: int, bits: int | None = None) -> S.Sketch | None:
    """None where sub-windows are too many for one."""

    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, texts in H.text_slices(batch):
            _, grams, own = _candidates(texts, size, sub)
            yield grams[np.unique(own[own >= 0])]

    # about one sub-window is chosen in every (size - sub + 2) / 2 words of some six bytes
    expected = S.total_bytes(docs) / 6 * 2 / (size - sub + 2)
    if not bits and S.too_many(expected):
        return None
    return S.build(docs.select("text"), keys, bits or S.width_for(expected))


def marked_windows(docs: DataFrame, size: int, sub: int) -> DataFrame:
    """docs with the places of their chosen sub-windows that occur twice or more."""

    def places(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        words, grams, own = _candidates(texts, size, sub)
        chosen = np.unique(own[own >= 0])
        cuts = np.searchsorted(chosen, words.first)
        for k in range(len(texts)):
            at = chosen[cuts[k] : cuts[k + 1]]
            yield at - words.first[k], grams[at]

    return S.marked(docs, places)


_WINDOWS = pa.schema([("wh", pa.int64()), ("other", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32()), ("len", pa.int32())])


def candidate_windows(docs: DataFrame, size: int, sub: int, sketch: S.Sketch | None) -> DataFrame:
    """Rows (wh, other, doc_id, pos, len): windows that may be repeated, each once a task and pair of hashes (len 0: to
    be judged); and, with len > 0, runs of window starts that the task itself has found in a smaller document."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    docs = marked_windows(docs, size, sub).drop("heavy") if sketch is None else docs.select("doc_id", "text")

    def settled(found: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        wh, other, doc, pos = (np.concatenate(c) for c in found)
        order = np.lexsort((pos, doc, other, wh))
        wh, other, doc, pos = wh[order], other[order], doc[order], pos[order]
        new = np.ones(len(wh), dtype=bool)
        new[1:] = (wh[1:] != wh[:-1]) | (other[1:] != other[:-1])
        least = doc[np.flatnonzero(new)][np.cumsum(new) - 1] if len(doc) else doc
        later = doc > least
        # of a document's own repeats, the first is enough to judge the hashes; all must learn the answer
        yield from _batches(_WINDOWS, H.signed(wh[~later]), H.signed(other[~later]), doc[~later], pos[~later], np.zeros((~later).sum(), np.int32))
        doc, pos = doc[later], pos[later]
        order = np.lexsort((pos, doc))
        doc, pos = doc[order], pos[order]
        if len(doc):
            first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1)]))
            count = np.diff(np.append(first, len(doc))).astype(np.int32)
            spread = H.signed(H.mix(doc[first].view(np.uint64) ^ pos[first].astype(np.uint64)))
            yield from _batches(_WINDOWS, spread, spread, doc[first], pos[first], count)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        found: list[list[np.ndarray]] = [[], [], [], []]
        held = 0
        for batch in batches:
            doc_ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for a, texts in H.text_slices(batch):
                words, grams, own = _candidates(texts, size, sub)
                at = np.flatnonzero(own >= 0)
                if known is None:
                    at = at[S.flags(batch.column("marks").slice(a, len(texts)), words.first, len(words.doc) + 1)[own[at]]]
                else:
                    used, back = np.unique(own[at], return_inverse=True)
                    at = at[known.repeated(grams[used])[back]]
                columns = (H.gram_hash(words.hash, size)[at], H.gram_hash(words.hashes(1), size)[at], doc_ids[a + words.doc[at]], (at - words.first[words.doc[at]]).astype(np.int32))
                for column, x in zip(found, columns, strict=True):
                    column.append(x)
                held += len(at)
                if held >= S.HELD_ROWS:
                    yield from settled(found)
                    found, held = [[], [], [], []], 0
        if held:
            yield from settled(found)

    return docs.mapInArrow(scan, "wh long, other long, doc_id long, pos int, len int")


def _batches(schema: pa.Schema, *columns: np.ndarray, most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), most):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + most], f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def repeated_starts(docs: DataFrame, size: int = 50, sub: int = SUB_WINDOW, bits: int | None = None) -> DataFrame:
    """(doc_id, runs array<struct<pos, len>>): starts of windows that also start in a document of smaller id."""
    docs = docs.where("doc_id is not null")
    windows = candidate_windows(docs, size, sub, window_sketch(docs, size, sub, bits))
    # one exchange and no second scan; a pair of hashes has a row from each task at most, and those of one document
    least = F.min(F.when(F.col("len") == 0, F.col("doc_id"))).over(Window.partitionBy("wh", "other"))
    found = windows.withColumn("least", least).where("len > 0 or doc_id > least")
    return found.select("doc_id", F.struct("pos", F.greatest("len", F.lit(1)).alias("len")).alias("run")).groupBy("doc_id").agg(F.collect_list("run").alias("runs"))


def dedup_windows(docs: DataFrame, size: int = 50, sub: int = SUB_WINDOW, bits: int | None = None, texts: bool = True) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_removed, kept_sha256 and, unless texts is false, text (kept words joined by a space)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, found = batch.column("doc_id"), batch.column("runs")
            for a, some in H.text_slices(batch):
                n_words, n_removed, kept_texts, digests = [], [], [], []
                for text, runs in zip(some, found.slice(a, len(some)).to_pylist(), strict=True):
                    split = text.split()
                    n = len(split)
                    gone = np.zeros(n + 1, dtype=np.int64)
                    for run in runs or ():
                        if run["pos"] < n:  # else it is of another row with this doc_id
                            gone[run["pos"]] += 1
                            gone[min(n, run["pos"] + run["len"] + size - 1)] -= 1
                    keep = np.cumsum(gone[:n]) == 0
                    kept = b" ".join([split[k] for k in np.flatnonzero(keep)] if runs else split)
                    n_words.append(n)
                    n_removed.append(n - int(keep.sum()))
                    digests.append(hashlib.sha256(kept).hexdigest())
                    kept_texts.append(kept)
                columns = [doc_ids.slice(a, len(some)), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if texts:
                    columns, names = [*columns, pa.array(kept_texts, pa.binary()).cast(pa.string())], [*names, "text"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    joined = docs.select("doc_id", "text").join(repeated_starts(docs, size, sub, bits), "doc_id", "left")
    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", text string" if texts else ""))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 50], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM win) WHERE doc_id > least),
cut AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM dup)),
runs AS (SELECT doc_id, min(i) AS lo, max(i) + 50 AS hi FROM cut GROUP BY doc_id, run),
gaps AS (SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS a, lo AS b FROM runs UNION ALL SELECT doc_id, max(hi), NULL FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(array_to_string(w[a + 1 : coalesce(b, len(w))], ' '), ' ' ORDER BY a) AS t FROM gaps JOIN d USING (doc_id) WHERE coalesce(b, len(w)) > a GROUP BY doc_id),
gone AS (SELECT doc_id, sum(hi - lo) AS n FROM runs GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ') ELSE coalesce(t, '') END) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
