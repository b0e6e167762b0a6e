"""N-gram Jaccard self-join by T-occurrence search with DivideSkip, and the components of its links.

Each document is the set of its word n-grams (64-bit hashes of content hashes of words). Equal sets are one node. To reach a similarity, two sets
must share an n-gram among the first few of each, in an order that all tasks agree on: n-grams that a merged sketch
marks as frequent come last. The leading n-grams are written once, cut into slices by their hash so that the largest
sketch can tell one slice's repeated n-grams from the others; a set of which too few in all slices may occur in another
set's too is linked with none. The others' leading n-grams are gathered by one shuffle, apart for sizes that can't be
linked; each list gets its smallest set as hub, and every set on the list is sent to that hub once, however many n-grams
they share. So each pair that can reach the similarity meets at a hub, and no list is expanded into pairs. Only texts
of sets at a hub are shuffled.

At a hub the sets' inverted lists answer a T-occurrence query for each set. DivideSkip divides them: of L long lists and
the short rest, a partner stands on T - L short ones at least. Those are merged with a heap, which counts occurrences
and skips what can't reach T - L any more; only the sets found are looked up in the long lists, by binary search, and
those that reach the overlap that both sizes ask for are links. Sets already in one component aren't looked up again. Hubs with more than `block` sets are cut into chunks, and every pair of chunks is
searched on its own, so no task holds an unbounded group.

Defined results: null, empty and blank texts have an empty set and are linked with nothing (n 0, component: their own
id); a text of fewer words than `size` is one n-gram, its whole sequence; equal texts are linked; rows without a doc_id
take no part; of rows that share a doc_id, each keeps its row, they share that id, and dedup() keeps or drops them
together; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.llm import hashing as H
from candor.llm import sketch as S
from candor.llm.components import connected_components
from candor.llm.shared import dropped, giving_back, without, written

#: Sets at a hub that one task searches at once, and n-grams in them.
BLOCK, BLOCK_GRAMS = 2048, 4 << 20
#: n-grams counted so often come last in the order, and so often in a task to be counted at all.
FREQUENT, LOCAL = 64, 4
_FREQUENT_BITS = 20
#: Of the hashes of leading n-grams, the bytes that are kept, and rows of them that meet at once.
KEY_BYTES, MEET_ROWS = 5, 1 << 18
#: What a step of a merge costs, as a share of a look-up; sets how many lists are long.
MU = 0.0085


def gram_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    words = H.Words(texts, lower=True)
    grams = H.gram_hash(words.hash, size)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(grams[a : b - size + 1])
        else:
            yield H.gram_hash(words.hash[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def _digest(grams: np.ndarray) -> tuple[int, int]:
    return tuple(int(H.mix(grams * np.uint64(m) + np.uint64(m >> 7)).sum(dtype=np.uint64).view(np.int64)) for m in (0xA24BAED4963EE407, 0x9FB21C651E98DF25))


def prefix_length(n: int, percent: int) -> int:
    """Of so many n-grams in the common order, sets of the similarity share one at least."""
    return n - -(-percent * n // 100) + 1


def leading(grams: np.ndarray, percent: int, frequent: S.Sketch) -> np.ndarray:
    """The first n-grams in the common order, rare ones before frequent ones, then by hash: twice the prefix.

    The first k n-grams that two linked sets share stand among the first prefix_length + k - 1 of each.
    """
    late = frequent.is_heavy(grams)
    return np.concatenate([grams[~late], grams[late]])[: 2 * prefix_length(len(grams), percent) - 1]


def least_shared(n: int, percent: int) -> int:
    """How many of its leading n-grams a set shares with a linked one of any size, also among the other's leading."""
    return prefix_length(-(-percent * n // 100), percent)


def size_class(n: int, percent: int) -> int:
    """Sizes of linked sets are in one class or in neighbouring ones."""
    return int(math.log(n) / (1.0001 * math.log(100 / percent)))


def _base(docs: DataFrame, size: int) -> DataFrame:
    """One table of two kinds of rows: (doc_id, n, d1, d2) of documents, and parts of the sketch of n-gram counts."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("place", pa.int32()), ("cells", pa.binary())])

    @giving_back
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for a, texts in H.text_slices(batch):
                rows = []
                for grams in gram_sets(texts, size):
                    rows.append((len(grams), *_digest(grams)))
                    keys.append(grams)
                    held += len(grams)
                if held > 4_000_000:  # what is rare here so far can be left out: counts only guide the order
                    some, times = np.unique(np.concatenate(keys), return_counts=True)
                    keys = [np.repeat(some[times > 1], times[times > 1])]
                    held = len(keys[0]) // 2
                columns = [batch.column("doc_id").slice(a, len(texts)), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(texts), pa.int32()), pa.nulls(len(texts), pa.binary())], schema=schema)
        if keys:
            places, payloads = S.partial(np.concatenate(keys), _FREQUENT_BITS, True, LOCAL)
            none = pa.nulls(len(places), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(places, pa.int32()), pa.array(payloads, pa.binary())], schema=schema)

    return written(docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, n long, d1 long, d2 long, place int, cells binary"), "sets")


def pack(grams: np.ndarray) -> bytes:
    """The upper KEY_BYTES of each hash."""
    return (grams >> np.uint64(64 - 8 * KEY_BYTES)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def unpack(bodies: list[bytes]) -> np.ndarray:
    """What pack() made of several sets, one behind the other, as numbers."""
    held = np.frombuffer(b"".join(bodies), dtype=np.uint8).reshape(-1, KEY_BYTES)
    out = np.zeros((len(held), 8), dtype=np.uint8)
    out[:, :KEY_BYTES] = held
    return out.reshape(-1).view("<u8").astype(np.uint64)


def _leads(docs: DataFrame, size: int, percent: int, frequent: S.Sketch, slices: int) -> DataFrame:
    """(slice, d1, n, need, first, more): each set's leading n-grams of a slice of all, those of its prefix apart, and how
    many leading ones of all slices a linked set shares at least. Sets that a task meets again are left out."""
    order = docs.sparkSession.sparkContext.broadcast(frequent)

    @giving_back
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, texts in H.text_slices(batch):
                rows = []
                for grams in gram_sets(texts, size):
                    n = len(grams)
                    if not n or (d1 := _digest(grams)[0]) in seen:
                        continue
                    seen.add(d1)
                    lead, first = leading(grams, percent, order.value), prefix_length(n, percent)
                    of = lead >> np.uint64(64 - 8 * KEY_BYTES)
                    of %= np.uint64(slices)
                    for s in range(slices):
                        mine = of == np.uint64(s)
                        if mine.any():
                            rows.append((s, d1, n, least_shared(n, percent), pack(lead[:first][mine[:first]]), pack(lead[first:][mine[first:]])))
                if rows:
                    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["slice", "d1", "n", "need", "first", "more"])

    return written(docs.select("text").mapInArrow(scan, "slice int, d1 long, n int, need int, first binary, more binary"), "leads", by="slice" if slices > 1 else None)


def _repeated(leads: DataFrame, bits: int, whole: bool) -> DataFrame:
    """(d1, n, need, hits, chosen) of one slice: how many leading n-grams may be another set's too, and which of the
    prefix. whole: the slice holds all, so sets with too few hits go at once."""

    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for c in ("first", "more"):
            yield unpack(batch.column(c).to_pylist())

    repeated = leads.sparkSession.sparkContext.broadcast(S.build(leads.select("first", "more"), keys, bits))

    @giving_back
    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, more = (batch.column(c).to_pylist() for c in ("first", "more"))
            lead, rest = unpack(first), unpack(more)
            maybe, later = repeated.value.repeated(lead), repeated.value.repeated(rest)
            ends, more_ends = (np.cumsum([0, *(len(x) // KEY_BYTES for x in c)]) for c in (first, more))
            among, others = (np.concatenate([[0], np.cumsum(x)]) for x in (maybe, later))
            hits = among[ends[1:]] - among[ends[:-1]] + others[more_ends[1:]] - others[more_ends[:-1]]
            kept = np.flatnonzero(hits >= (batch.column("need").to_numpy() if whole else 1))
            lead = lead << np.uint64(64 - 8 * KEY_BYTES)
            chosen = [pack(lead[ends[i] : ends[i + 1]][maybe[ends[i] : ends[i + 1]]]) for i in kept.tolist()]
            taken = [batch.column(c).take(pa.array(kept)) for c in ("d1", "n", "need")]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(hits[kept].astype(np.int32)), pa.array(chosen, pa.binary())], names=["d1", "n", "need", "hits", "chosen"])

    return leads.select("d1", "n", "need", "first", "more").mapInArrow(test, "d1 long, n int, need int, hits int, chosen binary")


def meetings(gram: np.ndarray, d1: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(d1, n, hub) of the sets on lists of several sets; each n-gram has a list for two neighbouring classes of sizes,
    and the smallest set of a list is its hub."""
    sizes, which = np.unique(n, return_inverse=True)
    c = np.array([size_class(int(x), percent) for x in sizes], dtype=np.int64)[which]
    gram, c, d1, n = np.tile(gram, 2), np.concatenate([c, c + 1]), np.tile(d1, 2), np.tile(n, 2)
    order = np.lexsort((d1, c, gram))
    gram, c, d1, n = gram[order], c[order], d1[order], n[order]
    begins = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (c[1:] != c[:-1])]))
    sets = np.diff(np.append(begins, len(gram)))
    hub, most = np.repeat(d1[begins], sets), np.repeat(d1[begins + sets - 1], sets)
    d1, n, hub = (x[hub < most] for x in (d1, n, hub))
    _, at = np.unique(np.stack([d1, hub]), axis=1, return_index=True) if len(d1) else (None, np.zeros(0, np.int64))
    return d1[at], n[at], hub[at]


def _memberships(docs: DataFrame, size: int, percent: int, frequent: S.Sketch) -> DataFrame:
    """(d1, n, hub): the hubs to which each set goes."""
    # some six bytes a word, so many of its n-grams lead
    keys = S.total_bytes(docs) / 6 * 2 * (100 - percent) / 100
    slices = max(1, math.ceil(keys / (1 << S.MOST_BITS - 1)))
    leads = _leads(docs, size, percent, frequent, slices)
    if slices == 1:
        tested = _repeated(leads, S.width_for(keys), True)
    else:
        parts = [written(_repeated(leads.where(F.col("slice") == s), S.width_for(keys / slices), False), "tested") for s in range(slices)]
        every = reduce(DataFrame.unionByName, parts)
        enough = every.groupBy("d1").agg(F.sum("hits").alias("hits"), F.first("need").alias("need")).where("hits >= need").select("d1")
        tested = every.join(enough, "d1", "left_semi")

    @giving_back
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = batch.column("chosen").to_pylist()
            at = pa.array(np.repeat(np.arange(len(chosen)), [len(x) // KEY_BYTES for x in chosen]))
            yield pa.RecordBatch.from_arrays([pa.array(unpack(chosen).astype(np.int64)), batch.column("d1").take(at), batch.column("n").take(at)], names=["gram", "d1", "n"])

    @giving_back
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by n-gram; whole n-grams are handled together."""

        def made(rows: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in meetings(*rows, percent)], names=["d1", "n", "hub"])

        held, count, most = [], 0, MEET_ROWS
        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in ("gram", "d1", "n")])
            count += batch.num_rows
            if count >= most:
                rows = [np.concatenate(c) for c in zip(*held, strict=True)]
                cut = int(np.searchsorted(rows[0], rows[0][-1]))
                if cut:
                    yield made([c[:cut] for c in rows])
                held, count = [[c[cut:] for c in rows]], len(rows[0]) - cut
                most = max(MEET_ROWS, 2 * count)
        if count:
            yield made([np.concatenate(c) for c in zip(*held, strict=True)])

    rows = tested.select("d1", "n", "chosen").mapInArrow(spread, "gram long, d1 long, n int")
    member = written(rows.repartition("gram").sortWithinPartitions("gram").mapInArrow(meet, "d1 long, n int, hub long").distinct(), "members")
    for old in (leads, *([] if slices == 1 else parts)):
        dropped(old)
    return member


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without most rows whose doc_id isn't in ids, before any text is shuffled."""

    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield H.mix(batch.column("doc_id").to_numpy().view(np.uint64))

    present = docs.sparkSession.sparkContext.broadcast(S.build(ids.select("doc_id"), keys, S.width_for(2 * ids.count()), single=True))

    @giving_back
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(present.value.present(next(keys(batch)))))

    return docs.mapInArrow(scan, docs.schema)


def long_lists(least: int, longest: int) -> int:
    """How many lists, the longest ones, are looked up instead of merged: fewer, the longer the longest of them is."""
    return min(least - 1, int(least / (MU * math.log2(max(longest, 2)) + 1)))


def merge_skip(lists: list[list[int]], need: int) -> Iterator[tuple[int, int]]:
    """(value, times) of the values on `need` or more of the ascending lists.

    The heap holds the head of each list. Where its least value is on too few lists, need - 1 lists are taken off and
    moved on, by binary search, to the least head of the others: what they skip is on need - 1 lists at most.
    """
    at = [0] * len(lists)
    heap = [(values[0], k) for k, values in enumerate(lists) if values]
    heapq.heapify(heap)
    while len(heap) >= need:
        value, taken = heap[0][0], []
        while heap and heap[0][0] == value:
            taken.append(heapq.heappop(heap)[1])
        if len(taken) >= need:
            yield value, len(taken)
            for k in taken:
                at[k] += 1
        else:
            while len(taken) < need - 1:
                taken.append(heapq.heappop(heap)[1])
            for k in taken:
                at[k] = bisect_left(lists[k], heap[0][0], at[k])
        for k in taken:
            if at[k] < len(lists[k]):
                heapq.heappush(heap, (lists[k][at[k]], k))


def divide_skip(sets: list[np.ndarray], percent: int, chunks: list[int] | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that connect all sets of one block that reach the similarity, directly or through others.

    chunks: of each set, 0 or 1; then only pairs of different chunks are looked for.
    """
    m = len(sets)
    rank = np.argsort([len(s) for s in sets], kind="stable")
    sizes = np.array([len(sets[i]) for i in rank])
    every = np.concatenate([sets[i] for i in rank])
    holder = np.repeat(np.arange(m, dtype=np.int64), sizes)
    order = np.argsort(every, kind="stable")  # holders ascend within a token
    tokens, where, counts = np.unique(every[order], return_inverse=True, return_counts=True)
    lists = holder[order]
    ends = np.cumsum(counts)
    token_of = np.empty(len(every), dtype=np.int64)
    token_of[order] = where
    begins = np.concatenate([[0], np.cumsum(sizes)])
    side = np.array([chunks[i] for i in rank]) if chunks else None
    group = np.arange(m)
    links = []
    for x in range(m):
        n = int(sizes[x])
        mine = token_of[begins[x] : begins[x + 1]]
        mine = mine[counts[mine] > 1]
        t = -(-2 * percent * n // (100 + percent))  # what a set of the same size must share; larger ones more
        if len(mine) < t or (group[x + 1 :] == group[x]).all():
            continue
        by_length = mine[np.argsort(counts[mine], kind="stable")]
        n_long = long_lists(t, int(counts[by_length[-1]]))
        short, long = by_length[: len(mine) - n_long], by_length[len(mine) - n_long :]
        later = (lists[ends[k] - counts[k] : ends[k]] for k in short.tolist())
        for y, in_short in merge_skip([a[np.searchsorted(a, x + 1) :].tolist() for a in later], t - n_long):
            if group[y] == group[x] or 100 * n < percent * sizes[y] or (side is not None and side[y] == side[x]):
                continue
            need = -(-percent * (n + int(sizes[y])) // (100 + percent))
            if in_short + n_long >= need and in_short + _probe(token_of[begins[y] : begins[y + 1]], long) >= need:
                links.append((int(rank[x]), int(rank[y])))
                group[group == group[y]] = group[x]
    return links


def _probe(held: np.ndarray, tokens: np.ndarray) -> int:
    """How many of the tokens' lists hold a set, by binary search in the set (its token numbers ascend)."""
    at = np.searchsorted(held, tokens)
    at[at == len(held)] = 0
    return int((held[at] == tokens).sum())


def links(docs: DataFrame, size: int, percent: int, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(base(doc_id, n, d1, d2), links(a, b) between the smallest documents of different sets)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    both = _base(docs, size)
    base = both.where("doc_id is not null").select("doc_id", "n", "d1", "d2")
    frequent = S.merged(both.where("place is not null").select("place", "cells"), _FREQUENT_BITS, FREQUENT)
    member = _memberships(docs, size, percent, frequent)
    needed = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / BLOCK_GRAMS)).cast("int")
    chunked = member.groupBy("hub").agg(needed.alias("parts")).where("parts > 1")
    dealt = member.drop("n").join(chunked, "hub", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("d1"), F.col("parts")).cast("int")
    places = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct("hub", F.least(x, "part").alias("i"), F.greatest(x, "part").alias("j"), "part"))
    sent = dealt.withColumn("part", part).select("d1", F.explode(places).alias("place")).groupBy("d1").agg(F.collect_list("place").alias("places"))
    nodes = base.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"))
    to_send = written(nodes.join(sent, "d1").groupBy("doc_id").agg(F.flatten(F.collect_list("places")).alias("places")), "places")

    @giving_back
    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in H.text_slices(batch):
                out: list[list] = [[], [], [], [], [], []]
                for k, grams in enumerate(gram_sets(texts, size), a):
                    doc_id, body = batch.column("doc_id")[k].as_py(), grams.tobytes()
                    for p in batch.column("places")[k].as_py():
                        for column, v in zip(out, (p["hub"], p["i"], p["j"], p["part"], doc_id, body), strict=True):
                            column.append(v)
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["hub", "i", "j", "part", "doc_id", "grams"])

    @giving_back
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: dict[int, tuple[int, bytes]], key: tuple) -> Iterator[pa.RecordBatch]:
            ids = list(rows)
            if len(ids) > 1:
                pairs = divide_skip([np.frombuffer(rows[i][1], dtype=np.uint64) for i in ids], percent, [rows[i][0] for i in ids] if key[1] != key[2] else None)
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array([ids[a] for a, _ in pairs], pa.int64()), pa.array([ids[b] for _, b in pairs], pa.int64())], names=["a", "b"])

        at, rows = None, {}
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("hub", "i", "j")), strict=True))
            parts, ids, grams = (batch.column(c) for c in ("part", "doc_id", "grams"))
            for k, key in enumerate(keys):
                if key != at:
                    yield from found(rows, at)
                    at, rows = key, {}
                rows[ids[k].as_py()] = (int(parts[k].as_py() != key[1]), grams[k].as_py())
        yield from found(rows, at)

    shipped = _only(docs, to_send).join(to_send, "doc_id").mapInArrow(ship, "hub long, i int, j int, part int, doc_id long, grams binary")
    blocks = shipped.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "doc_id")
    return base, blocks.mapInArrow(search, "a long, b long")


def components(docs: DataFrame, size: int = 4, percent: int = 85, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links reach."""
    base, found = links(docs, size, percent, block)
    labels = connected_components(found)
    nodes = base.groupBy("d1", "d2").agg(F.min("doc_id").alias("id"))
    named = nodes.join(labels, "id", "left").select("d1", "d2", F.coalesce("component", "id").alias("component"))
    return base.join(named, ["d1", "d2"]).select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def dedup(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs without those that a smaller doc_id of their component stands for."""
    gone = written(components(docs, size, percent).where("component_id < doc_id").select(F.col("doc_id").alias("gone_id")), "gone")
    kept, doubtful = _split(docs, gone)
    return kept.unionByName(without(doubtful, gone))


def _split(docs: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs that surely aren't in gone(gone_id), the others, which are few more than those): only the latter need a shuffle."""

    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield H.mix(batch.column("gone_id").to_numpy().view(np.uint64))

    present = docs.sparkSession.sparkContext.broadcast(S.build(gone, keys, S.width_for(2 * gone.count()), single=True))

    def test(ids: pd.Series) -> pd.Series:
        return pd.Series(present.value.present(H.mix(ids.to_numpy(dtype=np.int64).view(np.uint64))))

    # rows without a doc_id stay in any case
    maybe = F.pandas_udf(test, "boolean")(F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))) & F.col("doc_id").isNotNull()
    return docs.where(~maybe), docs.where(maybe)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(0, len(w) - 3), lambda i: array_to_string(w[i + 1 : i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
e AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
r AS (SELECT doc_id AS id, doc_id AS c FROM w UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)
SELECT w.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.id = w.doc_id GROUP BY w.doc_id
"""
