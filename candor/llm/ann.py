"""Approximate nearest neighbours with balanced posting lists on disk and a graph of their centroids in memory.

Centroids are fitted on a bounded sample by balanced k-means: after each round, centroids of the emptiest lists move
into the fullest ones. Every vector is indexed: under its nearest centroid, and also under further ones, `replicas` in all, whose distance is at most
(1 + `boundary`) times the nearest. (Leaving out centroids that lie near one already chosen is no option where centroids
are nearer to each other than vectors are to them, as in many dimensions: then no vector would have a replica.) Only the centroids, at most `most_centroids`, are held in memory and broadcast, with a neighbour graph that
best-first search walks; the graph's start points are spread over the centroids. A query reads the lists whose centroid
is at most (1 + `prune`) times as far as the nearest, up to `most_lists`, but never less than the nearest `share` of all
lists: with a fixed number of lists recall falls as tables grow. Where that share is more than `beam`, centroids are
ranked by all distances instead of the graph. Lists longer than `block` rows are cut into parts, and queries into blocks
of about `queries`; a task holds one part and one block. Distances are exact, in double precision, also where squares
would overflow.

Defined results: vectors that are null, all zero, of another length than most, or with null or non-finite parts take no
part, neither as queries nor as candidates; a query is never its own neighbour; equal distances go to the smaller
vec_id; with fewer candidates than k, all are returned (a second search over all rows completes queries whose lists
hold too few); rows of one vec_id: one of them takes part; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candor.llm.shared import written


#: Queries whose lists one batch holds.
ROUTED = 16


@dataclass(frozen=True)
class Settings:
    sample: int = 20_000  # vectors that centroids are fitted on
    per_list: int = 200  # rows of a list, wished for
    most_centroids: int = 4096
    boundary: float = 0.15
    replicas: int = 4
    prune: float = 0.2
    most_lists: int = 96
    share: float = 0.15  # of the lists, read at least
    degree: int = 24  # of the graph
    beam: int = 160
    block: int = 4096
    queries: int = 8192  # in a task at once


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>): one row for each vec_id with a usable vector."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None], 0)


def fit_centroids(x: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Balanced k-means: after each round, centroids of the emptiest lists move into the fullest ones."""
    rng = np.random.default_rng(11)
    n = min(n, len(x))
    c = x[rng.choice(len(x), n, replace=False)]
    for k in range(rounds):
        near = np.concatenate([_squares(x[i : i + 2048], c).argmin(1) for i in range(0, len(x), 2048)])
        size = np.bincount(near, minlength=n)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
        if k < rounds - 1:
            order = np.argsort(size)
            for low, high in zip(order[: n // 8], order[::-1][: n // 8], strict=True):
                if size[high] > 2 * len(x) / n and size[low] < 0.5 * len(x) / n:
                    c[low] = x[rng.choice(np.flatnonzero(near == high))]
    return c


class Graph:
    """Centroids with their nearest neighbours; searched best-first."""

    def __init__(self, centroids: np.ndarray, degree: int):
        self.c = centroids
        n = len(centroids)
        near = np.concatenate([np.argsort(_squares(centroids[i : i + 512], centroids), axis=1)[:, : degree + 1] for i in range(0, n, 512)])
        both: list[set[int]] = [set(row.tolist()) - {i} for i, row in enumerate(near)]
        for i, row in enumerate(near.tolist()):
            for j in row[: degree // 2]:
                if j != i:
                    both[j].add(i)  # so that every node can be reached
        self.neighbours = [np.fromiter(s, dtype=np.int64) for s in both]
        self.starts = np.arange(0, n, max(1, n // 32))

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroids found and their distances, nearest first, at most beam."""
        seen = np.zeros(len(self.c), dtype=bool)
        seen[self.starts] = True
        d = np.sqrt(((self.c[self.starts] - q) ** 2).sum(1))
        open_nodes = list(zip(d.tolist(), self.starts.tolist(), strict=True))
        best = [(-a, b) for a, b in open_nodes]
        heapq.heapify(open_nodes)
        heapq.heapify(best)
        while open_nodes:
            far, node = heapq.heappop(open_nodes)
            if len(best) >= beam and far > -best[0][0]:
                break
            new = self.neighbours[node]
            new = new[~seen[new]]
            seen[new] = True
            for a, b in zip(np.sqrt(((self.c[new] - q) ** 2).sum(1)).tolist(), new.tolist(), strict=True):
                if len(best) < beam or a < -best[0][0]:
                    heapq.heappush(open_nodes, (a, b))
                    heapq.heappush(best, (-a, b))
                    if len(best) > beam:
                        heapq.heappop(best)
        found = sorted((-a, b) for a, b in best)
        return np.array([b for _, b in found], dtype=np.int64), np.array([a for a, _ in found])


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    v = batch.column("v")
    return batch.column("vec_id").to_numpy(zero_copy_only=False), np.asarray(v.flatten()).reshape(len(v), -1) if len(v) else np.zeros((0, 1))


def _pruned(graph: Graph, q: np.ndarray, s: Settings) -> np.ndarray:
    least = math.ceil(s.share * len(graph.c))
    if least > s.beam:
        d = np.sqrt(((graph.c - q) ** 2).sum(1))
        near = np.argsort(d, kind="stable")
        far = d[near]
    else:
        near, far = graph.search(q, s.beam)
    within = int((far[: s.most_lists] <= (1 + s.prune) * far[0] + 1e-12).sum())
    return near[: max(within, least)]


def _replicas(graph: Graph, q: np.ndarray, s: Settings) -> list[int]:
    near, far = graph.search(q, max(32, 4 * s.replicas))
    return near[: s.replicas][far[: s.replicas] <= (1 + s.boundary) * far[0] + 1e-12].tolist()


def build(rows: DataFrame, s: Settings) -> tuple[DataFrame, Graph | None]:
    """(postings(list, vec_id, v), graph)."""
    n = rows.count()
    share = int(min(1.0, s.sample / max(n, 1)) * (1 << 32))
    some = rows.where(F.pmod(F.xxhash64("vec_id", F.lit("fit")), F.lit(1 << 32)) < share).select("v").orderBy(F.xxhash64("v"))
    x = np.array([r["v"] for r in some.toLocalIterator()], dtype=np.float64)  # bounded by the sample
    if not len(x):
        return rows.limit(0).selectExpr("0 as list", "vec_id", "v"), None
    graph = Graph(fit_centroids(x, max(1, min(s.most_centroids, n // s.per_list, len(x) // 8))), s.degree)
    shared = rows.sparkSession.sparkContext.broadcast(graph)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, v = _rows(batch)
            lists = [_replicas(shared.value, q, s) for q in v]
            at = pa.array(np.repeat(np.arange(len(v)), [len(a) for a in lists]), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([c for a in lists for c in a], pa.int32()), batch.column("vec_id").take(at), batch.column("v").take(at)], names=["list", "vec_id", "v"])

    return written(rows.select("vec_id", "v").mapInArrow(assign, "list int, vec_id long, v array<double>"), "postings"), graph


def search(vectors: DataFrame, every: int = 100, k: int = 10, s: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by `every`."""
    rows = usable(vectors)
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = written(rows.where(F.size("v") == (lengths["n"] if lengths else 0)), "vectors")
    postings, graph = build(rows, s)
    queries = rows.where(F.col("vec_id") % every == 0)
    sizes = {r["list"]: -(-r["count"] // s.block) for r in postings.groupBy("list").count().collect()}  # a row for each centroid
    shared = rows.sparkSession.sparkContext.broadcast((graph, sizes))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, sizes = shared.value
        for batch in batches:
            _, v = _rows(batch)
            for a in range(0, len(v), ROUTED):
                out = [(a + i, c, p) for i, q in enumerate(v[a : a + ROUTED]) for c in _pruned(graph, q, s).tolist() for p in range(sizes.get(c, 0))]
                at = pa.array([o[0] for o in out], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32()), batch.column("vec_id").take(at), batch.column("v").take(at)], names=["list", "part", "query_id", "q"])

    blocks_of = max(1, -(-queries.count() // s.queries))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks_of)).cast("int").alias("block")
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks_of - 1))).alias("block")
    routed = queries.mapInArrow(route, "list int, part int, query_id long, q array<double>").select("*", block)
    parts = F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("count") / s.block)).cast("int")
    dealt = postings.join(F.broadcast(postings.groupBy("list").count()), "list").withColumn("part", parts).select("list", "part", "vec_id", "v", every_block)
    cell = ["list", "part", "block"]
    found = routed.groupBy(cell).cogroup(dealt.groupBy(cell)).applyInPandas(_nearest(k), "query_id long, vec_id long, score double")
    found = written(found, "found")  # read by the ranking and by the search for short queries
    best = _ranked(found, k)
    # queries whose lists held fewer than k: all rows, in blocks
    missing = queries.join(best.groupBy("query_id").count().where(F.col("count") >= k).select("query_id"), queries.vec_id == F.col("query_id"), "left_anti")
    missing = written(missing, "missing")
    if missing.isEmpty():
        return best
    parts = max(1, -(-rows.count() // s.block))
    every_part = missing.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.col("vec_id").alias("query_id"), F.col("v").alias("q")).select("*", block)
    blocks = rows.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"), every_block)
    full = every_part.groupBy("part", "block").cogroup(blocks.groupBy("part", "block")).applyInPandas(_nearest(k), "query_id long, vec_id long, score double")
    return _ranked(found.unionByName(full), k)


def distances(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to q; those whose squares leave the range of doubles are scaled first."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        apart = v - q
        d = np.sqrt((apart**2).sum(axis=1))
        for i in np.flatnonzero(~np.isfinite(d) | (d < 1e-150)):
            most = np.abs(apart[i]).max()
            if np.isfinite(most) and most > 0:
                d[i] = most * np.sqrt(((apart[i] / most) ** 2).sum())
    return d


def _nearest(k: int):
    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            q, ids, order = np.stack(left["q"].to_numpy()), left["query_id"].to_numpy(), np.argsort(right["vec_id"].to_numpy())
            v, other = np.stack(right["v"].to_numpy())[order], right["vec_id"].to_numpy()[order]
            for i in range(len(q)):
                d = distances(v, q[i])
                few = np.argsort(d, kind="stable")[: k + 1]
                out += [(ids[i], other[j], d[j]) for j in few[other[few] != ids[i]][:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return nearest


def _ranked(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
