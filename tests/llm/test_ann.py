import numpy as np
import pytest

from candor.llm.ann import Graph, Settings, _squares, distances, fit_centroids, search

SCHEMA = "rank int, vec_id long, embedding array<float>"


def brute(rows, k=10, every=100):
    good = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = np.array(sorted(good))
    x = np.stack([good[i] for i in ids])
    out = {}
    for i in ids[ids % every == 0]:
        d = np.sqrt(((x - good[i]) ** 2).sum(1))
        out[int(i)] = [(int(ids[j]), d[j]) for j in np.lexsort((ids, d)) if ids[j] != i][:k]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(mine, want):
    return sum(len({i for i, _ in mine[q]} & {i for i, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_against_brute_force(spark, sf):
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    want, mine = brute(rows), got(search(table))
    assert mine.keys() == want.keys() and all(len(v) == 10 for v in mine.values())
    exact = {q: dict(w) for q, w in want.items()}
    assert all(abs(d - exact[q][i]) < 1e-12 for q, v in mine.items() for i, d in v if i in exact[q])
    assert recall(mine, want) >= 0.95


def test_edges(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.standard_normal(8).astype(np.float32)]) for i in range(1, 250)]
    rows += [(300, None), (400, [0.0] * 8), (500, [1.0, None] * 4), (600, [float("nan")] * 8), (700, [1.0] * 7), (800, [float("inf")] * 8)]
    rows += [(900 + i, [0.5] * 8) for i in range(101)]
    df = spark.createDataFrame([(1, i, v) for i, v in rows], SCHEMA)
    mine, want = got(search(df, s=Settings(block=16, per_list=20, most_lists=64, prune=9.0))), brute([r for r in rows if r[0] != 700])
    assert mine.keys() == want.keys() == {100, 200, 900, 1000}
    assert [i for i, _ in mine[1000]] == [i for i, _ in want[1000]] == list(range(900, 910))
    assert recall(mine, want) >= 0.95


def test_few_and_no_rows(spark):
    rows = [(i, [float(i), 1.0]) for i in (0, 3, 5)]
    assert got(search(spark.createDataFrame([(1, i, v) for i, v in rows], SCHEMA))) == brute(rows)
    assert search(spark.createDataFrame([], SCHEMA)).collect() == []


def test_graph_search_finds_nearest_centroids():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4000, 16))
    c = fit_centroids(x, 300)
    graph = Graph(c, 24)
    hit = sum(len(set(graph.search(q, 64)[0][:10].tolist()) & set(np.argsort(_squares(q[None], c)[0])[:10].tolist())) for q in x[:50])
    assert hit >= 490


def test_lists_read_grow_with_the_table(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((6000, 32)).astype(np.float32)
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame([(1, i, v) for i, v in rows], SCHEMA)
    assert recall(got(search(df, s=Settings(per_list=8, most_lists=4))), brute(rows)) >= 0.9


def test_large_components_and_blocks_of_queries(spark):
    rows = [(0, [1e200, 0.0]), (100, [-1e200, 0.0]), (200, [1e-200, 1.0]), (300, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    mine = got(search(df, s=Settings(queries=1)))
    assert {q: len(v) for q, v in mine.items()} == {0: 3, 100: 3, 200: 3, 300: 3}
    assert dict(mine[0])[100] == 2e200 and mine[200][0] == (300, 1e-200)
    assert distances(np.array([[3e-200, 4e-200], [0.0, 0.0]]), np.zeros(2)).tolist() == [5e-200, 0.0]
