import random
import zlib

import numpy as np
import pytest

from candor.llm import langid, quality
from candor.llm.folds import held_out, sampled

SCHEMA = "score double, doc_id long, text string, lang string"


def test_held_out_fold_is_by_crc32(spark):
    got = {r["id"]: r["h"] for r in spark.range(50).select("id", held_out("id").alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50)}


def test_sample_is_bounded_for_each_label(spark):
    rows = [(i, "a" if i % 50 else "b") for i in range(4000)] + [(None, "a"), (5000, None)]
    got = [r["y"] for r in sampled(spark.createDataFrame(rows, "doc_id long, y string"), "y", 400).collect()]
    assert got.count("b") == 80 and 100 < got.count("a") < 300


@pytest.mark.parametrize("n", [1, 2, 4, 6, 9, 25])
def test_codewords_differ(n):
    code = langid.codewords(n)
    assert len({tuple(r) for r in code.tolist()}) == n
    if n > 2:
        assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= 2


def test_decoding_survives_a_wrong_bit():
    code = langid.codewords(4)
    model = langid.Model(list("abcd"), code, np.vstack([np.eye(7), np.zeros(7)]).astype(np.float32), np.full(7, 1 / 7))
    for k in range(4):
        x = 3.0 * code[k].astype(np.float32)
        for bit in range(7):
            y = x.copy()
            y[bit] = -y[bit] / 3
            assert model.decode(y[None])[0].argmax() == k


def test_languages_are_learned_and_labels_of_held_out_rows_are_not(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    wrong = docs.selectExpr("doc_id", "text", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 'xx' else lang end as lang")
    got = {r["doc_id"]: r for r in langid.predictions(wrong).collect()}
    true = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [i for i in got if got[i]["held_out"]]
    assert {r["lang_pred"] for r in got.values()} <= {"en", "de", "fr", "es"}
    assert len(got) == len(true) and sum(got[i]["lang_pred"] == true[i] for i in held) >= 0.95 * len(held)


def test_language_edges(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("0.0D as score", "doc_id", "text", "lang")
    rows = [(0.0, 9000, None, "en"), (0.0, 9001, "", "en"), (0.0, 9002, "123 -- ...", "de"), (0.0, 9003, "中文", None), (0.0, 9004, "x", None), (0.0, None, "the and of", "en")]
    edge = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in langid.predictions(docs.unionByName(edge)).collect()}
    assert [got[i]["lang_pred"] for i in (9000, 9001, 9002)] == ["und"] * 3 and got[9000]["score"] == 0.0
    assert got[9003]["lang_pred"] != "und" and all(0 <= r["score"] <= 1 for r in got.values()) and got[None]["held_out"] is False
    assert {r["doc_id"] for r in langid.keep_known(docs.unionByName(edge)).collect()} >= {9003, 9004}
    alone = langid.predictions(spark.createDataFrame([(0.0, 1, "some text", None)], SCHEMA)).collect()
    assert alone[0]["lang_pred"] == "und"
    assert langid.predictions(spark.createDataFrame([], SCHEMA)).collect() == []


def test_gradient_of_the_network():
    rng = np.random.default_rng(0)
    net = quality.Network(rng)
    net.w = {k: a.astype(np.float64) for k, a in net.w.items()}
    x, sizes, y = rng.random((7, quality.BUCKETS + quality.SHARES)), np.array([3, 1, 3]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(np.log(np.where(y > 0, p := net.forward(x, sizes)["p"], 1 - p)))
    g = net.gradient(x, sizes, y)
    for k, a in net.w.items():
        at = tuple(int(rng.integers(n)) for n in a.shape)
        old, step = a[at], 1e-5
        a[at] = old + step
        up = loss()
        a[at] = old - step
        down = loss()
        a[at] = old
        assert g[k][at] == pytest.approx((up - down) / (2 * step), abs=1e-6, rel=1e-3)


def test_quality_is_learned(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    extra = docs.unionByName(spark.createDataFrame([(9000, None, "en", "s", 0), (9001, "", "en", "s", 0), (9002, "  \n", "en", "s", 0), (9003, "word " * 5000, "en", "s", 0)], docs.schema))
    got = {r["doc_id"]: r for r in quality.scores(extra, labels).collect()}
    assert len(got) == docs.count() + 4 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    held = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if r["doc_id"] in got and got[r["doc_id"]]["held_out"]]
    assert sum(p == q for p, q in held) >= 0.95 * len(held)


def test_quality_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(0.0, 1, "a b", "en")], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.scores(docs, labels).collect()[0]["score"] == 0.5
    assert quality.scores(docs.limit(0), labels).collect() == []


def test_passages_cover_all_words():
    random.seed(1)
    texts = [b"", b"  ", " ".join(random.choice("abc") * 3 for _ in range(250)).encode()]
    x, sizes = quality.encode_passages(texts)
    assert sizes.tolist() == [1, 1, 3] and len(x) == 5 and np.isfinite(x).all()


def test_long_texts_are_encoded_in_parts_of_whole_passages():
    text = b"  ".join(b"word%d" % (k % 900) for k in range(20_000))
    parts = list(quality.passage_parts(text, 10_000))
    assert b"".join(parts) == text and len(parts) > 5 and all(len(p.split()) % quality.PASSAGE == 0 for p in parts[:-1])
    whole, (n,) = quality.encode_passages([text])
    assert sum(quality.encode_passages([p])[1][0] for p in parts) == n == len(whole) == 200
    assert len(quality.learned_passages(text)) == quality.LEARNED and list(quality.passage_parts(b"x" * 5000, 100)) == [b"x" * 5000]


def test_decoding_and_scoring_against_plain_loops():
    import math

    rng = np.random.default_rng(2)
    code = langid.codewords(4)
    trust = rng.random(code.shape[1])
    model = langid.Model(list("abcd"), code, rng.standard_normal((33, code.shape[1])).astype(np.float32), trust / trust.sum())
    x = rng.random((5, 32)).astype(np.float32)
    for row, got in zip(x, model.decode(x), strict=True):
        losses = []
        for word in code:
            total = 0.0
            for bit in range(len(word)):
                margin = sum(float(row[f]) * float(model.weights[f, bit]) for f in range(32)) + float(model.weights[32, bit])
                total += model.trust[bit] * math.log(1 + math.exp(-margin * float(word[bit])))
            losses.append(total * len(word))
        share = [math.exp(min(losses) - v) for v in losses]
        assert np.allclose(got, [s / sum(share) for s in share], atol=1e-5)
    net = quality.Network(rng)
    x, sizes = rng.random((6, quality.BUCKETS + quality.SHARES)).astype(np.float32), np.array([1, 3, 2])
    at = 0
    for size, got in zip(sizes, net.forward(x, sizes)["p"], strict=True):
        hidden, weights = [], []
        for row in x[at : at + size]:
            h = [math.tanh(float(row @ net.w["E"][:, u]) + float(net.w["e"][u])) for u in range(quality.UNITS)]
            gate = 0.0
            for g in range(quality.GATES):
                up = sum(h[u] * float(net.w["V"][u, g]) for u in range(quality.UNITS))
                open_ = sum(h[u] * float(net.w["U"][u, g]) for u in range(quality.UNITS))
                gate += math.tanh(up) / (1 + math.exp(-open_)) * float(net.w["a"][g, 0])
            hidden.append(h)
            weights.append(math.exp(gate))
        bag = [sum(w * h[u] for w, h in zip(weights, hidden, strict=True)) / sum(weights) for u in range(quality.UNITS)]
        out = sum(bag[u] * float(net.w["c"][u, 0]) for u in range(quality.UNITS)) + float(net.w["b"][0])
        assert abs(got - 1 / (1 + math.exp(-out))) < 1e-4
        at += size
