from collections import defaultdict

import pytest

import corpus_pipeline
from tests.llm.test_decontam import brute as hit_by
from tests.llm.test_line_dedup import brute as lines_of
from tests.llm.test_ngram_join import brute as components_of

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    read = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 6000")
    odd = [(9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (9003, "12 34", "en", "s", 0), (9004, "some words that stand here alone and nowhere else at all", None, None, None), (None, "no number but words", "en", "s", 3)]
    return read.unionByName(spark.createDataFrame(odd, read.schema)).cache()


def test_stages_against_brute_force(spark, sf_dir, docs):
    before = {r["doc_id"]: r for r in docs.collect()}
    known = stage("language ID")(spark, docs, sf_dir)
    kept = {r["doc_id"]: r for r in known.collect()}
    assert known.columns == COLUMNS and before.keys() - kept.keys() == {9001, 9002, 9003} and all(kept[i] == before[i] for i in kept)

    cut = stage("line dedup")(spark, known, sf_dir)
    assert cut.columns == COLUMNS
    numbered = {i: r for i, r in kept.items() if i is not None}
    gone, after = lines_of([(i, r["text"]) for i, r in numbered.items()]), {r["doc_id"]: r for r in cut.collect()}
    for i, r in numbered.items():
        text = "\n".join(x for k, x in enumerate(r["text"].split("\n")) if k not in gone[i][1])
        assert (i not in after) if gone[i][1] and not text.strip() else (after[i]["text"], after[i]["n_chars"]) == (text, len(text))
    assert any(n for _, n in gone.values())

    single = stage("n-gram Jaccard join")(spark, docs, sf_dir)
    groups = components_of([(i, r["text"]) for i, r in before.items() if i is not None], 5, 80)
    assert single.columns == COLUMNS and {r["doc_id"] for r in single.collect()} == {i for i, (_, c) in groups.items() if i == c} | {None}
    assert any(i != c for i, (_, c) in groups.items())

    clean = stage("benchmark decontamination")(spark, docs, sf_dir)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hit = hit_by([(i, r["text"]) for i, r in before.items() if i is not None], items)
    assert clean.columns == COLUMNS and {r["doc_id"] for r in clean.collect()} == {i for i, h in hit.items() if not h[4]} | {None}
    assert any(h[4] for h in hit.values())


def test_run_packs_what_is_left(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert 0 < len({r["doc_id"] for r in rows}) < spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_empty_table(spark, sf_dir, docs):
    empty = docs.limit(0)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, empty, sf_dir).collect() == []


def test_the_join_stage_sends_no_unlike_texts_to_hubs_beyond_the_largest_sketch(spark, monkeypatch):
    monkeypatch.setattr("candor.llm.sketch.MOST_BITS", 11)
    found, made = [], corpus_pipeline.ngram_join._memberships
    monkeypatch.setattr(corpus_pipeline.ngram_join, "_memberships", lambda *a: found.append(made(*a)) or found[-1])
    words = [[f"r{k}x{i}" for i in range(100)] for k in range(120)]
    texts = [" ".join(w + words[k - 1][:12]) for k, w in enumerate(words)] + [" ".join(words[5] + words[4][:11])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    kept = corpus_pipeline.ngram_jaccard_join(spark, docs, "")
    assert {r["doc_id"] for r in kept.collect()} == set(range(120))
    assert {r["hub"] for r in found[0].collect()} and found[0].count() < 24  # of 121 sets
