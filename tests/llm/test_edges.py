"""Every operator on one table of odd rows: nulls, empty and very long texts, repeated ids and rows, and further columns whose
names are those that operators use themselves, or hold dots."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from candor.llm import compaction, decontam, langid, line_dedup, ngram_join, packing, quality, repeats, window_dedup
from candor.llm.queries import tokenizer_path

NAMES = ["a.b", "lines", "places", "arrival", "runs", "ranges", "key", "hub", "held_out", "score", "gone_id", "cut_id", "hit_id", "wh", "length", "least", "_lines", "_places", "_arrival", "_salt"]
LONG = "\n".join(f"{k} {hashlib.sha256(b'%d' % k).hexdigest()}" for k in range(15_000))
COPY = "a copy of some words that stands here more than once so that the joins have something to find in this table"
TEXTS = [(1, "en", COPY), (2, "en", None), (3, None, ""), (4, "de", " \n\t "), (5, "en", LONG), (6, "fr", COPY), (6, "fr", "another row of six"), (7, "en", "12 34"), (7, "en", "words under seven"), (8, "es", "x" * 300_000), (9, "en", COPY), (9, "en", COPY), (None, "en", "no id")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, "s", len(t or ""), *([1] * len(NAMES))) for i, lang, t in TEXTS]
    assert len(LONG) > 1_000_000
    columns = ", ".join(f"`{n}` int" for n in NAMES)
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {columns}")


def texts(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_operators_that_keep_columns(spark, docs):
    items = spark.createDataFrame([(1, "another row of six"), (2, None), (3, "")], "item_id long, text string")
    known = langid.keep_known(docs)
    assert known.columns == docs.columns and {(i, t) for i, t in texts(known)} <= {(i, t) for i, _, t in TEXTS if t and any(c.isalpha() for c in t)}
    assert (7, "12 34") not in texts(known)
    cut = line_dedup.dedup_lines(docs)
    assert cut.columns == docs.columns and (5, LONG) in texts(cut) and [i for i, t in texts(cut) if t == COPY] == [1]
    single = ngram_join.dedup(docs)
    assert single.columns == docs.columns and [i for i, t in texts(single) if t == COPY] == [1] and (None, "no id") in texts(single)
    clean = decontam.decontaminate(docs, items)
    assert clean.columns == docs.columns and {i for i, _ in texts(clean)} == {1, 2, 3, 4, 5, 7, 8, 9, None}
    spans = decontam.decontaminate(docs, items, remove="spans")
    assert spans.columns == docs.columns and (6, "") in texts(spans) and (5, LONG) in texts(spans)


def test_operators_that_report(spark, docs):
    ids = sorted(str(i) for i, _, _ in TEXTS)
    of = lambda df: sorted(str(r["doc_id"]) for r in df.collect())
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (6, 1, 0), (77, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    for df in (langid.predictions(docs), quality.scores(docs, labels)):
        assert of(df) == ids and all(0 <= r["score"] <= 1 for r in df.collect())
    words = {r["doc_id"]: r for r in window_dedup.dedup_windows(docs, size=10, sub=4, texts=False).collect() if r["doc_id"] in (1, 5)}
    assert words[1]["n_removed"] == 0 and words[5]["n_words"] == len(LONG.split())
    assert of(window_dedup.dedup_windows(docs)) == of(repeats.remove_repeats(docs)) == ids
    kept = {r["doc_id"]: r for r in repeats.remove_repeats(docs).collect()}
    assert kept[8]["n_bytes"] == 300_000 and kept[8]["n_removed"] == 300_000 - 1 and kept[2]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    linked = {(r["doc_id"], r["component_id"]) for r in ngram_join.components(docs).collect()}
    assert {(6, 1), (9, 1), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5)} <= linked
    hit = decontam.contamination(docs, spark.createDataFrame([(1, "another row of six")], "item_id long, text string"))
    assert of(hit) == ids and {r["doc_id"] for r in hit.collect() if r["contaminated"]} == {6}
    assert compaction.compacted_documents(docs, arrivals=3, fan=2).count() == len(TEXTS)
    packed = packing.pack_documents(docs, tokenizer_path()).collect()
    assert {r["doc_id"] for r in packed} == {i for i, _, _ in TEXTS} and all(r["length"] <= 2048 for r in packed)
    one = [r for r in packed if r["doc_id"] == 2][0]
    assert one["length"] == 1 and one["ids_crc32"] == zlib.crc32(b"\0" * 4)
    places = [(r["sequence_id"], p) for r in packed for p in range(r["offset"], r["offset"] + r["length"])]
    assert len(places) == len(set(places))


def test_other_tokenizers_read_whole_texts(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    some = docs.where("doc_id in (1, 2, 7)")
    got = sorted((r["doc_id"], r["ids"]) for r in packing.pieces(some, path, 100, ids=True).collect())
    want = Tokenizer.from_file(path)
    assert got == sorted((i, [*want.encode(t or "", add_special_tokens=False).ids, 0]) for i, _, t in TEXTS if i in (1, 2, 7))


def test_rows_that_a_filter_drops_first(docs):
    """Names of docs may be those of another table that is joined."""
    renamed = docs.withColumnRenamed("lines", "doc.id")
    assert line_dedup.dedup_lines(renamed).columns == renamed.columns and F.col("`doc.id`") is not None
