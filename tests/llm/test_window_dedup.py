import hashlib
import re

from candor.llm import window_dedup
from candor.llm.window_dedup import dedup_windows

SCHEMA = "extra int, doc_id long, text string, known long"


def brute(docs, size):
    first, out = {}, {}
    words = {i: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for i, t in docs}
    for i, w in words.items():
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, i), i)
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone |= set(range(k, k + size))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def got(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()}


def test_same_as_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], 50)
    assert sum(n for _, n, _ in want.values()) > 0
    assert got(dedup_windows(docs.repartition(3))) == want


def test_edges_and_a_sketch_that_is_too_small(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", "  \n", "one two", passage, "lead " + passage + "\ttail", passage[:-4], "a " * 300, "a " * 200, passage, "é x " * 80, "é x " * 80]
    rows = [(1, i, t, 5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = brute([(i, t) for _, i, t, _ in rows], 50)
    for bits in (16, 20):
        assert got(dedup_windows(docs.repartition(4), bits=bits)) == want
    assert want[9][1] == 60 and want[8][1] == 200 and want[0] == (0, 0, hashlib.sha256(b"").hexdigest())


def test_empty_table(spark):
    assert dedup_windows(spark.createDataFrame([], SCHEMA)).collect() == []


def test_windows_whose_polynomial_hashes_collide(spark):
    a = b"a"
    for _ in range(10):
        a += bytes(195 - c for c in a)
    other = bytes(195 - c for c in a).decode()
    a = a.decode()
    # words of 1024 bytes that differ in each byte, and an equal document
    df = spark.createDataFrame([(1, " ".join([a] * 50)), (2, " ".join([other] * 50)), (3, " ".join([a] * 50))], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in dedup_windows(df).collect()} == {1: 0, 2: 0, 3: 50}


def test_counting_hashes_gives_what_a_sketch_gives(spark, monkeypatch, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted(dedup_windows(docs, texts=False).collect())
    monkeypatch.setattr("candor.llm.sketch.MOST_BITS", 3)
    assert sorted(dedup_windows(docs, texts=False).collect()) == want and any(r["n_removed"] for r in want)


def test_what_leaves_the_scan_is_bounded_beyond_the_largest_sketch(spark, monkeypatch):
    """200,000 words of which one window is repeated: a sketch of 2**16 cells lets many through, counting only that."""
    rows = [(k, " ".join(f"w{k}x{i}" for i in range(1000))) for k in range(200)] + [(900 + k, " ".join(f"same{i}" for i in range(60))) for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr("candor.llm.sketch.MOST_BITS", 3)
    assert window_dedup.window_sketch(docs, 50, 20) is None
    assert window_dedup.candidate_windows(docs, 50, 20, None).count() <= 2 * 11
