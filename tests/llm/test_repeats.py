import hashlib
import random

import pytest

from candor.llm.repeats import intervals, remove_repeats, repeat_groups

SCHEMA = "lo int, doc_id long, text string, h string"


def brute(docs, size):
    seen, out = set(), {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            w = b[k : k + size]
            if w in seen:
                gone[k : k + size] = b"\1" * size
            seen.add(w)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def got(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def test_intervals_are_the_tree_of_common_prefixes():
    random.seed(3)
    for _ in range(200):
        lcp = [random.randrange(6) for _ in range(random.randrange(1, 12))]
        want = set()
        for a in range(len(lcp)):
            for b in range(a, len(lcp)):
                depth = min(lcp[a : b + 1])
                outside = max([lcp[a - 1] if a else -1, lcp[b + 1] if b + 1 < len(lcp) else -1])
                if depth >= 2 and outside < depth:
                    want.add((a, b + 1, depth, max(outside, 1)))
        assert set(intervals(lcp, 2)) == want


def test_same_as_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], 100)
    assert sum(n for _, n, _, _ in want.values()) > 1000
    assert got(remove_repeats(docs.repartition(3))) == want


@pytest.mark.parametrize("heavy", [4, 4096])
def test_edges_copies_and_shared_passages(spark, heavy):
    random.seed(1)
    make = lambda n: "".join(random.choice("abcdé fg\n") for _ in range(n))
    base, passage, page = make(900), make(150), make(99)
    texts = [None, "", "ab", base, base, page, page, "a" * 1000, "a" * 300, "ab" * 200, "\0" * 250, base[:100], base[1:100]]
    texts += [make(50) + passage + make(40) for _ in range(12)] + [passage[:120], passage[30:]]
    for _ in range(14):
        t = list(base)
        for _ in range(4):
            t[random.randrange(len(t))] = "#"
        texts.append("".join(t))
    rows = [(1, i, t, "x") for i, t in enumerate(texts)]
    want = brute([(i, t) for _, i, t, _ in rows], 100)
    assert got(remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(4), heavy=heavy)) == want


def test_groups_list_all_occurrences_of_maximal_repeats(spark):
    random.seed(5)
    make = lambda n: "".join(random.choice("abcdefgh") for _ in range(n))
    passage = make(110)
    rows = [(1, i, make(60) + passage + make(60), "x") for i in range(5)]
    found = {}
    for r in repeat_groups(spark.createDataFrame(rows, SCHEMA)).collect():
        found.setdefault(r["repeat"], []).append(r)
    assert found
    text = {i: t for _, i, t, _ in rows}
    for occurrences in found.values():
        strings = {text[r["doc_id"]][r["lo"] : r["hi"]] for r in occurrences}
        assert len(strings) == 1 and sum(r["first"] for r in occurrences) == 1
    assert any(len(g) == 5 for g in found.values())


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_heavy_windows_of_equal_polynomial_hashes(spark):
    """Windows of 1024 bytes: different strings of two letters whose polynomials modulo 2**64 are equal."""
    a = b"a"
    for _ in range(10):
        a += bytes(195 - c for c in a)
    other = bytes(195 - c for c in a).decode()
    a = a.decode()
    head = "0123456789abcdefghijklmn"
    df = spark.createDataFrame([(1, head + a), (2, head + other), (3, head + a)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in remove_repeats(df, size=len(head) + 1024, k=24, heavy=2).collect()}
    assert got == {1: 0, 2: 0, 3: len(head) + 1024}


@pytest.mark.parametrize("heavy", [32768, 3])
def test_counting_hashes_gives_what_a_sketch_gives(spark, monkeypatch, sf_dir, heavy):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 120")
    want = sorted(remove_repeats(docs, heavy=heavy).collect())
    monkeypatch.setattr("candor.llm.sketch.MOST_BITS", 3)
    assert sorted(remove_repeats(docs, heavy=heavy).collect()) == want and any(r["n_removed"] for r in want)
