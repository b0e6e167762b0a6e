import random

import numpy as np
import pytest

from candor.llm import line_dedup
from candor.llm.line_dedup import dedup_lines, line_decisions, repeated_in_block, within
from candor.llm.queries import op10_line_dedup

SCHEMA = "line int, doc_id long, text string, h1 string"


def brute(docs, least=24, edits=2):
    lines = [(i, k, x.encode()) for i, t in sorted(docs) if t is not None for k, x in enumerate(t.split("\n"))]
    out = {i: (0 if t is None else len(t.split("\n")), []) for i, t in docs}
    earlier = {}
    for i, k, x in lines:
        if len(x) < least:
            continue
        close = x in earlier or any(abs(len(x) - len(y)) <= edits and line_dedup._plain(x, y) <= edits for y in earlier)
        if close:
            out[i][1].append(k)
        earlier[x] = 1
    return out


def got(df):
    return {r["doc_id"]: (r["n_lines"], list(r["removed_lines"])) for r in df.collect()}


def edited(rng, line, n):
    for _ in range(n):
        k = rng.randrange(max(1, len(line)))
        line = rng.choice([line[:k] + line[k + 1 :], line[:k] + rng.choice("abc") + line[k:], line[:k] + rng.choice("abcé") + line[k + 1 :]])
    return line


def test_banded_distance():
    rng = random.Random(1)
    for _ in range(4000):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(0, 14)))
        b = edited(rng, a, rng.randrange(5)) if a and rng.random() < 0.8 else "".join(rng.choice("ab") for _ in range(rng.randrange(0, 14)))
        for edits in (0, 1, 2, 3):
            assert within(a.encode(), b.encode(), edits) == (line_dedup._plain(a.encode(), b.encode()) <= edits), (a, b, edits)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_block_search_finds_all(edits):
    rng = random.Random(edits)
    for _ in range(40):
        base = "".join(rng.choice("abc") for _ in range(rng.randrange(12, 30)))
        texts = sorted({edited(rng, base, rng.randrange(6)).encode() for _ in range(12)})
        rng.shuffle(texts)
        want = [x for x in range(len(texts)) if any(line_dedup._plain(texts[x], texts[y]) <= edits for y in range(x))]
        assert repeated_in_block([((k, 0), t, 0) for k, t in enumerate(texts)], edits) == want


def corpus(rng):
    make = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = [make(rng.randrange(24, 90)) for _ in range(12)]
    texts = [None, "", "\n", "short\nshort", make(30) + "\n" + make(23) + "\n" + make(23)]
    for _ in range(40):
        parts = [edited(rng, rng.choice(shared), rng.randrange(5)) if rng.random() < 0.6 else make(rng.randrange(5, 60)) for _ in range(rng.randrange(1, 6))]
        texts.append("\n".join(parts))
    texts += [texts[10], texts[10], "\n".join([shared[0]] * 4)]
    return [(1, 2 * i, t, "z") for i, t in enumerate(texts)]


def test_same_as_brute_force_whatever_the_block_size(spark):
    rows = corpus(random.Random(9))
    want = brute([(i, t) for _, i, t, _ in rows])
    assert sum(len(x) for _, x in want.values()) > 30
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert got(line_decisions(docs)) == want
    assert got(line_decisions(docs, block=3)) == want
    kept = {r["doc_id"]: r for r in dedup_lines(docs).collect()}
    for _, i, t, _ in rows:
        lines = [] if t is None else [x for k, x in enumerate(t.split("\n")) if k not in want[i][1]]
        if want[i][1] and not "".join(lines).strip():
            assert i not in kept
        else:
            assert kept[i]["text"] == (None if t is None else "\n".join(lines)) and kept[i]["h1"] == "z"


def test_empty_table(spark):
    assert line_decisions(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("apart", [False, True])
def test_near_lines_of_one_slice_are_found(spark, apart):
    rng = random.Random(5)
    make = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(60))
    pairs = [(x, x[:20] + "Z" + x[21:]) for x in (make() for _ in range(20))]
    texts = [t for a, b in pairs for t in ((a, b) if apart else (f"{a}\n{b}",))]
    docs = spark.createDataFrame([(1, i, t, "z") for i, t in enumerate(texts)], SCHEMA).coalesce(1)
    want = brute(list(enumerate(texts)))
    assert sum(len(x) for _, x in want.values()) == 20
    assert got(line_decisions(docs)) == want


def test_query_cuts_equal_lines_of_any_length(spark, tmp_path):
    texts = ["Ietzte.\n \n\nx\nAll rights reserved.", "Ietzte.\nIetzta.\n \n\nx", "é\nAll rights reserved.\n\t\né", None, ""]
    spark.createDataFrame([(1, i, t, "z") for i, t in enumerate(texts)], SCHEMA).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    assert got(op10_line_dedup(spark, str(tmp_path))) == {0: (5, []), 1: (5, [0, 4]), 2: (4, [1, 3]), 3: (0, []), 4: (1, [])}


def test_lines_whose_polynomial_hashes_collide(spark):
    a = b"a"
    for _ in range(10):
        a += bytes(195 - c for c in a)
    other = bytes(195 - c for c in a).decode()
    a = a.decode()
    df = spark.createDataFrame([(1, a), (2, other), (3, a), (4, a[:-1])], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in line_decisions(df).collect()} == {1: 0, 2: 0, 3: 1, 4: 1}


def test_profiles_never_rule_out_a_near_line():
    rng = random.Random(4)
    for _ in range(300):
        a = bytes(rng.choice(b"ab c1") for _ in range(rng.randrange(1, 40)))
        b = bytearray(a)
        for _ in range(edits := rng.randrange(1, 4)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(2)] = bytes([rng.choice(b"ab c1")] * rng.randrange(2))
        d = line_dedup.profiles([a, bytes(b)])
        assert int(np.bitwise_count(d[0] ^ d[1]).sum()) <= 4 * edits


def test_many_lines_of_one_pattern(spark):
    """20,000 lines that share a long segment and differ in numbers; every hundredth has a near copy."""
    lines = [f"{k * 7919 % 100003:06d} is the number of a line whose other words are all the same {k * 104729 % 1000003:08d}" for k in range(20_000)]
    near = [x[:10] + "#" + x[10:] for x in lines[::100]]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(near))], "doc_id long, text string")
    got = {r["doc_id"]: r["removed_lines"] for r in line_decisions(df).collect()}
    assert got[2] == list(range(200)) and set(got[1]) == {k for k, x in enumerate(lines) if any(line_dedup.within(x.encode(), y.encode(), 2) for y in _close(lines, k))}


def _close(lines, k, seen={}):
    """Earlier lines with the same first or the same second number, or with both near in digits."""
    if not seen:
        for at, x in enumerate(lines):
            for part in (x[:6], x[-8:]):
                for drop in range(len(part)):
                    seen.setdefault((len(part), drop, part[:drop] + part[drop + 1 :]), []).append(at)
    x = lines[k]
    return {lines[j] for part in (x[:6], x[-8:]) for drop in range(len(part)) for j in seen[len(part), drop, part[:drop] + part[drop + 1 :]] if j < k}
