import random
import re

import numpy as np

from candor.llm import ngram_join
from candor.llm.components import connected_components
from candor.llm.ngram_join import components, dedup, divide_skip

SCHEMA = "a int, doc_id long, text string, hub string"


def sets_of(docs, size):
    out = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    return out


def brute(docs, size=4, percent=85):
    s = sets_of(docs, size)
    ids, label = sorted(s), {i: i for i in s}
    for k, x in enumerate(ids):
        for y in ids[k + 1 :]:
            if s[x] and s[y] and 100 * len(s[x] & s[y]) >= percent * len(s[x] | s[y]):
                low, high = sorted((label[x], label[y]))
                label = {i: low if c == high else c for i, c in label.items()}
    return {i: (len(s[i]), label[i]) for i in ids}


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def family(rng):
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    shared = [f"s{i}" for i in range(60)]
    texts = [None, "", " \n", "One two", "one TWO", "one two three four", "one two three five", "É one two", "é one two"]
    for n in (0, 1, 2, 3, 4, 5, 6, 8, 10, 12):
        for _ in range(3):
            t = list(base)
            for _ in range(n):
                t[rng.randrange(len(t))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(t))
    texts += [" ".join([f"u{rng.randrange(10**6)}" for _ in range(40)] + shared) for _ in range(8)]
    texts += [" ".join(base[:k]) for k in (299, 280, 256, 255, 250)]
    return [(7, 3 * i + 1, t, "x") for i, t in enumerate(texts)]


def test_same_as_brute_force_whatever_the_block_size(spark):
    rows = family(random.Random(4))
    want = brute([(i, t) for _, i, t, _ in rows])
    assert len({c for _, c in want.values()}) < len(want) - 15
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(components(docs)) == want
    assert got(components(docs, block=3)) == want
    five = brute([(i, t) for _, i, t, _ in rows], 5, 80)
    kept = dedup(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in five.items() if c == i}


def test_divide_skip_links_all_that_reach_the_similarity():
    rng = np.random.default_rng(2)
    for _ in range(30):
        base = rng.integers(0, 1 << 60, 80).astype(np.uint64)
        sets = []
        for _ in range(12):
            s = base.copy()
            k = rng.integers(0, 14)
            s[rng.integers(0, 80, k)] = rng.integers(0, 1 << 60, k).astype(np.uint64)
            sets.append(np.unique(s[: rng.integers(60, 81)]))
        label = list(range(12))
        for i in range(12):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    label = [label[i] if c == label[j] else c for c in label]
        mine = list(range(12))
        for a, b in divide_skip(sets, 85):
            both = len(np.intersect1d(sets[a], sets[b]))
            assert 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both)
            mine = [mine[a] if c == mine[b] else c for c in mine]
        same = lambda lab: {(i, j) for i in range(12) for j in range(12) if lab[i] == lab[j]}
        assert same(mine) == same(label)


def test_components_of_a_path_a_star_and_a_ring(spark):
    rows = [(i, i + 1) for i in range(100, 150)] + [(500, i) for i in range(501, 560)] + [(900 + i, 900 + (i * 7 + 1) % 20) for i in range(20)] + [(3, 3)]
    found = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert {found[i] for i in range(100, 151)} == {100} and {found[i] for i in range(500, 560)} == {500} and 3 not in found


def test_empty_table(spark):
    assert components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_merge_skip_counts_what_stands_on_enough_lists():
    rng = np.random.default_rng(5)
    for _ in range(200):
        lists = [sorted(set(rng.integers(0, 40, rng.integers(0, 25)).tolist())) for _ in range(rng.integers(1, 9))]
        need = int(rng.integers(1, 6))
        times = {v: sum(v in one for one in lists) for v in range(40)}
        assert list(ngram_join.merge_skip(lists, need)) == [(v, k) for v, k in times.items() if k >= need]


def test_short_lists_are_merged_and_long_ones_probed(monkeypatch):
    """Sets of some size: partners must stand on several short lists, and few sets are looked up in the long ones."""
    rng = np.random.default_rng(8)
    common = np.arange(400, dtype=np.uint64)
    sets = []
    for k in range(120):
        own = np.arange(1000 + 1000 * (k // 2), 1000 + 1000 * (k // 2) + 60, dtype=np.uint64)
        sets.append(np.sort(np.concatenate([rng.choice(common, 140, replace=False), own[rng.permutation(60)[:59]]])))
    needs, probes = [], []
    merge, probe = ngram_join.merge_skip, ngram_join._probe
    monkeypatch.setattr(ngram_join, "merge_skip", lambda lists, need: needs.append(need) or merge(lists, need))
    monkeypatch.setattr(ngram_join, "_probe", lambda held, tokens: probes.append(len(tokens)) or probe(held, tokens))
    links = ngram_join.divide_skip(sets, 60)
    want = {(a, b) for a in range(120) for b in range(a) if 100 * (k := len(np.intersect1d(sets[a], sets[b]))) >= 60 * (len(sets[a]) + len(sets[b]) - k)}
    reach = lambda pairs: {frozenset(c) for c in _parts(120, pairs)}
    assert reach(links) == reach(want)
    assert min(needs) > 1 and 0 < len(probes) < 120 * 119 / 8


def _parts(n, pairs):
    of = list(range(n))
    for a, b in pairs:
        of = [of[a] if g == of[b] else g for g in of]
    return [[k for k in range(n) if of[k] == g] for g in set(of)]


def test_texts_whose_polynomial_hashes_collide(spark):
    a = b"a"
    for _ in range(10):
        a += bytes(195 - c for c in a)
    other = bytes(195 - c for c in a).decode()
    a = a.decode()
    # words of 1024 bytes that differ in each byte
    df = spark.createDataFrame([(1, f"{a} x {a} y"), (2, f"{other} x {other} y"), (3, f"{a} x {a} y")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.components(df).collect()} == {1: 1, 2: 2, 3: 1}


def test_more_leading_grams_than_the_largest_sketch_can_tell_apart(spark, monkeypatch):
    """In slices the result is the same, and sets that share a single n-gram still don't go to hubs."""
    monkeypatch.setattr("candor.llm.sketch.MOST_BITS", 11)
    rng = random.Random(6)
    rows = family(rng)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(components(docs)) == brute([(i, t) for _, i, t, _ in rows])
    words = [[f"r{rng.randrange(10**9)}" for _ in range(100)] for _ in range(120)]
    texts = [" ".join(w + words[k - 1][:12]) for k, w in enumerate(words)]  # each shares 9 of 109 with the next one
    unlike = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    order = ngram_join.S.Sketch(11, 64)
    assert ngram_join._memberships(unlike, 4, 85, order).count() < 24  # of 120 sets
    assert {c for _, c in got(components(unlike)).values()} == set(range(120))


def test_only_texts_of_sets_at_a_hub_are_shuffled(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(2000)], "doc_id long, text string").repartition(3)
    some = spark.createDataFrame([(i,) for i in range(0, 2000, 50)], "doc_id long")
    kept = {r["doc_id"] for r in ngram_join._only(docs, some).collect()}
    assert {*range(0, 2000, 50)} <= kept and len(kept) < 200


def test_packed_hashes_keep_their_upper_bytes():
    grams = np.array([1 << 63, (1 << 24) - 1, 0xFFFFFFFFFF000001], dtype=np.uint64)
    bodies = [ngram_join.pack(grams), b"", ngram_join.pack(grams[:1])]
    assert ngram_join.unpack(bodies).tolist() == [1 << 39, 0, (1 << 40) - 1, 1 << 39]


def test_dedup_shuffles_only_the_rows_that_may_go(spark, monkeypatch):
    joined, whole = [], ngram_join.without
    monkeypatch.setattr(ngram_join, "without", lambda docs, gone: joined.append(docs) or whole(docs, gone))
    texts = [" ".join(f"x{k}y{i}" for i in range(30)) for k in range(200)]
    rows = [*enumerate(texts), (200, texts[7]), (201, None), (None, texts[7]), (0, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    kept = dedup(docs)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert kept.schema == docs.schema and sorted(map(key, kept.collect())) == sorted(key(r) for r in rows if r[0] != 200)
    assert {r["doc_id"] for r in joined[0].collect()} == {200}
