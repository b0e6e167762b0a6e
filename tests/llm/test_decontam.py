import hashlib
import re

from candor.llm.decontam import contamination, decontaminate

DOCS = "extra int, item_id long, doc_id long, text string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size=10):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for k in range(len(w)):
            for n in {len(x) for x in windows}:
                if len(w) - k >= n and (at := windows.get(tuple(w[k : k + n]))):
                    hit |= set(range(k, k + n))
                    found |= at
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
    return out


def got(df):
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in df.collect()}


def test_edges(spark):
    long_item = "Alpha beta gamma delta épsilon zeta eta theta iota kappa lambda mu"
    items = [(1, long_item), (2, "short one"), (10, "short ONE"), (3, None), (4, " .,! "), (5, "a a a a a a a a a a a")]
    texts = [None, "", "...", long_item, "x " + long_item.upper().replace("É", "é") + " y", "so short-one, Short one", "a " * 30, "alpha beta gamma delta", "Épsilon " + long_item[:-3], "short", "É short one"]
    docs = [(0, 0, i, t) for i, t in enumerate(texts)]
    b, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, DOCS)
    want = brute([(i, t) for _, _, i, t in docs], items)
    assert want[5][:3] == (5, 4, 2)
    assert got(contamination(d, b)) == want
    assert got(contamination(d, b, block=3)) == want
    assert {r["doc_id"] for r in decontaminate(d, b).collect()} == {i for i, w in want.items() if not w[4]}
    kept = {r["doc_id"]: r["text"] for r in decontaminate(d, b, remove="spans").collect()}
    assert kept[4] == "x y" and kept[5] == "so" and kept[7] == texts[7] and kept[0] is None


def test_empty_tables(spark):
    b, d = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(0, 0, 1, "a b")], DOCS)
    assert got(contamination(d, b))[1][:3] == (2, 0, 0)
    assert contamination(d.limit(0), b).collect() == []


def test_windows_that_share_a_long_word_and_single_words(spark):
    items = [(k, f"internationalization of part {k} " + " ".join(f"w{k}x{i}" for i in range(6))) for k in range(30)] + [(100, "Zebra"), (101, "zebra crossing")]
    docs = [(1, "internationalization " * 50), (2, "x " + items[7][1] + " y"), (3, "a zebra"), (4, "a ZEBRA crossing zebra"), (5, "zebras")]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    got = {r["doc_id"]: r for r in contamination(*frames).collect()}
    assert {i: (r["n_words"], r["n_hit"], r["n_items"]) for i, r in got.items()} == {1: (50, 0, 0), 2: (12, 10, 1), 3: (2, 1, 1), 4: (4, 3, 2), 5: (1, 0, 0)}
    assert {i: r["contaminated"] for i, r in got.items()} == {i: h[4] for i, h in want.items()}
