import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from candor.llm.packing import Capacity, pack, pack_documents, pieces, plan
from candor.llm.queries import tokenizer_path


def check_plan(counts, capacity, **how):
    out, bins = plan(counts, capacity, **how), defaultdict(list)
    for length, n in counts.items():
        runs = out[length]
        for k in range(n):
            first, at, per, offset = [r for r in runs if r[0] <= k][-1]
            bins[at + (k - first) // per].append((offset + (k - first) % per * length, length))
    assert sorted(bins) == list(range(len(bins)))
    full = capacity.vector()
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= full[0] and len(held) <= full[1] and sum(x * x for _, x in held) <= full[2]
    return len(bins)


@pytest.mark.parametrize("by", ["dot", "norm"])
def test_plan_keeps_every_capacity_and_is_dense(by):
    rng = np.random.default_rng(1)
    for _ in range(20):
        counts = dict(Counter(rng.integers(1, 101, rng.integers(1, 3000)).tolist()))
        used = check_plan(counts, Capacity(100), by=by)
        assert used <= 1.03 * sum(k * n for k, n in counts.items()) / 100 + 2
        check_plan(counts, Capacity(100, 3), by=by)
        check_plan(counts, Capacity(100, 5, 6000 if max(counts) < 77 else 10000), by=by)
    assert plan({}, Capacity()) == {}
    with pytest.raises(ValueError, match="exceeds"):
        plan({101: 1}, Capacity(100))


def test_documents_round_trip(spark, sf_dir):
    texts = [None, "", "Hello  WORLD\x1c! don't <|endoftext|>x", "naïve\n\n\ttea é é 12345", "the cat " * 3000, "the cat " * 3000, "a" * 5000]
    docs = spark.createDataFrame([(5, i, t) for i, t in enumerate(texts)], "length int, doc_id long, text string")
    docs = docs.select("doc_id", "text", "length").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id + 100 as doc_id", "text", "7 as length"))
    whole = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = pack_documents(docs.repartition(3), tokenizer_path()).collect()
    t = Tokenizer.from_file(tokenizer_path())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(whole)
    total = 0
    for i, mine in by_doc.items():
        ids, at = [*t.encode(whole[i], add_special_tokens=False).ids, 0], 0
        total += len(ids)
        for k, r in enumerate(sorted(mine, key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and (r["length"] == 2048 or k == len(mine) - 1)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert len(by_sequence) <= -(-total // 2048) + 2


def test_one_length_and_no_documents(spark):
    docs = spark.createDataFrame([(i, "the same text") for i in range(500)], "doc_id long, text string")
    rows = pack_documents(docs, tokenizer_path(), Capacity(20, 3), salts=7).collect()
    assert max(Counter(r["sequence_id"] for r in rows).values()) == 3 and len({r["sequence_id"] for r in rows}) == 167
    assert pack(pieces(docs.limit(0), tokenizer_path())).collect() == []
