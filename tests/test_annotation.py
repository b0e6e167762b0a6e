import math
import random

import pytest
from pyspark.sql import functions as F

from candor.operators import annotate as A
from candor.operators.constraints import Domain, PlaneSpeedConstraint, PrimaryKey, SpeedConstraint
from candor.operators.paths import ChainHistory, PathHistory, windows_of
from candor.operators.windows import annotation_windows, containing_start, hopping_starts
from candor.sources import generators as G

SC = SpeedConstraint("v", -1.0, 1.0)


def rows_of(df):
    return {(r["key"], r["seq"]): r["ann_vars"] for r in df.collect()}


def model(rows, constraint, size, slide):
    """Violations of each record with the history of the earliest window that holds it."""
    out = {}
    for r in rows:
        w = windows_of(r["ts"], size, slide)[0]
        found = {}
        for o in rows:
            if o["key"] == r["key"] and (o["ts"], o["seq"]) < (r["ts"], r["seq"]) and w in windows_of(o["ts"], size, slide):
                d = constraint.value(o, r)
                if d:
                    name = f"{constraint.name}_{o['ts']}"
                    found[name] = found.get(name, 0) + math.ceil(abs(d))
        out[r["key"], r["seq"]] = found
    return out


def some_rows(n, seed, keys=2, ties=True):
    rng = random.Random(seed)
    return [{"key": f"k{rng.randrange(keys)}", "ts": rng.randrange(0, 60) if ties else i, "seq": i, "v": float(rng.randrange(-20, 20)), "p": rng.randrange(4)} for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(r["key"], r["ts"], r["seq"], r["v"], r["p"]) for r in rows], "key string, ts bigint, seq bigint, v double, p int")


@pytest.mark.parametrize(("size", "slide"), [(10, 10), (12, 4), (5, 2), (7, 3), (60, 1)])
def test_exact_annotation_is_the_model(spark, size, slide):
    rows = some_rows(60, size * 31 + slide)
    for c in (SC, PrimaryKey(("p",)), PlaneSpeedConstraint("v", "p", -0.5, 0.5), SpeedConstraint("v", -1, 1, upper_only=True)):
        assert rows_of(A.annotate(frame(spark, rows), c, size, slide)) == model(rows, c, size, slide)


def test_products_of_several_constraints(spark):
    rows = some_rows(60, 5)
    pk = PrimaryKey(("p",))
    got = rows_of(A.annotate(frame(spark, rows), [SC, pk, Domain("v > 10")], 12, 4))
    sc, key = model(rows, SC, 12, 4), model(rows, pk, 12, 4)
    for r in rows:
        k = r["key"], r["seq"]
        assert got[k] == sc[k] | key[k] | ({f"SCH_{r['ts']}": 1} if r["v"] > 10 else {})


def test_all_windows_and_kept_window(spark):
    rows = some_rows(40, 8)
    every = A.annotate(frame(spark, rows), SC, 12, 4, emit="all")
    got = {(r["key"], r["seq"], r["win_start"]): r["ann_vars"] for r in every.collect()}
    assert len(got) == sum(len(windows_of(r["ts"], 12, 4)) for r in rows)
    first = A.annotate(frame(spark, rows), SC, 12, 4, keep_window=True).collect()
    assert all(got[r["key"], r["seq"], r["win_start"]] == r["ann_vars"] and r["win_start"] == windows_of(r["ts"], 12, 4)[0][0] for r in first)


@pytest.mark.parametrize("seed", range(4))
def test_paths_find_the_same_origins_and_multiples_of_the_exponents(spark, seed):
    rows = some_rows(50, seed, ties=False)
    exact = rows_of(A.annotate(frame(spark, rows), SC, 30, 10))
    paths = rows_of(A.annotate(frame(spark, rows), SC, 30, 10, mode="paths"))
    assert exact.keys() == paths.keys()
    for k, found in exact.items():
        assert paths[k].keys() == found.keys() and all(paths[k][v] % e == 0 for v, e in found.items())


def test_a_record_on_two_paths_counts_twice():
    h = PathHistory(SpeedConstraint("v", -1.0, 1.0))
    found = [h.add({"ts": t, "v": v}) for t, v in enumerate([0.0, 0.5, 9.0, 1.0, 9.5, 3.0])]
    assert found[0] == found[1] == {} and found[2] == {"SC_0": 7, "SC_1": 8}
    assert max(sum(f.values()) for f in found[3:]) > 0


def test_key_chain_counts_earlier_records_of_the_key(spark):
    keys, h = "kgkkkkk", ChainHistory(PrimaryKey(("k",)))
    assert [len(h.add({"ts": t, "k": k})) for t, k in enumerate(keys)] == [0, 0, 1, 2, 3, 4, 5]


def test_validation_keeps_rejected_records_as_origins(spark):
    rows = [{"key": "a", "ts": t, "seq": t, "v": v, "p": 0} for t, v in enumerate([0.0, 50.0, 50.5, 2.0])]
    assert [r["seq"] for r in A.consistent_only(frame(spark, rows), SC, 100).collect()] == [0]


def test_sampled_records_alone_are_checked(spark):
    rows = some_rows(60, 2)
    got = rows_of(A.annotate_some(frame(spark, rows), SC, 30, 10, chosen=F.col("seq") % 2 == 0))
    want = model([r for r in rows if r["seq"] % 2 == 0], SC, 30, 10)
    assert got == {**{(r["key"], r["seq"]): {} for r in rows}, **want}
    assert rows_of(A.annotate_some(frame(spark, rows), SC, 30, 10, percent=0)) == {(r["key"], r["seq"]): {} for r in rows}


def test_one_key_for_all_and_the_self_join_plan(spark):
    rows = some_rows(40, 3)
    merged = [{**r, "key": "all"} for r in rows]
    got = {r["seq"]: r["ann_vars"] for r in A.annotate_values(frame(spark, rows), SC, 12, 4).collect()}
    assert got == {s: m for (_, s), m in model(merged, SC, 12, 4).items()}
    joined = rows_of(A.annotate_by_self_join(frame(spark, rows), SC, 9))
    for r in rows:
        want = {}
        for o in rows:
            if o["key"] == r["key"] and r["ts"] - 9 <= o["ts"] and (o["ts"], o["seq"]) < (r["ts"], r["seq"]) and (d := SC.value(o, r)):
                want[f"SC_{o['ts']}"] = want.get(f"SC_{o['ts']}", 0) + math.ceil(abs(d))
        assert joined[r["key"], r["seq"]] == want


def test_misuse_is_refused(spark):
    df = frame(spark, some_rows(3, 1))
    for bad in (dict(constraints=[]), dict(constraints=[SC, SC]), dict(constraints=SC, emit="some"), dict(constraints=SC, mode="x"), dict(constraints=SC, size=0), dict(constraints=SC, slide=20)):
        with pytest.raises(ValueError):
            A.annotate(df, **{"size": 10, **bad})


def test_window_rules(spark):
    df = spark.range(60).withColumnRenamed("id", "ts")
    for size, slide in ((5, 2), (6, 3), (10, 10), (7, 3)):
        got = df.select("ts", annotation_windows(F.col("ts"), size, slide).alias("w"), hopping_starts(F.col("ts"), size, slide).alias("h"), containing_start(F.col("ts"), size, slide).alias("c")).collect()
        for r in got:
            assert [(w["start"], w["end"]) for w in r["w"]] == windows_of(r["ts"], size, slide)
            assert r["h"] == [s for s in range(0, r["ts"] + 1, slide) if s <= r["ts"] < s + size]
            assert r["c"] == max(0, r["ts"] - size + slide) // slide * slide
    assert windows_of(4, 5, 2) == [(0, 5), (2, 7), (4, 9)] and windows_of(5, 5, 2) == [(1, 6), (3, 8), (5, 10)]


def test_literal_series(spark):
    got = rows_of(A.annotate(G.gps_manual(spark), PlaneSpeedConstraint("x", "y", -10, 10), 100))
    jump = {k for k, v in got.items() if "SC_6" in v}
    assert len([k for k in got if k[0] == "gps.key()"]) == 3 and jump and all(k[0] == "key" for k in jump)
    assert G.stock_example(spark).count() == 11 and G.stock_four(spark).count() == 28
