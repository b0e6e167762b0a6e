import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from candor.functions import algebra
from candor.operators import annotate as A
from candor.operators import blocks
from candor.operators.constraints import Constraint, Domain, PlaneSpeedConstraint, PrimaryKey, SpeedConstraint
from candor.plans import applications as Q
from candor.plans import queries as plans
from tests.test_annotation import SC, frame, model, rows_of, some_rows

CONSTRAINTS = (SC, PrimaryKey(("p",)), PlaneSpeedConstraint("v", "p", -0.5, 0.5), SpeedConstraint("v", -1, 1, upper_only=True))


@pytest.mark.parametrize("most", [1 << 19, 7])
@pytest.mark.parametrize(("size", "slide"), [(10, 10), (12, 4), (7, 3)])
def test_blocks_are_the_model(spark, monkeypatch, size, slide, most):
    monkeypatch.setattr(blocks.violations, "__defaults__", (most,))
    rows = some_rows(60, size * 31 + slide)
    for c in CONSTRAINTS:
        want = model(rows, c, size, slide)
        assert rows_of(A.annotate(frame(spark, rows), c, size, slide, mode="blocks")) == want
        bare = A.annotate(frame(spark, rows), c, size, slide, mode="blocks", variables=False)
        assert {(r["key"], r["seq"]): r["ann_degree"] for r in bare.collect()} == {k: sum(v.values()) for k, v in want.items()}


def test_blocks_and_pairs_agree_on_all_windows_and_several_constraints(spark):
    rows, made = some_rows(80, 4), [SC, PrimaryKey(("p",)), Domain("v > 10")]
    for size, slide in ((12, 4), (7, 3)):
        both = [A.annotate(frame(spark, rows), made, size, slide, emit="all", mode=m).select("key", "seq", "win_start", "ann_degree", algebra.text(F.col("ann_vars")).alias("t")) for m in ("exact", "blocks")]
        assert sorted(both[0].collect()) == sorted(both[1].collect())


def test_far_apart_values_and_many_violations_are_whole(spark):
    rows = [{"key": "a", "ts": t, "seq": t, "v": v, "p": 0} for t, v in enumerate([0.0, 1e12, 3e12])]
    want = model(rows, SC, 100, 100)
    for mode in ("exact", "blocks"):
        got = A.annotate(frame(spark, rows), SC, 100, mode=mode)
        assert rows_of(got) == want and got.agg(F.sum("ann_degree")).first()[0] == sum(sum(m.values()) for m in want.values()) > 2**40


def test_blocks_take_nulls_nan_and_empty_tables(spark):
    data = [("a", 1, 1, 0.0, 1), ("a", 2, 2, None, None), ("a", 3, 3, float("nan"), 1), ("a", 4, 4, 50.0, None), (None, 5, 5, 90.0, 1)]
    df = spark.createDataFrame(data, "key string, ts bigint, seq bigint, v double, p int")
    got = {r["seq"]: r["ann_vars"] for r in A.annotate(df, [SC, PrimaryKey(("p",))], 100, mode="blocks").collect()}
    assert got == {1: {}, 2: {}, 3: {"PK_1": 1}, 4: {"SC_1": 47}, 5: {}}
    assert A.annotate(df.limit(0), SC, 100, mode="blocks").count() == 0


def test_skipped_blocks_hold_no_violation():
    rng, c = np.random.default_rng(3), SpeedConstraint("v", -0.1, 0.1)
    for _ in range(200):
        side = lambda n, t: {"ts": np.sort(rng.integers(t, t + 50, n)).astype(float), "v": np.round(rng.random(n) * rng.choice([1, 10, 40]), 2)}  # noqa: E731, B023
        o, r = side(5, 0), side(4, 50)
        d = c.distances({k: v[None] for k, v in o.items()}, {k: v[:, None] for k, v in r.items()})
        assert d.any() <= blocks._may_violate(c.lines(o)[0], c.lines(r)[0], slice(0, 5), slice(0, 4))


def test_a_constraint_without_matrices_of_its_own(spark):
    class Parity(Constraint):
        name = "PAR"

        def columns(self):
            return ["v"]

        def value(self, origin, record):
            return float((origin["v"] + record["v"]) % 2)

    c = Parity()
    got = c.distances({"ts": np.zeros((1, 2)), "v": np.array([[1.0, 2.0]])}, {"ts": np.ones((3, 1)), "v": np.array([[1.0], [2.0], [3.0]])})
    assert got.tolist() == [[0, 1], [1, 0], [0, 1]]


def test_pairs_of_sums_are_sums_of_pairs(spark):
    data = [(n, t, s, float(v)) for s, (n, t, v) in enumerate((n, t, (i * 7 + t) % 11) for i, n in enumerate("ABCA") for t in range(0, 40, 2))]
    df = spark.createDataFrame(data, "name string, ts bigint, seq bigint, value double").withColumn("key", F.col("name"))
    got = Q.stock_pearson(df, SpeedConstraint("value", -0.2, 0.2), 10, 5, 20, 10, k=9).collect()
    pairs = Q.stock_combo(df, SpeedConstraint("value", -0.2, 0.2), 10, 5).df.select("left.name", F.col("right.name").alias("other"), F.col("left.value").alias("x"), F.col("right.value").alias("y"), "ts", "ann_degree_sum", "ann_n_incons").collect()
    assert len(got) == 6 * 4
    for r in got:
        mine = [p for p in pairs if f"{p['name']}|{p['other']}" == r["key"] and r["win_start"] <= p["ts"] < r["win_start"] + 20]
        assert r["n_couples"] == len(mine) and r["sum_xy"] == sum(p["x"] * p["y"] for p in mine) and r["sum_y2"] == sum(p["y"] ** 2 for p in mine)
        assert r["ann_degree_sum"] == sum(p["ann_degree_sum"] for p in mine) and r["ann_degree"] == max(p["ann_degree_sum"] for p in mine) and r["ann_n_incons"] == sum(p["ann_n_incons"] for p in mine)


@pytest.mark.parametrize("most", [1 << 19, 7])
def test_variables_are_made_where_the_row_is_and_not_shuffled(spark, monkeypatch, most):
    """All columns, types and rows stay, also of groups that are cut, rows without key or seq, and early ones."""
    monkeypatch.setattr(blocks, "MOST", most)
    rows = some_rows(80, 9)
    df = frame(spark, rows).withColumn("a.b", F.concat(F.lit("x"), "seq")).withColumn("part", F.struct("v", "p"))
    odd = df.limit(3).select(*[(F.lit(None) if c == "key" else F.col(f"`{c}`")).cast(t).alias(c) for c, t in df.dtypes])
    early = df.limit(2).withColumn("ts", F.col("ts") - 1000).withColumn("seq", F.col("seq") + 5000)
    df = df.unionByName(odd).unionByName(early)
    for size, slide, emit in ((12, 4, "first"), (12, 4, "all"), (7, 3, "all")):
        shown = []
        for mode in ("exact", "blocks"):
            out = A.annotate(df, [SC, PrimaryKey(("p",))], size, slide, emit=emit, keep_window=True, mode=mode)
            text = out.withColumn("t", algebra.text(F.col("ann_vars"))).drop("ann_vars")
            shown.append((text.dtypes, sorted(map(str, text.collect()))))
            if mode == "blocks" and most > 7:
                plan = text._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
                assert "MapInArrow" in plan and "hashpartitioning(key#" in plan and not [x for x in plan.splitlines() if "Exchange hashpartitioning(key" in x and "_g1" not in x]
        assert shown[0] == shown[1]


@pytest.mark.parametrize("most", [1 << 19, 7])
def test_rows_taken_along_have_the_degrees_of_the_join(spark, monkeypatch, most):
    monkeypatch.setattr(blocks, "MOST", most)
    df = frame(spark, some_rows(80, 9))
    odd = df.limit(3).select(*[(F.lit(None) if c == "key" else F.col(c)).cast(t).alias(c) for c, t in df.dtypes])
    df = df.unionByName(odd).unionByName(df.limit(2).withColumn("ts", F.col("ts") - 1000).withColumn("seq", F.col("seq") + 5000))
    for size, slide, emit in ((12, 4, "first"), (12, 4, "all"), (7, 3, "all")):
        how = {"emit": emit, "keep_window": True}
        exact = A.annotate(df, [SC, PrimaryKey(("p",))], size, slide, **how).withColumn("ann_vars", F.lit(None).cast(algebra.VARS_TYPE))
        along = A.annotate(df, [SC, PrimaryKey(("p",))], size, slide, mode="blocks", variables=False, rows_along=True, **how)
        assert exact.dtypes == along.dtypes and sorted(map(str, exact.collect())) == sorted(map(str, along.collect()))


def test_stock_combo_joins_no_rows_with_their_degrees(spark, sf_dir):
    df = plans.queries()["q1_stock_combo"](spark, sf_dir)
    df.collect()  # the plan without what turned out to be empty, records of groups that are cut
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    dealt_by = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert "MapInArrow" in plan and dealt_by and not [x for x in dealt_by if "win_start#" in x]


@pytest.mark.parametrize("most", [1 << 19, 7])
def test_a_row_goes_once_to_its_group_and_on_only_where_a_window_reaches(spark, most):
    """Two windows in one bucket length: the first half of a bucket is in no window of the next one's records."""
    df = frame(spark, [{"key": "a", "ts": t, "seq": t, "v": float(t), "p": 0} for t in range(100, 180)]).withColumn("w", F.lit("x"))
    carried = ["ts", "v", "p", "w"]
    placed, _, _, there = blocks._dealt(df, [SC, PrimaryKey(("p",))], 20, 10, "first", most, carried)
    assert there == {"ts": "ts", "v": "n0", "p": "e0", "w": "p3"}
    got = placed.where("_i = 0 and _j = 0" if most > 80 else "role = 0 and _j = 0 or role = 1 and _i = 0").collect()
    assert sum(r["role"] != 1 for r in got) == 80 and all((r["p3"] is None) == (r["role"] == 1) for r in got)
    on = [r["ts"] for r in got if r["_g1"] > r["ts"] // 20]
    assert sorted(on) == [t for t in range(100, 180) if t % 20 >= 10]
    assert len(got) == (120 if most > 80 else 200)


def test_one_key_shuffles_only_what_it_shows(spark, sf_dir):
    df = plans.queries()["annotate_values_one_key"](spark, sf_dir)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "user_id" in plan and "cents" not in plan


@pytest.mark.parametrize("variables", [True, False])
def test_like_origins_are_compared_once(spark, monkeypatch, variables):
    """Copies of rows, some within a tick, some with nulls: results of the pair join, by a fraction of its pairs."""
    rows = [{**r, "seq": r["seq"] + 1000 * k} for k in range(6) for r in some_rows(50, 5)]
    df = frame(spark, rows).withColumn("v", F.when(F.col("seq") % 1000 != 7, F.col("v")))
    made, seen = [SC, PrimaryKey(("p",))], []
    for mode in ("exact", "blocks"):
        out = A.annotate(df, made, 12, 4, mode=mode, rows_along=True, variables=variables or mode == "exact")
        seen.append(sorted(map(str, out.select("key", "seq", "ann_degree", *([algebra.text(F.col("ann_vars")).alias("t")] if variables else [])).collect())))
    assert seen[0] == seen[1] and len(seen[0]) == 300
    n = 40 * 6
    place = np.repeat(np.arange(40), 6)
    side = blocks._Side({"ts": place.astype(float), "v": place * 1.5}, {"PK": place % 3})
    rep, weights = blocks._alike(place, side)
    assert len(rep) == 40 and weights.sum() == n and place[rep].tolist() == list(range(40))
    assert blocks._alike(np.arange(n), side) is None
