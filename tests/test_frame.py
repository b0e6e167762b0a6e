import csv

import pytest
from pyspark.sql import functions as F

from candor.operators import annotate as A
from candor.operators.constraints import SpeedConstraint
from candor.operators.frame import AnnotatedFrame, correlation, pearson
from candor.operators.repair import fill_gaps, screen
from candor.plans import applications as Q
from candor.sources import generators as G
from candor.sources import readers, sinks

# Published values of the grid cost query by the window's latest ts.
GOLDEN = {
    "truth": [504.0, 630.0, 630.0, 630.0, 630.0, 639.0, 678.0, 708.0, 690.0],
    "pure": [504.0, 522.0, 354.0, 318.0, 486.0, 615.0, 678.0, 708.0, 690.0],
    "repaired": [504.0, 538.8, 412.8, 484.8, 735.6, 921.0, 1084.8, 1242.0, 1262.4],
    "simplified": [504.0, 538.8, 412.8, 484.8, 735.6, 845.4, 757.2, 708.0, 690.0],
}


def costs(df):
    return {r["win_start"]: (r["ts"], round(r["value"], 6)) for r in df.collect()}


@pytest.mark.parametrize("name", GOLDEN)
def test_grid_cost_has_the_published_values(spark, name):
    got = costs(Q.grid_cost(G.grid(spark, dirty=name != "truth"), "pure" if name == "truth" else name))
    assert [got[s] for s in range(0, 18, 2)] == list(zip(range(4, 21, 2), GOLDEN[name], strict=True))


def test_grid_cost_of_consistent_records(spark):
    got = costs(Q.grid_cost(G.grid(spark), "consistent"))
    assert {s: got[s] for s in (0, 2, 4)} == {0: (4, 504.0), 2: (5, 468.0), 4: (5, 216.0)}


def annotated(spark):
    return AnnotatedFrame.annotated(G.stock_four(spark), SpeedConstraint("value", -1e-7, 1e-7), 10 * G.DAY_MS)


def test_payload_aggregates_do_not_depend_on_annotation(spark):
    plain = AnnotatedFrame.plain(G.stock_four(spark)).group("key").agg(F.sum("value").alias("s")).df
    with_it = annotated(spark).group("key").agg(F.sum("value").alias("s"), polynomial=True).df
    assert {(r["key"], round(r["s"], 6)) for r in plain.collect()} == {(r["key"], round(r["s"], 6)) for r in with_it.collect()}
    assert all(len(r["ann_poly"]) == r["ann_n_incons"] for r in with_it.collect())


def test_counts_are_the_same_for_any_partitioning(spark):
    df = G.stock_four(spark)
    counts = {A.annotate(df.repartition(n), SpeedConstraint("value", -1e-7, 1e-7), 10 * G.DAY_MS).agg(F.sum("ann_n_incons")).first()[0] for n in (1, 3, 7)}
    assert len(counts) == 1 and counts.pop() > 0


def test_projection_filter_and_keys(spark):
    f = annotated(spark)
    assert f.select("value").payload() == ["value"] and set(f.drop_annotation().columns) == {"key", "value", "ts", "seq"}
    assert f.where_annotation("ann_degree = 0").df.count() < f.df.count()
    assert f.with_key(F.lit("x")).df.select("key").distinct().count() == 1
    assert f.where_not_null().df.count() == f.df.count()
    with pytest.raises(ValueError, match="not an annotated relation"):
        AnnotatedFrame(G.stock_four(spark))


def test_filter_before_annotation_differs_from_filter_after(spark):
    df, c = G.stock_four(spark), SpeedConstraint("value", -1e-7, 1e-7)
    after = A.annotate(df, c, 10 * G.DAY_MS).where("seq >= 50").agg(F.sum("ann_degree")).first()[0]
    before = A.annotate(df.where("seq >= 50"), c, 10 * G.DAY_MS).agg(F.sum("ann_degree")).first()[0]
    assert after > before


def test_joins_multiply_annotations(spark):
    f = annotated(spark)
    both = f.join(f, 2 * G.DAY_MS).df.collect()
    by = {(r["key"], r["seq"]): r for r in f.df.collect()}
    assert len(both) == 4 * (7 + 6 + 5)
    for r in both:
        left, right = by[r["key"], r["left"]["seq"]], by[r["key"], r["right"]["seq"]]
        assert r["ann_degree"] == left["ann_degree"] + right["ann_degree"] and r["ts"] == max(left["ts"], right["ts"])
    lonely = f.left_join(f.where("value > 5000"), 0).df
    assert lonely.count() == 28 and lonely.where("right is not null").count() == 0
    with pytest.raises(ValueError):
        f.join(f, 1, how="outer")


def test_pairs_pearson_and_top_k(spark):
    out = Q.stock_pearson(G.stock_four(spark).withColumn("name", F.col("key")), SpeedConstraint("value", -1e-7, 1e-7), 10 * G.DAY_MS, 10 * G.DAY_MS, 4 * G.DAY_MS, 2 * G.DAY_MS, k=2)
    rows = out.withColumn("r", correlation()).collect()
    assert rows and all(r["rank"] <= 2 for r in rows) and all(r["r"] is None or -1.000001 <= r["r"] <= 1.000001 for r in rows)
    for s in {r["win_start"] for r in rows}:
        degrees = [r["ann_degree_sum"] for r in sorted(rows, key=lambda r: r["rank"]) if r["win_start"] == s]
        assert degrees == sorted(degrees, reverse=True)
    assert len(pearson("a", "b")) == 6


def test_qualitative_variants(spark):
    c = [SpeedConstraint("value", -10, 10, "SCA"), SpeedConstraint("value", -100, 100, "SCB")]
    df = G.stock_example(spark)
    got = {v: [r["value"] for r in Q.qualitative(df, c, 100, 100, v, {"value": "SCA"}).orderBy("seq").collect()] for v in ("pure", "consistent", "song", "simplified")}
    assert got["pure"] == [float(x) for x in G.STOCK_EXAMPLE] and len(got["consistent"]) < 11 and got["song"] != got["pure"]


def test_screen_keeps_speeds_within_bounds():
    t, v = list(range(8)), [0, 1, 2, 50, 4, 5, 6, 7]
    fixed = screen(t, v, -1, 1)
    assert fixed[3] < 10 and all(abs(b - a) <= 1 + 1e-9 for a, b in zip(fixed, fixed[1:]))
    assert screen([1], [5.0]).tolist() == [5.0] and screen([], []).tolist() == []
    assert fill_gaps([0, 1, 2, 3], [float("nan"), 1, float("inf"), 3]).tolist() == [0, 1, 2, 3]


def test_repair_by_key_and_window(spark):
    df = spark.createDataFrame([("a", t, t, v) for t, v in enumerate([0, 1, 90, 3, 4])] + [("b", 0, 9, 7)], "key string, ts bigint, seq bigint, v int")
    got = {r["seq"]: r["v"] for r in Q.repaired(df, "v", 10, 10, 1.0).collect()}
    assert got[9] == 7 and got[2] < 10 and len(got) == 6


def test_generators(spark):
    df = G.grid_ablation(spark, 250)
    assert df.where("uuid = 'shared'").count() == 2 and df.agg(F.sum("cons_a")).first()[0] == sum(G.ABLATION_A[i % 19] for i in range(250))
    again = G.replay(df, 3)
    assert again.count() == 750 and again.select("seq").distinct().count() == 750 and again.agg(F.max("ts")).first()[0] == 750
    ticks = G.simulated_time(df)
    assert ticks.agg(F.max("ts")).first()[0] == 250_000
    assert G.inject_every(df, "cons_a", -1).where("cons_a = -1").count() == 22
    few = G.inject_percent(df, "cons_a", 20)
    changed = few.alias("f").join(df.alias("d"), "seq").where("f.cons_a != d.cons_a").count()
    assert 20 <= changed <= 80 and sorted(few.collect()) == sorted(G.inject_percent(df, "cons_a", 20).collect())


def test_csv_readers(spark, tmp_path):
    (tmp_path / "ACME.csv").write_text("date,a,open,b,c,close\n02-01-2020,x,10.5,x,x,11\nbad,x,1,x,x,2\n")
    rows = readers.stocks(spark, f"{tmp_path}/ACME.csv").orderBy("ts").collect()
    assert [(r["name"], r["value"]) for r in rows] == [("ACME", 10.5), ("ACME", 11.0)] and rows[1]["ts"] - rows[0]["ts"] == 13 * 3_600_000
    (tmp_path / "gps.csv").write_text("ts,y,x\n5,1.5,2.5\n")
    assert readers.gps(spark, f"{tmp_path}/gps.csv").first().asDict() == {"x": 2.5, "y": 1.5, "ts": 5}
    (tmp_path / "reviews.csv").write_text("7,Film,2020-01-02,4\n8,Short\n")
    assert [r["value"] for r in readers.reviews(spark, f"{tmp_path}/reviews.csv").collect()] == [4]
    (tmp_path / "road.csv").write_text("skip\n[1, 60,x, 2,x,x, 33,x, 900]\n")
    assert readers.linear_road(spark, f"{tmp_path}/road.csv").first().asDict() == {"ts": 900, "speed": 60, "vid": 1, "x_way": 2, "segment": 33}


def test_metrics(spark, tmp_path):
    watched, seen = sinks.observed(annotated(spark).df)
    watched.write.format("noop").mode("overwrite").save()
    for _ in range(2):
        sinks.write_metrics(f"{tmp_path}/m.csv", "x", 10, 5, 0, seen)
    lines = list(csv.DictReader(open(f"{tmp_path}/m.csv")))
    assert len(lines) == 2 and lines[0]["events"] == "28" and int(lines[0]["inconsistencies"]) > 0
