import csv
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from candor.operators import repair
from candor.operators.annotate import unannotated
from candor.plans import queries as plans
from candor.plans.streams import shared_folder
from candor.sources import generators as G
from candor.sources.sinks import HEADER, Usage, observed, write_metrics


def test_series_repaired_together_are_repaired_as_alone():
    rng = np.random.default_rng(6)
    sizes = rng.integers(1, 12, 300)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    t = np.concatenate([np.sort(rng.integers(0, 50, n)) for n in sizes]).astype(float)
    v = np.round(rng.random(len(t)) * 30, 1)
    v[rng.random(len(v)) < 0.02] = np.nan
    want = np.concatenate([repair.screen(t[a : a + n], v[a : a + n], -0.3, 0.4) for a, n in zip(first, sizes, strict=True)])
    assert np.array_equal(repair.screen_groups(t, v, first, -0.3, 0.4), want, equal_nan=True)
    free = np.concatenate([repair.screen(t[a : a + n], v[a : a + n]) for a, n in zip(first, sizes, strict=True)])
    assert np.array_equal(repair.screen_groups(t, v, first, None, None), free, equal_nan=True)


def test_metrics_have_memory_and_cpu(spark, tmp_path):
    seen_df, seen = observed(unannotated(spark.range(10).selectExpr("'a' as key", "id as ts", "id as seq")))
    with Usage(spark, 0.01) as usage:
        seen_df.count()
        time.sleep(0.05)
    path = str(tmp_path / "m.csv")
    for _ in range(2):
        write_metrics(path, "e", 10, 5, 0, seen, usage)
    rows = list(csv.reader(open(path)))
    assert rows[0] == HEADER and len(rows) == 3 and rows[1][5] == "10"
    low, high, load, most = map(float, rows[1][-4:])
    assert 0 < low <= high and 0 <= load <= most <= 1


def test_draws_are_spread_and_repeatable(spark):
    df = spark.range(5000).withColumn("key", F.lit("a")).select(G.draw(10, 7, "key", "id").alias("n"))
    counts = {r["n"]: r["count"] for r in df.groupBy("n").count().collect()}
    assert set(counts) == set(range(1, 11)) and min(counts.values()) > 400 and df.collect() == df.collect()


def test_shared_folder_is_in_the_folder_that_the_session_names(spark):
    a, b = shared_folder(spark), shared_folder(spark)
    assert a != b and a.startswith(spark.conf.get("spark.checkpoint.dir"))


@pytest.mark.parametrize("name", ["source_stocks_csv", "source_linear_road_csv", "reduce_and_slide", "annotate_pair_values", "q14_partial_stock_pearson", "stream_top_k", "stream_window_updates", "stream_annotate_key_chain"])
def test_queries_have_sql_and_run(spark, sf_dir, name):
    assert name in plans.oracle_sql() and plans.queries()[name](spark, sf_dir).count() > 0
