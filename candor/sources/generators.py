"""Deterministic inputs: literal series, replay, simulated time, and injected errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Series of the grid, GPS and stock examples, by position.
GRID_A = [80, 80, 80, 80, 50, 20, 0, 20, 40, 60, 80, 80, 80, 50, 30, 0, 20, 40, 60, 80, 80, 80, 80]
GRID_B = [20, 20, 20, 20, 20, 20, 20, 20, 20, 20, 20, 20, 20, 50, 70, 100, 80, 60, 40, 20, 20, 20, 20]
ABLATION_A = [80, 80, 80, 80, 50, 30, 20, 20, 40, 60, 80, 80, 80, 60, 40, 20, 20, 40, 60]
ABLATION_B = [20, 20, 20, 20, 20, 20, 20, 20, 20, 20, 20, 20, 20, 50, 70, 100, 80, 60, 40]
GPS_X = [10, 15, 15, 20, 25, 3000, 40, 45, 45, 60, 75, 80, 85, 90, 95, 100, 105, 110, 115, 120, 125, 130, 135, 140, 145]
GPS_Y = [10, 15, 20, 20, 25, 25000, 40, 45, 50, 60, 75, 80, 85, 90, 95, 100, 105, 110, 115, 120, 125, 130, 135, 140, 145]
STOCK_EXAMPLE = [12, 10, 120, 120, 1200, 1200, 1200, 2200, 2200, 3200, 3200]
STOCK_FOUR = {
    "A": [132.69, 132.69, 131.99, 132.05, 129.41, 200.41, 200.41],
    "B": [223.52, 223.52, 223.52, 223.52, 223.52, 400.00, 400.00],
    "C": [3218.51, 3218.51, 3218.51, 3218.51, 3218.51, 1218.51, 1218.51],
    "D": [1751.88, 1751.88, 1751.88, 1751.88, 1751.88, 4751.88, 4751.88],
}
DAY_MS = 86_400_000


def grid(spark: SparkSession, dirty: bool = True) -> DataFrame:
    a = GRID_A if dirty else [80] * 13 + GRID_A[13:]
    rows = [(1, x, y, t, f"u{t}", t) for t, (x, y) in enumerate(zip(a, GRID_B, strict=True), 1)]
    return spark.createDataFrame(rows, "key int, cons_a bigint, cons_b bigint, ts bigint, uuid string, seq bigint")


def gps_manual(spark: SparkSession) -> DataFrame:
    odd = {13: "gps.key()", 19: "gps.key()", 23: "gps.key()"}
    rows = [(odd.get(t, "key"), float(x), float(y), t, t) for t, (x, y) in enumerate(zip(GPS_X, GPS_Y, strict=True), 1)]
    return spark.createDataFrame(rows, "key string, x double, y double, ts bigint, seq bigint")


def stock_example(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("A", float(v), t, t) for t, v in enumerate(STOCK_EXAMPLE, 1)], "key string, value double, ts bigint, seq bigint")


def stock_four(spark: SparkSession) -> DataFrame:
    rows = [(name, v, day * DAY_MS, day * 10 + k) for k, (name, values) in enumerate(STOCK_FOUR.items()) for day, v in enumerate(values)]
    return spark.createDataFrame(rows, "key string, value double, ts bigint, seq bigint")


def grid_ablation(spark: SparkSession, n: int) -> DataFrame:
    """The 19-row pattern repeated for ts 1 to n; one shared uuid wherever ts is a multiple of 100."""
    at = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), ((F.col("ts") - 1) % len(values) + 1).cast("int")).cast("bigint")
    uuid = F.when(F.col("ts") % 100 == 0, F.lit("shared")).otherwise(F.concat(F.lit("u"), F.col("ts")))
    return spark.range(1, n + 1).select(F.lit(1).alias("key"), F.col("id").alias("ts"), F.col("id").alias("seq")).withColumns({"cons_a": at(ABLATION_A), "cons_b": at(ABLATION_B), "uuid": uuid})


def replay(df: DataFrame, times: int) -> DataFrame:
    """The relation over and over, each time shifted by its time span + 1 ms; seq goes on. The span is one small row."""
    span = df.agg((F.max("ts") - F.min("ts") + 1).alias("_span"), (F.max("seq") - F.min("seq") + 1).alias("_seqs"))
    rounds = df.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).join(F.broadcast(span))
    return rounds.withColumn("ts", F.col("ts") + F.col("round") * F.col("_span")).withColumn("seq", F.col("seq") + F.col("round") * F.col("_seqs")).drop("_span", "_seqs")


def simulated_time(df: DataFrame, source: str = "key", order: Sequence[str] = ("ts", "seq"), step_ms: int = 1000) -> DataFrame:
    """Replaces ts by the row's number within its source times a step: one record of each source in every tick."""
    return df.withColumn("ts", (F.row_number().over(Window.partitionBy(source).orderBy(*order)) * F.lit(step_ms)).cast("bigint"))


def inject_every(df: DataFrame, column: str, dirty: object, period: int = 11, phase: int = 0, by: str = "key", order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """Puts a value outside the domain into every `period`-th record of a group."""
    number = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn(column, F.when(number % period == phase % period, F.lit(dirty).cast(df.schema[column].dataType)).otherwise(F.col(column)))


def draw(n: int, seed: int, *columns: str) -> Column:
    """A number from 1 to n that depends on the columns' texts and the seed alone (32 bits of an MD5 digest)."""
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns], F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % n + 1


def inject_percent(df: DataFrame, column: str, percent: int, seed: int = 7, by: str = "key", order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """Replaces about percent % of the values by the group's running mean times 1 to 50, with alternating sign. The
    choice is by hash, so it is the same in every run."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    hit = draw(100, seed, by, "seq") <= percent
    many = draw(50, seed + 1, by, "seq")
    sign = F.when(F.sum(hit.cast("int")).over(w) % 2 == 0, F.lit(1)).otherwise(F.lit(-1))
    return df.withColumn(column, F.when(hit, F.avg(column).over(w) * many * sign).otherwise(F.col(column)).cast(df.schema[column].dataType))
