"""Readers of the relations that queries work on; ts is epoch milliseconds everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def millis(ts: str) -> Column:
    """Epoch ms of a timestamp column without a zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, {EPOCH}, {ts})")


def _csv(spark: SparkSession, path: str, columns: int, header: bool = False) -> DataFrame:
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(columns)])
    return spark.read.csv(path, schema=schema, header=header, enforceSchema=True)


def _at(date: str, pattern: str, clock: str) -> Column:
    return F.unix_millis(F.try_to_timestamp(F.concat(F.col(date), F.lit(" " + clock)), F.lit(pattern + " HH:mm")))


def stocks(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """Daily CSV (header; 0 date dd-MM-yyyy, 2 opening, 5 closing value): two rows a day, at 07:00 and 20:00. The
    name is the file's, without its ending, unless given."""
    symbol = F.lit(name) if name else F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1)
    day = _csv(spark, path, 6, header=True).withColumn("name", symbol)
    points = F.array(*[F.struct(_at("c0", "dd-MM-yyyy", clock).alias("ts"), F.col(c).try_cast("double").alias("value")) for clock, c in (("07:00", "c2"), ("20:00", "c5"))])
    return day.select("name", F.explode(points).alias("p")).select("name", "p.value", "p.ts").where("ts is not null and value is not null")


def gps(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header: 0 ts, 1 y, 2 x."""
    row = _csv(spark, path, 3, header=True)
    return row.select(F.col("c2").try_cast("double").alias("x"), F.col("c1").try_cast("double").alias("y"), F.col("c0").try_cast("bigint").alias("ts")).dropna()


def reviews(spark: SparkSession, path: str) -> DataFrame:
    """CSV without header: 0 user, 1 title, 2 date yyyy-MM-dd (07:00), 3 rating; shorter rows are skipped."""
    row = _csv(spark, path, 4)
    return row.select(F.col("c0").try_cast("bigint").alias("user_id"), F.col("c1").alias("title"), _at("c2", "yyyy-MM-dd", "07:00").alias("ts"), F.col("c3").try_cast("int").alias("value")).dropna()


def linear_road(spark: SparkSession, path: str) -> DataFrame:
    """CSV, first line skipped, with brackets and blanks: 0 vid, 1 speed, 3 x_way, 6 segment, 8 ts."""
    row = _csv(spark, path, 9, header=True)
    clean = lambda c: F.regexp_replace(c, r"[\[\]() ]", "")
    kinds = {"c8": ("ts", "bigint"), "c1": ("speed", "int"), "c0": ("vid", "bigint"), "c3": ("x_way", "int"), "c6": ("segment", "int")}
    return row.select(*[clean(c).try_cast(t).alias(n) for c, (n, t) in kinds.items()]).dropna()


def events(spark: SparkSession, sf_dir: str, key: str = "user_id") -> DataFrame:
    """The events table as a stream relation: key, ts, seq, cents (value in hundredths, whole), v (value) and the rest."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    return as_events(table, key)


def as_events(table: DataFrame, key: str = "user_id") -> DataFrame:
    return table.select(F.col(key).alias("key"), millis("ts").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("v"), F.round(F.col("value") * 100).cast("bigint").alias("cents"), "user_id", "event_type")


def kafka(spark: SparkSession, servers: str, topic: str, schema: T.StructType | str, ts: str, streaming: bool = True) -> DataFrame:
    """JSON records of a topic, from the earliest offset; event time is the record's own field (epoch ms), as `ts` and,
    for watermarks, as the timestamp `event_time`. Needs Spark's Kafka package on the class path."""
    reader = spark.readStream if streaming else spark.read
    raw = reader.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()
    row = raw.select(F.col("key").cast("string").alias("key"), F.from_json(F.col("value").cast("string"), schema).alias("r")).select("key", "r.*")
    return row.withColumn("ts", F.col(ts)).withColumn("event_time", F.timestamp_millis("ts"))


def parquet_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)
