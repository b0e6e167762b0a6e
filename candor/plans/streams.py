"""The same queries as streams: the events file is read as a stream, run to its end, and the result table is read back."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candor.functions.algebra import VARS_TYPE
from candor.operators import annotate as A
from candor.operators.constraints import Domain, PrimaryKey, SpeedConstraint
from candor.operators.frame import AnnotatedFrame
from candor.sources.readers import as_events, parquet_stream
from candor.sources.sinks import for_each_batch, write_stream
from candor.streaming.annotate import annotate_stream, annotate_stream_domain, join_streams, window_aggregate, with_event_time

HOUR = 3_600_000


def shared_folder(spark: SparkSession, name: str = "stream") -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir; a temporary one on one machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a stream source takes folders: this one's only file, or all of a folder's
    source = path if not os.path.isfile(path.removeprefix("file://")) else f"{sf_dir}/events.parque[t]"
    return with_event_time(as_events(parquet_stream(spark, source, schema)), HOUR)


def _finished(df: DataFrame, mode: str = "append") -> DataFrame:
    spark, folder = df.sparkSession, shared_folder(df.sparkSession)
    write_stream(df, "parquet", f"q{uuid.uuid4().hex}", f"{folder}/state", mode, f"{folder}/out").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


def stream_annotate_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = annotate_stream(_events(spark, sf_dir), [SpeedConstraint("v", -1e-6, 1e-6), PrimaryKey(("event_type",))], 48 * HOUR, 12 * HOUR)
    return _finished(out).select("seq", "ann_degree", "ann_n_incons")


def stream_annotate_key_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = annotate_stream(_events(spark, sf_dir), PrimaryKey(("event_type",)), 48 * HOUR, 12 * HOUR)
    return _finished(out).select("seq", F.col("ann_degree").cast("bigint").alias("ann_degree"), "ann_n_incons")


def stream_annotate_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = annotate_stream_domain(_events(spark, sf_dir), Domain("v > 150"))
    return _finished(out).select("seq", F.col("ann_degree").cast("bigint").alias("ann_degree"))


def stream_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = A.unannotated(_events(spark, sf_dir))
    b = A.unannotated(_events(spark, sf_dir)).where("event_type = 'purchase'")
    return _finished(join_streams(a, b, 6 * HOUR)).select(F.col("left.seq").alias("left_seq"), F.col("right.seq").alias("right_seq"))


def stream_window_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has closed."""
    out = window_aggregate(annotate_stream_domain(_events(spark, sf_dir), Domain("v > 150")), 24 * HOUR, 6 * HOUR, ["event_type"], F.sum("cents").alias("cents"))
    return _finished(out).select("event_type", "win_start", "cents", F.col("ann_degree_sum").cast("bigint").alias("ann_degree_sum"))


def _updated(df: DataFrame, keys: list[str]) -> DataFrame:
    """The last value of each group of an aggregation in update mode: what every batch has changed is one table, which
    a batch that is run again replaces."""
    spark, folder = df.sparkSession, shared_folder(df.sparkSession)
    for_each_batch(df, lambda rows, batch: rows.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}"), f"{folder}/state").awaitTermination()
    seen = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{folder}/out")
    values = [c for c in df.columns if c not in keys]
    return seen.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("last")).select(*keys, "last.*")


def _typed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = window_aggregate(annotate_stream_domain(_events(spark, sf_dir), Domain("v > 150")), 24 * HOUR, 6 * HOUR, ["event_type"], F.sum("cents").alias("cents"))
    return _updated(out, ["event_type", "win_start"])


def stream_window_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window with the last update of it, closed or not."""
    return _typed_windows(spark, sf_dir).select("event_type", "win_start", "cents", F.col("ann_degree_sum").cast("bigint").alias("ann_degree_sum"))


def stream_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two most inconsistent event types of every window, over the last updates."""
    ranked = AnnotatedFrame(_typed_windows(spark, sf_dir).withColumnsRenamed({"event_type": "key"}).withColumn("ann_vars", F.lit(None).cast(VARS_TYPE)))
    return ranked.top(2).select("key", "win_start", F.col("ann_degree_sum").cast("bigint").alias("ann_degree_sum"), "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (stream_annotate_paths, stream_annotate_key_chain, stream_annotate_domain, stream_window_updates, stream_top_k, stream_interval_join, stream_window_aggregate)}


def oracle_sql() -> dict[str, str]:
    ev = "ev AS (SELECT event_id AS seq, user_id AS key, epoch_us(ts) // 1000 AS ts, value AS v, CAST(round(value * 100) AS BIGINT) AS cents, event_type FROM events)"
    closed = f"(SELECT max(ts) - {HOUR} FROM ev)"
    hop = f"unnest(range(greatest((ts - {24 * HOUR}) // {6 * HOUR} + 1, 0), ts // {6 * HOUR} + 1)) * {6 * HOUR}"
    windows = f"h AS (SELECT *, {hop} AS win_start FROM ev), g AS (SELECT event_type, win_start, CAST(sum(cents) AS BIGINT) AS cents, CAST(count_if(v > 150) AS BIGINT) AS ann_degree_sum FROM h GROUP BY event_type, win_start)"
    first = f"s AS (SELECT *, greatest(((ts + {12 * HOUR - 1}) // {12 * HOUR}) * {12 * HOUR} - {48 * HOUR}, 0) AS s0, greatest(((ts + {12 * HOUR - 1}) // {12 * HOUR}) * {12 * HOUR}, {48 * HOUR}) AS e0 FROM ev), w AS (SELECT *, s0 + CASE WHEN e0 <= ts THEN {12 * HOUR} ELSE 0 END AS ws FROM s)"
    return {
        "stream_annotate_key_chain": f"WITH {ev}, {first} SELECT r.seq, count(o.seq) AS ann_degree, CASE WHEN count(o.seq) > 0 THEN 1 ELSE 0 END AS ann_n_incons FROM w r LEFT JOIN ev o ON o.key = r.key AND o.event_type = r.event_type AND o.ts >= r.ws AND (o.ts < r.ts OR (o.ts = r.ts AND o.seq < r.seq)) GROUP BY r.seq",
        "stream_window_updates": f"WITH {ev}, {windows} SELECT event_type, win_start, cents, ann_degree_sum FROM g",
        "stream_top_k": f"WITH {ev}, {windows}, t AS (SELECT event_type AS key, win_start, ann_degree_sum, row_number() OVER (PARTITION BY win_start ORDER BY ann_degree_sum DESC, event_type) AS rank FROM g) SELECT * FROM t WHERE rank <= 2",
        "stream_annotate_domain": f"WITH {ev} SELECT seq, CAST(CASE WHEN v > 150 THEN 1 ELSE 0 END AS BIGINT) AS ann_degree FROM ev",
        "stream_interval_join": f"WITH {ev} SELECT l.seq AS left_seq, r.seq AS right_seq FROM ev l JOIN ev r ON l.key = r.key AND r.event_type = 'purchase' AND r.ts BETWEEN l.ts - {6 * HOUR} AND l.ts",
        "stream_window_aggregate": f"WITH {ev}, h AS (SELECT *, {hop} AS win_start FROM ev) SELECT event_type, win_start, CAST(sum(cents) AS BIGINT) AS cents, CAST(count_if(v > 150) AS BIGINT) AS ann_degree_sum FROM h WHERE win_start + {24 * HOUR} <= {closed} GROUP BY event_type, win_start",
    }
