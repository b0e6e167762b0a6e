"""The same definitions over Structured Streaming.

Records are annotated by path histories in keyed state, which expire once the watermark has passed their windows.
Late records within the watermark keep their own time; the state is checkpointed with the query.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from candor.functions import algebra
from candor.operators import paths
from candor.operators.annotate import annotate_domain, with_annotation
from candor.operators.constraints import Constraint, Domain


def with_event_time(df: DataFrame, delay_ms: int) -> DataFrame:
    """Adds event_time from ts and a watermark on it."""
    return df.withColumn("event_time", F.timestamp_millis("ts")).withWatermark("event_time", f"{delay_ms} milliseconds")


def annotate_stream(df: DataFrame, constraints: Constraint | Sequence[Constraint], size: int, slide: int | None = None) -> DataFrame:
    """df(key, ts, seq, event_time with watermark, ...) -> the same rows, annotated with the earliest window's history."""
    constraints = [constraints] if isinstance(constraints, Constraint) else list(constraints)
    slide = slide or size
    schema = T.StructType([*df.schema.fields, T.StructField("_found", T.MapType(T.StringType(), T.LongType()))])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held: dict[tuple[int, int], list] = pickle.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        found = []
        for r in rows.drop(columns="event_time").to_dict("records"):
            first = None
            for w in paths.windows_of(r["ts"], size, slide):
                mine: dict[str, int] = {}
                for h in held.setdefault(w, [paths.history(c) for c in constraints]):
                    mine |= h.add(r)
                first = mine if first is None else first
            found.append(first or {})
        mark = state.getCurrentWatermarkMs()
        held = {w: h for w, h in held.items() if w[1] > mark}
        state.update((pickle.dumps(held),))
        if held:
            state.setTimeoutTimestamp(max(mark + 1, max(w[1] for w in held)))
        yield rows.assign(_found=found)

    stepped = df.groupBy("key").applyInPandasWithState(step, schema, "held binary", "append", GroupStateTimeout.EventTimeTimeout)
    return with_annotation(stepped, F.col("_found")).drop("_found")


def annotate_stream_domain(df: DataFrame, constraint: Domain) -> DataFrame:
    """Without state."""
    return annotate_domain(df, constraint)


def join_streams(left: DataFrame, right: DataFrame, before_ms: int, after_ms: int = 0, on: Column | None = None) -> DataFrame:
    """Annotated stream-stream join on equal keys and a time interval; both sides need a watermark on event_time."""
    l, r = left.alias("l"), right.alias("r")
    near = F.col("r.event_time").between(F.col("l.event_time") - F.make_dt_interval(secs=F.lit(before_ms / 1000)), F.col("l.event_time") + F.make_dt_interval(secs=F.lit(after_ms / 1000)))
    joined = l.join(r, (F.col("l.key") == F.col("r.key")) & near & (F.lit(True) if on is None else on))
    payload = lambda a, df: F.struct(*[F.col(f"{a}.{c}").alias(c) for c in df.columns if not c.startswith("ann_") and c != "event_time"])
    degree = F.col("l.ann_degree_sum") + F.col("r.ann_degree_sum")
    return joined.select(F.col("l.key").alias("key"), F.greatest("l.ts", "r.ts").alias("ts"), F.col("l.event_time").alias("event_time"), payload("l", left).alias("left"), payload("r", right).alias("right"), algebra.times(F.col("l.ann_vars"), F.col("r.ann_vars")).alias("ann_vars"), degree.alias("ann_degree"), degree.alias("ann_degree_sum"), F.greatest("l.ann_n_incons", "r.ann_n_incons").alias("ann_n_incons"))


def window_aggregate(df: DataFrame, size_ms: int, slide_ms: int | None, by: Sequence[str], *aggregates: Column) -> DataFrame:
    """Annotated hopping or tumbling windows over an annotated stream with a watermark."""
    window = F.window("event_time", f"{size_ms} milliseconds", f"{slide_ms or size_ms} milliseconds")
    grouped = df.groupBy(window.alias("w"), *by).agg(*aggregates, F.max("ts").alias("ts"), F.max("ann_degree").alias("ann_degree"), F.sum("ann_degree_sum").alias("ann_degree_sum"), F.sum("ann_n_incons").alias("ann_n_incons"))
    return grouped.where(F.unix_millis("w.start") >= 0).withColumn("win_start", F.unix_millis("w.start")).drop("w")
