"""Window assignment in whole milliseconds: the annotation grid, hopping and tumbling windows, first windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("bigint")


def _earliest(ts: Column, size: int, slide: int) -> tuple[Column, Column]:
    """Start and end of the earliest window of the annotation grid that holds ts, if ts isn't negative."""
    end = ts + F.pmod(-ts, F.lit(slide))
    at_end = F.greatest(end, F.lit(size)) == ts
    shift = F.when(at_end, F.lit(slide)).otherwise(F.lit(0))
    return (F.greatest(end - size, F.lit(0)) + shift).cast("bigint"), (F.greatest(end, F.lit(size)) + shift).cast("bigint")


def annotation_windows(ts: Column, size: int, slide: int) -> Column:
    """Array of structs (start, end), earliest first, of the annotation grid's windows that hold ts.

    The grid is aligned on window ends; starts are never below 0, and then ends are at least `size`. So, if slide
    doesn't divide size, early records live on another grid than later ones.
    """
    start, end = _earliest(ts, size, slide)
    steps = F.when(start <= ts, F.sequence(F.lit(0).cast("bigint"), _div(ts - start, slide))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(steps, lambda k: F.struct((start + k * slide).alias("start"), (end + k * slide).alias("end")))


def first_window(ts: Column, size: int, slide: int) -> Column:
    """The first of annotation_windows(), or null."""
    start, end = _earliest(ts, size, slide)
    return F.when(ts >= 0, F.struct(start.alias("start"), end.alias("end")))


def hopping_starts(ts: Column, size: int, slide: int) -> Column:
    """Starts, multiples of slide and at least 0, of the windows of this size that hold ts."""
    last = _div(ts, slide)
    first = F.greatest(_div(ts - F.lit(size), slide) + 1, F.lit(0).cast("bigint"))
    return F.when(last >= first, F.transform(F.sequence(first, last), lambda k: k * slide)).otherwise(F.array().cast("array<bigint>"))


def hop(df: DataFrame, size: int, slide: int | None = None, ts: str = "ts") -> DataFrame:
    """One row for each hopping (or, without slide, tumbling) window: adds win_start and win_end."""
    exploded = df.withColumn("win_start", F.explode(hopping_starts(F.col(ts), size, slide or size)))
    return exploded.withColumn("win_end", F.col("win_start") + F.lit(size))


def containing_start(ts: Column, size: int, advance: int) -> Column:
    """Start of the earliest hopping window that holds ts."""
    if size <= 0 or not 0 < advance <= size:
        raise ValueError("size must be positive and advance between 1 and size")
    return _div(F.greatest(ts - F.lit(size) + F.lit(advance), F.lit(0)), advance) * advance
