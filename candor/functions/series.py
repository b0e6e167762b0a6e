"""Helpers on series of numbers: robust spread, speeds, differences, durations."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Makes the median deviation of a normal distribution its standard deviation.
MAD_SCALE = 1.4826

#: Milliseconds of each unit.
UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}


def mad(df, value: str, by: list[str]):
    """(by..., mad): scaled median distance from the median of each group."""
    middle = df.groupBy(*by).agg(F.median(value).alias("_median"))
    return df.join(middle, by).groupBy(*by).agg((MAD_SCALE * F.median(F.abs(F.col(value) - F.col("_median")))).alias("mad"))


def speed(value: str, ts: str, by: list[str], order: list[str]) -> Column:
    """Change to the next row of the group, divided by the time until then; null in the last row."""
    w = Window.partitionBy(*by).orderBy(*order)
    return (F.lead(value).over(w) - F.col(value)) / (F.lead(ts).over(w) - F.col(ts))


def variation(value: str, by: list[str], order: list[str]) -> Column:
    return F.lead(value).over(Window.partitionBy(*by).orderBy(*order)) - F.col(value)


def parse_duration(text: str) -> int:
    """Milliseconds of a duration such as 90s, 1h30m or 250."""
    text = text.strip()
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    if not re.fullmatch(r"(\d+(ms|s|m|h|d))+", text):
        raise ValueError(f"not a duration: {text!r}")
    return sum(int(n) * UNITS[u] for n, u in re.findall(r"(\d+)(ms|s|m|h|d)", text))


def parse_duration_column(text: Column) -> Column:
    """The same over a column; null where it isn't a duration."""
    parts = F.regexp_extract_all(text, F.lit(r"(\d+)(ms|s|m|h|d)"), F.lit(0))
    unit = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    total = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, p: a + F.regexp_extract(p, r"\d+", 0).cast("bigint") * unit[F.regexp_extract(p, "[a-z]+", 0)])
    return F.when(text.rlike(r"^\d+$"), text.try_cast("bigint")).when(text.rlike(r"^(\d+(ms|s|m|h|d))+$"), total)


def numpy_mad(x: np.ndarray) -> float:
    return float(MAD_SCALE * np.median(np.abs(x - np.median(x))))
