"""Repair of values: from annotations, and by speed constraints in each window (median of candidates, then clamped)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.functions import algebra
from candor.functions.series import numpy_mad
from candor.operators.windows import first_window


#: Series up to this length are repaired together with others of their length.
ALIKE = 64


def _magnitude(poly: Column, prefix: str) -> Column:
    """Largest and smallest exponents of each monomial, then of the polynomial, combined alike both times."""
    combine = lambda high, low: F.when(high > 0, F.when(low < 0, high + low).otherwise(high)).otherwise(low)
    each = F.transform(poly, lambda m: combine(F.array_max(algebra.exponents(m, prefix)), F.array_min(algebra.exponents(m, prefix))))
    return combine(F.array_max(each), F.array_min(each))


def from_annotation(value: Column, prefix: str = "", how: str = "add") -> Column:
    """A value corrected by the size of its violations of one constraint.

    add: v + m, or half of m if m exceeds v (truncated to whole numbers). subtract: v - m, or v - m / 2 if m exceeds
    v. subtract_all: v - m always.
    """
    m = _magnitude(F.array("ann_vars"), prefix)
    if how == "add":
        return F.when(m > value, (value + m / F.lit(2.0)).cast("bigint")).otherwise(value + m)
    if how == "subtract":
        return F.when(m > value, value - m / F.lit(2.0)).otherwise(value - m)
    if how == "subtract_all":
        return value - m
    raise ValueError(f"unknown repair {how!r}")


def fill_gaps(t: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Replaces values that aren't finite on the line through their neighbours (beyond the ends, through the two
    nearest); with fewer than two finite values nothing changes."""
    v = np.asarray(v, dtype=float).copy()
    good = np.flatnonzero(np.isfinite(v))
    if len(good) < 2:
        return v
    for i in np.flatnonzero(~np.isfinite(v)):
        k = int(np.clip(np.searchsorted(good, i), 1, len(good) - 1))
        a, b = good[k - 1], good[k]
        v[i] = v[a] + (v[b] - v[a]) / (t[b] - t[a]) * (t[i] - t[a]) if t[b] != t[a] else v[a]
    return v


def screen(t: np.ndarray, v: np.ndarray, low: float | None = None, high: float | None = None, width: float | None = None) -> np.ndarray:
    """Nearest values that keep speeds in [low, high] against the repaired past, led by the median of what the next
    `width` of time allows. Bounds default to the median speed and three scaled median deviations around it."""
    t, v = np.asarray(t, dtype=float), fill_gaps(t, v)
    n = len(v)
    if n < 2:
        return v
    if low is None or high is None:
        dt = np.diff(t)
        speeds = np.diff(v)[dt > 0] / dt[dt > 0]
        middle, spread = (float(np.median(speeds)), 3 * numpy_mad(speeds)) if len(speeds) else (0.0, 0.0)
        low, high = middle - spread if low is None else low, middle + spread if high is None else high
    width = t[-1] - t[0] if width is None else width
    out = v.copy()
    for i in range(n):
        ahead = np.arange(i + 1, np.searchsorted(t, t[i] + width, side="right"))
        back = t[i] - t[ahead]
        middle = float(np.median(np.concatenate([[v[i]], v[ahead] + low * back, v[ahead] + high * back])))
        if i:
            dt = t[i] - t[i - 1]
            middle = min(max(middle, out[i - 1] + low * dt), out[i - 1] + high * dt)
        out[i] = middle
    return out


def screen_alike(t: np.ndarray, v: np.ndarray, low: float, high: float) -> np.ndarray:
    """screen() for many series of one length, a row each, without gaps, each led by its whole future."""
    n, out = v.shape[1], v.copy()
    for i in range(n):
        back = t[:, i : i + 1] - t[:, i + 1 :]
        middle = np.median(np.concatenate([v[:, i : i + 1], v[:, i + 1 :] + low * back, v[:, i + 1 :] + high * back], axis=1), axis=1)
        if i:
            dt = t[:, i] - t[:, i - 1]
            middle = np.minimum(np.maximum(middle, out[:, i - 1] + low * dt), out[:, i - 1] + high * dt)
        out[:, i] = middle
    return out if n > 1 else v


def screen_groups(t: np.ndarray, v: np.ndarray, first: np.ndarray, low: float | None, high: float | None) -> np.ndarray:
    """screen() for each of the series that start at `first`; short ones of one length together."""
    out, size = np.empty(len(v)), np.diff(np.append(first, len(v)))
    whole = np.minimum.reduceat(np.isfinite(v), first) if len(first) else np.zeros(0, dtype=bool)
    together = whole & (size <= ALIKE) if low is not None and high is not None else np.zeros(len(first), dtype=bool)
    for n in np.unique(size[together]):
        at = first[together & (size == n)][:, None] + np.arange(n)
        out[at] = screen_alike(t[at], v[at], low, high)
    for a, n in zip(first[~together], size[~together], strict=True):
        out[a : a + n] = screen(t[a : a + n], v[a : a + n], low, high)
    return out


def repair(df: DataFrame, column: str, size: int, slide: int | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """Replaces a column by its repaired values; each record is repaired once, with its key's records of the earliest
    window that holds it. Groups stand one behind the other in a task, which holds one group and a batch at a time."""
    kind = df.schema[column].dataType.simpleString()
    whole = kind in ("bigint", "int", "smallint", "tinyint")
    win = first_window(F.col("ts"), size, slide or size)["start"]

    def fixed(rows: pd.DataFrame) -> pd.DataFrame:
        values, ts = pd.to_numeric(rows[column]).to_numpy(dtype=float), rows["ts"].to_numpy(dtype=float)
        first = np.flatnonzero((rows["key"] != rows["key"].shift()) | (rows["_win"] != rows["_win"].shift()))
        out = screen_groups(ts, values, first, low, high)
        return rows.assign(**{column: np.trunc(out).astype("int64") if whole else out}).drop(columns="_win")

    def fix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if batch.empty:
                continue
            last = (batch["key"] == batch["key"].iloc[-1]) & (batch["_win"] == batch["_win"].iloc[-1])
            if last.all():
                held.append(batch)
                continue
            yield fixed(pd.concat([*held, batch[~last]]) if held else batch[~last])
            held = [batch[last]]
        if held:
            yield fixed(pd.concat(held))

    grouped = df.withColumn("_win", win).repartition("key", "_win").sortWithinPartitions("key", "_win", "ts", "seq")
    return grouped.mapInPandas(fix, df.schema)
