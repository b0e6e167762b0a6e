"""Constraints between a record and an earlier one (its origin), as column expressions, Python functions and matrices.

A distance of zero means that both are consistent; otherwise the record violates the constraint against that origin,
under the variable `<name>_<origin's ts>` with the exponent ceil(abs(distance)).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Field = Callable[[str], Column]


class Constraint:
    name: str

    def columns(self) -> list[str]:
        raise NotImplementedError

    def distance(self, origin: Field, record: Field) -> Column:
        """Over the columns() and ts of both."""
        raise NotImplementedError

    def value(self, origin: Any, record: Any) -> float:
        """The same for mappings from column to Python value."""
        raise NotImplementedError

    def distances(self, origins: dict[str, np.ndarray], records: dict[str, np.ndarray]) -> np.ndarray:
        """The same for arrays that broadcast against each other (ts and columns(), as doubles); a new array."""
        both = {c: np.broadcast_arrays(origins[c], records[c]) for c in origins}
        shape = both["ts"][0].shape
        flat = [self.value({c: o.flat[k] for c, (o, _) in both.items()}, {c: r.flat[k] for c, (_, r) in both.items()}) for k in range(int(np.prod(shape)))]
        return np.array(flat, dtype=np.float64).reshape(shape)

    def lines(self, rows: dict[str, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each axis of a speed constraint, values less the fastest and the slowest allowed change since time 0. A
        pair is consistent if on each axis the record has no more of the first and no less of the second than the
        origin. Empty: nothing is known without comparing."""
        return []

    def equal_columns(self) -> list[str]:
        """Columns in which violating pairs agree (all that do violate); joins use them as keys."""
        return []


def _band_matrix(low: float, high: float, o: np.ndarray, r: np.ndarray, dt: np.ndarray) -> np.ndarray:
    above = r - (o + high * dt)
    if low == float("-inf"):
        return np.maximum(above, 0.0, out=above)
    below = r - (o + low * dt)
    if low > high:
        return np.where(above > 0, above, np.minimum(below, 0.0))
    np.maximum(above, 0.0, out=above)
    np.minimum(below, 0.0, out=below)
    return np.add(above, below, out=above)


def _line(values: np.ndarray, ts: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    return values - ts * high, np.full(len(values), np.inf) if low == float("-inf") else values - ts * low


def _band(low: float, high: float, o, r, dt):
    return F.when(o + F.lit(high) * dt < r, r - (o + F.lit(high) * dt)).when(o + F.lit(low) * dt > r, r - (o + F.lit(low) * dt)).otherwise(F.lit(0.0))


def _band_value(low: float, high: float, o: float, r: float, dt: float) -> float:
    if o + high * dt < r:
        return r - (o + high * dt)
    return r - (o + low * dt) if o + low * dt > r else 0.0


@dataclass(frozen=True)
class SpeedConstraint(Constraint):
    """A value may change by `low` to `high` per millisecond; strictness divides both. upper_only ignores `low`."""

    column: str
    low: float
    high: float
    name: str = "SC"
    strictness: float = 1.0
    upper_only: bool = False

    def bounds(self) -> tuple[float, float]:
        return (float("-inf") if self.upper_only else self.low / self.strictness), self.high / self.strictness

    def columns(self) -> list[str]:
        return [self.column]

    def distance(self, origin: Field, record: Field) -> Column:
        low, high = self.bounds()
        o, r, dt = origin(self.column), record(self.column), record("ts") - origin("ts")
        if self.upper_only:
            return F.when(o + F.lit(high) * dt < r, r - (o + F.lit(high) * dt)).otherwise(F.lit(0.0))
        return _band(low, high, o, r, dt)

    def value(self, origin: Any, record: Any) -> float:
        low, high = self.bounds()
        o, r, dt = origin[self.column], record[self.column], record["ts"] - origin["ts"]
        if self.upper_only:
            return r - (o + high * dt) if o + high * dt < r else 0.0
        return _band_value(low, high, o, r, dt)

    def distances(self, origins: dict[str, np.ndarray], records: dict[str, np.ndarray]) -> np.ndarray:
        return _band_matrix(*self.bounds(), origins[self.column], records[self.column], records["ts"] - origins["ts"])

    def lines(self, rows: dict[str, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        low, high = self.bounds()
        return [_line(rows[self.column], rows["ts"], low, high)] if low <= high else []


@dataclass(frozen=True)
class PlaneSpeedConstraint(Constraint):
    """Speed along two axes; the distance is the sum of both, so opposite violations can cancel."""

    x: str
    y: str
    low: float
    high: float
    name: str = "SC"
    strictness: float = 1.0

    def columns(self) -> list[str]:
        return [self.x, self.y]

    def distance(self, origin: Field, record: Field) -> Column:
        dt, low, high = record("ts") - origin("ts"), self.low / self.strictness, self.high / self.strictness
        return _band(low, high, origin(self.x), record(self.x), dt) + _band(low, high, origin(self.y), record(self.y), dt)

    def value(self, origin: Any, record: Any) -> float:
        dt, low, high = record["ts"] - origin["ts"], self.low / self.strictness, self.high / self.strictness
        return sum(_band_value(low, high, origin[c], record[c], dt) for c in (self.x, self.y))

    def distances(self, origins: dict[str, np.ndarray], records: dict[str, np.ndarray]) -> np.ndarray:
        dt, low, high = records["ts"] - origins["ts"], self.low / self.strictness, self.high / self.strictness
        out = _band_matrix(low, high, origins[self.x], records[self.x], dt)
        return np.add(out, _band_matrix(low, high, origins[self.y], records[self.y], dt), out=out)

    def lines(self, rows: dict[str, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        low, high = self.low / self.strictness, self.high / self.strictness
        return [_line(rows[c], rows["ts"], low, high) for c in (self.x, self.y)] if low <= high else []


@dataclass(frozen=True)
class PrimaryKey(Constraint):
    """No two records of a window may agree in the columns."""

    key_columns: tuple[str, ...]
    name: str = "PK"

    def columns(self) -> list[str]:
        return list(self.key_columns)

    def distance(self, origin: Field, record: Field) -> Column:
        same = F.lit(True)
        for c in self.key_columns:
            same &= origin(c) == record(c)
        return F.when(same, F.lit(-1.0)).otherwise(F.lit(0.0))

    def value(self, origin: Any, record: Any) -> float:
        return -1.0 if all(origin[c] == record[c] for c in self.key_columns) else 0.0

    def equal_columns(self) -> list[str]:
        return list(self.key_columns)


@dataclass(frozen=True)
class Domain:
    """A predicate (SQL text) that marks a single record as violating; exponent 1 under its own ts."""

    violated: str
    name: str = "SCH"

    def column(self) -> Column:
        return F.coalesce(F.expr(self.violated), F.lit(False))
