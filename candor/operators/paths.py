"""Histories that keep paths of mutually consistent records, in Python; used by the `paths` mode and by streams."""

from __future__ import annotations

import math
from typing import Any

from candor.operators.constraints import Constraint, PrimaryKey


def variable(constraint: Constraint, origin: Any) -> str:
    return f"{constraint.name}_{int(origin['ts'])}"


class PathHistory:
    """Each path is scanned back from its end until a consistent record; what lies behind that is consistent too.

    A record met on several paths counts once for each, so exponents are multiples of the exact ones.
    """

    def __init__(self, constraint: Constraint):
        self.constraint, self.paths = constraint, []

    def add(self, record: Any) -> dict[str, int]:
        found: dict[str, int] = {}
        grown: set[int] = set()
        new: list[list[Any]] = []
        for path in self.paths:
            for back in range(len(path) - 1, -1, -1):
                distance = self.constraint.value(path[back], record)
                if distance:
                    name = variable(self.constraint, path[back])
                    found[name] = found.get(name, 0) + math.ceil(abs(distance))
                    continue
                if id(path[back]) not in grown:
                    grown.add(id(path[back]))
                    if back == len(path) - 1:
                        path.append(record)
                    else:
                        new.append([path[back], record])
                break
        self.paths += new
        if not grown:
            self.paths.append([record])
        return found


class ChainHistory:
    """For keys: the last record that a new one contradicts hands on what it contradicts itself."""

    def __init__(self, constraint: PrimaryKey):
        self.constraint, self.last = constraint, {}

    def add(self, record: Any) -> dict[str, int]:
        key = tuple(record[c] for c in self.constraint.key_columns)
        found: dict[str, int] = {}
        if key in self.last:
            origin, inherited = self.last[key]
            found = dict(inherited)
            name = variable(self.constraint, origin)
            found[name] = found.get(name, 0) + 1
        self.last[key] = (record, found)
        return found


def history(constraint: Constraint) -> PathHistory | ChainHistory:
    return ChainHistory(constraint) if isinstance(constraint, PrimaryKey) else PathHistory(constraint)


def windows_of(ts: int, size: int, slide: int) -> list[tuple[int, int]]:
    """The annotation grid's windows that hold ts; as windows.annotation_windows."""
    end = -(-ts // slide) * slide
    start, end = max(end - size, 0), max(end, size)
    while end <= ts:
        start, end = start + slide, end + slide
    out = []
    while start <= ts < end:
        out.append((start, end))
        start, end = start + slide, end + slide
    return out
