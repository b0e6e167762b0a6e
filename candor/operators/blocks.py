"""Violations of dense histories, compared in blocks of Arrow batches.

Where most pairs of a window violate a constraint, a join makes a row of each pair only to add it up. Here the rows of
a (key, time bucket) pass a task in order of time, and blocks of records by blocks of origins are compared as matrices;
what leaves the task is one row for each record: its degree and, if asked for, its variables and the row itself. A key constraint counts
by binary search instead. Blocks whose running extremes show that no pair can violate a speed constraint are skipped.
Where that halves them, origins that are alike (ts and compared columns) are compared once, as often as they are there.

A group with more than `most` origins is cut into chunks, and every chunk of records meets every chunk of origins in a
group of its own, so that no task holds more than two chunks. The list of such groups has at most 2 * rows / most
entries (a few megabytes for 10**12 rows), which is why it may be broadcast.

Nulls and NaN are consistent with everything; exponents and degrees are at most 2**53.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candor.functions import algebra
from candor.operators.constraints import Constraint
from candor.operators.windows import annotation_windows, first_window

#: Origins of a group in one task, cells of a matrix, records of a block, and variables of a batch.
MOST, CELLS, ROWS, ENTRIES = 1 << 19, 1 << 16, 64, 1 << 20
LARGEST = 2.0**53
GROUP = ["key", "_g1", "_g2", "_i", "_j"]


def _buckets(size: int, slide: int) -> Column:
    """Array of (_g1, _g2): the groups in which a row is an origin."""
    ts, pair = F.col("ts"), lambda a, b: F.struct(a.alias("_g1"), b.alias("_g2"))
    if size % slide:
        return F.transform(annotation_windows(ts, size, slide), lambda w: pair(w["start"], w["end"]))
    bucket, zero = F.floor(ts / size).cast("bigint"), F.lit(0).cast("bigint")
    own = pair(bucket, zero)
    return F.when(_reaches_on(bucket, size, slide), F.array(own, pair(bucket + 1, zero))).otherwise(F.array(own))


def _reaches_on(bucket: Column, size: int, slide: int) -> Column:
    """Whether a row is in a window of any record of the next bucket: windows start no earlier than that of its first ms."""
    return F.coalesce(F.col("ts") >= first_window((bucket + 1) * size, size, slide)["start"], F.lit(False))


def _places(size: int, slide: int, emit: str) -> Column:
    """Array of (_g1, _g2, win_start, role): the groups in which a row is an origin (role 1), those in which it is a
    record (role 0), and where it is both, so that it goes there once (role 2)."""
    ts, none = F.col("ts"), F.lit(None).cast("bigint")
    entry = lambda g1, g2, start, role: F.struct(g1.alias("_g1"), g2.alias("_g2"), start.alias("win_start"), (F.lit(role) if isinstance(role, int) else role).cast("tinyint").alias("role"))
    bucket, zero = F.floor(ts / size).cast("bigint"), F.lit(0).cast("bigint")
    every, first = annotation_windows(ts, size, slide), first_window(ts, size, slide)
    if size % slide:
        records = F.transform(every, lambda w: entry(w["start"], w["end"], w["start"], 0)) if emit == "all" else F.array(entry(first["start"], first["end"], first["start"], 0))
        return F.concat(F.transform(every, lambda w: entry(w["start"], w["end"], none, 1)), records)
    recorded = first.isNotNull() & F.col("seq").isNotNull()
    places = F.array(entry(bucket, zero, first["start"], F.when(recorded, 2).otherwise(1)))
    if emit == "all":
        places = F.concat(places, F.transform(F.filter(every, lambda w: w["start"] > first["start"]), lambda w: entry(bucket, zero, w["start"], 0)))
    return F.when(_reaches_on(bucket, size, slide), F.concat(places, F.array(entry(bucket + 1, zero, none, 1)))).otherwise(places)


def _dealt(df: DataFrame, constraints: Sequence[Constraint], size: int, slide: int, emit: str, most: int, carried: Sequence[str] = ()) -> tuple[DataFrame, list[str], list[str], dict[str, str]]:
    """Origins and records at their places, `_cut` where a group has more than `most` origins; the columns of numbers and
    codes. carried: what records take along; where each of these columns is, those that are compared as they are only once."""
    numbers = list(dict.fromkeys(c for x in constraints for c in x.columns() if c not in x.equal_columns()))
    codes = list(dict.fromkeys(c for x in constraints for c in x.equal_columns()))
    types = dict(df.dtypes)
    there = {"ts": "ts"} if types["ts"] == "bigint" else {}
    there |= {c: f"n{k}" for k, c in enumerate(numbers) if types.get(c) == "double" and c not in there} | {c: f"e{k}" for k, c in enumerate(codes) if c not in there}
    there = {c: there[c] if c in there else f"p{k}" for k, c in enumerate(carried)}
    taken = [c for c in carried if there[c].startswith("p")]
    columns = [*[F.col(c).cast("double").alias(f"n{k}") for k, c in enumerate(numbers)], *[F.col(c).alias(f"e{k}") for k, c in enumerate(codes)], *[_quoted(c).alias(there[c]) for c in taken]]
    rows = df.where("key is not null and ts is not null").select("key", F.col("ts").cast("bigint").alias("ts"), "seq", *columns)
    groups, most_rows = ["key", "_g1", "_g2"], F.lit(most)
    large = rows.select("key", F.explode(_buckets(size, slide)).alias("_b")).groupBy("key", "_b._g1", "_b._g2").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    placed = rows.select("*", F.explode(_places(size, slide, emit)).alias("_p")).select(*rows.columns, "_p.*").where("role > 0 or win_start is not null and seq is not null")
    placed = placed.join(F.broadcast(large.withColumn("_parts", F.ceil(F.col("_n") / most_rows).cast("int")).drop("_n")), groups, "left")
    # chunks of a cut group: a record meets the origins of each
    role, mine, others = F.col("role"), F.pmod(F.xxhash64("seq"), F.col("_parts")).cast("int"), F.sequence(F.lit(0), F.col("_parts") - 1)
    entry = lambda i, j, r: F.struct(i.alias("_i"), j.alias("_j"), r.cast("tinyint").alias("role"))
    as_record = F.when(role != 1, F.transform(others, lambda k: entry(mine, k, F.lit(0)))).otherwise(F.array())
    as_origin = F.when(role != 0, F.transform(others, lambda k: entry(k, mine, F.lit(1)))).otherwise(F.array())
    chunks = F.when(F.col("_parts").isNull(), F.array(entry(F.lit(0), F.lit(0), role))).otherwise(F.concat(as_record, as_origin))
    placed = placed.select(*[c for c in placed.columns if c != "role"], F.explode(chunks).alias("_c")).select("*", "_c.*")
    kept = [F.when(F.col("role") != 1, F.col(c)).alias(c) if re.fullmatch(r"p\d+", c) else F.col(c) for c in rows.columns]
    return placed.select(*kept, "_g1", "_g2", "win_start", "role", "_i", "_j", F.col("_parts").isNotNull().alias("_cut")), numbers, codes, there


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _ordered(placed: DataFrame) -> DataFrame:
    # a number of its own: few bytes make much work here, so adaptive execution must not join partitions by their bytes
    tasks = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.drop("_cut").repartition(tasks, *GROUP).sortWithinPartitions(*GROUP, "ts", "seq", "role")


def _summed(df: DataFrame, constraints: Sequence[Constraint], dealt: tuple[DataFrame, list[str], list[str]], variables: bool) -> DataFrame:
    placed, numbers, codes = dealt
    key_type, seq_type = (df.schema[c].dataType.simpleString() for c in ("key", "seq"))
    kernel = _Kernel(tuple(constraints), numbers, codes, variables)
    found = _ordered(placed).mapInArrow(kernel, f"key {key_type}, seq {seq_type}, win_start bigint, degree bigint, vars map<string,bigint>")
    merged = F.collect_list("vars") if variables else F.lit(None)
    by = found.groupBy("key", "seq", "win_start").agg(F.sum("degree").alias("_degree"), merged.alias("_maps"))
    if not variables:
        return by.withColumn("_found", F.lit(None).cast(algebra.VARS_TYPE)).drop("_maps")
    # a record whose group was cut has a map from each chunk of origins
    return by.withColumn("_found", F.when(F.size("_maps") == 1, F.col("_maps")[0]).otherwise(algebra.product(F.col("_maps")))).drop("_maps")


def violations(df: DataFrame, constraints: Sequence[Constraint], size: int, slide: int, emit: str, variables: bool, most: int = MOST) -> DataFrame:
    """(key, seq, win_start, _degree, _found) of the records that contradict an earlier one; _found is null unless
    variables are asked for."""
    return _summed(df, constraints, _dealt(df, constraints, size, slide, emit, most)[:3], variables)


def with_variables(df: DataFrame, out: DataFrame, constraints: Sequence[Constraint], size: int, slide: int, emit: str, most: int | None = None, variables: bool = True) -> DataFrame:
    """out, which is df with win_start and win_end (one row for each window), and its _degree and _found (null unless
    variables are asked for).

    Variables are much longer than rows. So a record takes its row along to its group, whose task makes all its
    variables: nothing is shuffled after them. Only records of groups that are cut are joined with what their chunks give.
    """
    most = MOST if most is None else most
    carried = [f.name for f in df.schema.fields if f.name not in ("key", "seq", "win_start", "win_end")]
    placed, numbers, codes, there = _dealt(df, constraints, size, slide, emit, most, carried)
    fields = {f.name: f.dataType for f in placed.schema.fields}
    taken = list(dict.fromkeys(there.values()))
    made = T.StructType().add("key", fields["key"]).add("seq", fields["seq"]).add("win_start", T.LongType()).add("_degree", T.LongType()).add("_found", T.MapType(T.StringType(), T.LongType()))
    for c in taken:
        made.add(c, fields[c])
    whole = _ordered(placed.where("not _cut")).mapInArrow(_Kernel(tuple(constraints), numbers, codes, variables, taken), made)
    cut_places = placed.where("_cut")
    cut = _summed(df, constraints, (cut_places.drop(*[c for c in taken if c.startswith("p")]), numbers, codes), variables)
    large = cut_places.where("role = 0 and _j = 0").select("key", "seq", "win_start", *taken)
    # Spark takes maps for a few bytes and would broadcast them, however long they are
    both = whole.unionByName(large.join(cut.hint("merge"), ["key", "seq", "win_start"], "left"))
    # a window is as long as `size`, on either grid
    both = both.select("key", "seq", *[F.col(there[c]).alias(c) for c in carried], "win_start", (F.col("win_start") + F.lit(size)).cast("bigint").alias("win_end"), "_found", "_degree")
    rest = out.where("key is null or ts is null or seq is null or win_start is null").select("*", F.lit(None).cast(algebra.VARS_TYPE).alias("_found"), F.lit(None).cast("bigint").alias("_degree"))
    return both.unionByName(rest).select(*[_quoted(c) for c in out.columns], "_found", "_degree")


def whole_groups(batches: Iterator[pa.RecordBatch], by: Sequence[str]) -> Iterator[pa.Table]:
    """The batches, sorted by `by`, as tables that no group crosses."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        last = held[-1].slice(held[-1].num_rows - 1) if held else new.slice(0, 0)
        ends = np.flatnonzero(_changes(pa.concat_tables([last, new]), by))
        if len(ends):
            cut = int(ends[-1]) + 1 - last.num_rows
            yield pa.concat_tables([*held, new.slice(0, cut)]).combine_chunks()
            held = [new.slice(cut)]
        else:
            held.append(new)
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _changes(table: pa.Table, by: Sequence[str]) -> np.ndarray:
    """For each row but the first, whether it differs from the one before."""
    out = np.zeros(max(table.num_rows - 1, 0), dtype=bool)
    for c in by:
        column = table.column(c).combine_chunks()
        out |= pc.not_equal(column.slice(1), column.slice(0, max(len(column) - 1, 0))).fill_null(True).to_numpy(zero_copy_only=False)
    return out


@dataclass
class _Side:
    """Records or origins of a slab: numbers, and one code for each key constraint (-1: null)."""

    values: dict[str, np.ndarray]
    codes: dict[str, np.ndarray]

    def at(self, index, axis: int) -> dict[str, np.ndarray]:
        return {c: np.expand_dims(v[index], axis) for c, v in self.values.items()}


    def of(self, index: np.ndarray) -> _Side:
        return _Side({c: v[index] for c, v in self.values.items()}, {c: v[index] for c, v in self.codes.items()})


@dataclass
class _Part:
    """Origins, and which of them each record is compared with; weights: how many like ones each stands for, the first at rep."""

    origins: _Side
    low: np.ndarray
    high: np.ndarray
    rep: np.ndarray | None = None
    weights: np.ndarray | None = None

    def of(self, index: np.ndarray) -> np.ndarray:
        return index if self.rep is None else self.rep[index]


def _alike(place: np.ndarray, origins: _Side) -> tuple[np.ndarray, np.ndarray] | None:
    """One origin of each place and values, in order, and how many there are; None unless that halves them."""
    by = [*origins.codes.values(), *origins.values.values(), place]
    order = np.lexsort(by)
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.logical_or.reduce([x[order[1:]] != x[order[:-1]] for x in by])
    first = np.flatnonzero(new)
    return (order[first], np.diff(first, append=len(order)).astype(np.float64)) if 2 * len(first) <= len(order) else None


class _Kernel:
    def __init__(self, constraints: tuple[Constraint, ...], numbers: list[str], codes: list[str], variables: bool, payload: Sequence[str] | None = None):
        self.constraints, self.numbers, self.code_columns, self.variables, self.payload = constraints, numbers, codes, variables, payload

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, GROUP):
            yield from self.slab(table)

    def slab(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        ts, role = table.column("ts").to_numpy(), table.column("role").to_numpy()
        origin = role != 0
        group = np.concatenate([[0], np.cumsum(_changes(table, GROUP))])
        at = np.flatnonzero(role != 1)
        if not len(at) or not origin.any():
            return
        # history ends before the origins of a record's own ts and seq, of which it is one
        run = np.flatnonzero(np.concatenate([[True], _changes(table, [*GROUP, "ts", "seq"])]))
        high = (np.cumsum(origin) - origin)[run[np.searchsorted(run, at, side="right") - 1]]
        least, span = ts.min(), int(ts.max() - ts.min()) + 1
        start = table.column("win_start").combine_chunks().take(pa.array(at)).to_numpy()
        place = group[origin] * span + (ts[origin] - least)
        begin, now = group[at] * span + np.clip(start - least, 0, span), group[at] * span + (ts[at] - least)
        low = np.minimum(np.searchsorted(place, begin), high)
        sides = []
        for rows in (np.flatnonzero(origin), at):
            values = {"ts": ts[rows].astype(np.float64)}
            values |= {c: table.column(f"n{k}").to_numpy()[rows].astype(np.float64) for k, c in enumerate(self.numbers)}
            sides.append(_Side(values, {c.name: code[rows] for c, code in self.coded(table)}))
        origins, records = sides
        parts = [_Part(origins, low, high)]
        if alike := _alike(place, origins):
            # like origins of one ts are compared once, but for a record's own ts, where they count up to its seq
            rep, weights = alike
            middle, until = np.searchsorted(place, now), np.searchsorted(place[rep], now)
            parts = [_Part(origins.of(rep), np.minimum(np.searchsorted(place[rep], begin), until), until, rep, weights), _Part(origins, np.maximum(low, middle), high)]
        yield from self.blocks(table, at, low, high, ts[origin], parts, records)

    def coded(self, table: pa.Table) -> Iterator[tuple[Constraint, np.ndarray]]:
        for c in self.constraints:
            if not c.equal_columns():
                continue
            code = np.zeros(table.num_rows, dtype=np.int64)
            for column in c.equal_columns():
                found = pc.dictionary_encode(table.column(f"e{self.code_columns.index(column)}").combine_chunks())
                index = found.indices.fill_null(-1).to_numpy().astype(np.int64)
                both = np.unique(code * (len(found.dictionary) + 1) + index, return_inverse=True)[1]
                code = np.where((index < 0) | (code < 0), -1, both)
            yield c, code

    def blocks(self, table: pa.Table, at: np.ndarray, low: np.ndarray, high: np.ndarray, origin_ts: np.ndarray, parts: list[_Part], records: _Side) -> Iterator[pa.RecordBatch]:
        plain = [(c, part, (c.lines(part.origins.values), c.lines(records.values))) for c in self.constraints if not c.equal_columns() for part in parts]
        keyed = [(c, part, _Positions(part.origins.codes[c.name], part.weights)) for c in self.constraints if c.equal_columns() for part in parts]
        names = {c.name: _names(c.name, origin_ts) for c in self.constraints} if self.variables else {}
        held, entries = [], 0
        degree = np.zeros(len(at))
        for a, b in _cuts(low, high):
            pairs: list[tuple[str, np.ndarray, np.ndarray, np.ndarray]] = []
            for c, part, positions in keyed:
                first, last = positions.ranges(records.codes[c.name][a:b], part.low[a:b], part.high[a:b])
                degree[a:b] += positions.counted(first, last)
                if self.variables:
                    rec, org = positions.listed(first, last)
                    pairs.append((c.name, rec, part.of(org), np.ones(len(rec)) if part.weights is None else part.weights[org]))
            for c, part, lines in plain:
                for rec, org, exponent, total in self.compared(c, lines, part, records, a, b):
                    degree[a:b] += total
                    if self.variables:
                        pairs.append((c.name, rec, part.of(org), exponent))
            if self.variables:
                made = _merged(pairs, origin_ts, names, b - a)
                held.append((a, b, *made))
                entries += len(made[1])
                if entries >= ENTRIES:
                    yield self.batch(table, at, degree, held, names)
                    held, entries = [], 0
        if self.variables:
            if held:
                yield self.batch(table, at, degree, held, names)
        else:
            yield self.batch(table, at, degree, [(0, len(at), None, None, None)], names)

    def compared(self, c: Constraint, lines, part: _Part, records: _Side, a: int, b: int):
        """Matrices of the records a to b with all their origins: violating pairs, and the degree of each record."""
        origins, low, high = part.origins, part.low, part.high
        left, right = int(low[a:b].min()), int(high[a:b].max())
        width = max(1, CELLS // (b - a))
        inner = int(low[a:b].max()), int(high[a:b].min())
        theirs, ours = lines
        record = records.at(slice(a, b), 1)
        for s in range(left, right, width):
            e = min(s + width, right)
            if theirs and not any(_may_violate(o, r, slice(s, e), slice(a, b)) for o, r in zip(theirs, ours, strict=True)):
                continue
            d = c.distances(origins.at(slice(s, e), 0), record)
            np.abs(d, out=d)
            np.ceil(d, out=d)
            if part.weights is not None:
                d *= part.weights[s:e]
            if not inner[0] <= s < e <= inner[1]:
                place = np.arange(s, e)[None, :]
                d[(place < low[a:b, None]) | (place >= high[a:b, None])] = 0
            total = d.sum(axis=1)
            if not (total < LARGEST).all():
                np.copyto(d, 0, where=np.isnan(d))
                np.minimum(d, LARGEST, out=d)
                total = np.minimum(d.sum(axis=1), LARGEST)
            if self.variables:
                rec, org = np.nonzero(d)
                yield rec, org + s, d[rec, org], total
            else:
                yield None, None, None, total

    def batch(self, table: pa.Table, at: np.ndarray, degree: np.ndarray, held: list, names: dict) -> pa.RecordBatch:
        a, b = held[0][0], held[-1][1]
        rows = np.arange(a, b) if self.payload is not None else np.flatnonzero(degree[a:b] > 0) + a
        take = lambda c: table.column(c).combine_chunks().take(pa.array(at[rows]))
        total = pa.array(np.minimum(degree[rows], LARGEST).astype(np.int64))
        if self.variables:
            sizes = np.concatenate([h[2] for h in held])
            offsets = np.concatenate([[0], np.cumsum(sizes[rows - a])]).astype(np.int32)
            keys, items = pa.concat_arrays([h[3] for h in held]), pa.array(np.concatenate([h[4] for h in held]).astype(np.int64))
            maps = pa.MapArray.from_arrays(pa.array(offsets), keys, items)
        else:
            maps = pa.nulls(len(rows), pa.map_(pa.string(), pa.int64()))
        if self.payload is not None:
            return pa.RecordBatch.from_arrays([take("key"), take("seq"), take("win_start"), total, maps, *[take(c) for c in self.payload]], names=["key", "seq", "win_start", "_degree", "_found", *self.payload])
        return pa.RecordBatch.from_arrays([take("key"), take("seq"), take("win_start"), total, maps], names=["key", "seq", "win_start", "degree", "vars"])


def _cuts(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of records: at most ROWS, fewer where their origins together would make too large a matrix row."""
    a = 0
    while a < len(low):
        b = min(a + ROWS, len(low))
        while b - a > 1 and (high[a:b].max() - low[a:b].min()) * (b - a) > CELLS * 32:
            b = a + (b - a) // 2
        yield a, b
        a = b


def _may_violate(origins: tuple[np.ndarray, np.ndarray], records: tuple[np.ndarray, np.ndarray], s: slice, a: slice) -> bool:
    """Whether any record is outside the band of any origin, by the extremes of both; rounding is left a margin."""
    (o_up, o_low), (r_up, r_low) = ([x[p] for x in side] for side, p in ((origins, s), (records, a)))
    slack = 1e-12 * (np.nanmax(np.abs(o_up), initial=0) + np.nanmax(np.abs(r_up), initial=0) + np.nanmax(np.abs(o_low), initial=0, where=np.isfinite(o_low)) + 1)
    return bool(np.nanmax(r_up, initial=-np.inf) > np.nanmin(o_up, initial=np.inf) - slack or np.nanmin(r_low, initial=np.inf) < np.nanmax(o_low, initial=-np.inf) + slack)


class _Positions:
    """Where each code stands among the origins."""

    def __init__(self, codes: np.ndarray, weights: np.ndarray | None = None):
        self.n = len(codes) + 1
        self.sorted = np.sort(codes * self.n + np.arange(len(codes)))
        self.before = None if weights is None else np.concatenate([[0], np.cumsum(weights[self.sorted % self.n])])

    def counted(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return last - first if self.before is None else self.before[last] - self.before[first]

    def ranges(self, codes: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, last = (np.searchsorted(self.sorted, codes * self.n + x) for x in (low, high))
        return first, np.where(codes < 0, first, np.maximum(first, last))

    def listed(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = last - first
        rec = np.repeat(np.arange(len(first)), counts)
        step = np.arange(len(rec)) - np.repeat(np.cumsum(counts) - counts, counts)
        return rec, self.sorted[np.repeat(first, counts) + step] % self.n


def _names(name: str, origin_ts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The variables' names, and which of them each origin has."""
    different, which = np.unique(origin_ts, return_inverse=True)
    return pc.binary_join_element_wise(pa.scalar(name), pa.array(different).cast(pa.string()), "_"), which


def _merged(pairs: list, origin_ts: np.ndarray, names: dict, n: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """How many variables each record has, and all of them: names and exponents. Origins of one ts add up."""
    recs, keys, items, base, tables = [], [], [], 0, []
    for name, (table, which) in names.items():
        tables.append(table)
        mine = [p for p in pairs if p[0] == name]
        if mine:
            recs.append(np.concatenate([p[1] for p in mine]))
            keys.append(which[np.concatenate([p[2] for p in mine])] + base)
            items.append(np.concatenate([p[3] for p in mine]))
        base += len(table)
    if not recs:
        return np.zeros(n, dtype=np.int64), tables[0].slice(0, 0), np.zeros(0)
    rec, key, item = np.concatenate(recs), np.concatenate(keys), np.concatenate(items)
    code = rec * base + key
    order = np.argsort(code, kind="stable")
    code, item = code[order], item[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, dtype=np.int64)
    code, item = code[first], np.minimum(np.add.reduceat(item, first), LARGEST) if len(first) else item
    every = tables[0] if len(tables) == 1 else pa.concat_arrays(tables)
    return np.bincount(code // base, minlength=n), every.take(pa.array(code % base)), item
