"""Annotation: every record learns which earlier records of its key and window it contradicts, and by how much.

Exact mode compares a record with all earlier ones of its window (order: ts, then seq). The plan is an equi-join on
(key, time bucket): history reaches back `size` at most, so every origin is placed in its own bucket and the next one,
and one hot key spreads over its buckets. A speed constraint is tested first: a record is inside all bounds exactly if
it is inside the tightest, which running extremes give in one pass, and only records outside are joined with their
history. A key constraint adds its columns to the join keys. Where slide doesn't divide size the windows themselves are
the join key, as then the grid's early windows differ from later ones.

Blocks mode gives the same results for dense histories: matrices instead of joined pairs (operators.blocks).

Paths mode keeps paths of consistent records (operators.paths) in one Python group for each key and window.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candor.functions import algebra
from candor.operators import blocks, paths
from candor.operators.constraints import Constraint, Domain, SpeedConstraint
from candor.operators.windows import annotation_windows, first_window

ANN = ["ann_vars", "ann_degree", "ann_degree_sum", "ann_n_incons"]


def with_annotation(df: DataFrame, variables: Column) -> DataFrame:
    """Sets the annotation columns from one monomial for each row."""
    df = df.withColumn("ann_vars", F.coalesce(variables, algebra.one()))
    total = algebra.degree(F.col("ann_vars"))
    return df.withColumns({"ann_degree": total, "ann_degree_sum": total, "ann_n_incons": (F.size("ann_vars") > 0).cast("int")})


def unannotated(df: DataFrame) -> DataFrame:
    """Every row with the constant annotation."""
    return with_annotation(df, algebra.one())


def annotate_domain(df: DataFrame, constraint: Domain, ts: str = "ts") -> DataFrame:
    """Record by record, without history or shuffle."""
    mark = F.map_from_arrays(F.array(F.concat(F.lit(constraint.name + "_"), F.col(ts).cast("string"))), F.array(F.lit(1).cast("bigint")))
    return with_annotation(df, F.when(constraint.column(), mark).otherwise(algebra.one()))


def _fields(alias: str):
    return lambda c: F.col(f"{alias}.{c}")


def _before() -> Column:
    return (F.col("o.ts") < F.col("r.ts")) | ((F.col("o.ts") == F.col("r.ts")) & (F.col("o.seq") < F.col("r.seq")))


def _suspects(rows: DataFrame, c: SpeedConstraint) -> DataFrame:
    """Rows of their own bucket that some earlier row of the bucket may contradict. Rounding is left a margin: rows that
    contradict none can be among them, but no row that does is missing."""
    low, high = c.bounds()
    past = Window.partitionBy("key", "bucket").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    v, t = F.col(c.column).cast("double"), F.col("ts").cast("double")
    upper, slack = v - t * high, (F.abs(v) + F.abs(t * high) + 1) * 1e-12
    flagged, outside = rows.withColumn("_lowest", F.min(upper).over(past)), upper > F.col("_lowest") - slack
    if not c.upper_only:
        lower, slack = v - t * low, (F.abs(v) + F.abs(t * low) + 1) * 1e-12
        flagged, outside = flagged.withColumn("_highest", F.max(lower).over(past)), outside | (lower < F.col("_highest") + slack)
    return flagged.where(F.col("_own") & outside).drop("_lowest", "_highest")


def _pairs(df: DataFrame, constraint: Constraint, size: int, slide: int, emit: str) -> DataFrame:
    """(key, seq, win_start, var_ts, exponent): each violation of each record to be emitted."""
    columns = list(dict.fromkeys(["key", "ts", "seq", *constraint.columns()]))
    rows = df.select(columns)
    equal = [F.col(f"o.{c}") == F.col(f"r.{c}") for c in constraint.equal_columns()]
    if size % slide == 0:
        bucket = F.floor(F.col("ts") / size).cast("bigint")
        placed = rows.withColumn("_place", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("bucket", bucket + F.col("_place")).withColumn("_own", F.col("_place") == 0).drop("_place")
        own = placed.where("_own")
        if isinstance(constraint, SpeedConstraint):
            own = _suspects(placed, constraint)
        windows = F.explode(annotation_windows(F.col("ts"), size, slide)) if emit == "all" else first_window(F.col("ts"), size, slide)
        records = own.withColumn("win", windows).withColumn("win_start", F.col("win.start")).drop("win")
        on = [F.col("o.key") == F.col("r.key"), F.col("o.bucket") == F.col("r.bucket"), F.col("o.ts") >= F.col("r.win_start")]
        origins = placed
    else:
        every = rows.withColumn("win", F.explode(annotation_windows(F.col("ts"), size, slide))).withColumn("win_start", F.col("win.start")).withColumn("win_end", F.col("win.end")).drop("win")
        first = first_window(F.col("ts"), size, slide)
        records = every if emit == "all" else every.where((F.col("win_start") == first["start"]) & (F.col("win_end") == first["end"]))
        on = [F.col(f"o.{c}") == F.col(f"r.{c}") for c in ("key", "win_start", "win_end")]
        origins = every
    distance = constraint.distance(_fields("o"), _fields("r"))
    found = origins.alias("o").join(records.alias("r"), reduce(lambda a, b: a & b, [*on, *equal, _before(), distance != 0]))
    name = F.concat(F.lit(constraint.name + "_"), F.col("o.ts").cast("string"))
    return found.select("r.key", "r.seq", "r.win_start", name.alias("var"), _exponent(distance).alias("exponent"))


def _exponent(distance: Column) -> Column:
    """At most 2**53, as in blocks mode, so that sums of a thousand stay whole."""
    return F.least(F.ceil(F.abs(distance)), F.lit(1 << 53))


def _merged(entries: Column) -> Column:
    """Map from variable to the sum of its exponents."""
    names = F.array_distinct(F.transform(entries, lambda e: e["var"]))
    total = lambda n: F.aggregate(F.filter(entries, lambda e: e["var"] == n), F.lit(0).cast("bigint"), lambda a, e: a + e["exponent"])
    # origins of one ts are rare; without them no name is searched for
    return F.when(F.size(names) == F.size(entries), F.map_from_entries(entries)).otherwise(F.map_from_arrays(names, F.transform(names, total)))


def annotate(df: DataFrame, constraints: Constraint | Domain | Sequence[Constraint | Domain], size: int, slide: int | None = None, emit: str = "first", keep_window: bool = False, mode: str = "exact", variables: bool = True, rows_along: bool = False) -> DataFrame:
    """df with columns key, ts (epoch ms), seq (unique in a key) and the annotation columns.

    emit: "first" annotates each record once, with the history of the earliest window that holds it; "all" once for
    each window (with win_start, win_end). keep_window adds the window of "first". Several constraints multiply.
    variables=False leaves ann_vars null in blocks mode, where only degrees are then made; the other modes' plans drop
    unread variables by themselves. rows_along has records take their rows along then, as they do for variables, instead
    of joining rows and degrees: two shuffles less, but of all columns, so for narrow rows.
    """
    constraints = [constraints] if isinstance(constraints, Constraint | Domain) else list(constraints)
    slide = slide or size
    if not constraints:
        raise ValueError("no constraint given")
    if len({c.name for c in constraints}) < len(constraints):
        raise ValueError("constraints need different names")
    if emit not in ("first", "all") or mode not in ("exact", "blocks", "paths"):
        raise ValueError(f"unknown emit {emit!r} or mode {mode!r}")
    if size <= 0 or not 0 < slide <= size:
        raise ValueError("size must be positive and slide between 1 and size")
    paired = [c for c in constraints if isinstance(c, Constraint)]
    window = F.explode(annotation_windows(F.col("ts"), size, slide)) if emit == "all" else first_window(F.col("ts"), size, slide)
    out = df.withColumn("_win", window).withColumn("win_start", F.col("_win.start")).withColumn("win_end", F.col("_win.end")).drop("_win")
    if not paired:
        out = out.withColumns({"_found": algebra.one(), "_degree": F.lit(0).cast("bigint")})
    elif mode == "blocks" and (variables or rows_along):
        out = blocks.with_variables(df, out, paired, size, slide, emit, variables=variables)
    elif mode == "blocks":
        found = blocks.violations(df, paired, size, slide, emit, False)
        out = out.join(found, ["key", "seq", "win_start"], "left").select(out["*"], "_found", "_degree")
    elif mode == "paths":
        found = _by_paths(df, paired, size, slide, emit).withColumn("_degree", algebra.degree(F.col("found")))
        out = out.join(found, ["key", "seq", "win_start"], "left").select(out["*"], F.col("found").alias("_found"), "_degree")
    else:
        pairs = reduce(DataFrame.unionByName, [_pairs(df, c, size, slide, emit) for c in paired])
        # the degree has a sum of its own: where no variables are asked for, no list is collected
        found = pairs.groupBy("key", "seq", "win_start").agg(F.sum("exponent").alias("_degree"), F.collect_list(F.struct("var", "exponent")).alias("entries"))
        found = found.select("key", "seq", "win_start", "_degree", _merged(F.col("entries")).alias("_found"))
        out = out.join(found, ["key", "seq", "win_start"], "left").select(out["*"], "_found", "_degree")
    domains = [c for c in constraints if isinstance(c, Domain)]
    marks = [F.when(c.column(), F.map_from_arrays(F.array(F.concat(F.lit(c.name + "_"), F.col("ts").cast("string"))), F.array(F.lit(1).cast("bigint")))).otherwise(algebra.one()) for c in domains]
    degree = reduce(lambda a, b: a + b, [F.coalesce(F.col("_degree"), F.lit(0).cast("bigint")), *[c.column().cast("int") for c in domains]])
    unread = mode == "blocks" and not variables
    out = out.withColumn("ann_vars", F.lit(None).cast(algebra.VARS_TYPE) if unread else algebra.times(F.col("_found"), *marks)).withColumn("ann_degree", degree)
    out = out.withColumns({"ann_degree_sum": F.col("ann_degree"), "ann_n_incons": (F.col("ann_degree") > 0).cast("int")}).drop("_found", "_degree")
    return out if emit == "all" or keep_window else out.drop("win_start", "win_end")


def _by_paths(df: DataFrame, constraints: list[Constraint], size: int, slide: int, emit: str) -> DataFrame:
    columns = list(dict.fromkeys(["key", "ts", "seq", *(c for x in constraints for c in x.columns())]))
    every = df.select(columns).withColumn("win", F.explode(annotation_windows(F.col("ts"), size, slide))).withColumn("win_start", F.col("win.start")).withColumn("win_end", F.col("win.end")).drop("win")
    key_type, seq_type = df.schema["key"].dataType.simpleString(), df.schema["seq"].dataType.simpleString()

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # groups follow each other, so one history is held at a time
        at, histories = None, []
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                if at != (group := (r["key"], r["win_start"], r["win_end"])):
                    at, histories = group, [paths.history(c) for c in constraints]
                found: dict[str, int] = {}
                for h in histories:
                    found |= h.add(r)
                if emit == "all" or paths.windows_of(r["ts"], size, slide)[0] == (r["win_start"], r["win_end"]):
                    out.append((r["key"], r["seq"], r["win_start"], found))
            yield pd.DataFrame(out, columns=["key", "seq", "win_start", "found"])

    grouped = every.repartition("key", "win_start", "win_end").sortWithinPartitions("key", "win_start", "win_end", "ts", "seq")
    return grouped.mapInPandas(walk, f"key {key_type}, seq {seq_type}, win_start bigint, found map<string,bigint>")


def annotate_some(df: DataFrame, constraints, size: int, slide: int | None = None, percent: int = 100, chosen: Column | None = None, **how) -> DataFrame:
    """Applies constraints to a fixed choice of about percent % of the records; the others pass with the constant
    annotation and are no origins. `chosen` makes another choice."""
    chosen = F.pmod(F.xxhash64("key", "seq"), F.lit(100)) < percent if chosen is None else chosen
    return annotate(df.where(chosen), constraints, size, slide, **how).unionByName(unannotated(df.where(~chosen)))


def consistent_only(df: DataFrame, constraints, size: int, slide: int | None = None, **how) -> DataFrame:
    """Records that contradict no earlier one, without annotation. Rejected records still count as origins."""
    return annotate(df, constraints, size, slide, **{"variables": False, **how}).where("ann_degree <= 0").drop(*ANN)


def annotate_values(df: DataFrame, constraints, size: int, slide: int | None = None, key: object = "all", **how) -> DataFrame:
    """As annotate(), with one constant key for all records, which replaces `key` in checks only."""
    return annotate(df.withColumn("_key", F.col("key")).withColumn("key", F.lit(key)), constraints, size, slide, **how).drop("key").withColumnRenamed("_key", "key")


def annotate_by_self_join(df: DataFrame, constraint: Constraint, size: int) -> DataFrame:
    """The plan without windows: each record with all records of its key of the last `size`, itself included, then a
    product of the pairs' annotations."""
    pairs = df.alias("r").join(df.alias("o"), (F.col("o.key") == F.col("r.key")) & (F.floor(F.col("o.ts") / (size + 1)).between(F.floor(F.col("r.ts") / (size + 1)) - 1, F.floor(F.col("r.ts") / (size + 1)))) & F.col("o.ts").between(F.col("r.ts") - size, F.col("r.ts")) & ((F.col("o.ts") < F.col("r.ts")) | (F.col("o.seq") <= F.col("r.seq"))))
    distance = constraint.distance(_fields("o"), _fields("r"))
    entry = F.when(distance != 0, F.struct(F.concat(F.lit(constraint.name + "_"), F.col("o.ts").cast("string")).alias("var"), _exponent(distance).alias("exponent")))
    grouped = pairs.groupBy("r.key", "r.seq").agg(F.collect_list(entry).alias("entries"))
    return with_annotation(df.join(grouped.select("key", "seq", _merged(F.col("entries")).alias("_found")), ["key", "seq"], "left"), F.col("_found")).drop("_found")

