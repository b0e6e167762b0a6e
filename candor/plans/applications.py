"""The application queries, over any relation with the columns they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.functions import algebra
from candor.operators.annotate import annotate, consistent_only, unannotated
from candor.operators.frame import AnnotatedFrame, running
from candor.operators.repair import from_annotation, repair
from candor.operators.windows import hop


def pairs_at_same_time(frame: AnnotatedFrame, name: str) -> AnnotatedFrame:
    """All ordered pairs of rows of one ts that differ in `name`."""
    same = AnnotatedFrame(frame.df.withColumn("key", F.col("ts")))
    return same.join(same, 0, on=F.col(f"l.{name}") != F.col(f"r.{name}"), exact_ts=True)


def _annotated(df: DataFrame, constraints, size: int, slide: int, **how) -> AnnotatedFrame:
    return AnnotatedFrame.annotated(df, constraints, size, slide, **how) if constraints else AnnotatedFrame.plain(df)


def stock_combo(df: DataFrame, constraints, size: int, slide: int, name: str = "name", **how) -> AnnotatedFrame:
    return pairs_at_same_time(_annotated(df, constraints, size, slide, **how), name)


def stock_pearson(df: DataFrame, constraints, size: int, slide: int, query_size: int, query_slide: int, k: int = 3, name: str = "name", value: str = "value") -> DataFrame:
    """Correlation statistics of each pair in each hopping window, with the k most inconsistent pairs of a window."""
    return pearson_top(_annotated(df, constraints, size, slide, mode="blocks", variables=False), query_size, query_slide, k, name, value)


def pearson_top(frame: AnnotatedFrame, query_size: int, query_slide: int, k: int = 3, name: str = "name", value: str = "value") -> DataFrame:
    """stock_pearson() of an annotated relation.

    Every row of one name meets every row of another at the same ts, so all sums over pairs are products of sums over
    one side and counts of the other: rows are aggregated by name and ts first, and those aggregates are paired.
    """
    rows = frame.df
    x, n, one = F.col(value), F.count(F.lit(1)), F.lit(1)
    sides = rows.groupBy(F.col("ts"), F.col(name).alias("_name")).agg(
        n.alias("_n"),
        F.count(F.when(F.col("ann_n_incons") == 0, one)).alias("_clean"),
        F.sum(x).alias("_x"),
        F.sum(x * x).alias("_x2"),
        F.sum("ann_degree_sum").alias("_sum"),
        F.max("ann_degree").alias("_degree"),
    )
    l, r = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))
    joined = sides.alias("l").join(sides.alias("r"), (l("ts") == r("ts")) & (l("_name") != r("_name")))
    pairs = joined.select(
        F.concat_ws("|", l("_name"), r("_name")).alias("key"),
        l("ts").alias("ts"),
        (l("_x") * r("_n")).alias("sum_x"),
        (r("_x") * l("_n")).alias("sum_y"),
        (l("_x") * r("_x")).alias("sum_xy"),
        (l("_x2") * r("_n")).alias("sum_x2"),
        (r("_x2") * l("_n")).alias("sum_y2"),
        (l("_n") * r("_n")).alias("n_couples"),
        (l("_degree") + r("_degree")).alias("ann_degree"),
        (l("_sum") * r("_n") + r("_sum") * l("_n")).alias("ann_degree_sum"),
        # a pair is inconsistent unless both sides are clean
        (l("_n") * r("_n") - l("_clean") * r("_clean")).alias("ann_n_incons"),
        F.lit(None).cast(algebra.VARS_TYPE).alias("ann_vars"),
    )
    sums = [F.sum(c).alias(c) for c in ("sum_x", "sum_y", "sum_xy", "sum_x2", "sum_y2", "n_couples")]
    return AnnotatedFrame(pairs).group_and_window("key", size=query_size, slide=query_slide).agg(*sums).top(k)


def ranked(df: DataFrame, constraints, size: int, slide: int, k: int = 3, descending: bool = True, **how) -> DataFrame:
    """The k most inconsistent records of each first window (GPS and review queries)."""
    return _annotated(df, constraints, size, slide, **how).top_first_window(k, size, slide, descending=descending, ties=("ts", "seq"))


def co_travel(df: DataFrame, constraints, size: int, slide: int, segment: str, same: str, back: int, least: int | None = None, **how) -> AnnotatedFrame:
    """Pairs on one segment, equal in `same`, of which the right one is up to `back` older (each row meets itself)."""
    keyed = _annotated(df, constraints, size, slide, **how).with_key(segment)
    pairs = keyed.join(keyed, back, on=F.col(f"l.{same}") == F.col(f"r.{same}"))
    return pairs if least is None else pairs.where_annotation(F.col("ann_degree_sum") > least)


def grid_cost(df: DataFrame, variant: str, low: float = -2.0, high: float = 2.0, size: int = 5, slide: int = 2) -> DataFrame:
    """win_start, ts, value: 1.2 and 1.5 times the window's sums. variant: pure, consistent, repaired or simplified."""
    from candor.operators.constraints import SpeedConstraint

    if variant == "pure":
        rows = AnnotatedFrame.plain(df)
    else:
        rows = AnnotatedFrame.annotated(df, [SpeedConstraint("cons_a", low, high, "SCA"), SpeedConstraint("cons_b", low, high, "SCB")], size, slide)
    if variant == "consistent":
        rows = rows.where_annotation("ann_degree = 0")
    elif variant in ("repaired", "simplified"):
        rows = rows.simplified("SCA", "SCB") if variant == "simplified" else rows
        fixed = {c: from_annotation(F.col(c), p).cast("bigint") for c, p in (("cons_a", "SCA"), ("cons_b", "SCB"))}
        rows = AnnotatedFrame(rows.df.withColumns(fixed))
    elif variant != "pure":
        raise ValueError(f"unknown variant {variant!r}")
    sums = rows.group_and_window("key", size=size, slide=slide).agg(F.sum("cons_a").alias("a"), F.sum("cons_b").alias("b"))
    return sums.df.select("win_start", "ts", (F.lit(1.2) * F.col("a") + F.lit(1.5) * F.col("b")).alias("value"))


def window_sums(df: DataFrame, constraints, size: int, slide: int, query_size: int, query_slide: int, *columns: str, **how) -> DataFrame:
    """Sums of columns in hopping windows with the annotation's aggregates; without constraints, un-annotated."""
    sums = [F.sum(c).alias(f"sum_{c}") for c in columns]
    if not constraints:
        return hop(df, query_size, query_slide).groupBy("key", "win_start").agg(*sums, F.max("ts").alias("ts"))
    out = AnnotatedFrame.annotated(df, constraints, size, slide, **how).group_and_window("key", size=query_size, slide=query_slide).agg(*sums)
    return out.df.drop("ann_vars")


def running_sum(df: DataFrame, value: str) -> DataFrame:
    return df.withColumn("running_sum", running(df, F.sum(value)))


def running_max(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({f"max_{c}": running(df, F.max(c)) for c in columns})


def qualitative(df: DataFrame, constraints, size: int, slide: int, variant: str, repairs: dict[str, str], how: str = "subtract") -> DataFrame:
    """Rows as they are (pure), consistent ones, or with columns repaired by the variables of their prefix."""
    if variant == "pure":
        return unannotated(df)
    out = annotate(df, constraints, size, slide)
    if variant == "consistent":
        return out.where("ann_degree = 0")
    if variant == "simplified":
        first, second = (c.name for c in constraints)
        out = AnnotatedFrame(out).simplified(first, second).df
    return out.withColumns({c: from_annotation(F.col(c), p, how) for c, p in repairs.items()})


def validated(df: DataFrame, constraints, size: int, slide: int, **how) -> DataFrame:
    return consistent_only(df, constraints, size, slide, **how)


def repaired(df: DataFrame, column: str, size: int, slide: int, strictness: float) -> DataFrame:
    return repair(df, column, size, slide, -strictness, strictness)


def annotation_text() -> Column:
    return algebra.text(F.col("ann_vars"))
