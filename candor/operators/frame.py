"""Annotated relations: a DataFrame of payload, key, ts, seq and annotation, with the operators that carry it along."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candor.functions import algebra
from candor.operators import annotate as A
from candor.operators.windows import containing_start, hop

ANN = A.ANN


class AnnotatedFrame:
    """Methods return new frames; `.df` is the DataFrame behind one."""

    def __init__(self, df: DataFrame):
        missing = [c for c in ("key", "ts", *ANN) if c not in df.columns]
        if missing:
            raise ValueError(f"not an annotated relation, {missing} missing")
        self.df = df

    @classmethod
    def annotated(cls, df: DataFrame, constraints, size: int, slide: int | None = None, **how) -> AnnotatedFrame:
        return cls(A.annotate(df, constraints, size, slide, **how))

    @classmethod
    def plain(cls, df: DataFrame) -> AnnotatedFrame:
        return cls(A.unannotated(df))

    # projection, filters, keys

    def payload(self) -> list[str]:
        return [c for c in self.df.columns if c not in ("key", "ts", "seq", *ANN, "ann_poly")]

    def _kept(self) -> list[str]:
        return [c for c in ("key", "ts", "seq", *ANN, "ann_poly") if c in self.df.columns]

    def select(self, *columns: Column | str) -> AnnotatedFrame:
        """Maps the payload; key, ts and annotation stay."""
        return AnnotatedFrame(self.df.select(*columns, *self._kept()))

    map_values = select

    def where(self, condition: Column | str) -> AnnotatedFrame:
        return AnnotatedFrame(self.df.where(condition))

    def where_not_null(self, *columns: str) -> AnnotatedFrame:
        """Drops rows of which none of the columns (by default the whole payload) has a value."""
        return AnnotatedFrame(self.df.dropna("all", subset=list(columns) or self.payload()))

    def where_annotation(self, condition: Column | str) -> AnnotatedFrame:
        """A condition over payload and annotation, such as ann_degree = 0."""
        return AnnotatedFrame(self.df.where(condition))

    def transform_annotation(self, variables: Column) -> AnnotatedFrame:
        """Rewrites the monomial; degrees follow."""
        return AnnotatedFrame(A.with_annotation(self.df, variables))

    def simplified(self, first: str, second: str) -> AnnotatedFrame:
        """Cancels simultaneous violations of two constraints."""
        return self.transform_annotation(algebra.simplify(F.col("ann_vars"), first, second))

    def values_from_annotation(self, *columns: Column | str) -> DataFrame:
        """Consumes the annotation: a plain relation of key, ts and the given columns."""
        return self.df.select("key", "ts", *columns)

    def drop_annotation(self) -> DataFrame:
        return self.df.drop(*ANN, "ann_poly")

    def with_key(self, key: Column | str) -> AnnotatedFrame:
        return AnnotatedFrame(self.df.withColumn("key", F.col(key) if isinstance(key, str) else key))

    # joins

    def join(self, other: AnnotatedFrame, before: int, after: int = 0, on: Column | str | None = None, how: str = "inner", exact_ts: bool = False) -> AnnotatedFrame:
        """Equal keys and other.ts in [ts - before, ts + after]; annotations multiply, the later ts counts.

        Payloads become structs `left` and `right`. `on` is a further condition over l and r. The time condition is
        also an equality of time buckets, so that one hot key is spread over its buckets. how: inner or left.
        """
        if how not in ("inner", "left"):
            raise ValueError(f"how must be inner or left, not {how}")
        width = max(1, before + after)
        bucket = lambda t: F.floor(t / F.lit(width)).cast("bigint")
        left = self.df.withColumn("_bucket", F.lit(0).cast("bigint") if exact_ts else bucket(F.col("ts")))
        right = other.df
        if exact_ts:
            right = right.withColumn("_bucket", F.lit(0).cast("bigint"))
        else:
            right = right.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("ts") - F.lit(after)), bucket(F.col("ts") + F.lit(before)))))
        cond = [F.col("l.key") == F.col("r.key"), F.col("l._bucket") == F.col("r._bucket")]
        cond += [F.col("l.ts") == F.col("r.ts")] if exact_ts else [F.col("r.ts").between(F.col("l.ts") - before, F.col("l.ts") + after)]
        if on is not None:
            cond.append(F.expr(on) if isinstance(on, str) else on)
        joined = left.alias("l").join(right.alias("r"), reduce(lambda a, b: a & b, cond), how)
        pack = lambda frame, alias: F.struct(*[F.col(f"{alias}.{c}").alias(c) for c in [*frame.payload(), *(["seq"] if "seq" in frame.df.columns else [])]])
        right_side = F.when(F.col("r.ts").isNotNull(), pack(other, "r"))
        degree = F.col("l.ann_degree_sum") + F.coalesce(F.col("r.ann_degree_sum"), F.lit(0))
        variables = algebra.times(F.col("l.ann_vars"), F.col("r.ann_vars"))
        return AnnotatedFrame(
            joined.select(
                F.col("l.key").alias("key"),
                F.greatest("l.ts", "r.ts").alias("ts"),
                pack(self, "l").alias("left"),
                right_side.alias("right"),
                variables.alias("ann_vars"),
                degree.alias("ann_degree"),
                degree.alias("ann_degree_sum"),
                F.greatest("l.ann_n_incons", F.coalesce(F.col("r.ann_n_incons"), F.lit(0))).alias("ann_n_incons"),
            )
        )

    def left_join(self, other: AnnotatedFrame, before: int, after: int = 0, on: Column | str | None = None) -> AnnotatedFrame:
        return self.join(other, before, after, on, "left")

    # groups and windows

    def group(self, *by: Column | str) -> AnnotatedGroups:
        return AnnotatedGroups(self.df, list(by) or ["key"])

    def group_and_window(self, *by: Column | str, size: int, slide: int | None = None, restamp: bool = False) -> AnnotatedGroups:
        """Hopping windows (tumbling without slide). restamp first moves each row to the last ms of its own window
        (win_end), as relations with one row a window need."""
        df = self.df.withColumn("ts", F.col("win_end") - 1) if restamp else self.df
        return AnnotatedGroups(hop(df.drop("win_start", "win_end"), size, slide), [*(by or ["key"]), "win_start"])

    def group_first_window(self, *by: Column | str, size: int, slide: int) -> AnnotatedGroups:
        """Each row in the earliest window that holds it only."""
        return AnnotatedGroups(self.df.withColumn("win_start", containing_start(F.col("ts"), size, slide)), [*(by or ["key"]), "win_start"])

    # ranking

    def top(self, k: int, window: Sequence[str] = ("win_start",), order: Sequence[Column] | None = None, descending: bool = True, ties: Sequence[str] = ("key",)) -> DataFrame:
        """The k rows of each window with the largest (or smallest) degree sum, with their rank. Equal ones go by `ties`.

        Rows beyond k are cut inside each task before they are shuffled to their window.
        """
        by = list(order or [F.desc("ann_degree_sum") if descending else F.asc("ann_degree_sum")])
        rank = F.row_number().over(Window.partitionBy(*window).orderBy(*by, *ties))
        return self.df.withColumn("rank", rank).where(F.col("rank") <= k)

    def top_first_window(self, k: int, size: int, slide: int, **how) -> DataFrame:
        """Top-k over rows, each ranked in the earliest window that holds it."""
        return AnnotatedFrame(self.df.withColumn("win_start", containing_start(F.col("ts"), size, slide))).top(k, **how)

    def counts(self) -> DataFrame:
        """Events, violating monomials, and their average."""
        return self.df.agg(F.count(F.lit(1)).alias("n_events"), F.coalesce(F.sum("ann_n_incons"), F.lit(0)).cast("bigint").alias("n_inconsistencies"), F.avg("ann_n_incons").alias("avg_inconsistencies"))


class AnnotatedGroups:
    """A grouped annotated relation; aggregates are built-in, so they are partial before the shuffle."""

    def __init__(self, df: DataFrame, by: list[Column | str]):
        self.df, self.by = df, by

    def agg(self, *aggregates: Column, polynomial: bool = False) -> AnnotatedFrame:
        """Aggregates the payload; degree is the largest, degree sum and inconsistencies are sums, ts the latest.
        polynomial also keeps the sum of the annotations as ann_poly (as long as the group)."""
        extra = [F.filter(F.collect_list("ann_vars"), lambda m: F.size(m) > 0).alias("ann_poly")] if polynomial else []
        names = ["key"] if "key" in self.by else []
        out = self.df.groupBy(*self.by).agg(
            *aggregates,
            F.max("ts").alias("ts"),
            F.max("ann_degree").alias("ann_degree"),
            F.sum("ann_degree_sum").cast("bigint").alias("ann_degree_sum"),
            F.sum("ann_n_incons").cast("bigint").alias("ann_n_incons"),
            *extra,
        )
        keyed = out if names else out.withColumn("key", F.lit(None).cast("string"))
        return AnnotatedFrame(keyed.withColumn("ann_vars", F.lit(None).cast(algebra.VARS_TYPE)))

    reduce = agg


def pearson(x: str, y: str) -> list[Column]:
    """Sufficient statistics of a correlation."""
    a, b = F.col(x), F.col(y)
    return [F.sum(a).alias("sum_x"), F.sum(b).alias("sum_y"), F.sum(a * b).alias("sum_xy"), F.sum(a * a).alias("sum_x2"), F.sum(b * b).alias("sum_y2"), F.count(F.lit(1)).alias("n_couples")]


def correlation() -> Column:
    """The coefficient that pearson()'s columns give."""
    n, x, y, xy, x2, y2 = (F.col(c).cast("double") for c in ("n_couples", "sum_x", "sum_y", "sum_xy", "sum_x2", "sum_y2"))
    above, below = n * xy - x * y, F.sqrt((n * x2 - x * x) * (n * y2 - y * y))
    return F.when(below != 0, above / below)


def running(df: DataFrame, aggregate: Column, by: Sequence[str] = ("key",), order: Sequence[str] = ("ts", "seq")) -> Column:
    """An aggregate over all rows of the group so far."""
    return aggregate.over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
