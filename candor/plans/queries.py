"""Queries over the driver's tables, each with the SQL that must give the same rows.

Events are the stream: key user_id, ts in ms, seq event_id, v the value, cents the value in hundredths (whole numbers,
so that sums don't depend on their order).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.functions import algebra, series
from candor.operators import annotate as A
from candor.operators.constraints import Domain, PlaneSpeedConstraint, PrimaryKey, SpeedConstraint
from candor.operators.frame import AnnotatedFrame, correlation, pearson
from candor.operators.repair import from_annotation
from candor.operators.windows import containing_start, hop
from candor.plans import applications as Q
from candor.plans.streams import shared_folder
from candor.sources import generators as G
from candor.sources.readers import events, gps, linear_road, millis, reviews, stocks

HOUR = 3_600_000
SIZE, SLIDE = 48 * HOUR, 12 * HOUR
LOW, HIGH = -1e-6, 1e-6
SC = SpeedConstraint("v", LOW, HIGH)
SCA, SCB = SpeedConstraint("v", -2e-6, 2e-6, "SCA"), SpeedConstraint("v", -5e-7, 5e-7, "SCB")
PK = PrimaryKey(("event_type",))
SCH = Domain("v > 150")

# SQL building blocks

EV = "ev AS (SELECT event_id AS seq, user_id AS key, epoch_us(ts) // 1000 AS ts, value AS v, CAST(round(value * 100) AS BIGINT) AS cents, user_id, event_type FROM events)"


def _first(size: int, slide: int, rel: str = "ev", out: str = "w") -> str:
    end = f"greatest(((ts + {slide} - 1) // {slide}) * {slide}, {size})"
    return f"{out}0 AS (SELECT *, greatest(((ts + {slide} - 1) // {slide}) * {slide} - {size}, 0) AS s0, {end} AS e0 FROM {rel}), {out} AS (SELECT * EXCLUDE (s0, e0), s0 + CASE WHEN e0 <= ts THEN {slide} ELSE 0 END AS ws, e0 + CASE WHEN e0 <= ts THEN {slide} ELSE 0 END AS we FROM {out}0)"


def _every(size: int, slide: int, rel: str = "ev", out: str = "wa") -> str:
    return f"{_first(size, slide, rel, out + 'f')}, {out} AS (SELECT * EXCLUDE (ws, we, k), ws + k * {slide} AS ws, we + k * {slide} AS we FROM (SELECT *, unnest(range(0, (ts - ws) // {slide} + 1)) AS k FROM {out}f))"


def _band(c: str = "v", low: float = LOW, high: float = HIGH) -> str:
    o, r, dt, low_s, high_s = f"o.{c}", f"r.{c}", "(r.ts - o.ts)", f"CAST('{low!r}' AS DOUBLE)", f"CAST('{high!r}' AS DOUBLE)"
    return f"(CASE WHEN {o} + {high_s} * {dt} < {r} THEN {r} - ({o} + {high_s} * {dt}) WHEN {o} + {low_s} * {dt} > {r} THEN {r} - ({o} + {low_s} * {dt}) ELSE 0 END)"


_BEFORE = "(o.ts < r.ts OR (o.ts = r.ts AND o.seq < r.seq))"


def _pairs(distance: str, name: str, rel: str = "w", origins: str = "ev", on: str = "o.ts >= r.ws") -> str:
    return f"SELECT r.key, r.seq, r.ws, '{name}_' || o.ts AS var, CAST(ceil(abs({distance})) AS BIGINT) AS e FROM {rel} r JOIN {origins} o ON o.key = r.key AND {on} AND {_BEFORE} WHERE {distance} <> 0"


def _annotated(pairs: list[str], rel: str = "w", out: str = "ann", marks: str = "") -> str:
    both = " UNION ALL ".join([*pairs, *([marks] if marks else [])])
    return (
        f"p{out} AS ({both}), q{out} AS (SELECT key, seq, ws, var, sum(e) AS e FROM p{out} GROUP BY ALL), "
        f"g{out} AS (SELECT key, seq, ws, CAST(sum(e) AS BIGINT) AS d, string_agg('<' || var || '>^' || e, '' ORDER BY var) AS t FROM q{out} GROUP BY ALL), "
        f"{out} AS (SELECT r.*, coalesce(d, 0) AS ann_degree, coalesce(d, 0) AS ann_degree_sum, CASE WHEN d IS NULL THEN 0 ELSE 1 END AS ann_n_incons, '1' || coalesce(t, '') AS ann_text FROM {rel} r LEFT JOIN g{out} g ON g.key = r.key AND g.seq = r.seq AND g.ws = r.ws)"
    )


_PK = "(CASE WHEN o.event_type = r.event_type THEN -1 ELSE 0 END)"
_MARK = "SELECT key, seq, ws, 'SCH_' || ts AS var, 1 AS e FROM w WHERE v > 150"
_SC = f"WITH {EV}, {_first(SIZE, SLIDE)}, {_annotated([_pairs(_band(), 'SC')])} "
_ALL = f"WITH {EV}, {_every(SIZE, SLIDE)}, {_annotated([_pairs(_band(), 'SC', 'wa')], 'wa')} "
_DOUBLE = f"WITH {EV}, {_first(SIZE, SLIDE)}, {_annotated([_pairs(_band(low=-2e-6, high=2e-6), 'SCA'), _pairs(_band(low=-5e-7, high=5e-7), 'SCB')])} "
_OUT = "seq, ann_degree, ann_degree_sum, ann_n_incons, ann_text"

#: Degrees alone, for histories of which most pairs violate.
DEGREES = {"mode": "blocks", "variables": False}

FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None):
    def add(f):
        FOUND[f.__name__] = (f, sql)
        return f

    return add


def _shown(df: DataFrame, *more: str) -> DataFrame:
    return df.select("seq", *more, F.col("ann_degree").cast("bigint").alias("ann_degree"), F.col("ann_degree_sum").cast("bigint").alias("ann_degree_sum"), "ann_n_incons", Q.annotation_text().alias("ann_text"))


def _frame(spark, sf_dir, constraints=SC, **how) -> AnnotatedFrame:
    return AnnotatedFrame.annotated(events(spark, sf_dir), constraints, SIZE, SLIDE, **how)


# sources and generators


@query(f"WITH {EV} SELECT event_type, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents, min(ts) AS first_ts, max(ts) AS last_ts FROM ev GROUP BY event_type")
def source_consume(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(f"WITH {EV}, s AS (SELECT max(ts) - min(ts) + 1 AS span, max(seq) - min(seq) + 1 AS seqs FROM ev), x AS (SELECT seq + k * seqs AS seq, ts + k * span AS ts, cents, k AS round FROM ev, s, range(3) t(k)) SELECT round, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq, min(ts) AS first_ts, max(ts) AS last_ts, CAST(sum(cents) AS BIGINT) AS cents FROM x GROUP BY round")
def source_replay(spark, sf_dir):
    out = G.replay(events(spark, sf_dir), 3).groupBy(F.col("round").cast("bigint").alias("round"))
    return out.agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum("cents").alias("cents"))


@query(f"WITH {EV} SELECT seq, row_number() OVER (PARTITION BY key ORDER BY ts, seq) * 1000 AS ts FROM ev")
def source_simulated_time(spark, sf_dir):
    return G.simulated_time(events(spark, sf_dir)).select("seq", "ts")


@query(f"WITH {EV} SELECT seq, CASE WHEN row_number() OVER (PARTITION BY key ORDER BY ts, seq) % 11 = 0 THEN 1000000 ELSE cents END AS cents FROM ev")
def inject_fixed_period(spark, sf_dir):
    return G.inject_every(events(spark, sf_dir), "cents", 1_000_000).select("seq", "cents")


def _draw(n: int, seed: int) -> str:
    return f"(CAST('0x' || substr(md5(key || '|' || seq || '|{seed}'), 1, 8) AS BIGINT) % {n} + 1)"


@query(f"WITH {EV}, h AS (SELECT *, {_draw(100, 7)} <= 10 AS hit, {_draw(50, 8)} AS many FROM ev), r AS (SELECT *, sum(CAST(hit AS INTEGER)) OVER w AS hits, sum(cents) OVER w / count(*) OVER w AS mean FROM h WINDOW w AS (PARTITION BY key ORDER BY ts, seq)) SELECT seq, CASE WHEN hit THEN CAST(trunc(mean * many * CASE WHEN hits % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) ELSE cents END AS cents FROM r")
def inject_percentage(spark, sf_dir):
    return G.inject_percent(events(spark, sf_dir), "cents", 10).select("seq", "cents")


def _through_csv(df: DataFrame, header: bool) -> str:
    """A folder with the rows as CSV."""
    folder = shared_folder(df.sparkSession, "csv")
    df.write.option("header", header).csv(folder)
    return folder


@query("WITH d AS (SELECT CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS day, min(event_id) AS a, max(event_id) AS b FROM events GROUP BY 1), p AS (SELECT day, unnest([7, 20]) AS h, a, b FROM d) SELECT 'S' AS name, CAST(CASE WHEN h = 7 THEN a ELSE b END AS DOUBLE) AS value, day * 86400000 + h * 3600000 AS ts FROM p")
def source_stocks_csv(spark, sf_dir):
    days = events(spark, sf_dir).groupBy(F.floor(F.col("ts") / 86_400_000).alias("day")).agg(F.min("seq").alias("a"), F.max("seq").alias("b"))
    rows = days.select(F.date_format(F.timestamp_millis(F.col("day") * 86_400_000), "dd-MM-yyyy").alias("date"), F.lit("").alias("one"), "a", F.lit("").alias("three"), F.lit("").alias("four"), "b")
    return stocks(spark, _through_csv(rows, True), "S")


@query(f"WITH {EV} SELECT v AS x, CAST(seq % 97 AS DOUBLE) AS y, ts FROM ev")
def source_gps_csv(spark, sf_dir):
    return gps(spark, _through_csv(events(spark, sf_dir).select("ts", (F.col("seq") % 97).cast("double").alias("y"), F.col("v").alias("x")), True))


@query(f"WITH {EV} SELECT user_id, event_type AS title, ts // 86400000 * 86400000 + 25200000 AS ts, CAST(seq % 5 + 1 AS INTEGER) AS value FROM ev")
def source_reviews_csv(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "event_type", F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd").alias("date"), F.col("seq") % 5 + 1)
    return reviews(spark, _through_csv(rows, False))


@query(f"WITH {EV} SELECT ts, CAST(cents % 100 AS INTEGER) AS speed, user_id AS vid, CAST(seq % 3 AS INTEGER) AS x_way, CAST(seq % 50 AS INTEGER) AS segment FROM ev")
def source_linear_road_csv(spark, sf_dir):
    none = lambda n: F.lit("0").alias(n)
    rows = events(spark, sf_dir).select(F.concat(F.lit("["), "user_id").alias("vid"), F.col("cents") % 100, none("c2"), F.col("seq") % 3, none("c4"), none("c5"), F.concat(F.lit("("), F.col("seq") % 50, F.lit(")")).alias("segment"), none("c7"), F.concat(F.lit(" "), "ts", F.lit("]")).alias("ts"))
    return linear_road(spark, _through_csv(rows, True))


@query("WITH g AS (SELECT CAST(i AS BIGINT) AS ts, [80, 80, 80, 80, 50, 30, 20, 20, 40, 60, 80, 80, 80, 60, 40, 20, 20, 40, 60] AS a, CASE WHEN i % 100 = 0 THEN 'shared' ELSE 'u' || i END AS uuid FROM range(1, 1001) t(i)) SELECT ts, CAST(a[(ts - 1) % 19 + 1] AS BIGINT) AS cons_a, uuid FROM g")
def source_ablation(spark, sf_dir):
    return G.grid_ablation(spark, 1000).select("ts", "cons_a", "uuid")


# projection, filters, annotation access


@query(f"WITH {EV} SELECT seq, cents * 2 AS twice, ts FROM ev WHERE cents > 5000 AND event_type <> 'error'")
def project_filter(spark, sf_dir):
    plain = AnnotatedFrame.plain(events(spark, sf_dir))
    return plain.where("cents > 5000 and event_type <> 'error'").select((F.col("cents") * 2).alias("twice")).drop_annotation().drop("key")


@query(_SC + "SELECT seq, cents FROM ann WHERE ann_degree = 0")
def filter_on_annotation(spark, sf_dir):
    return _frame(spark, sf_dir).where_annotation("ann_degree = 0").drop_annotation().select("seq", "cents")


@query(_SC + "SELECT seq, ann_degree_sum FROM ann WHERE ann_degree_sum > 100")
def filter_above_threshold(spark, sf_dir):
    return _frame(spark, sf_dir).where_annotation(F.col("ann_degree_sum") > 100).df.select("seq", F.col("ann_degree_sum").cast("bigint").alias("ann_degree_sum"))


@query(_SC + "SELECT event_type, count(*) AS n, CAST(sum(ann_degree) AS BIGINT) AS total FROM ann GROUP BY event_type")
def values_from_annotation(spark, sf_dir):
    plain = _frame(spark, sf_dir).values_from_annotation("event_type", "ann_degree")
    return plain.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("ann_degree").cast("bigint").alias("total"))


_HALVES = _DOUBLE + ", h AS (SELECT key, seq, split_part(var, '_', 1) AS c, split_part(var, '_', 2) AS ots, e FROM qann), s AS (SELECT a.key, a.seq, a.c, a.ots, a.e - coalesce(b.e, 0) AS e FROM h a LEFT JOIN h b ON a.key = b.key AND a.seq = b.seq AND a.ots = b.ots AND a.c <> b.c), k AS (SELECT key, seq, CAST(sum(e) AS BIGINT) AS d, string_agg('<' || c || '_' || ots || '>^' || CAST(e AS BIGINT), '' ORDER BY c || '_' || ots) AS t, max(CASE WHEN c = 'SCB' THEN e END) AS mx, min(CASE WHEN c = 'SCB' THEN e END) AS mn FROM s WHERE e > 0 GROUP BY ALL) "


@query(_HALVES + "SELECT ann.seq, coalesce(d, 0) AS ann_degree, '1' || coalesce(t, '') AS ann_text FROM ann LEFT JOIN k USING (key, seq)")
def simplify_annotation(spark, sf_dir):
    out = _frame(spark, sf_dir, [SCA, SCB]).simplified("SCA", "SCB").df
    return out.select("seq", F.col("ann_degree").cast("bigint").alias("ann_degree"), Q.annotation_text().alias("ann_text"))


@query(_DOUBLE + ", m AS (SELECT key, seq, max(CASE WHEN starts_with(var, 'SCB_') THEN e END) AS m FROM qann GROUP BY ALL) SELECT ann.seq, CASE WHEN coalesce(m, 0) > cents THEN CAST(trunc(cents + coalesce(m, 0) / 2.0) AS BIGINT) ELSE CAST(cents + coalesce(m, 0) AS BIGINT) END AS added, CASE WHEN coalesce(m, 0) > cents THEN cents - coalesce(m, 0) / 2.0 ELSE CAST(cents - coalesce(m, 0) AS DOUBLE) END AS subtracted FROM ann LEFT JOIN m USING (key, seq)")
def repair_from_annotation(spark, sf_dir):
    df = _frame(spark, sf_dir, [SCA, SCB]).df
    c = F.col("cents")
    return df.select("seq", from_annotation(c, "SCB").cast("bigint").alias("added"), from_annotation(c, "SCB", "subtract").cast("double").alias("subtracted"))


@query(_DOUBLE + ", m AS (SELECT key, seq, ws, bool_or(starts_with(var, 'SCB_')) AS b FROM qann GROUP BY ALL), z AS (SELECT key, seq, ws, coalesce(b, false) AS b FROM m) SELECT key, count(*) AS n_monomials, CAST(count_if(NOT b) AS INTEGER) AS without_scb FROM z GROUP BY key")
def pattern_quantifier(spark, sf_dir):
    summed = _frame(spark, sf_dir, [SCA, SCB]).group("key").agg(polynomial=True).df.where(F.size("ann_poly") > 0)
    return summed.select("key", F.size("ann_poly").cast("bigint").alias("n_monomials"), algebra.quantify_without(F.col("ann_poly"), ["SCB"]).alias("without_scb"))


# constraints and annotation


@query(_SC + f"SELECT {_OUT} FROM ann")
def annotate_speed(spark, sf_dir):
    return _shown(_frame(spark, sf_dir).df)


@query(_ALL + f"SELECT ws AS win_start, {_OUT} FROM ann")
def annotate_speed_all_windows(spark, sf_dir):
    return _shown(_frame(spark, sf_dir, emit="all").df, "win_start")


@query(_SC + f"SELECT ws AS win_start, we AS win_end, {_OUT} FROM ann")
def annotate_speed_keep_window(spark, sf_dir):
    return _shown(_frame(spark, sf_dir, keep_window=True).df, "win_start", "win_end")


@query(f"WITH {EV}, {_every(30 * HOUR, 12 * HOUR)}, {_first(30 * HOUR, 12 * HOUR)}, wf AS (SELECT * FROM w), {_annotated([_pairs(_band(), 'SC', 'wa', 'wa', 'o.ws = r.ws AND o.we = r.we')], 'wa')} SELECT ws AS win_start, {_OUT} FROM ann")
def annotate_speed_unaligned_grid(spark, sf_dir):
    return _shown(A.annotate(events(spark, sf_dir), SC, 30 * HOUR, 12 * HOUR, emit="all"), "win_start")


@query(f"WITH {EV}, {_first(SIZE, SLIDE)}, {_annotated([_pairs('(CASE WHEN o.v + 1e-6::DOUBLE * (r.ts - o.ts) < r.v THEN r.v - (o.v + 1e-6::DOUBLE * (r.ts - o.ts)) ELSE 0 END)', 'SC')])} SELECT {_OUT} FROM ann")
def annotate_speed_upper_only(spark, sf_dir):
    return _shown(_frame(spark, sf_dir, SpeedConstraint("v", LOW, HIGH, upper_only=True)).df)


_XY = EV.replace("event_type FROM", "event_type, CAST(event_id % 97 AS DOUBLE) AS y FROM")


@query(f"WITH {_XY}, {_first(SIZE, SLIDE)}, {_annotated([_pairs(f'({_band()} + {_band('y')})', 'SC')])} SELECT {_OUT} FROM ann")
def annotate_plane(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("y", (F.col("seq") % 97).cast("double"))
    return _shown(A.annotate(df, PlaneSpeedConstraint("v", "y", LOW, HIGH), SIZE, SLIDE))


@query(f"WITH {_XY}, {_first(SIZE, SLIDE)}, {_annotated([_pairs(_band(), 'SCX'), _pairs(_band('y'), 'SCY')])} SELECT {_OUT} FROM ann")
def annotate_each_axis(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("y", (F.col("seq") % 97).cast("double"))
    return _shown(A.annotate(df, [SpeedConstraint("v", LOW, HIGH, "SCX"), SpeedConstraint("y", LOW, HIGH, "SCY")], SIZE, SLIDE))


@query(f"WITH {EV}, {_first(SIZE, SLIDE)}, {_annotated([_pairs(_band(low=LOW / 4.0, high=HIGH / 4.0), 'SC')])} SELECT {_OUT} FROM ann")
def annotate_strict(spark, sf_dir):
    return _shown(_frame(spark, sf_dir, SpeedConstraint("v", LOW, HIGH, strictness=4.0)).df)


@query(f"WITH {EV}, {_first(SIZE, SLIDE)}, {_annotated([_pairs(_PK, 'PK')])} SELECT {_OUT} FROM ann")
def annotate_primary_key(spark, sf_dir):
    return _shown(_frame(spark, sf_dir, PK).df)


@query(f"WITH {EV} SELECT seq, CASE WHEN v > 150 THEN 1 ELSE 0 END AS ann_degree, CASE WHEN v > 150 THEN '1<SCH_' || ts || '>^1' ELSE '1' END AS ann_text FROM ev")
def annotate_domain(spark, sf_dir):
    return A.annotate_domain(events(spark, sf_dir), SCH).select("seq", F.col("ann_degree").cast("int").alias("ann_degree"), Q.annotation_text().alias("ann_text"))


_MULTI = f"WITH {EV}, {_first(SIZE, SLIDE)}, {_annotated([_pairs(_band(), 'SC'), _pairs(_PK, 'PK')], marks=_MARK)} "


@query(_MULTI + f"SELECT {_OUT} FROM ann")
def annotate_multi(spark, sf_dir):
    return _shown(_frame(spark, sf_dir, [SC, PK, SCH]).df)


_ONE = EV.replace("user_id AS key", "'all' AS key")


@query(f"WITH {_ONE}, {_first(2 * HOUR, HOUR)}, {_annotated([_pairs(_band(), 'SC'), _pairs(_PK, 'PK')])} SELECT user_id AS key, {_OUT} FROM ann")
def annotate_values_one_key(spark, sf_dir):
    rows = events(spark, sf_dir).select("key", "ts", "seq", "v", "event_type")  # what is taken along is shuffled
    return _shown(A.annotate_values(rows, [SC, PK], 2 * HOUR, HOUR, mode="blocks"), "key")


@query(_DOUBLE + f"SELECT {_OUT} FROM ann")
def annotate_double(spark, sf_dir):
    return _shown(_frame(spark, sf_dir, [SCA, SCB]).df)


@query(_DOUBLE + "SELECT seq FROM ann WHERE ann_degree <= 0")
def consistent_under_both(spark, sf_dir):
    return A.consistent_only(events(spark, sf_dir), [SCA, SCB], SIZE, SLIDE).select("seq")


@query(_SC + "SELECT seq, event_type, cents FROM ann WHERE ann_degree <= 0")
def validation_filter(spark, sf_dir):
    return Q.validated(events(spark, sf_dir), SC, SIZE, SLIDE).select("seq", "event_type", "cents")


@query(f"WITH {EV}, chosen AS (SELECT * FROM ev WHERE seq % 10 < 3), {_first(SIZE, SLIDE, 'chosen')}, {_annotated([_pairs(_band(), 'SC', origins='chosen')])} SELECT {_OUT} FROM ann UNION ALL SELECT seq, 0, 0, 0, '1' FROM ev WHERE seq % 10 >= 3")
def annotate_sampled(spark, sf_dir):
    return _shown(A.annotate_some(events(spark, sf_dir), SC, SIZE, SLIDE, chosen=F.col("seq") % 10 < 3))


@query(f"WITH {EV} SELECT seq, CAST(0 AS BIGINT) AS ann_degree, CAST(0 AS BIGINT) AS ann_degree_sum, 0 AS ann_n_incons, '1' AS ann_text FROM ev")
def annotate_dummy(spark, sf_dir):
    return _shown(A.unannotated(events(spark, sf_dir)))


@query(f"WITH {EV}, w AS (SELECT *, ts - {6 * HOUR} AS ws FROM ev), {_annotated([_pairs(_band(), 'SC')])} SELECT {_OUT} FROM ann")
def annotate_by_self_join(spark, sf_dir):
    return _shown(A.annotate_by_self_join(events(spark, sf_dir), SC, 6 * HOUR))


@query(f"WITH {EV}, {_first(SIZE, SLIDE)}, {_annotated([_pairs(_PK, 'PK')])} SELECT {_OUT} FROM ann")
def annotate_key_chain(spark, sf_dir):
    return _shown(_frame(spark, sf_dir, PK, mode="paths").df)


@query(_SC + f"SELECT seq, CAST(count_if(ann_degree > 0) AS INTEGER) AS inconsistent, CAST(max(CASE WHEN g.n IS NULL THEN 0 ELSE g.n END) AS INTEGER) AS n_origins FROM ann LEFT JOIN (SELECT key, seq, count(*) AS n FROM qann GROUP BY ALL) g USING (key, seq) GROUP BY seq")
def annotate_paths_origins(spark, sf_dir):
    """Paths meet the origins that pairs meet; only how often may differ."""
    return _frame(spark, sf_dir, mode="paths").df.select("seq", F.col("ann_n_incons").alias("inconsistent"), algebra.cardinality(F.col("ann_vars")).alias("n_origins"))


@query(f"WITH {_XY}, {_first(SIZE, SLIDE)}, {_annotated([_pairs(_band('y'), 'SC')])} SELECT {_OUT} FROM ann")
def annotate_pair_values(spark, sf_dir):
    """A constraint on one value of a pair."""
    df = events(spark, sf_dir).withColumn("pair", F.struct("v", (F.col("seq") % 97).cast("double").alias("second")))
    return _shown(A.annotate(df, SpeedConstraint("pair.second", LOW, HIGH), SIZE, SLIDE, mode="blocks"))


@query(_SC + f", k AS (SELECT q.key, q.seq, CAST(sum(q.e) AS BIGINT) AS d FROM qann q JOIN w USING (key, seq) WHERE CAST(split_part(q.var, '_', 2) AS BIGINT) >= w.ws + {24 * HOUR} AND CAST(split_part(q.var, '_', 2) AS BIGINT) < w.we GROUP BY ALL) SELECT event_type, CAST(sum(coalesce(d, 0)) AS BIGINT) AS slid, CAST(sum(ann_degree) AS BIGINT) AS total FROM ann LEFT JOIN k USING (key, seq) GROUP BY event_type")
def reduce_and_slide(spark, sf_dir):
    """Annotations of a window cut to the part that a later window shares with it, then summed."""
    frame = _frame(spark, sf_dir, keep_window=True)
    kept = frame.transform_annotation(algebra.slide(F.col("ann_vars"), F.col("win_start") + 24 * HOUR, F.col("win_end")))
    slid = kept.df.select("event_type", F.col("ann_degree").alias("slid"), F.lit(0).cast("bigint").alias("total"))
    both = slid.unionByName(frame.df.select("event_type", F.lit(0).cast("bigint").alias("slid"), F.col("ann_degree").alias("total")))
    return both.groupBy("event_type").agg(F.sum("slid").alias("slid"), F.sum("total").alias("total"))


@query(None)
def annotate_paths(spark, sf_dir):
    return _shown(_frame(spark, sf_dir, [SC, PK], mode="paths").df)


# joins


@query(_SC + f"SELECT l.seq AS left_seq, r.seq AS right_seq, greatest(l.ts, r.ts) AS ts, l.ann_degree_sum + r.ann_degree_sum AS ann_degree_sum FROM ann l JOIN ann r ON l.key = r.key AND r.ts BETWEEN l.ts - {3 * HOUR} AND l.ts + {HOUR} AND l.event_type <> r.event_type")
def join_interval(spark, sf_dir):
    f = _frame(spark, sf_dir)
    out = f.join(f, 3 * HOUR, HOUR, on=F.col("l.event_type") != F.col("r.event_type")).df
    return out.select(F.col("left.seq").alias("left_seq"), F.col("right.seq").alias("right_seq"), "ts", F.col("ann_degree_sum").cast("bigint").alias("ann_degree_sum"))


@query(_SC + f"SELECT l.seq AS left_seq, coalesce(r.seq, -1) AS right_seq, l.ann_degree_sum + coalesce(r.ann_degree_sum, 0) AS ann_degree_sum FROM ann l LEFT JOIN (SELECT * FROM ann WHERE event_type = 'purchase') r ON l.key = r.key AND r.ts BETWEEN l.ts - {3 * HOUR} AND l.ts")
def join_left_interval(spark, sf_dir):
    f = _frame(spark, sf_dir)
    out = f.left_join(f.where("event_type = 'purchase'"), 3 * HOUR).df
    return out.select(F.col("left.seq").alias("left_seq"), F.coalesce("right.seq", F.lit(-1)).alias("right_seq"), F.col("ann_degree_sum").cast("bigint").alias("ann_degree_sum"))


# groups, windows, aggregates

_HOP = "unnest(range(CASE WHEN ts < {size} THEN 0 ELSE (ts - {size}) // {slide} + 1 END, ts // {slide} + 1)) * {slide}"


def _hops(rel: str, size: int, slide: int, out: str = "h") -> str:
    return f"{out} AS (SELECT *, {_HOP.format(size=size, slide=slide)} AS win_start FROM {rel})"


_AGG = "CAST(sum(cents) AS BIGINT) AS cents, max(ts) AS ts, CAST(max(ann_degree) AS BIGINT) AS ann_degree, CAST(sum(ann_degree_sum) AS BIGINT) AS ann_degree_sum, CAST(sum(ann_n_incons) AS BIGINT) AS ann_n_incons"


def _summed(frame: AnnotatedFrame, *by: str) -> DataFrame:
    return frame.df.select(*by, "cents", "ts", F.col("ann_degree").cast("bigint").alias("ann_degree"), "ann_degree_sum", "ann_n_incons")


@query(_SC + f", {_hops('ann', 24 * HOUR, 6 * HOUR)} SELECT key, win_start, {_AGG} FROM h GROUP BY key, win_start")
def window_hopping(spark, sf_dir):
    return _summed(_frame(spark, sf_dir).group_and_window("key", size=24 * HOUR, slide=6 * HOUR).agg(F.sum("cents").alias("cents")), "key", "win_start")


@query(_SC + f", h AS (SELECT *, ts // {24 * HOUR} * {24 * HOUR} AS win_start FROM ann) SELECT event_type, win_start, {_AGG} FROM h GROUP BY event_type, win_start")
def window_tumbling(spark, sf_dir):
    return _summed(_frame(spark, sf_dir).group_and_window("event_type", size=24 * HOUR).reduce(F.sum("cents").alias("cents")), "event_type", "win_start")


@query(_SC + f", h AS (SELECT *, greatest(ts - {24 * HOUR} + {6 * HOUR}, 0) // {6 * HOUR} * {6 * HOUR} AS win_start FROM ann) SELECT key, win_start, {_AGG} FROM h GROUP BY key, win_start")
def window_first(spark, sf_dir):
    return _summed(_frame(spark, sf_dir).group_first_window("key", size=24 * HOUR, slide=6 * HOUR).agg(F.sum("cents").alias("cents")), "key", "win_start")


@query(_ALL + f", s AS (SELECT * REPLACE (we - 1 AS ts) FROM ann), {_hops('s', 24 * HOUR, 12 * HOUR)} SELECT key, win_start, {_AGG} FROM h GROUP BY key, win_start")
def window_restamped(spark, sf_dir):
    return _summed(_frame(spark, sf_dir, emit="all").group_and_window("key", size=24 * HOUR, slide=12 * HOUR, restamp=True).agg(F.sum("cents").alias("cents")), "key", "win_start")


@query(f"WITH {EV}, {_hops('ev', 24 * HOUR, 6 * HOUR)} SELECT key, win_start, CAST(sum(cents) AS BIGINT) AS cents, max(ts) AS ts FROM h GROUP BY key, win_start")
def window_without_annotation(spark, sf_dir):
    return hop(events(spark, sf_dir), 24 * HOUR, 6 * HOUR).groupBy("key", "win_start").agg(F.sum("cents").alias("cents"), F.max("ts").alias("ts"))


@query(_SC + f"SELECT event_type, {_AGG} FROM ann GROUP BY event_type")
def reduce_without_window(spark, sf_dir):
    return _summed(_frame(spark, sf_dir).group("event_type").reduce(F.sum("cents").alias("cents")), "event_type")


@query(_SC + "SELECT count(*) AS n_events, CAST(sum(ann_n_incons) AS BIGINT) AS n_inconsistencies, round(avg(ann_n_incons), 9) AS avg_inconsistencies FROM ann")
def inconsistency_counts(spark, sf_dir):
    return _frame(spark, sf_dir).counts().withColumn("avg_inconsistencies", F.round("avg_inconsistencies", 9))


@query(f"WITH {EV} SELECT seq, CAST(sum(cents) OVER (PARTITION BY key ORDER BY ts, seq) AS BIGINT) AS running_sum FROM ev")
def running_sum(spark, sf_dir):
    return Q.running_sum(events(spark, sf_dir), "cents").select("seq", "running_sum")


@query(f"WITH {EV} SELECT seq, max(cents) OVER (PARTITION BY key ORDER BY ts, seq) AS max_cents, max(ts) OVER (PARTITION BY key ORDER BY ts, seq) AS max_ts FROM ev")
def running_max(spark, sf_dir):
    return Q.running_max(events(spark, sf_dir), "cents", "ts").select("seq", "max_cents", "max_ts")


# top-k

_DESC = "row_number() OVER (PARTITION BY win_start ORDER BY ann_degree_sum DESC, key)"


@query(_SC + f", {_hops('ann', 24 * HOUR, 12 * HOUR)}, g AS (SELECT key, win_start, {_AGG} FROM h GROUP BY key, win_start), t AS (SELECT *, {_DESC} AS rank FROM g) SELECT * FROM t WHERE rank <= 3")
def top_k_per_window(spark, sf_dir):
    g = _frame(spark, sf_dir).group_and_window("key", size=24 * HOUR, slide=12 * HOUR).agg(F.sum("cents").alias("cents"))
    return _summed(AnnotatedFrame(g.top(3).withColumn("seq", F.lit(0))), "key", "win_start", "rank")


@query(_SC + f", t AS (SELECT *, row_number() OVER (PARTITION BY win_start ORDER BY ann_degree_sum, seq) AS rank FROM (SELECT *, greatest(ts - {24 * HOUR} + {12 * HOUR}, 0) // {12 * HOUR} * {12 * HOUR} AS win_start FROM ann)) SELECT seq, win_start, rank, ann_degree_sum FROM t WHERE rank <= 3")
def top_k_ascending_first_window(spark, sf_dir):
    out = _frame(spark, sf_dir).top_first_window(3, 24 * HOUR, 12 * HOUR, descending=False, ties=("seq",))
    return out.select("seq", "win_start", "rank", F.col("ann_degree_sum").cast("bigint").alias("ann_degree_sum"))


@query(f"WITH {EV}, t AS (SELECT *, row_number() OVER (PARTITION BY win_start ORDER BY seq) AS rank FROM (SELECT *, ts // {12 * HOUR} * {12 * HOUR} AS win_start FROM ev)) SELECT seq, win_start, rank FROM t WHERE rank <= 3")
def top_k_without_annotation(spark, sf_dir):
    plain = AnnotatedFrame.plain(events(spark, sf_dir).withColumn("win_start", containing_start(F.col("ts"), 12 * HOUR, 12 * HOUR)))
    return plain.top(3, order=[F.asc("seq")], ties=()).select("seq", "win_start", "rank")


# series


@query(f"WITH {EV}, m AS (SELECT key, median(v) AS m FROM ev GROUP BY key) SELECT key, round(1.4826 * median(abs(v - m)), 6) AS mad FROM ev JOIN m USING (key) GROUP BY key")
def series_mad(spark, sf_dir):
    return series.mad(events(spark, sf_dir), "v", ["key"]).withColumn("mad", F.round("mad", 6))


@query(f"WITH {EV} SELECT seq, coalesce(lead(cents) OVER w - cents, 0) AS variation, round((lead(cents) OVER w - cents) * 1000.0 / (lead(ts) OVER w - ts), 6) AS speed FROM ev WINDOW w AS (PARTITION BY key ORDER BY ts, seq)")
def series_speed_and_variation(spark, sf_dir):
    df = events(spark, sf_dir)
    order = ["ts", "seq"]
    return df.select("seq", F.coalesce(series.variation("cents", ["key"], order), F.lit(0)).alias("variation"), F.round(series.speed("cents", "ts", ["key"], order) * 1000.0, 6).alias("speed"))


@query("SELECT CAST(event_id AS BIGINT) AS seq, CAST((event_id % 50) * 3600000 + (event_id % 60) * 60000 AS BIGINT) AS ms FROM events")
def series_durations(spark, sf_dir):
    text = F.concat((F.col("seq") % 50).cast("string"), F.lit("h"), (F.col("seq") % 60).cast("string"), F.lit("m"))
    return events(spark, sf_dir).select("seq", series.parse_duration_column(text).alias("ms"))


# applications

TICK = 600_000
_TICKS = EV.replace("user_id AS key, epoch_us(ts) // 1000 AS ts", f"event_type AS key, epoch_us(ts) // 1000 // {TICK} * {TICK} AS ts")


def _ticks(spark, sf_dir):
    return events(spark, sf_dir, "event_type").withColumn("ts", (F.col("ts") - F.col("ts") % TICK)).withColumnRenamed("event_type", "name")


_TICK_ANN = f"WITH {_TICKS}, {_first(2 * HOUR, HOUR)}, {_annotated([_pairs(_band(), 'SC')])} "
_COMBO = ", c AS (SELECT l.seq AS left_seq, r.seq AS right_seq, l.event_type AS n1, r.event_type AS n2, l.cents AS x, r.cents AS y, l.ts, l.ann_degree_sum + r.ann_degree_sum AS ann_degree_sum, greatest(l.ann_n_incons, r.ann_n_incons) AS ann_n_incons FROM ann l JOIN ann r ON l.ts = r.ts AND l.event_type <> r.event_type) "


@query(_TICK_ANN + _COMBO + "SELECT left_seq, right_seq, ts, ann_degree_sum FROM c")
def q1_stock_combo(spark, sf_dir):
    ticks = _ticks(spark, sf_dir).select("key", "ts", "seq", "v", "name")
    out = Q.stock_combo(ticks, SC, 2 * HOUR, HOUR, rows_along=True, **DEGREES).df
    return out.select(F.col("left.seq").alias("left_seq"), F.col("right.seq").alias("right_seq"), "ts", F.col("ann_degree_sum").cast("bigint").alias("ann_degree_sum"))


@query(f"WITH {_TICKS} SELECT l.seq AS left_seq, r.seq AS right_seq, l.ts FROM ev l JOIN ev r ON l.ts = r.ts AND l.event_type <> r.event_type")
def q1_stock_combo_unannotated(spark, sf_dir):
    return Q.stock_combo(_ticks(spark, sf_dir), None, 2 * HOUR, HOUR).df.select(F.col("left.seq").alias("left_seq"), F.col("right.seq").alias("right_seq"), "ts")


_SUMS = "CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(y) AS BIGINT) AS sum_y, CAST(sum(x * y) AS BIGINT) AS sum_xy, CAST(sum(x * x) AS BIGINT) AS sum_x2, CAST(sum(y * y) AS BIGINT) AS sum_y2, count(*) AS n_couples"


@query(_TICK_ANN + _COMBO + f", {_hops('c', 24 * HOUR, 6 * HOUR)}, g AS (SELECT n1 || '|' || n2 AS key, win_start, {_SUMS}, CAST(sum(ann_degree_sum) AS BIGINT) AS ann_degree_sum FROM h GROUP BY ALL), t AS (SELECT *, {_DESC} AS rank FROM g) SELECT * FROM t WHERE rank <= 3")
def q2_stock_pearson(spark, sf_dir):
    out = Q.stock_pearson(_ticks(spark, sf_dir), SC, 2 * HOUR, HOUR, 24 * HOUR, 6 * HOUR, value="cents")
    return out.select("key", "win_start", "sum_x", "sum_y", "sum_xy", "sum_x2", "sum_y2", "n_couples", "ann_degree_sum", "rank")


_XYP = _XY.replace("user_id AS key", "'key' AS key")
_TOP = "t AS (SELECT *, row_number() OVER (PARTITION BY win_start ORDER BY ann_degree_sum DESC, ts, seq) AS rank FROM (SELECT *, greatest(ts - {size} + {slide}, 0) // {slide} * {slide} AS win_start FROM ann)) SELECT seq, win_start, rank, ann_degree_sum FROM t WHERE rank <= 3"


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("seq", "win_start", "rank", F.col("ann_degree_sum").cast("bigint").alias("ann_degree_sum"))


@query(f"WITH {_XYP}, {_first(2 * HOUR, HOUR)}, {_annotated([_pairs(f'({_band()} + {_band('y')})', 'SC')])}, {_TOP.format(size=2 * HOUR, slide=HOUR)}")
def q3_gps_top_k(spark, sf_dir):
    df = events(spark, sf_dir).withColumns({"y": (F.col("seq") % 97).cast("double"), "key": F.lit("key")})
    return _ranked(Q.ranked(df, PlaneSpeedConstraint("v", "y", LOW, HIGH), 2 * HOUR, HOUR, **DEGREES))


_TITLES = EV.replace("user_id AS key", "event_type AS key")
_UK = "(CASE WHEN o.user_id = r.user_id THEN -1 ELSE 0 END)"


@query(f"WITH {_TITLES}, {_first(12 * HOUR, 6 * HOUR)}, {_annotated([_pairs(_band(), 'SC'), _pairs(_UK, 'PK')])}, {_TOP.format(size=12 * HOUR, slide=6 * HOUR)}")
def q4_review_top_k(spark, sf_dir):
    return _ranked(Q.ranked(events(spark, sf_dir, "event_type"), [SC, PrimaryKey(("user_id",))], 12 * HOUR, 6 * HOUR, **DEGREES))


_SEG = EV.replace("event_type FROM", "event_type, event_id % 50 AS segment FROM")


@query(f"WITH {_SEG}, {_first(SIZE, SLIDE)}, {_annotated([_pairs(_band(), 'SC')])} SELECT l.seq AS left_seq, r.seq AS right_seq, l.ann_degree_sum + r.ann_degree_sum AS ann_degree_sum FROM ann l JOIN ann r ON l.segment = r.segment AND l.event_type = r.event_type AND r.ts BETWEEN l.ts - {12 * HOUR} AND l.ts WHERE l.ann_degree_sum + r.ann_degree_sum > 1")
def q5_linear_road(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("segment", F.col("seq") % 50)
    out = Q.co_travel(df, SC, SIZE, SLIDE, "segment", "event_type", 12 * HOUR, least=1).df
    return out.select(F.col("left.seq").alias("left_seq"), F.col("right.seq").alias("right_seq"), F.col("ann_degree_sum").cast("bigint").alias("ann_degree_sum"))


def _grid_sql(a: list[int], b: list[int]) -> str:
    rows = ", ".join(f"({t}, {x}, {y})" for t, (x, y) in enumerate(zip(a, b, strict=True), 1))
    return f"WITH ev(ts, a, b) AS (VALUES {rows}), {_hops('ev', 5, 2)} SELECT CAST(win_start AS BIGINT) AS win_start, CAST(max(ts) AS BIGINT) AS ts, CAST('1.2' AS DOUBLE) * sum(a) + CAST('1.5' AS DOUBLE) * sum(b) AS value FROM h GROUP BY win_start"


@query(_grid_sql(G.GRID_A, G.GRID_B))
def q6_grid_pure(spark, sf_dir):
    return Q.grid_cost(G.grid(spark), "pure")


def _grid_annotated(a: list[int], b: list[int], variant: str) -> str:
    rows = ", ".join(f"(1, {t}, {t}, {x}, {y})" for t, (x, y) in enumerate(zip(a, b, strict=True), 1))
    on = "o.ws = r.ws AND o.we = r.we"
    pairs = [_pairs(_band(c, -2.0, 2.0), n, "w", "wa", on) for c, n in (("cons_a", "SCA"), ("cons_b", "SCB"))]
    base = f"WITH ev(key, seq, ts, cons_a, cons_b) AS (VALUES {rows}), {_first(5, 2)}, {_every(5, 2)}, {_annotated(pairs)}"
    largest = lambda c: f"coalesce((SELECT max(e) FROM {'x' if variant == 'simplified' else 'qann'} q WHERE q.seq = ann.seq AND starts_with(q.var, '{c}_')), 0)"
    if variant == "simplified":
        halves = "hv AS (SELECT seq, split_part(var, '_', 1) AS c, split_part(var, '_', 2) AS ots, e FROM qann), x AS (SELECT a.seq, a.c || '_' || a.ots AS var, a.e - coalesce(b.e, 0) AS e FROM hv a LEFT JOIN hv b ON a.seq = b.seq AND a.ots = b.ots AND a.c <> b.c WHERE a.e > coalesce(b.e, 0))"
        base += f", {halves}"
    if variant == "consistent":
        base += ", f AS (SELECT ts, cons_a AS a, cons_b AS b FROM ann WHERE ann_degree = 0)"
    else:
        fixed = lambda c, n: f"CASE WHEN {largest(n)} > {c} THEN CAST(trunc({c} + {largest(n)} / 2.0) AS BIGINT) ELSE CAST({c} + {largest(n)} AS BIGINT) END"
        base += f", f AS (SELECT ts, {fixed('cons_a', 'SCA')} AS a, {fixed('cons_b', 'SCB')} AS b FROM ann)"
    return base + f", {_hops('f', 5, 2)} SELECT CAST(win_start AS BIGINT) AS win_start, CAST(max(ts) AS BIGINT) AS ts, CAST('1.2' AS DOUBLE) * sum(a) + CAST('1.5' AS DOUBLE) * sum(b) AS value FROM h GROUP BY win_start"


def q6(variant: str, spark, sf_dir):
    return Q.grid_cost(G.grid(spark), variant)


for _v in ("consistent", "repaired", "simplified"):
    FOUND[f"q6_grid_{_v}"] = (partial(q6, _v), _grid_annotated(G.GRID_A, G.GRID_B, _v))


def _q7(names: tuple[str, ...], spark, sf_dir):
    made = {"SC": SC, "PK": PK, "SCH": SCH}
    out = Q.window_sums(events(spark, sf_dir), [made[n] for n in names], SIZE, SLIDE, 24 * HOUR, 6 * HOUR, "cents")
    return out.select("key", "win_start", F.col("sum_cents").alias("cents"), "ts", F.col("ann_degree").cast("bigint").alias("ann_degree"), "ann_degree_sum", "ann_n_incons")


for _names in (("SC",), ("PK",), ("SCH",), ("SC", "PK"), ("SC", "SCH"), ("PK", "SCH"), ("SC", "PK", "SCH")):
    _parts = [_pairs(_band(), "SC")] * ("SC" in _names) + [_pairs(_PK, "PK")] * ("PK" in _names)
    _sql = f"WITH {EV}, {_first(SIZE, SLIDE)}, {_annotated(_parts, marks=_MARK if 'SCH' in _names else '')}, {_hops('ann', 24 * HOUR, 6 * HOUR)} SELECT key, win_start, {_AGG} FROM h GROUP BY key, win_start"
    FOUND["q7_ablation_" + "_".join(_names).lower()] = (partial(_q7, _names), _sql)


@query(_DOUBLE + "SELECT seq, CAST(sum(cents) OVER (PARTITION BY key ORDER BY ts, seq) AS BIGINT) AS running_sum FROM ann WHERE ann_degree = 0")
def q8_stock_qualitative(spark, sf_dir):
    kept = Q.qualitative(events(spark, sf_dir), [SCA, SCB], SIZE, SLIDE, "consistent", {})
    return Q.running_sum(kept, "cents").select("seq", "running_sum")


@query(f"WITH {_XY}, {_first(SIZE, SLIDE)}, {_annotated([_pairs(_band(), 'SCX'), _pairs(_band('y'), 'SCY')])} SELECT seq, max(cents) OVER (PARTITION BY key ORDER BY ts, seq) AS max_cents FROM ann WHERE ann_degree = 0")
def q9_gps_qualitative(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("y", (F.col("seq") % 97).cast("double"))
    kept = Q.qualitative(df, [SpeedConstraint("v", LOW, HIGH, "SCX"), SpeedConstraint("y", LOW, HIGH, "SCY")], SIZE, SLIDE, "consistent", {})
    return Q.running_max(kept, "cents").select("seq", "max_cents")


def _subtracted(prefix: str, rel: str) -> str:
    """SQL of cents corrected by the largest exponent of a prefix."""
    m = f"m AS (SELECT key, seq, max(CASE WHEN starts_with(var, '{prefix}_') THEN e END) AS m FROM {rel} GROUP BY ALL), f AS (SELECT ann.*, CASE WHEN coalesce(m, 0) > cents THEN cents - coalesce(m, 0) / 2.0 ELSE CAST(cents - coalesce(m, 0) AS DOUBLE) END AS fixed FROM ann LEFT JOIN m USING (key, seq))"
    return m


_SHORT = _HALVES.rstrip() + ", x AS (SELECT key, seq, c || '_' || ots AS var, e FROM s WHERE e > 0), "
_RUN = "SELECT seq, sum(fixed) OVER (PARTITION BY key ORDER BY ts, seq) AS running_sum FROM f"


def _q8(variant: str, spark, sf_dir):
    kept = Q.qualitative(events(spark, sf_dir), [SCA, SCB], SIZE, SLIDE, variant, {"cents": "SCB"})
    return Q.running_sum(kept.withColumn("cents", F.col("cents").cast("double")), "cents").select("seq", "running_sum")


FOUND["q8_stock_pure"] = (partial(_q8, "pure"), f"WITH {EV} SELECT seq, CAST(sum(cents) OVER (PARTITION BY key ORDER BY ts, seq) AS DOUBLE) AS running_sum FROM ev")
FOUND["q8_stock_repaired"] = (partial(_q8, "repaired"), _DOUBLE + ", " + _subtracted("SCB", "qann") + _RUN)
FOUND["q8_stock_simplified"] = (partial(_q8, "simplified"), _SHORT + _subtracted("SCB", "x") + _RUN)

_AXES = [SpeedConstraint("v", LOW, HIGH, "SCX"), SpeedConstraint("y", LOW, HIGH, "SCY")]


def _q9(variant: str, spark, sf_dir):
    df = events(spark, sf_dir).withColumn("y", (F.col("seq") % 97).cast("double"))
    kept = Q.qualitative(df, _AXES, SIZE, SLIDE, variant, {"cents": "SCX"})
    return Q.running_max(kept.withColumn("cents", F.col("cents").cast("double")), "cents").select("seq", "max_cents")


_PEAK = "SELECT seq, max(fixed) OVER (PARTITION BY key ORDER BY ts, seq) AS max_cents FROM f"
_PLANE = f"WITH {_XY}, {_first(SIZE, SLIDE)}, {_annotated([_pairs(_band(), 'SCX'), _pairs(_band('y'), 'SCY')])}"
FOUND["q9_gps_pure"] = (partial(_q9, "pure"), f"WITH {EV} SELECT seq, CAST(max(cents) OVER (PARTITION BY key ORDER BY ts, seq) AS DOUBLE) AS max_cents FROM ev")
FOUND["q9_gps_repaired"] = (partial(_q9, "repaired"), _PLANE + ", " + _subtracted("SCX", "qann") + _PEAK)
FOUND["q9_gps_simplified"] = (partial(_q9, "simplified"), _PLANE + _SHORT[len(_DOUBLE) :] + _subtracted("SCX", "x") + _PEAK)


@query(_SC + "SELECT count(*) AS n_events, CAST(sum(ann_degree_sum) AS BIGINT) AS degree_sum FROM ann")
def q10_annotation_only(spark, sf_dir):
    return _frame(spark, sf_dir).df.agg(F.count("*").alias("n_events"), F.sum("ann_degree_sum").cast("bigint").alias("degree_sum"))


@query(_SC + "SELECT event_type, count(*) AS n FROM ann WHERE ann_degree <= 0 GROUP BY event_type")
def q11_validation(spark, sf_dir):
    return Q.validated(events(spark, sf_dir), SC, SIZE, SLIDE, mode="blocks").groupBy("event_type").agg(F.count("*").alias("n"))


_E6 = "CAST('1e-06' AS DOUBLE)"
#: The median of what a row's future allows, then a walk along each group that clamps it by the repaired row before.
_SCREEN = (
    f"WITH RECURSIVE {EV}, {_first(SIZE, SLIDE)}, n AS (SELECT *, row_number() OVER (PARTITION BY key, ws ORDER BY ts, seq) AS i FROM w), "
    f"c AS (SELECT key, ws, i, v AS x FROM n UNION ALL SELECT r.key, r.ws, r.i, unnest([o.v + -{_E6} * (r.ts - o.ts), o.v + {_E6} * (r.ts - o.ts)]) FROM n r JOIN n o ON o.key = r.key AND o.ws = r.ws AND o.i > r.i), "
    "m AS (SELECT key, ws, i, median(x) AS x FROM c GROUP BY ALL), b AS (SELECT n.key, n.ws, n.i, seq, ts, n.v, m.x, count(*) OVER (PARTITION BY n.key, n.ws) AS size FROM n JOIN m USING (key, ws, i)), "
    "walk AS (SELECT key, ws, i, seq, ts, CASE WHEN size = 1 THEN v ELSE x END AS v FROM b WHERE i = 1 UNION ALL "
    f"SELECT b.key, b.ws, b.i, b.seq, b.ts, least(greatest(b.x, walk.v + -{_E6} * (b.ts - walk.ts)), walk.v + {_E6} * (b.ts - walk.ts)) FROM walk JOIN b ON b.key = walk.key AND b.ws = walk.ws AND b.i = walk.i + 1) "
    "SELECT key, seq, ts, v FROM walk"
)


@query(_SCREEN)
def q12_repair(spark, sf_dir):
    return Q.repaired(events(spark, sf_dir), "v", SIZE, SLIDE, 1e-6).select("key", "seq", "ts", "v")


@query(f"WITH {EV} SELECT count(*) AS n_events, CAST(sum(cents) AS BIGINT) AS cents FROM ev")
def q13_consumption(spark, sf_dir):
    return events(spark, sf_dir).agg(F.count("*").alias("n_events"), F.sum("cents").alias("cents"))


@query(f"WITH {EV}, chosen AS (SELECT * FROM ev WHERE seq % 10 < 5), {_first(SIZE, SLIDE, 'chosen')}, {_annotated([_pairs(_band(), 'SC', origins='chosen')], out='chosen_ann')}, ann AS (SELECT seq, ts, ann_degree_sum FROM chosen_ann UNION ALL SELECT seq, ts, 0 FROM ev WHERE seq % 10 >= 5), {_TOP.format(size=24 * HOUR, slide=12 * HOUR)}")
def q14_partial_constraints(spark, sf_dir):
    frame = AnnotatedFrame(A.annotate_some(events(spark, sf_dir), SC, SIZE, SLIDE, chosen=F.col("seq") % 10 < 5))
    return _ranked(frame.top_first_window(3, 24 * HOUR, 12 * HOUR, ties=("ts", "seq")))


def _chosen_ann(rel: str, size: int, slide: int) -> str:
    """SQL of annotate_some() on half of a relation."""
    return f"chosen AS (SELECT * FROM {rel} WHERE seq % 10 < 5), {_first(size, slide, 'chosen')}, {_annotated([_pairs(_band(), 'SC', origins='chosen')], out='chosen_ann')}, ann AS (SELECT key, seq, ts, cents, user_id, event_type, ann_degree_sum, ann_n_incons FROM chosen_ann UNION ALL SELECT key, seq, ts, cents, user_id, event_type, 0, 0 FROM {rel} WHERE seq % 10 >= 5)"


def _half() -> dict:
    return {"chosen": F.col("seq") % 10 < 5, **DEGREES}


@query(f"WITH {_TICKS}, {_chosen_ann('ev', 2 * HOUR, HOUR)}" + _COMBO + "SELECT left_seq, right_seq, ts, ann_degree_sum FROM c")
def q14_partial_stock_combo(spark, sf_dir):
    some = AnnotatedFrame(A.annotate_some(_ticks(spark, sf_dir), SC, 2 * HOUR, HOUR, **_half()))
    return Q.pairs_at_same_time(some, "name").df.select(F.col("left.seq").alias("left_seq"), F.col("right.seq").alias("right_seq"), "ts", "ann_degree_sum")


@query(f"WITH {_TICKS}, {_chosen_ann('ev', 2 * HOUR, HOUR)}" + _COMBO + f", {_hops('c', 24 * HOUR, 6 * HOUR)}, g AS (SELECT n1 || '|' || n2 AS key, win_start, {_SUMS}, CAST(sum(ann_degree_sum) AS BIGINT) AS ann_degree_sum FROM h GROUP BY ALL), t AS (SELECT *, {_DESC} AS rank FROM g) SELECT key, win_start, rank, n_couples, ann_degree_sum, round((CAST(n_couples AS DOUBLE) * sum_xy - CAST(sum_x AS DOUBLE) * sum_y) / sqrt((CAST(n_couples AS DOUBLE) * sum_x2 - CAST(sum_x AS DOUBLE) * sum_x) * (CAST(n_couples AS DOUBLE) * sum_y2 - CAST(sum_y AS DOUBLE) * sum_y)), 6) AS correlation FROM t WHERE rank <= 3")
def q14_partial_stock_pearson(spark, sf_dir):
    some = AnnotatedFrame(A.annotate_some(_ticks(spark, sf_dir), SC, 2 * HOUR, HOUR, **_half()))
    out = Q.pearson_top(some, 24 * HOUR, 6 * HOUR, value="cents").withColumn("correlation", F.round(correlation(), 6))
    return out.select("key", "win_start", "rank", "n_couples", "ann_degree_sum", "correlation")


@query(f"WITH {EV}, {_chosen_ann('ev', SIZE, SLIDE)} SELECT l.seq AS left_seq, r.seq AS right_seq, l.ann_degree_sum + r.ann_degree_sum AS ann_degree_sum FROM ann l JOIN ann r ON l.seq % 50 = r.seq % 50 AND l.event_type = r.event_type AND r.ts BETWEEN l.ts - {12 * HOUR} AND l.ts WHERE l.ann_degree_sum + r.ann_degree_sum > 1")
def q14_partial_linear_road(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("segment", F.col("seq") % 50)
    some = AnnotatedFrame(A.annotate_some(df, SC, SIZE, SLIDE, **_half())).with_key("segment")
    pairs = some.join(some, 12 * HOUR, on=F.col("l.event_type") == F.col("r.event_type")).where_annotation(F.col("ann_degree_sum") > 1).df
    return pairs.select(F.col("left.seq").alias("left_seq"), F.col("right.seq").alias("right_seq"), "ann_degree_sum")


# joins and top-k over the order tables

_LI = "li AS (SELECT l_orderkey * 8 + l_linenumber AS seq, l_suppkey AS key, epoch_us(l_shipdate) // 1000 AS ts, l_quantity AS v, CAST(l_quantity AS BIGINT) AS cents, l_orderkey, l_returnflag FROM lineitem)"


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), F.col("l_suppkey").alias("key"), millis("l_shipdate").alias("ts"), F.col("l_quantity").alias("v"), F.col("l_quantity").cast("bigint").alias("cents"), "l_orderkey", "l_returnflag")


@query(f"WITH {_LI} SELECT key, l_returnflag, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents, CAST(count_if(v > 45) AS BIGINT) AS ann_n_incons FROM li GROUP BY key, l_returnflag")
def lineitem_domain_sums(spark, sf_dir):
    frame = AnnotatedFrame(A.annotate_domain(lineitems(spark, sf_dir), Domain("v > 45")))
    return frame.group("key", "l_returnflag").agg(F.count("*").alias("n"), F.sum("cents").alias("cents")).df.select("key", "l_returnflag", "n", "cents", "ann_n_incons")


@query(f"WITH {_LI}, g AS (SELECT key, ts // {30 * 24 * HOUR} * {30 * 24 * HOUR} AS win_start, CAST(sum(cents) AS BIGINT) AS cents, CAST(count_if(v > 45) AS BIGINT) AS ann_degree_sum FROM li GROUP BY ALL), t AS (SELECT *, {_DESC} AS rank FROM g) SELECT * FROM t WHERE rank <= 3")
def lineitem_top_suppliers(spark, sf_dir):
    frame = AnnotatedFrame(A.annotate_domain(lineitems(spark, sf_dir), Domain("v > 45")))
    return frame.group_and_window("key", size=30 * 24 * HOUR).agg(F.sum("cents").alias("cents")).top(3).select("key", "win_start", "cents", "ann_degree_sum", "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from candor.plans import streams

    return {name: f for name, (f, _) in FOUND.items()} | streams.queries()


def oracle_sql() -> dict[str, str]:
    from candor.plans import streams

    return {name: sql for name, (_, sql) in FOUND.items() if sql} | streams.oracle_sql()


__all__ = ["FOUND", "oracle_sql", "pearson", "queries"]
