import pytest
from pyspark.sql import functions as F

from candor.operators.annotate import annotate
from candor.operators.constraints import PrimaryKey, SpeedConstraint
from candor.operators.frame import AnnotatedFrame
from candor.plans import queries as plans
from candor.sources.readers import events, kafka

HOUR = 3_600_000


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(plans.FOUND))
def test_no_query_makes_a_cartesian_product(spark, sf_dir, name):
    text = plan(plans.queries()[name](spark, sf_dir))
    # replay joins every row with one row of spans, by broadcast
    assert "CartesianProduct" not in text and (name == "source_replay" or "BroadcastNestedLoopJoin" not in text)


def test_only_needed_columns_are_read(spark, sf_dir):
    text = plan(events(spark, sf_dir).groupBy("event_type").agg(F.sum("cents")))
    assert "ReadSchema: struct<event_type:string,value:double>" in text


def test_filters_reach_the_scan_but_not_below_annotation(spark, sf_dir):
    before = plan(events(spark, sf_dir).where("event_type = 'error'"))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in before
    after = plan(annotate(events(spark, sf_dir), SpeedConstraint("v", -1e-6, 1e-6), 48 * HOUR).where("event_type = 'error'"))
    scans = [s for s in after.split("FileScan")[1:]]
    assert sum("EqualTo(event_type,error)" not in s for s in scans) >= 2  # origins and history are read whole


def test_annotation_stays_out_of_python_and_is_pruned(spark, sf_dir):
    df = annotate(events(spark, sf_dir), [SpeedConstraint("v", -1e-6, 1e-6), PrimaryKey(("event_type",))], 48 * HOUR, 12 * HOUR)
    assert "Python" not in plan(df) and "Pandas" not in plan(df)
    frame = AnnotatedFrame(df)
    assert "collect_list" not in plan(frame.select("cents").values_from_annotation("cents"))


def test_top_k_is_limited_before_the_shuffle(spark, sf_dir):
    text = plan(plans.queries()["top_k_without_annotation"](spark, sf_dir))
    assert "WindowGroupLimit" in text


def test_kafka_needs_its_package(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        kafka(spark, "localhost:1", "t", "ts bigint", "ts", streaming=False).count()
