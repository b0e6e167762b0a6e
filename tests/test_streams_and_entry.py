import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from candor.operators.annotate import annotate
from candor.operators.constraints import PrimaryKey, SpeedConstraint
from candor.plans import queries as plans
from candor.plans import streams
from candor.sources.readers import events

HOUR = 3_600_000


def test_stream_annotation_is_the_batch_one(spark, sf_dir):
    c = [SpeedConstraint("v", -1e-6, 1e-6), PrimaryKey(("event_type",))]
    batch = {r["seq"]: r["ann_degree"] for r in annotate(events(spark, sf_dir), c, 48 * HOUR, 12 * HOUR, mode="paths").collect()}
    stream = {r["seq"]: r["ann_degree"] for r in streams.stream_annotate_paths(spark, sf_dir).collect()}
    assert stream == batch and sum(v > 0 for v in batch.values()) > 10


@pytest.mark.parametrize("name", ["stream_annotate_domain", "stream_window_aggregate", "stream_interval_join", "q12_repair", "inject_percentage", "annotate_paths"])
def test_queries_run(spark, sf_dir, name):
    assert plans.queries()[name](spark, sf_dir).count() > 0


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(plans.queries()) == len(set(plans.queries())) >= 70


def test_entry_without_the_optional_parts(tmp_path):
    root = Path(__spark_entry__.__file__).parent
    for p in root.iterdir():
        if p.name not in ("candor", "corpus_pipeline.py"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "candor").mkdir()
    for p in (root / "candor").iterdir():
        if p.name != "llm":
            (tmp_path / "candor" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(k.startswith('op') for k in q) and q and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": "", "PATH": "/usr/bin:/bin"})
