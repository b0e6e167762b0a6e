import pytest
from pyspark.sql import functions as F

from candor.llm.compaction import Conflict, ShardStore, compacted_documents

SCHEMA = "_arrival int, doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def store(spark, tmp_path):
    return ShardStore(spark, f"file://{tmp_path}/store", target=1 << 20, fan=3)


def test_small_shards_are_merged_by_tier_and_nothing_is_lost(spark, store):
    assert store.read() is None
    make = lambda a, b: spark.range(a, b).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"), F.lit(None).cast("int").alias("none"))
    for k in range(9):
        store.append(make(k * 100, k * 100 + 100).coalesce(1))
    assert len(store.shards()) == 9 and store.versions()[-1] == 9
    before = rows_of(store.read())
    assert store.compact() == 1 or len(store.shards()) < 9
    assert len(store.shards()) <= 3 and rows_of(store.read()) == before
    assert rows_of(store.read(9)) == before  # an older version stays readable until vacuum
    assert store.vacuum() >= 9 and rows_of(store.read()) == before and len(store.versions()) == 1
    big = make(10_000, 40_000).coalesce(1)
    store.append(big)
    store.append(make(900, 1000).coalesce(1))
    names = {s.name for s in store.shards()}
    assert store.compact() == 0 and {s.name for s in store.shards()} == names  # of different tiers
    assert store.read().count() == 31_000


def test_readers_see_whole_versions_and_writers_cannot_overwrite(spark, store):
    store.append(spark.range(5).toDF("id"))
    other = ShardStore(spark, store.root, store.target, store.fan)
    first = other.append(spark.range(5, 9).toDF("id"))
    assert first == 2 and store.append(spark.range(9, 12).toDF("id")) == 3
    assert store.read(1).count() == 5 and store.read().count() == 12
    _, shards, schema = store._manifest()

    def stale(old):
        if shards[0].name not in {s.name for s in old}:
            raise Conflict("gone")
        return old

    assert other.compact() == 1
    with pytest.raises(Conflict):
        store._commit(stale, schema)
    with pytest.raises(ValueError, match="holds"):
        store.append(spark.range(3).select(F.col("id").alias("other")))
    assert store.read().count() == 12


def test_lost_race_is_tried_again(spark, store):
    store.append(spark.range(2).toDF("id"))
    other, done = ShardStore(spark, store.root), []

    def change(old):
        if not done:
            done.append(other.append(spark.range(2, 4).toDF("id")))
        return old

    assert store._commit(change, store._manifest()[2]) == 3 and store.read().count() == 4


def test_documents_survive_whatever_they_hold(spark):
    rows = [(5, 1, None, None, None, None), (5, 2, "", "en", "s", 0), (5, 2, "", "en", "s", 0), (5, None, "é" * 50_000, "fr", "s", 50_000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = rows_of(docs.select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256)))
    assert rows_of(compacted_documents(docs.withColumnRenamed("_arrival", "arrival"), arrivals=3, fan=2)) == want
    assert compacted_documents(docs.limit(0)).collect() == []
