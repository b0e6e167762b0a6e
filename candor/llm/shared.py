"""Tables written to the folder that driver and executors share, to cut lineage and to survive lost executors."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


#: Bytes and rows of a batch that is handed to Python; texts may be long, and both sides hold a batch.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1000


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, unless it has set less itself."""
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        now = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Hands what this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def giving_back(step: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A step over a task's batches that ends with give_back(): workers stay when their task is over, several to a
    core, and each would keep what its largest task took."""

    @functools.wraps(step)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from step(batches)
        finally:
            give_back()

    return run


def unused(df: DataFrame, name: str) -> str:
    """A column name like this that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs, whatever their columns' names, without the rows of the doc_ids in gone(gone_id)."""
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


_made: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where it is unset, and all runs in one process, a temporary folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _made.setdefault(context.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        _made[context.applicationId] = found
    return found.rstrip("/")


_paths: dict[int, str] = {}


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read back with its schema; by: a column that gives it parts."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table that written() made and nothing reads any more."""
    spark, path = df.sparkSession, _paths.pop(id(df), None)
    if path:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
