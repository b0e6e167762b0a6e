"""Sinks: console, memory and files for streams, and metrics of annotated relations."""

from __future__ import annotations

import csv
import os
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

HEADER = ["experiment", "window_size", "window_slide", "start_ms", "current_ms", "events", "inconsistencies", "avg_inconsistencies", "avg_memory_mb", "max_memory_mb", "avg_cpu", "max_cpu"]


def write_stream(df: DataFrame, sink: str, name: str, checkpoint: str, mode: str = "append", path: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Starts a stream into console, memory (a table of this name) or parquet. available_now ends it with the input."""
    writer = df.writeStream.outputMode(mode).format(sink).queryName(name).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path) if path else writer.start()


def for_each_batch(df: DataFrame, f: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    return df.writeStream.outputMode(mode).foreachBatch(f).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def observed(df: DataFrame, name: str = "metrics") -> tuple[DataFrame, Observation]:
    """df, which counts events and inconsistencies while whatever uses it runs; no second pass."""
    seen = Observation(name)
    violations = F.col("ann_n_incons") if "ann_n_incons" in df.columns else F.lit(0)
    return df.observe(seen, F.count(F.lit(1)).alias("events"), F.coalesce(F.sum(violations), F.lit(0)).alias("inconsistencies")), seen


class Usage:
    """Memory (MB of heap) and CPU load (of all cores, 0 to 1) of the driver's JVM while a block runs, sampled in a
    thread; the load is read from /proc and 0 where there is none."""

    def __init__(self, spark: SparkSession, every_s: float = 0.2):
        jvm = spark._jvm
        self._runtime, self._stat = jvm.java.lang.Runtime.getRuntime(), f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/stat"
        self._every, self._stop, self.memory, self.cpu = every_s, threading.Event(), [], []
        self._last = self._seconds(), time.monotonic()

    def _seconds(self) -> float:
        """CPU seconds of the process so far: fields 14 and 15, counted behind the name in brackets."""
        if not os.path.exists(self._stat):
            return 0.0
        with open(self._stat) as f:
            fields = f.read().rpartition(")")[2].split()
        return (int(fields[11]) + int(fields[12])) / os.sysconf("SC_CLK_TCK")

    def _sample(self) -> None:
        self.memory.append((self._runtime.totalMemory() - self._runtime.freeMemory()) / (1 << 20))
        now = self._seconds(), time.monotonic()
        passed, self._last = (now[0] - self._last[0], now[1] - self._last[1]), now
        self.cpu.append(min(1.0, passed[0] / max(passed[1], 1e-3) / (os.cpu_count() or 1)))

    def _watch(self) -> None:
        while not self._stop.wait(self._every):
            self._sample()

    def __enter__(self) -> Usage:
        self._sample()
        self._thread = threading.Thread(target=self._watch, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._stop.set()
        self._thread.join()
        self._sample()

    def columns(self) -> list[float]:
        """Average and maximum of both."""
        return [f(x) for x in (self.memory, self.cpu) for f in (lambda a: sum(a) / len(a), max)]


def write_metrics(path: str, experiment: str, size: int, slide: int, start_ms: int, seen: Observation, usage: Usage | None = None) -> None:
    """Appends a line to a CSV of metrics on the driver, with a header if it is new; without usage its columns are empty."""
    got, new = seen.get, not os.path.exists(path)
    with open(path, "a", newline="") as f:
        out = csv.writer(f)
        if new:
            out.writerow(HEADER)
        events, bad = got["events"], got["inconsistencies"]
        out.writerow([experiment, size, slide, start_ms, int(time.time() * 1000), events, bad, bad / events if events else 0.0, *(usage.columns() if usage else [None] * 4)])


class MetricsListener(StreamingQueryListener):
    """Keeps rows and milliseconds of every micro-batch."""

    def __init__(self) -> None:
        self.progress: list[dict] = []

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.progress.append({"batch": p.batchId, "rows": p.numInputRows, "ms": p.durationMs.get("triggerExecution", 0), "state_rows": sum(s.numRowsTotal for s in p.stateOperators)})

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...
