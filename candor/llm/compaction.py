"""Size-tiered compaction of immutable shards under a versioned manifest.

Arrivals are appended as small shards (folders of Parquet files that never change). A shard's tier is the logarithm of
its bytes to the base `fan`. Where `fan` or more shards of one tier follow each other in order of arrival, they are
merged into one, in files of about `target` bytes, without a shuffle. Files that have reached the target aren't
rewritten again.

A manifest file lists a version's shards. It is written beside its place and renamed to `v<number>`, which fails if
that version exists: then another writer was first, and the change is made again on what it left, or given up if it
removed shards that this change needs. Readers take the highest version, so they see all of a change or nothing.
Shards that no kept version lists are deleted by vacuum(). The folder must be in a file system whose renames are
atomic; driver and executors must both reach it.

Defined results: appending no rows commits nothing; nulls, empty and long texts and repeated rows are stored as they
are; all columns are kept, whatever their names; a store without versions reads as None; reading an explicit schema
makes an empty table readable.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candor.llm.shared import shared_folder, unused


@dataclass(frozen=True)
class Shard:
    name: str
    sequence: int  # of the first arrival in it
    bytes: int
    files: int
    level: int = 0  # merges behind it


class Conflict(RuntimeError):
    """Another writer has committed what this change can't follow."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target: int = 128 << 20, fan: int = 4):
        if fan < 2 or target < 1:
            raise ValueError("fan must be 2 or more and target positive")
        self.spark, self.root, self.target, self.fan = spark, root.rstrip("/"), target, fan
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        for name in ("shards", "manifests"):
            self._fs.mkdirs(self._path(f"{self.root}/{name}"))

    # manifests

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())

    def _manifest(self, version: int | None = None) -> tuple[int, list[Shard], T.StructType | None]:
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return 0, [], None
        stream = self._fs.open(self._path(f"{self.root}/manifests/v{version:012d}"))
        try:
            found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return version, [Shard(**s) for s in found["shards"]], T.StructType.fromJson(found["schema"])

    def shards(self, version: int | None = None) -> list[Shard]:
        return self._manifest(version)[1]

    def _commit(self, change: Callable[[list[Shard]], list[Shard]], schema: T.StructType, tries: int = 20) -> int:
        for _ in range(tries):
            version, shards, known = self._manifest()
            if known is not None and known.simpleString() != schema.simpleString():
                raise ValueError(f"the store holds {known.simpleString()}, not {schema.simpleString()}")
            text = json.dumps({"shards": [asdict(s) for s in change(shards)], "schema": schema.jsonValue()})
            draft = self._path(f"{self.root}/manifests/_{uuid.uuid4().hex}")
            stream = self._fs.create(draft, False)
            try:
                stream.write(bytearray(text.encode()))
            finally:
                stream.close()
            try:
                self._context.rename(draft, self._path(f"{self.root}/manifests/v{version + 1:012d}"), self._options)
                return version + 1
            except Exception as e:
                self._fs.delete(draft, False)
                if "FileAlreadyExists" not in str(e):
                    raise
        raise Conflict("other writers were always first")

    # data

    def _measured(self, name: str, sequence: int, level: int) -> Shard | None:
        found = [s for s in self._fs.listStatus(self._path(f"{self.root}/shards/{name}")) if s.getPath().getName().endswith(".parquet")]
        return Shard(name, sequence, sum(s.getLen() for s in found), len(found), level) if found else None

    def append(self, df: DataFrame, by: str | None = None) -> int | None:
        """Adds rows as one shard, or, with `by`, as one for each value of that column (which isn't stored), all in
        one write; each becomes visible by a commit of its own, in the order of the values. Gives the last version."""
        name = f"a{uuid.uuid4().hex}"
        place, schema = f"{self.root}/shards/{name}", df.drop(by).schema if by else df.schema
        if by:
            df.write.partitionBy(by).parquet(place)
            names = sorted((s.getPath().getName() for s in self._fs.listStatus(self._path(place)) if s.isDirectory()), key=lambda n: (len(n), n))
            names = [f"{name}/{n}" for n in names]
        else:
            df.write.parquet(place)
            names = [name]
        version = None
        for n in names:
            if shard := self._measured(n, 0, 0):
                numbered = lambda old, s=shard: [*old, Shard(s.name, 1 + max((o.sequence for o in old), default=0), s.bytes, s.files)]
                version = self._commit(numbered, schema)
        return version

    def tier(self, shard: Shard) -> int:
        return max(0, int(math.log(max(shard.bytes, 1), self.fan)))

    def _files(self, run: list[Shard]) -> int:
        """Files of the shard that a run becomes."""
        return max(1, round(sum(s.bytes for s in run) / self.target))

    def _run(self, shards: list[Shard]) -> list[Shard]:
        """The first run, in order of arrival, of `fan` or more neighbours of one tier that aren't of full files and
        that become fewer files by a merge."""
        run: list[Shard] = []
        for s in [*sorted(shards, key=lambda s: s.sequence), None]:
            small = s is not None and s.bytes < self.target * s.files * 0.75
            if small and run and self.tier(s) == self.tier(run[0]):
                run.append(s)
                continue
            if len(run) >= self.fan and self._files(run) < sum(s.files for s in run):
                return run
            run = [s] if small else []
        return []

    def compact(self) -> int:
        """Merges runs until none is left; gives the number of merges. A shard merged once isn't merged again in vain."""
        merges = 0
        while run := self._run(self.shards()):
            _, _, schema = self._manifest()
            name = f"m{uuid.uuid4().hex}"
            self._read(run, schema).coalesce(self._files(run)).write.parquet(f"{self.root}/shards/{name}")
            merged = self._measured(name, min(s.sequence for s in run), 1 + max(s.level for s in run))

            def swap(old: list[Shard], run=run, merged=merged) -> list[Shard]:
                if not {s.name for s in run} <= {s.name for s in old}:
                    raise Conflict("another writer has merged these shards")
                rest = [s for s in old if s.name not in {r.name for r in run}]
                return sorted([*rest, merged], key=lambda s: s.sequence)

            self._commit(swap, schema)
            merges += 1
        return merges

    def _read(self, shards: list[Shard], schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/shards/{s.name}" for s in shards])

    def read(self, version: int | None = None) -> DataFrame | None:
        _, shards, schema = self._manifest(version)
        if schema is None:
            return None
        return self._read(shards, schema)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes older manifests than the last `keep` and the shards that none of the kept ones lists. Call it while
        no writer is at work: a shard that is being appended isn't listed yet."""
        versions = self.versions()
        held = {s.name for v in versions[-keep:] for s in self.shards(v)}
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"{self.root}/manifests/v{v:012d}"), False)
        gone = 0
        for status in self._fs.listStatus(self._path(f"{self.root}/shards")):
            name = status.getPath().getName()
            inner = [f"{name}/{s.getPath().getName()}" for s in self._fs.listStatus(status.getPath()) if s.isDirectory()]
            for n in inner or [name]:
                if n not in held and not any(h.startswith(n + "/") for h in held):
                    gone += self._fs.delete(self._path(f"{self.root}/shards/{n}"), True)
        return gone


def compacted_documents(docs: DataFrame, arrivals: int = 16, target: int = 32 << 20, fan: int = 4) -> DataFrame:
    """Documents after they have arrived in parts, been merged and been read back under the last manifest:
    doc_id, lang, source, n_chars, text_sha256."""
    store = ShardStore(docs.sparkSession, f"{shared_folder(docs.sparkSession)}/shards-{uuid.uuid4().hex}", target, fan)
    arrival = unused(docs, "arrival")
    store.append(docs.withColumn(arrival, F.pmod(F.xxhash64("doc_id"), F.lit(arrivals))), by=arrival)
    store.compact()
    store.vacuum()
    held = store.read()
    return (docs.limit(0) if held is None else held).select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))


ORACLE_SQL = "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents"
