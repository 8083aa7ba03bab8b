"""Sharding by size-tiered compaction, with DataFrame functions only.

A table of shards is a folder of immutable Parquet files and a chain of manifest versions. An append
writes the arriving rows as small shards; nothing that exists is rewritten. Compaction puts the live
shards into tiers by size (tier t holds sizes from base * fanout**t), and wherever a tier has
``fanout`` shards or more it merges them into as few shards of about the target size as their bytes fill. Every
merge is one task that reads a run of a tier and writes one file, so compaction shuffles nothing; the merges of
a round are one job, a scan for each tier. Sizes are the shards' file sizes.

A manifest is a set of immutable part files of up to ``PART_LINES`` shards each, so a commit only writes the parts that change. A
commit writes its parts, then creates the file of its version, which names them, and creating it fails if it is there:
of two writers of one version one wins. That takes a store whose create without overwriting is exclusive: HDFS, object stores with
conditional puts, and local disks, where a finished file is linked to its name. A version file without its closing line was never
committed: readers pass over it, writers go beyond it.

Writers register a folder in ``_writing`` before anything is written to it, and take the mark away after its commit; a mark counts for ``ABANDONED`` seconds.
``vacuum`` keeps the last versions, everything younger than ``grace`` seconds, and what is registered; it removes the rest.

Recovery: a lost executor repeats its task; files of failed or repeated attempts are not in any
manifest, since the shards of a version are listed from what Spark's committer left. A manifest holds a line per shard (path, rows,
bytes), which is metadata of the table; rows never pass through the driver.

Defined results: columns of any names and types that Parquet holds are kept as they are, nulls included;
rows are kept whole and exactly once, repeated rows as often as they came; an append without rows
commits a version without new shards; a table without versions reads as an error.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larkspur.llm.common import drop_path, fresh_path

PART_LINES = 20_000
GRACE = 24 * 3600.0
#: A mark of this age is of a writer that has died.
ABANDONED = 7 * 24 * 3600.0


@dataclass(frozen=True)
class Shard:
    path: str
    rows: int
    bytes: int


class ShardTable:
    """A versioned table of shards in ``root``, a path that Spark can write."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, target_bytes: int = 128 << 20, fanout: int = 4, base_bytes: int = 1 << 20):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.target, self.fanout, self.base = target_bytes, fanout, base_bytes
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    # ------------------------------------------------------------------ files

    def _read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, path: str, text: str) -> None:
        stream = self._fs.create(self._path(path), False)
        stream.write(bytearray(text.encode()))
        stream.close()

    def _list(self, path: str) -> list:
        folder = self._path(path)
        return list(self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def _create(self, path: str, text: str) -> bool:
        """Create a file with this text; false if it is there already, whoever was first."""
        if self._fs.getScheme() != "file":
            try:
                self._write(path, text)
            except Py4JJavaError as e:
                if "AlreadyExists" not in e.java_exception.getClass().getName():
                    raise
                return False
            return True
        jvm = self.spark.sparkContext._jvm
        temp = f"{path}.{uuid.uuid4().hex}"
        self._write(temp, text)
        name = lambda p: jvm.java.io.File(self._path(p).toUri().getPath()).toPath()
        try:
            jvm.java.nio.file.Files.createLink(name(path), name(temp))
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False
        finally:
            self._fs.delete(self._path(temp), False)
        return True

    # ------------------------------------------------------------------ manifests

    def _version_path(self, version: int) -> str:
        return f"{self.root}/_manifests/v{version:08d}"

    def _taken(self) -> list[int]:
        """Numbers of all version files, those that were never finished too."""
        names = [s.getPath().getName() for s in self._list(f"{self.root}/_manifests")]
        return sorted(int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit())

    def _parts(self, version: int) -> list[str] | None:
        """The parts that a version names, or None where it was never finished."""
        lines = self._read(self._version_path(version)).split("\n")
        return lines[:-1] if lines[-1] == "committed" else None

    def versions(self) -> list[int]:
        return [v for v in self._taken() if self._parts(v) is not None]

    def latest(self) -> int:
        return next((v for v in reversed(self._taken()) if self._parts(v) is not None), 0)

    def _shards(self, part: str) -> list[Shard]:
        return [Shard(*json.loads(line)) for line in self._read(f"{self.root}/_manifests/{part}").splitlines()]

    def manifest(self, version: int | None = None) -> list[Shard]:
        version = self.latest() if version is None else version
        return [s for part in self._parts(version) or [] for s in self._shards(part)] if version else []

    def commit(self, added: list[Shard], gone: set[str], expected: int) -> int:
        """The version after ``expected``, with shards added and others gone; raises if another writer has committed one."""
        kept, loose = [], list(added)
        for part in (self._parts(expected) or []) if expected else []:
            shards = self._shards(part)
            if len(shards) < PART_LINES // 2 or any(s.path in gone for s in shards):
                loose += [s for s in shards if s.path not in gone]
            else:
                kept.append(part)
        for k in range(0, len(loose), PART_LINES):
            part = f"part-{uuid.uuid4().hex}"
            self._write(f"{self.root}/_manifests/{part}", "\n".join(json.dumps([s.path, s.rows, s.bytes]) for s in loose[k : k + PART_LINES]))
            kept.append(part)
        new = expected + 1
        for v in self._taken():
            if v >= new:
                if self._parts(v) is not None:
                    raise RuntimeError(f"version {v} has been committed by another writer")
                new = v + 1
        if not self._create(self._version_path(new), "\n".join([*kept, "committed"])):
            raise RuntimeError(f"version {new} has been committed by another writer")
        return new

    # ------------------------------------------------------------------ writing

    def _listed(self, folder: str) -> list[Shard]:
        """The shards that a finished job left in a folder, with row counts from their footers."""
        if not any(s.getPath().getName().endswith(".parquet") for s in self._fs.listStatus(self._path(folder))):
            return []
        found = (
            self.spark.read.schema(self.schema)
            .parquet(folder)
            .groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
            .agg(F.count(F.lit(1)).alias("rows"))
        )
        return sorted((Shard(r["path"], r["rows"], r["bytes"]) for r in found.collect()), key=lambda s: s.path)

    @contextmanager
    def _folder(self) -> Iterator[str]:
        """A new folder for shards, registered until its commit."""
        name = f"shards-{uuid.uuid4().hex}"
        mark = f"{self.root}/_writing/{name}"
        self._write(mark, "")
        yield f"{self.root}/{name}"
        self._fs.delete(self._path(mark), False)

    def append(self, arrivals: DataFrame, max_rows_per_shard: int = 0, attempts: int = 5) -> int:
        """Write arriving rows as small shards and commit them, after whatever others have committed meanwhile."""
        writer = arrivals.select(*[F.col(f"`{c}`") for c in self.schema.names]).write.option("compression", "zstd")
        with self._folder() as folder:
            (writer.option("maxRecordsPerFile", max_rows_per_shard) if max_rows_per_shard else writer).parquet(folder)
            shards = self._listed(folder)
            for left in range(attempts - 1, -1, -1):
                try:
                    return self.commit(shards, set(), self.latest())
                except RuntimeError:
                    if not left:
                        raise
        raise AssertionError

    def tier(self, size: int) -> int:
        return 0 if size <= self.base else int(math.log(size / self.base, self.fanout)) + 1

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """The tiers to merge: those with ``fanout`` shards or more, which are all under half the target."""
        tiers: dict[int, list[Shard]] = defaultdict(list)
        for s in shards:
            if s.bytes < self.target / 2:
                tiers[self.tier(s.bytes)].append(s)
        return [sorted(t, key=lambda s: (s.bytes, s.path)) for _, t in sorted(tiers.items()) if len(t) >= max(2, self.fanout)]

    def _merged(self, tiers: list[list[Shard]]) -> DataFrame:
        """The rows of all tiers, in as many partitions as their bytes fill targets: fewer than half as many as there were shards, and one more."""
        parts = [self.spark.read.schema(self.schema).parquet(*[s.path for s in t]).coalesce(math.ceil(sum(s.bytes for s in t) / self.target)) for t in tiers]
        return reduce(DataFrame.unionAll, parts)

    def compact(self) -> int:
        """Merge until no tier is full; a job and a version for each round."""
        version = self.latest()
        while tiers := self.plan(self.manifest(version)):
            merged = [s for t in tiers for s in t]
            with self._folder() as folder:
                self._merged(tiers).write.option("compression", "zstd").option("maxRecordsPerFile", 0).parquet(folder)
                made = self._listed(folder)
                if sum(s.rows for s in made) != sum(s.rows for s in merged):
                    raise RuntimeError("a merge has lost or repeated rows; nothing is committed")
                if len(made) >= len(merged):
                    raise RuntimeError("a merge has made as many shards as there were; nothing is committed")
                version = self.commit(made, {s.path for s in merged}, version)
        return version

    def vacuum(self, keep_versions: int = 1, grace: float = GRACE) -> None:
        """Remove what isn't in the last ``keep_versions`` versions, is older than ``grace`` seconds, and isn't registered by a writer."""
        before = (time.time() - grace) * 1000
        have = self.versions()
        kept = have[-keep_versions:]
        young = [v for v in have[:-keep_versions] if self._fs.getFileStatus(self._path(self._version_path(v + 1 if v + 1 in have else have[-1]))).getModificationTime() > before]
        parts = {p for v in [*kept, *young] for p in self._parts(v)}
        live = {s.path.rsplit("/", 2)[-2] + "/" + s.path.rsplit("/", 1)[-1] for p in parts for s in self._shards(p)}
        writing = {s.getPath().getName() for s in self._list(f"{self.root}/_writing") if s.getModificationTime() > (time.time() - ABANDONED) * 1000}
        for status in self._list(self.root):
            folder = status.getPath().getName()
            if folder.startswith("shards-") and folder not in writing:
                files = [f for f in self._list(f"{self.root}/{folder}") if f.getPath().getName().endswith(".parquet")]
                old = [f for f in files if f"{folder}/{f.getPath().getName()}" not in live and f.getModificationTime() <= before]
                if len(old) == len(files) and status.getModificationTime() <= before:
                    self._fs.delete(status.getPath(), True)
                else:
                    for f in old:
                        self._fs.delete(f.getPath(), False)
        for status in self._list(f"{self.root}/_manifests"):
            name = status.getPath().getName()
            number = int(name[1:]) if name[0] == "v" and name[1:].isdigit() else 0
            if status.getModificationTime() <= before and (number and number < have[-1] and number not in {*kept, *young} or not number and name not in parts):
                self._fs.delete(status.getPath(), False)

    # ------------------------------------------------------------------ reading

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, and nothing else, from the shards that its manifest names."""
        if not self.latest():
            raise ValueError(f"{self.root} has no committed version")
        shards = self.manifest(version)
        if not shards:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[s.path for s in shards])

    def drop(self) -> None:
        drop_path(self.spark, self.root)


def shard_table(docs: DataFrame, arrivals_rows: int = 2000, target_bytes: int = 128 << 20, root: str | None = None) -> ShardTable:
    """A compacted table of the rows of ``docs``, which arrive as shards of up to ``arrivals_rows`` rows."""
    table = ShardTable(docs.sparkSession, root or fresh_path(docs.sparkSession, "sharded"), docs.schema, target_bytes)
    table.append(docs, arrivals_rows)
    table.compact()
    if root is None:  # nobody else knows of it
        table.vacuum(grace=0.0)
    return table
