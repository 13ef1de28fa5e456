"""Size-tiered shards with a versioned manifest, in DataFrame functions alone.

append() writes an arrival as small immutable Parquet shards; compact() merges the runs of a tier, that is of
similar size, into files of about the target size; each ends with an atomic commit of a new manifest version.
Readers take the newest version and never see half of a change. A manifest is a Parquet table of files with their
bytes and rows; a version is a small file that names it and holds the schema of all arrivals so far. It is written aside
and then put in place in one step that fails if the version exists: a hard link on a local file system, a rename
without replacement elsewhere (atomic on HDFS; a store without atomic renames needs a committer of its own). The writer
that comes second takes up the newer version and tries again.

A merge reads its runs with the reader's own packing of small files and writes them without a shuffle.

Edge cases: rows are kept as they are, with all their columns, nulls and repeats; a column that only some
arrivals have is null in the others' rows, and one that comes with another type is refused; an empty arrival commits a
version that adds no rows, and a store without rows gives none; runs of half the target or more are final; a tier with
fewer than `fanout` runs waits; a version that vacuum() has dropped is refused. Names of files, no rows, pass through the driver, as Spark's
own reader needs them there.
"""

from __future__ import annotations

import json
import math
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import hadoop_path, remove

MANIFEST = "path string, bytes long, rows long"


class CommitConflict(RuntimeError):
    """Another writer has committed the version first."""


class ShardStore:
    """Shards of one table under `root`, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, target: int = 64 << 20, least: int = 1 << 20, fanout: int = 4):
        self.spark, self.root, self.target, self.least, self.fanout = spark, root, target, least, fanout

    def _versions(self) -> list[int]:
        fs, p = hadoop_path(self.spark, f"{self.root}/versions")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(p) if f.getPath().getName().isdigit()) if fs.exists(p) else []

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        return max(self._versions(), default=0)

    def oldest(self) -> int:
        """The oldest version that can still be read."""
        return min(self._versions(), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """The files of a version."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        if version < self.oldest():
            raise ValueError(f"version {version} is gone: vacuum() has dropped it")
        name = self._lines(version)[0]
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{name}")

    def _lines(self, version: int) -> list[str]:
        """The manifest's name and the schema; versions of older stores have the name alone."""
        return self.spark.read.text(f"{self.root}/versions/{version:08d}", wholetext=True).first()[0].splitlines()

    def schema(self, version: int | None = None) -> StructType:
        """The columns of all arrivals up to a version."""
        version = self.version() if version is None else version
        if not version:
            return StructType()
        lines = self._lines(version)
        if len(lines) > 1:
            return StructType.fromJson(json.loads(lines[1]))
        files = [r.path for r in self.manifest(version).select("path").toLocalIterator()]
        return self.spark.read.option("mergeSchema", True).parquet(*files).schema if files else StructType()

    def _merged(self, base: int, new: StructType) -> StructType:
        """The schema of a version with the columns that are new."""
        fields = {f.name.lower(): f for f in self.schema(base)}
        for f in new:
            held = fields.setdefault(f.name.lower(), f)
            if held.dataType != f.dataType:
                raise TypeError(f"column {f.name} is {held.dataType.simpleString()} in the store and {f.dataType.simpleString()} in the arrival")
        return StructType(list(fields.values()))

    def _commit(self, base: int, files: DataFrame, schema: StructType | None = None) -> int:
        """Commit the version after base, or raise CommitConflict if another writer has done so."""
        name, schema = uuid.uuid4().hex, self.schema(base) if schema is None else schema
        files.coalesce(1).write.parquet(f"{self.root}/manifests/{name}")
        fs, held = hadoop_path(self.spark, f"{self.root}/versions/.{name}")
        _, final = hadoop_path(self.spark, f"{self.root}/versions/{base + 1:08d}")
        out = fs.create(held, False)
        out.write(bytearray(f"{name}\n{schema.json()}".encode()))
        out.close()
        try:
            self._put(fs, held, final)
        except FileExistsError:
            remove(self.spark, f"{self.root}/manifests/{name}")
            raise CommitConflict(f"version {base + 1} exists") from None
        finally:
            fs.delete(held, False)
        return base + 1

    def _put(self, fs, held, final) -> None:
        """Give a written file its final name, in one step that fails if that is taken."""
        if fs.getUri().getScheme() == "file":
            os.link(held.toUri().getPath(), final.toUri().getPath())
            return
        jvm = self.spark._jvm.org.apache.hadoop.fs
        never = self.spark.sparkContext._gateway.new_array(getattr(jvm, "Options$Rename"), 1)
        never[0] = getattr(jvm, "Options$Rename").NONE
        try:
            jvm.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(held, final, never)
        except Exception as problem:
            if "FileAlreadyExistsException" in str(problem):
                raise FileExistsError(str(final)) from None
            raise

    def _change(self, files: Callable[[int], DataFrame | None], schema: Callable[[int], StructType], tries: int = 100) -> int | None:
        """Commit files(base) over the newest version, again over a newer one after each conflict; None if it has become none."""
        for _ in range(tries):
            base = self.version()
            if (now := files(base)) is None:
                return None
            try:
                return self._commit(base, now, schema(base))
            except CommitConflict:
                continue
        raise CommitConflict(f"no commit in {tries} tries")

    def _written(self, folder: str) -> DataFrame:
        """The files under a folder with bytes and rows, from their footers."""
        meta = self.spark.read.parquet(folder).select("_metadata.file_path", "_metadata.file_size")
        return meta.groupBy(F.col("file_path").alias("path")).agg(F.max("file_size").alias("bytes"), F.count("*").alias("rows"))

    def append(self, rows: DataFrame, shard_rows: int = 4000) -> int:
        """Write an arrival as shards of at most shard_rows rows and commit it."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        rows.write.option("maxRecordsPerFile", shard_rows).parquet(folder)
        new, written = self.spark.read.parquet(folder).schema, self._written(folder)
        try:
            return self._change(lambda base: self.manifest(base).unionByName(written), lambda base: self._merged(base, new))
        except TypeError:
            remove(self.spark, folder)
            raise

    def tiers(self, files: DataFrame) -> DataFrame:
        """files with their tier: the power of fanout of their size over the least; -1 for final ones."""
        power = F.floor(F.log(float(self.fanout), F.greatest(F.col("bytes") / self.least, F.lit(1.0))))
        return files.withColumn("tier", F.when(F.col("bytes") * 2 >= self.target, -1).otherwise(power).cast("int"))

    def compact(self) -> int:
        """Merge every tier that has `fanout` runs or more, smallest first, until none has; the last version."""
        while True:
            base = self.version()
            files = self.tiers(self.manifest(base))
            due = files.where("tier >= 0").groupBy("tier").agg(F.count("*").alias("runs"), F.sum("bytes").alias("bytes")).where(F.col("runs") >= self.fanout).orderBy("tier").first()
            if due is None:
                return base
            runs = [r.path for r in files.where(F.col("tier") == due.tier).select("path").toLocalIterator()]  # names, not rows
            folder = f"{self.root}/data/{uuid.uuid4().hex}"
            self.spark.read.schema(self.schema(base)).parquet(*runs).coalesce(max(1, math.ceil(due.bytes / self.target))).write.parquet(folder)
            merged, gone = self._written(folder), files.where(F.col("tier") == due.tier).select("path")

            def rest(now: int) -> DataFrame | None:
                """The files of a version with the merged ones for the runs; none if another writer has merged some of them."""
                held = self.manifest(now)
                if now != base and held.join(gone, "path", "left_semi").count() < len(runs):
                    return None
                return held.join(gone, "path", "left_anti").unionByName(merged)

            if self._change(rest, self.schema) is None:
                remove(self.spark, folder)

    def vacuum(self, older_than_s: float = 0) -> None:
        """Drop all versions but the newest, and delete the files that it does not name: those of older versions and of
        failed writers. Files younger than older_than_s stay; while others write, that must exceed their longest write."""
        now = self.version()
        under = F.substring_index("path", "/data/", -1)  # the listing writes a folder's scheme in another way
        held = self.manifest(now).select(under.alias("name"))
        if now:
            for r in self.spark.read.text(f"{self.root}/versions", wholetext=True).select("_metadata.file_name", "value").collect():  # one row a version
                if int(r.file_name) < now:
                    remove(self.spark, f"{self.root}/versions/{r.file_name}")
                    remove(self.spark, f"{self.root}/manifests/{r.value.splitlines()[0]}")
        if not hadoop_path(self.spark, f"{self.root}/data")[0].exists(hadoop_path(self.spark, f"{self.root}/data")[1]):
            return
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{self.root}/data").select("path", "modificationTime")
        old_enough = found.where(F.col("modificationTime") <= F.current_timestamp() - F.make_dt_interval(secs=F.lit(float(older_than_s)).cast("decimal(18,6)")))
        for r in old_enough.select("path", under.alias("name")).join(held, "name", "left_anti").toLocalIterator():
            remove(self.spark, r.path)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        version = self.version() if version is None else version
        files, schema = [r.path for r in self.manifest(version).select("path").toLocalIterator()], self.schema(version)
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)
