"""The index of a source tree: facts, graph and findings as relations, saved as Parquet and refreshed by difference."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import extract, schemas
from ..functions.scalars import token_estimate
from ..operators import graph
from ..operators.delta import refresh as refreshed
from ..operators.delta import snapshot_diff
from ..operators.resolve import resolve
from ..operators.rules import Facts, audit
from .cut import cut

RELATIONS = ("symbols", "types", "routes", "models", "imports")
VERSION = 1


@dataclass
class Index:
    """files (relative_path, language, mtime_ms, size) and facts; all else derives from them."""

    files: DataFrame
    facts: DataFrame

    def relation(self, kind: str) -> DataFrame:
        """symbols, types, routes, models or errors; imports come resolved."""
        rows = extract.relation(self.facts, kind)
        return resolve(rows, self.files) if kind == "imports" else rows

    @property
    def edges(self) -> DataFrame:
        return graph.edges_from_imports(self.relation("imports"))

    @cached_property
    def kept_edges(self) -> DataFrame:
        """edges, cut once: for what reads them several times, which would else resolve all imports each time."""
        return cut(self.edges)

    def findings(self) -> DataFrame:
        return audit(Facts(self.files, self.relation("symbols"), self.relation("types"), self.edges))

    def blast(self, path: str, hops: int = 3) -> dict[str, DataFrame]:
        """What depends on a file: files by hop, and the routes and models in them or in it."""
        spark = self.files.sparkSession
        start = spark.createDataFrame([(path,)], "node string")
        files = graph.reach(self.kept_edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start, hops)
        hit = files.select(F.col("node").alias("file_path")).unionByName(start.withColumnRenamed("node", "file_path"))
        routes = self.relation("routes").join(hit, "file_path", "left_semi").select(F.concat_ws(" ", "method", "path").alias("route")).distinct()
        return {"files": files, "routes": routes, "models": self.relation("models").join(hit, "file_path", "left_semi").select("name").distinct()}

    def lookup(self, text: str) -> DataFrame:
        """Symbols and types whose name contains text, in any case."""
        found = [self.relation(k).select("name", "kind", "file_path", "line") for k in ("symbols", "types")]
        return found[0].unionByName(found[1]).where(F.contains(F.lower("name"), F.lit(text.lower())))

    def counts(self) -> DataFrame:
        """One row: files, languages, and facts of each kind, parse errors included."""
        kinds = ("symbol", "type", "route", "model", "import", "error")
        files = self.files.agg(F.count("*").alias("files"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))
        return files.crossJoin(self.facts.agg(*(F.count_if(F.col("kind") == k).alias(f"{k}s") for k in kinds)))  # one row each

    def save(self, path: str) -> None:
        self.files.write.mode("overwrite").parquet(f"{path}/v{VERSION}/files")
        self.facts.write.mode("overwrite").parquet(f"{path}/v{VERSION}/facts")


def _sources(files: DataFrame) -> DataFrame:
    return files.select(F.col("relative_path").alias("file_path"), "language", "text")


def build(files: DataFrame, framework: str = "generic", schemas_of: DataFrame | None = None) -> Index:
    """Index files (relative_path, language, mtime_ms, size, text) and the models of schema files (relative_path, text).
    Text is parsed once, where it is read; files and facts are then cut, because every relation starts from them."""
    source = _sources(files)
    if schemas_of is not None:
        source = source.unionByName(_sources(schemas_of.withColumn("language", F.lit("prisma"))))
    return Index(cut(files.drop("text")), cut(extract.facts(source, framework)))


def load(spark: SparkSession, path: str) -> Index | None:
    """A saved index; None if there is none of this version."""
    try:
        return Index(spark.read.schema(schemas.FILES).parquet(f"{path}/v{VERSION}/files"), spark.read.schema(schemas.FACTS).parquet(f"{path}/v{VERSION}/facts"))
    except Exception as problem:
        if "PATH_NOT_FOUND" in str(problem):
            return None
        raise


def changes(old: Index, files: DataFrame) -> DataFrame:
    """relative_path and status of every file, by time and size."""
    return snapshot_diff(old.files, files, "relative_path", ["mtime_ms", "size"])


def update(old: Index, files: DataFrame, framework: str = "generic", schemas_of: DataFrame | None = None) -> Index:
    """The index of files, parsing only those that are new or changed, and schema files each time; equal to build(..).

    Imports are resolved from raw facts each time, so deleted files leave no edges and new ones attract old imports."""
    diff = changes(old, files).withColumnRenamed("relative_path", "file_path")
    new = diff.where("status IN ('added', 'changed')").select(F.col("file_path").alias("relative_path"))
    fresh = build(files.join(new, "relative_path", "left_semi"), framework)
    facts = refreshed(old.facts.where("language <> 'prisma'"), diff, fresh.facts, "file_path")
    if schemas_of is not None:
        facts = facts.unionByName(extract.facts(_sources(schemas_of.withColumn("language", F.lit("prisma")))))
    return Index(cut(files.drop("text")), cut(facts))


def report_stats(spark: SparkSession, folder: str) -> DataFrame:
    """name, bytes and tokens of each report file in a folder, by name."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
    return found.select(F.regexp_extract("path", r"([^/]+)\z", 1).alias("name"), F.col("length").alias("bytes"), token_estimate("length").alias("tokens")).orderBy("name")
