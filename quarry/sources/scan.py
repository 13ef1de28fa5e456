"""Source trees as DataFrames: path, language, time, size and, when asked for, text.

Listing and reading are Spark's own binaryFile source, so trees may lie in any store; content is read only if the
text column is used. Ending and size filters reach the listing."""

from __future__ import annotations

import fnmatch
import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Languages by file ending.
LANGUAGES = {".ts": "typescript", ".js": "javascript", ".tsx": "tsx", ".jsx": "jsx", ".py": "python", ".go": "go", ".rs": "rust", ".java": "java", ".cs": "csharp", ".php": "php", ".rb": "ruby", ".kt": "kotlin", ".kts": "kotlin", ".astro": "astro"}
#: Folder names that are never entered. Folders of other tools and of the reports are the caller's to add.
EXCLUDED = ["node_modules", ".next", ".git", ".worktrees", "__pycache__", ".turbo", "dist", "build", ".cache", "coverage", ".nyc_output", ".parcel-cache", "target", "vendor", "bin", "obj", ".venv", "venv", "env"]
#: Files whose name contains one of these are left out.
SKIPPED = [".d.ts", ".map", ".min.js", ".min.css", ".backup.", "-backup-", ".test.", ".spec.", ".stories.", "__test__", "__tests__", "__mocks__"]


def ignore_names(text: str) -> list[str]:
    """Folder names and globs of an ignore file: no comments, no trailing slash."""
    lines = (line.strip() for line in text.split("\n"))
    return [line.rstrip("/") for line in lines if line and not line.startswith("#")]


def language_of(path: Column) -> Column:
    """The language of a path by its ending, or null."""
    ending = F.regexp_extract(path, r"(\.[A-Za-z]+)\z", 1)
    out = None
    for e, name in LANGUAGES.items():
        out = F.when(ending == e, name) if out is None else out.when(ending == e, name)
    return out


def select_files(files: DataFrame, include: list[str] = (), exclude: list[str] = (), skip: list[str] = SKIPPED, ignore: list[str] = ()) -> DataFrame:
    """The files (relative_path, ..) that count, with their language.

    exclude has names of folders at any depth, and globs for names of folders or files; ignore has names of folders alone;
    include has top-level folders, and files at the root always pass."""
    path = F.col("relative_path")
    parts = F.split(path, "/")
    folders, name = F.slice(parts, 1, F.size(parts) - 1), F.element_at(parts, -1)
    names = [*EXCLUDED, *ignore, *(e for e in exclude if not re.search(r"[*?\[]", e))]
    globs = [fnmatch.translate(e).removesuffix("\\Z").removesuffix("\\z") for e in exclude if re.search(r"[*?\[]", e)]
    ok = ~F.arrays_overlap(folders, F.array(*map(F.lit, names)))
    if globs:
        ok &= ~F.exists(parts, lambda x: x.rlike(f"\\A(?:{'|'.join(globs)})\\z"))
    if include:
        ok &= (F.size(parts) == 1) | parts[0].isin(list(include))
    for s in skip:
        ok &= ~F.contains(name, F.lit(s))
    return files.withColumn("language", language_of(path)).where(ok & F.col("language").isNotNull())


def _listed(spark: SparkSession, root: str, glob: str, deep: bool, most_bytes: int | None = None) -> DataFrame:
    """relative_path, mtime_ms, size and text of the files under root whose names match.

    Spark's readers leave out files without bytes; these are what its own listing has besides, and come without a time."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", deep).option("pathGlobFilter", glob).option("ignoreMissingFiles", True).load(root)
    base = re.sub(r"^[a-z0-9]+:/*", "", root).strip("/")
    under = F.regexp_replace("path", rf"^[a-z0-9]+:/*(?:[^/]*/)??{re.escape(base)}/", "").alias("relative_path")
    every = spark.createDataFrame([(unquote(p),) for p in found.inputFiles()], "path string").select(under)
    empty = every.join(found.select(under), "relative_path", "left_anti").select("relative_path", F.lit(0.0).alias("mtime_ms"), F.lit(0).cast("long").alias("size"), F.lit("").alias("text"))
    if most_bytes:
        found = found.where(F.col("length") <= most_bytes)
    full = found.select(under, (F.unix_micros("modificationTime") / 1000).alias("mtime_ms"), F.col("length").alias("size"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return full.unionByName(empty)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def ignored(spark: SparkSession, root: str) -> list[str]:
    """The folder names of the tree's ignore file; globs and negations in it are no names and match nothing."""
    path = f"{root.rstrip('/')}/.gitignore"
    if not exists(spark, path):
        return []
    p = spark._jvm.org.apache.hadoop.fs.Path(path)  # Spark's readers leave out hidden files
    opened = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return ignore_names(spark._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8"))
    finally:
        opened.close()


def scan(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = (), most_bytes: int | None = None, ignore: list[str] | None = None) -> DataFrame:
    """relative_path, language, mtime_ms, size and text of the source files under root; by default its ignore file counts."""
    rows = _listed(spark, root, "*.{" + ",".join(e[1:] for e in LANGUAGES) + "}", True, most_bytes)
    names = ignored(spark, root) if ignore is None else ignore
    return select_files(rows, include, exclude, ignore=names).select("relative_path", "language", "mtime_ms", "size", "text")


def project_files(spark: SparkSession, root: str) -> DataFrame:
    """relative_path and text of the files at the root of a tree that tell its framework, whatever their endings."""
    return _listed(spark, root, "{package.json,next.config.*,astro.config.*,manage.py}", False).select("relative_path", "text")


#: Where a Prisma schema is looked for, in order.
PRISMA = ["prisma/schema.prisma", "schema.prisma", "prisma/schema/schema.prisma"]


def schema_files(spark: SparkSession, root: str, schema: list[str] = ()) -> DataFrame | None:
    """relative_path and text of the given Prisma schemas, or of the first of the usual ones; None where there is none."""
    asked = [p for p in schema if p.endswith(".prisma")] if schema else PRISMA
    there = [p for p in asked if exists(spark, f"{root.rstrip('/')}/{p}")]
    there = there if schema else there[:1]
    out = None
    for p in there:
        one = spark.read.text(f"{root.rstrip('/')}/{p}", wholetext=True).select(F.lit(p).alias("relative_path"), F.col("value").alias("text"))
        out = one if out is None else out.unionByName(one)
    return out
