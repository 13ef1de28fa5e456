"""Import resolution as a priority lookup join.

Each import has a target: what its candidates depend on, such as the path that a relative import names. Each distinct
target makes a short array of candidate keys with priorities; candidates are exploded and equi-joined with a table of keys
that files answer to, and the best hit by (priority, scan order) wins. Prefixes, suffixes, stems and folder runs are such
keys too, so no resolver scans the files. All joins are shuffled: the sizes that Spark estimates for exploded keys are those
of the narrow columns below them, a small part of the truth, and would send millions of rows through the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import dir_name, normalise_path

SCRIPTS = ["typescript", "javascript", "tsx", "jsx", "astro"]
#: Endings tried for a script import, in order.
SCRIPT_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".astro"]
CANDIDATE = "array<struct<kind:string,key:string>>"


def _path(*parts: Column) -> Column:
    return F.struct(F.lit("path").alias("kind"), F.concat(*parts).alias("key"))


def _key(kind: str, key: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), key.alias("key"))


def _join(folder: Column, path: Column) -> Column:
    return normalise_path(F.concat(folder, F.lit("/"), path))


def _targets(languages: set[str]) -> Column:
    """way, base and rest of a row (language, folder, source): equal ones have the same candidates. Only rules of `languages`
    go into the expression, which is otherwise too large to be compiled."""
    lang, folder, s = F.col("language"), F.col("folder"), F.col("source")

    def target(way: str, base: Column, rest: Column | None = None) -> Column:
        return F.struct(F.lit(way).alias("way"), base.alias("base"), (F.lit("") if rest is None else rest).alias("rest"))

    nothing = target("", s, folder)  # by folder too, so that a popular package is not one key
    script = F.when(s.startswith("@/"), target("script", F.regexp_replace(s, "^@/", "src/"))).when(s.startswith("."), target("script", _join(folder, s))).otherwise(nothing)

    dots = F.length(F.regexp_extract(s, r"^(\.+)", 1))
    module = F.regexp_replace(F.regexp_replace(s, r"^\.+", ""), r"\.", "/")
    up = _join(folder, F.concat(F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))), module))
    python = F.when((dots > 0) & (module == ""), nothing).when(dots > 0, target("python near", up)).otherwise(target("python", module))

    inner = F.regexp_replace(F.regexp_replace(s, "^(crate|super|self)::", ""), "::", "/")
    rust_base = F.when(s.startswith("crate::"), F.concat(F.lit("src/"), inner)).when(s.startswith("super::"), _join(folder, F.concat(F.lit("../"), inner))).otherwise(_join(folder, inner))
    rust = F.when(s.rlike("^(crate|super|self)::"), target("rust", rust_base)).otherwise(nothing)

    php = F.when(s.startswith("./") | s.startswith("../"), target("php near", _join(folder, s))).otherwise(target("php", s))
    ruby = target("ruby", _join(folder, s), s)
    ways = [(SCRIPTS, script), (["python"], python), (["go"], target("go", s)), (["rust"], rust), (["java"], target("java", s)), (["kotlin"], target("kotlin", s)), (["csharp"], target("csharp", s)), (["php"], php), (["ruby"], ruby)]
    return F.coalesce(*(F.when(lang.isin(names), way) for names, way in ways if languages & {*names}), nothing)


def _candidates(languages: set[str]) -> Column:
    """The candidates of a target (way, base, rest), best first."""
    way, base, rest = F.col("way"), F.col("base"), F.col("rest")
    nothing = F.array().cast(CANDIDATE)

    cut = F.regexp_replace(base, r"\.(ts|tsx|js|jsx)\z", "")
    script = F.array(_path(base), _key("stem", cut), *(_key("stem", F.concat(b, F.lit("/index"))) for b in (cut, base)))

    ends = [".py", "/__init__.py"]
    near = F.array(*(_path(base, F.lit(e)) for e in ends))
    python = F.array(*(_path(F.lit(p), base, F.lit(e)) for p in ("", "src/") for e in ends))

    parts = F.split(base, "/")
    go = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: _key("go", F.array_join(F.slice(parts, i, F.size(parts)), "/")))).otherwise(nothing)

    rust = F.array(_path(base, F.lit(".rs")), _path(base, F.lit("/mod.rs")))

    ext = F.when(way == "java", ".java").otherwise(".kt")
    last = F.element_at(F.split(base, r"\."), -1)
    jvm = F.array(_key("tail", F.concat(F.regexp_replace(base, r"\.", "/"), ext)), _key("name", F.concat(last, ext)), _key("name", F.concat(last, F.lit(".kts"))))

    names = F.split(base, r"\.")
    dotnet = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: _key("run", F.array_join(F.slice(names, i, F.size(names)), "/")))

    php_path = F.concat(F.regexp_replace(base, r"\\", "/"), F.lit(".php"))
    php = F.array(_path(php_path), _path(F.lower(F.substring(php_path, 1, 1)), F.expr("substring(replace(base, '\\\\', '/') || '.php', 2)")), _path(F.lit("src/"), php_path))

    ruby = F.array(_path(base, F.lit(".rb")), _path(base), _path(F.lit("lib/"), rest, F.lit(".rb")), _path(F.lit("app/"), rest, F.lit(".rb")))
    ways = [(SCRIPTS, "script", script), (["python"], "python near", near), (["python"], "python", python), (["go"], "go", go), (["rust"], "rust", rust), (["java"], "java", jvm), (["kotlin"], "kotlin", jvm), (["csharp"], "csharp", dotnet), (["php"], "php near", F.array(_path(base))), (["php"], "php", php), (["ruby"], "ruby", ruby)]
    return F.coalesce(*(F.when(way == name, found) for of, name, found in ways if languages & {*of}), nothing)


def file_keys(files: DataFrame, languages: set[str]) -> DataFrame:
    """kind, key, path, rank: every key a file (relative_path) answers to for imports of `languages`, and the place of a
    stem's ending in SCRIPT_EXTENSIONS. A path of d folders has d tails and d * d runs."""
    p = F.col("relative_path")
    parts = F.split(p, "/")
    n = F.size(parts)
    stems = F.concat(F.slice(parts, 1, n - 1), F.array(F.regexp_replace(F.element_at(parts, -1), r"\.cs\z", "")))
    folders = F.when(p.endswith(".go") & (n > 1), F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: _key("go", F.array_join(F.slice(parts, 1, i), "/")))).otherwise(F.array().cast(CANDIDATE))
    jvm = p.rlike(r"\.(java|kt|kts)\z")
    tails = F.when(jvm, F.transform(F.sequence(F.lit(1), n), lambda i: _key("tail", F.array_join(F.slice(parts, i, n), "/")))).otherwise(F.array().cast(CANDIDATE))
    name = F.when(jvm & (n > 1), F.array(_key("name", F.element_at(parts, -1)))).otherwise(F.array().cast(CANDIDATE))
    to_end = F.transform(F.sequence(F.lit(1), n), lambda i: _key("run", F.array_join(F.slice(stems, i, n), "/")))
    between = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.transform(F.sequence(F.lit(1), F.greatest(n - i, F.lit(1))), lambda k: _key("run", F.array_join(F.slice(parts, i, k), "/")))))
    runs = F.when(p.endswith(".cs"), F.when(n > 1, F.concat(to_end, between)).otherwise(to_end)).otherwise(F.array().cast(CANDIDATE))
    ending = F.regexp_extract(p, rf"({'|'.join(e.replace('.', r'\.') for e in SCRIPT_EXTENSIONS)})\z", 1)
    stem = F.when(ending != "", F.array(_key("stem", F.expr("left(relative_path, length(relative_path) - length(ending))")))).otherwise(F.array().cast(CANDIDATE))
    more = [k for names, keys in (({*SCRIPTS}, [stem]), ({"go"}, [folders]), ({"java", "kotlin"}, [tails, name]), ({"csharp"}, [runs])) if languages & names for k in keys]
    every = F.array_distinct(F.concat(F.array(_path(p)), *more)) if more else F.array(_path(p))
    rank = F.when(F.col("k.kind") == "stem", F.array_position(F.array(*map(F.lit, SCRIPT_EXTENSIONS)), F.col("ending"))).otherwise(0)
    return files.select("relative_path", ending.alias("ending")).select(p.alias("path"), "ending", F.explode(every).alias("k")).select("k.kind", "k.key", "path", rank.cast("int").alias("rank"))


def resolve(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports with resolved_path and is_external; a hit makes an import internal, others stay as they are.

    Targets are made distinct first, so a file that many folders import is looked up once. Ties between files go to
    the first in scan order, a Unicode collation of paths."""
    languages = {r.language for r in imports.select("language").distinct().collect()}  # one row a language
    target = ["way", "base", "rest"]
    aimed = imports.withColumn("folder", dir_name("file_path")).withColumn("t", _targets(languages)).select(*imports.columns, *(F.col(f"t.{c}").alias(c) for c in target))
    asked = aimed.where("way <> ''").select(target).distinct()
    each = asked.select(*target, F.posexplode(_candidates(languages)).alias("priority", "k")).select(*target, "priority", "k.kind", "k.key")
    # Of the files with one key only the first in scan order can win, so a popular folder is one row, not many.
    first = F.struct("rank", F.collate("path", "UNICODE").alias("o"), F.col("path").alias("p"))
    known = file_keys(files, languages).groupBy("kind", "key").agg(F.min_by("path", first).alias("path"))
    hits = each.join(known.hint("merge"), ["kind", "key"]).groupBy(target).agg(F.min_by("path", "priority").alias("hit"))
    out = aimed.join(hits.hint("merge"), target, "left")
    return out.withColumn("resolved_path", F.col("hit")).withColumn("is_external", F.col("is_external") & F.col("hit").isNull()).select(imports.columns)
