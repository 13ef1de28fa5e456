"""Framework detection: one aggregate over the paths of a project, then the first rule that holds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scan import project_files


@dataclass(frozen=True)
class Framework:
    id: str
    name: str
    entry_points: tuple[str, ...] = ()


#: Entry points by framework.
NEXT_APP = ("app/layout.tsx", "app/layout.ts", "app/layout.jsx")
NEXT_PAGES = ("pages/_app.tsx", "pages/_app.ts", "pages/_app.jsx")
NEXT_BOTH = ("app/layout.tsx", "app/layout.ts", "pages/_app.tsx", "pages/_app.ts")
NODE = ("src/index.ts", "src/app.ts", "src/server.ts", "index.ts")
FLASK_FILES = ["app.py", "main.py", "src/app.py", "src/main.py"]


def _signs(files: DataFrame, by: list[str]) -> DataFrame:
    """One row for each project of what its paths, and the texts of a handful of files, show."""
    p, text = F.col("relative_path"), F.col("text")
    has = {
        "next": p.rlike(r"\Anext\.config\.(js|mjs|ts)\z"), "app": p.startswith("app/"), "pages": p.startswith("pages/"),
        "astro": p.rlike(r"\Aastro\.config\.(mjs|ts|js)\z"), "django": p == "manage.py",
    }
    flask = [F.coalesce(F.bool_or((p == f) & F.substring(text, 1, 2000).rlike("(from|import) flask")), F.lit(False)) for f in FLASK_FILES]
    package = F.max(F.when(p == "package.json", text))
    both = [F.coalesce(F.from_json(F.get_json_object(package, f"$.{k}"), "map<string,string>"), F.create_map().cast("map<string,string>")) for k in ("dependencies", "devDependencies")]
    uses = [F.coalesce(F.nullif(both[1][n], F.lit("")), F.nullif(both[0][n], F.lit(""))).isNotNull().alias(n) for n in ("fastify", "express")]
    return files.groupBy(*by).agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(k) for k, c in has.items()), *uses, F.array(*flask).alias("flask"))


def detect_projects(files: DataFrame, by: list[str]) -> DataFrame:
    """by and id: the framework of each project from its files (by, relative_path, text), by the first rule that holds.

    Order: Next, Astro, Fastify, Express, Django, Flask, generic."""
    both, app, pages = F.col("app") & F.col("pages"), F.col("app"), F.col("pages")
    kind = F.when(F.col("next") & both, "nextjs-both").when(F.col("next") & app, "nextjs-app").when(F.col("next") & pages, "nextjs-pages")
    for k in ("astro", "fastify", "express", "django"):
        kind = kind.when(F.col(k), k)
    return _signs(files, by).select(*by, kind.when(F.array_contains("flask", True), "flask").otherwise("generic").alias("id"), "flask")


#: Names and entry points by framework.
KNOWN = {
    "nextjs-both": ("Next.js (App and Pages Router)", NEXT_BOTH),
    "nextjs-app": ("Next.js (App Router)", NEXT_APP),
    "nextjs-pages": ("Next.js (Pages Router)", NEXT_PAGES),
    "astro": ("Astro", ("src/pages/index.astro", "src/layouts/Layout.astro")),
    "fastify": ("Fastify", NODE),
    "express": ("Express", (*NODE, "app.ts", "server.ts")),
    "django": ("Django", ("manage.py",)),
    "flask": ("Flask", ()),
    "generic": ("Generic", ()),
}


def detect(files: DataFrame) -> Framework:
    """The framework of one project from its files (relative_path, text): source files and project files."""
    row = detect_projects(files.select("relative_path", "text"), []).first()
    name, entry_points = KNOWN[row.id]
    if row.id == "flask":
        entry_points = (next(f for f, on in zip(FLASK_FILES, row.flask, strict=True) if on),)
    return Framework(row.id, name, entry_points)


def detect_tree(spark: SparkSession, root: str, files: DataFrame) -> Framework:
    """The framework of a scanned tree; files that tell it are listed for themselves, because a scan leaves out their endings."""
    return detect(files.select("relative_path", "text").unionByName(project_files(spark, root)))
