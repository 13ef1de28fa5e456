"""Markdown reports as lines. Ranking, grouping and ordering happen in Spark; lines are written as they arrive, a partition
of sorted rows at a time, so a report may be as long as the index asks for and nothing is left out without a count."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import entry_role, is_entry_point, tree_annotation
from ..operators import graph, routes
from ..operators.ranking import kind_order, top_per_group
from ..operators.rules import severity_counts
from ..sources.frameworks import Framework
from .index import Index

Lines = Iterator[str]
LEVELS = ("critical", "high", "medium", "low")


def _rest(n: int, what: str) -> list[str]:
    return [f"...and {n} more {what}"] if n else []


def _headed(rows: DataFrame, title: str, group: str, line) -> Lines:
    """A heading for each group of sorted rows, and what `line` makes of each row; nothing without rows."""
    last = None
    for r in rows.toLocalIterator():
        if last is None:
            yield f"# {title}"
        if r[group] != last:
            last = r[group]
            yield from ("", f"## {last}")
        yield from line(r)


def export_rows(ix: Index, most: int = 4) -> DataFrame:
    """The first `most` exported symbols of each file by kind and name, with rank and the number left out."""
    return top_per_group(ix.relation("symbols").where("is_exported"), ["file_path"], [*kind_order(), F.col("seq")], most)


def exports(ix: Index, most: int = 4) -> Lines:
    """Exported symbols by file, `most` for each."""

    def line(r) -> Lines:
        yield f"- {r['kind']} {r['name']}{r.signature if r['kind'] in ('function', 'method') else ''}"
        if r["rank"] == most and r.more:
            yield f"- +{r.more} more"

    return _headed(export_rows(ix, most).orderBy("file_path", "rank"), "Exports", "file_path", line)


def type_rows(ix: Index) -> DataFrame:
    """Types with their first fields and the number left out: 5 of an interface, 8 of an enum or 6 of a longer one."""
    n = F.size("fields")
    shown = F.when((F.col("kind") == "enum") & (n > 8), 6).when(F.col("kind") == "enum", 8).otherwise(5)
    return ix.relation("types").select("file_path", "seq", "kind", "name", F.slice("fields", 1, shown).alias("head"), F.greatest(F.lit(0), n - shown).alias("more"))


def types(ix: Index) -> Lines:
    """Types by file."""

    def line(r) -> Lines:
        fields = [f.name + ("?" if f.optional else "") + (f": {f.type}" if f.type else "") for f in r["head"]] + _rest(r.more, "fields")
        yield f"- {r['kind']} {r['name']}" + (f" {{ {', '.join(fields)} }}" if fields else "")

    return _headed(type_rows(ix).orderBy("file_path", "seq"), "Types", "file_path", line)


def route_list(ix: Index) -> Lines:
    """Routes by prefix; large groups are summarised with three examples."""
    for i, r in enumerate(routes.prefix_groups(ix.relation("routes")).orderBy("prefix").toLocalIterator()):
        if not i:
            yield from ("# Routes", "")
        yield f"- {r.prefix}: {r.n} routes, {r.methods}{', checked user' if r.auth else ''} ({r.examples})"


def model_list(ix: Index) -> Lines:
    """Models with their fields; compact where at most three plain fields and two relations."""
    for i, r in enumerate(ix.relation("models").orderBy("file_path", "seq").toLocalIterator()):
        if not i:
            yield from ("# Models", "")
        plain = [f for f in r.fields if not f.is_relation]
        text = [f.name + ":" + f.type + ("" if f.required else "?") + (f" ({', '.join(f.attributes)})" if f.attributes else "") for f in r.fields]
        compact = len(plain) <= 3 and len(r.fields) - len(plain) <= 2
        yield f"## {r['name']} [{r.orm}]" + (f": {', '.join(text)}" if compact else "")
        yield from () if compact else (f"- {t}" for t in text)


def graph_report(ix: Index, hot: int = 15, packages: int = 10) -> Lines:
    """The files most depended on and the packages most used; nothing without edges."""
    imports = ix.relation("imports")
    edges = graph.edges_from_imports(imports)
    top = graph.hottest(edges, hot).collect()
    if not top:
        return
    used = graph.external_packages(imports)
    yield from ("# Dependencies", "", f"{edges.count()} imports between {graph.connected_count(edges).first()[0]} files", "")
    yield from (f"- {r.node}: imported by {r.imported_by}, imports {r.imports}" for r in top)
    yield from (*_rest(top[0].more, "files"), "", "## Packages")
    yield from (f"- {r.package}: {r.used_by} files" for r in used.orderBy(F.desc("used_by"), "package").limit(packages).collect())
    yield from _rest(max(0, used.count() - packages), "packages")


def _finding(r, related: int = 5) -> Lines:
    files = list(r.related_files[:related]) + _rest(max(0, len(r.related_files) - related), "files")
    yield f"- [{r.score}] {r.rule}: {r.title} ({r.file_path})" + (f", imported by {r.heat}" if r.heat else "")
    yield from (f"  - {s}" for s in r.signals)
    yield from ([f"  - with {', '.join(files)}"] if files else []) + [f"  - {r.action}"]


def audit_report(findings: DataFrame, top: int = 10) -> Lines:
    """The counts by severity, the `top` highest scores, then every finding by severity."""
    counts = severity_counts(findings).first().asDict()
    n = sum(counts.values())
    if not n:
        return
    yield from ("# Findings", "", ", ".join(f"{k}: {counts[k]}" for k in LEVELS), "", "## First to look at", "")
    yield from (f"- [{r.score}] {r.severity} {r.rule}: {r.title} ({r.file_path})" for r in findings.limit(top).collect())
    yield from _rest(max(0, n - top), "findings")
    order = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("severity"))
    yield from _headed(findings.orderBy(order, F.desc("score"), "rule_order", "file_path", "title"), "By severity", "severity", _finding)


def tree_rows(ix: Index, framework: Framework | None = None, most: int = 8, shown: int = 5) -> DataFrame:
    """The tree's lines in order: path, name, depth, is_dir, annotation; folders first, then names. A folder with more than
    `most` entries has the first `shown` and a line with the number left out, whose name is null."""
    tree = graph.file_tree(ix.files)
    cut = top_per_group(tree, ["parent"], [F.desc("is_dir"), F.collate("name", "UNICODE"), F.col("name")], most)
    kept = cut.where((F.col("more") == 0) | (F.col("rank") <= shown))
    dots = kept.where((F.col("more") > 0) & (F.col("rank") == shown)).select(F.concat_ws("/", F.nullif("parent", F.lit("")), F.lit("\0")).alias("path"), F.lit(None).cast("string").alias("name"), "depth", F.lit(False).alias("is_dir"), F.lit(shown + 1).alias("rank"), (F.col("more") + most - shown).alias("more"))
    rows = kept.select("path", "name", "depth", "is_dir", "rank", F.lit(0).cast("long").alias("more")).unionByName(dots)
    # A line is shown if all its folders are; their ranks, from the root, give its place.
    parts = F.split("path", "/")
    steps = rows.select("path", F.explode(F.sequence(F.lit(1), "depth")).alias("d")).withColumn("step", F.array_join(F.slice(F.split("path", "/"), 1, F.col("d")), "/"))
    places = steps.join(rows.select(F.col("path").alias("step"), "rank"), "step").groupBy("path").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("d", "rank"))), lambda x: x["rank"]).alias("place"))
    note = tree_annotation("path", framework.id, framework.entry_points) if framework else tree_annotation("path", "generic")
    out = rows.join(places, "path").where(F.size(parts) == F.col("n"))
    return out.select("path", "name", "depth", "is_dir", F.when(~F.col("is_dir") & F.col("name").isNotNull(), note).alias("annotation"), "more", "place").orderBy("place")


def structure(ix: Index, framework: Framework | None = None) -> Lines:
    """Framework, languages, the tree with annotations, and entry points."""
    counts = ix.counts().first()
    yield from ("# Structure", "", f"Framework: {framework.name if framework else 'Generic'}", f"Languages: {counts.languages}", f"Files: {counts.files}", "")
    for r in tree_rows(ix, framework).toLocalIterator():
        pad = "  " * (r.depth - 1)
        yield f"{pad}...{r.more} more" if r["name"] is None else f"{pad}{r['name']}{'/' if r.is_dir else f' [{r.annotation}]' if r.annotation else ''}"
    known = list(framework.entry_points) if framework else []
    entries = ix.files.where(is_entry_point("relative_path") | F.col("relative_path").isin(known)).select("relative_path", entry_role("relative_path").alias("role")).orderBy("relative_path")
    yield from ("", "## Entry points")
    yield from (f"- {r.relative_path}: {r.role}" for r in entries.toLocalIterator())


def reports(ix: Index, framework: Framework | None = None) -> dict[str, Lines]:
    """Every report by file name; one without lines has nothing to report, and an old file of it should go."""
    return {"structure.md": structure(ix, framework), "exports.md": exports(ix), "types.md": types(ix), "routes.md": route_list(ix), "schema.md": model_list(ix), "graph.md": graph_report(ix), "audit.md": audit_report(ix.findings())}


def write_all(ix: Index, folder: str, framework: Framework | None = None) -> list[str]:
    """Write the reports that have lines and remove old files of the others; the names written."""
    os.makedirs(folder, exist_ok=True)
    out = []
    for name, lines in reports(ix, framework).items():
        path, first = os.path.join(folder, name), next(lines, None)
        if first is None:
            if os.path.exists(path):
                os.remove(path)
            continue
        with open(path, "w", encoding="utf-8") as f:
            f.write(f"{first}\n")
            f.writelines(f"{line}\n" for line in lines)
        out.append(name)
    return out


def blast_lines(path: str, hit: dict[str, DataFrame], files: int = 20, most_routes: int = 10) -> Lines:
    """What depends on a file: the nearest files, routes, each with the number left out, and all models."""
    n = hit["files"].count()
    yield f"{path}: {n} files depend on it"
    yield from (f"  {r.node} ({r.hop})" for r in hit["files"].orderBy("hop", "node").limit(files).collect())
    yield from (f"  {x}" for x in _rest(max(0, n - files), "files"))
    if n_routes := hit["routes"].count():
        yield "routes:"
        yield from (f"  {r.route}" for r in hit["routes"].orderBy("route").limit(most_routes).collect())
        yield from (f"  {x}" for x in _rest(max(0, n_routes - most_routes), "routes"))
    for i, r in enumerate(hit["models"].orderBy("name").toLocalIterator()):
        yield from ([] if i else ["models:"]) + [f"  {r['name']}"]


def stats_lines(stats: DataFrame) -> Lines:
    """Bytes and tokens of each report and of all."""
    total = [0, 0]
    for r in stats.toLocalIterator():
        yield f"{r['name']}: {r.bytes} bytes, about {r.tokens} tokens"
        total = [total[0] + r.bytes, total[1] + r.tokens]
    yield f"total: {total[0]} bytes, about {total[1]} tokens"
