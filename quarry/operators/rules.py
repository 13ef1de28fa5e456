"""Rules over symbols, types, files and edges. Each gives findings; audit() scores, joins heat and ranks them.

A rule is a function of Facts registered with its place in the order; it returns rule-specific columns, and
the shared builder adds rule, order and score. Heat, the in-degree of a file, is joined once for all rules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import any_of, base_name, dir_name, heat_score, is_entry_point, naming_style, stem, type_root
from ..plans.cut import cut
from . import graph

#: Names of files that gather unrelated helpers.
JUNK = r"(?i)\A(utils?|helpers?|lib|libs|misc|common|shared|stuff|etc|things)\z"
#: Marks of superseded code.
LEGACY = r"(?i)(^|_)(old|legacy|deprecated|backup|v[0-9]+)(\z|_)"
#: Folders of the data layer and of the layer above it.
DATA_LAYER = ["lib/", "data/", "db/", "models/", "services/"]
UI_LAYER = ["pages/", "app/", "components/", "views/", "routes/"]
#: Export names that repeat by convention.
COMMON_NAMES = ["default", "index", "main", "run", "init", "get", "set", "toString", "GET", "POST", "PUT", "DELETE", "PATCH", "loader", "action", "meta", "handler", "config"]
TYPE_KINDS = ["interface", "type", "enum"]


@dataclass
class Facts:
    """The relations a rule may use. Edges and heat (file_path, heat, imports) are cut once, because every rule needs
    them and import resolution would run again for each."""

    files: DataFrame
    symbols: DataFrame
    types: DataFrame
    edges: DataFrame

    def __post_init__(self) -> None:
        self.edges = cut(self.edges)

    @cached_property
    def heat(self) -> DataFrame:
        d = graph.degrees(self.edges)
        return cut(d.select(F.col("node").alias("file_path"), F.col("imported_by").alias("heat"), "imports"))

    @property
    def exports(self) -> DataFrame:
        return self.symbols.where("is_exported")

    def with_heat(self, df: DataFrame, on: str = "file_path") -> DataFrame:
        h = self.heat.withColumnRenamed("file_path", on)
        return df.join(h, on, "left").withColumn("heat", F.coalesce("heat", F.lit(0)).cast("long")).withColumn("imports", F.coalesce("imports", F.lit(0)))


RULES: list[tuple[str, Callable[[Facts], DataFrame]]] = []


def rule(name: str) -> Callable:
    def put(f: Callable) -> Callable:
        RULES.append((name, f))
        return f

    return put


def finding(df: DataFrame, severity: Column | str, title: Column, signals: list[Column], action: str, heat: Column | None = None, related: Column | None = None) -> DataFrame:
    """The shared shape; signals that are null are left out."""
    level = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(level.alias("severity"), "file_path", (related if related is not None else F.array().cast("array<string>")).alias("related_files"), title.alias("title"), F.array_compact(F.array(*signals)).alias("signals"), F.lit(action).alias("action"), (heat if heat is not None else F.lit(0)).cast("long").alias("heat"))


def _members(f: Facts, rows: DataFrame, group: str) -> DataFrame:
    """group, file_path (the hottest), heat, related: others by heat, then path."""
    hot = f.with_heat(rows.select(group, "file_path").distinct())
    g = hot.groupBy(group).agg(F.array_sort(F.collect_set(F.struct((-F.col("heat")).alias("h"), F.col("file_path").alias("p")))).alias("all"))
    return g.select(group, F.col("all")[0]["p"].alias("file_path"), (-F.col("all")[0]["h"]).alias("heat"), F.transform(F.slice("all", 2, F.size("all")), lambda x: x["p"]).alias("related"), F.size("all").alias("n_files"))


@rule("junk-drawer")
def junk_drawer(f: Facts) -> DataFrame:
    n = F.col("n")
    g = f.with_heat(f.exports.where(stem("file_path").rlike(JUNK)).groupBy("file_path").agg(F.count("*").alias("n")).where("n >= 5"))
    level = F.when(n >= 15, "critical").when(n >= 8, "high").otherwise("medium")
    return finding(g, level, F.concat(F.lit("Catch-all file "), base_name("file_path")), [F.format_string("%d exports without a common subject", n), F.format_string("imported by %d files", "heat")], "Split it by subject", F.col("heat"))


@rule("monolith")
def monolith(f: Facts) -> DataFrame:
    g = f.exports.groupBy("file_path").agg(F.count("*").alias("n"), F.count_if(~F.col("kind").isin(TYPE_KINDS)).alias("code"))
    typed = f.types.where("is_exported").select("file_path").distinct().withColumn("typed", F.lit(True))
    g = g.where("n >= 15").join(typed, "file_path", "left").where((F.col("code") > 0) | F.col("typed").isNull()).where(~stem("file_path").rlike(JUNK))
    return finding(f.with_heat(g), F.when(F.col("n") >= 25, "critical").otherwise("high"), F.concat(F.lit("Very large module "), base_name("file_path")), [F.format_string("%d exports in one file", "n")], "Divide it into smaller modules", F.col("heat"))


@rule("circular-dependency")
def cycles(f: Facts) -> DataFrame:
    c = graph.scc(f.edges).withColumnRenamed("node", "file_path")
    g = _members(f, c, "component")
    chain = F.concat(F.array_join(F.concat(F.array("file_path"), "related"), " -> "), F.lit(" -> "), F.col("file_path"))
    return finding(g, "critical", F.format_string("Cycle of %d files", "n_files"), [chain], "Move what they share into a file of its own", F.col("heat"), F.col("related"))


@rule("layer-violation")
def layers(f: Facts) -> DataFrame:
    e = f.edges.where(any_of("src", DATA_LAYER) & any_of("dst", UI_LAYER)).withColumnRenamed("src", "file_path")
    return finding(f.with_heat(e), "high", F.lit("Data layer imports user interface"), [F.concat("file_path", F.lit(" imports "), "dst")], "Turn the dependency around", F.col("heat"), F.array("dst"))


@rule("duplicated-domain")
def duplicates(f: Facts) -> DataFrame:
    named = f.exports.where(~F.col("name").isin(COMMON_NAMES))
    # count(distinct) of two columns would expand rows; equal extremes say the same of one.
    many = named.groupBy("name").agg(F.min("language").alias("l1"), F.max("language").alias("l2"), F.min("file_path").alias("f1"), F.max("file_path").alias("f2")).where("l1 = l2 AND f1 < f2").select("name")
    g = _members(f, named.join(many, "name"), "name")
    return finding(g, "high", F.format_string("%s is exported by %d files", "name", "n_files"), [F.array_join(F.concat(F.array("file_path"), "related"), ", ")], "Keep one definition", F.col("heat"), F.col("related"))


@rule("type-sprawl")
def sprawl(f: Facts) -> DataFrame:
    t = f.types.where("is_exported").withColumn("root", type_root("name")).where("root IS NOT NULL")
    names = t.groupBy("root").agg(F.array_sort(F.collect_set("name")).alias("names")).where(F.size("names") >= 3)
    g = _members(f, t.join(names.select("root"), "root", "left_semi"), "root").join(names, "root")
    return finding(g, "high", F.format_string("%d variants of %s", F.size("names"), F.col("root")), [F.array_join("names", ", "), F.format_string("%d files", "n_files")], "Keep one shape of it", F.col("heat"), F.col("related"))


@rule("legacy-marker")
def legacy(f: Facts) -> DataFrame:
    folder = F.exists(F.split(dir_name("file_path"), "/"), lambda x: x.rlike(LEGACY))  # per segment
    files = f.with_heat(f.files.select(F.col("relative_path").alias("file_path")).where(stem("file_path").rlike(LEGACY) | folder))
    one = finding(files, "high", F.concat(F.lit("Superseded file "), base_name("file_path")), [F.when(F.col("heat") > 0, F.format_string("still imported by %d files", "heat")).otherwise("nothing imports it")], "Move its users, then delete it", F.col("heat"))
    marked = f.exports.where(F.col("name").rlike(LEGACY)).where(~stem("file_path").rlike(LEGACY))
    g = f.with_heat(marked.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("seq", "name"))).alias("all")))
    two = finding(g, "high", F.concat(F.lit("Superseded exports in "), base_name("file_path")), [F.array_join(F.transform("all", lambda x: x["name"]), ", ")], "Remove them once nothing calls them", F.col("heat"))
    return one.unionByName(two)


@rule("dead-file")
def dead(f: Facts) -> DataFrame:
    g = f.files.select(F.col("relative_path").alias("file_path")).where(~is_entry_point("file_path")).join(f.heat, "file_path", "left_anti")
    return finding(g, "medium", F.concat(F.lit("Unconnected file "), base_name("file_path")), [F.lit("no imports in or out"), F.lit("not an entry point")], "Check its use; else delete it")


@rule("unused-export")
def unused(f: Facts) -> DataFrame:
    g = f.exports.groupBy("file_path").agg(F.count("*").alias("n")).where(~is_entry_point("file_path"))
    g = f.with_heat(g).where("heat = 0 AND imports > 0")
    return finding(g, "medium", F.concat(F.lit("Exports without importers in "), base_name("file_path")), [F.format_string("%d exports, no importer", "n"), F.format_string("%d imports", "imports")], "Use it or delete it")


@rule("naming-inconsistency")
def naming(f: Facts) -> DataFrame:
    style = naming_style("name")

    def first(kind: str) -> Column:
        return F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.when(style == kind, F.struct("seq", "name")))), 1, 3), lambda x: x["name"]), ", ").alias(f"{kind}_names")

    g = f.exports.groupBy("file_path").agg(F.count("*").alias("n"), F.count_if(style == "camel").alias("camel"), F.count_if(style == "snake").alias("snake"), first("camel"), first("snake"))
    g = f.with_heat(g.where("n >= 4 AND camel >= 2 AND snake >= 2"))
    return finding(g, "low", F.concat(F.lit("Two naming styles in "), base_name("file_path")), [F.format_string("%d in camel case: %s", "camel", "camel_names"), F.format_string("%d in snake case: %s", "snake", "snake_names")], "Choose one style", F.col("heat"))


def audit(facts: Facts, only: list[str] | None = None) -> DataFrame:
    """All findings, the highest score first; ties by rule order, then path and title."""
    out = None
    for order, (name, f) in enumerate(RULES, 1):
        if only and name not in only:
            continue
        rows = f(facts).withColumn("rule", F.lit(name)).withColumn("rule_order", F.lit(order))
        out = rows if out is None else out.unionByName(rows)
    scored = out.withColumn("score", heat_score("severity", "heat"))
    return scored.select("rule", "rule_order", "severity", "file_path", "related_files", "title", "signals", "action", "heat", "score").orderBy(F.desc("score"), "rule_order", "file_path", "title")


def severity_counts(findings: DataFrame) -> DataFrame:
    """The number of findings of each of the four severities, zeros included, in one aggregate."""
    return findings.agg(*(F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")))
