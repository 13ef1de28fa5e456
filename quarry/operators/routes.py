"""Route listings: REST templates, groups by prefix, collapse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import route_prefix
from .ranking import top_per_group

#: The actions of a plural resource (method, action, path after /name).
RESOURCES = [("GET", "index", ""), ("GET", "new", "/new"), ("POST", "create", ""), ("GET", "show", "/:id"), ("GET", "edit", "/:id/edit"), ("PATCH", "update", "/:id"), ("DELETE", "destroy", "/:id")]
#: Those of a singular one.
RESOURCE = [("GET", "new", "/new"), ("POST", "create", ""), ("GET", "show", ""), ("GET", "edit", "/edit"), ("PATCH", "update", ""), ("DELETE", "destroy", "")]


def templates(spark: SparkSession) -> DataFrame:
    rows = [("resources", *r) for r in RESOURCES] + [("resource", *r) for r in RESOURCE]
    return spark.createDataFrame(rows, "form string, method string, action string, tail string")


def expand(resources: DataFrame) -> DataFrame:
    """One route for each allowed action of each resource (name, form, only, except; the lists may be null).

    The template has 13 rows, so it may be broadcast at any size of the other side."""
    out = resources.join(F.broadcast(templates(resources.sparkSession)), "form")
    keep = (F.col("only").isNull() | F.array_contains("only", F.col("action"))) & (F.col("except").isNull() | ~F.array_contains("except", F.col("action")))
    return out.where(F.coalesce(keep, F.lit(True))).select("name", "action", "method", F.concat(F.lit("/"), F.col("name"), F.col("tail")).alias("path"))


def prefix_groups(routes: DataFrame, most: int = 5, examples: int = 3) -> DataFrame:
    """prefix, n, methods, auth, examples: groups of more than `most` routes keep `examples` of them, others all.

    Methods are listed in alphabetical order, and examples in order of path and method."""
    rows = routes.withColumn("prefix", route_prefix("path"))
    sums = rows.groupBy("prefix").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("method")), ",").alias("methods"), F.bool_or("auth").alias("auth"))
    first = top_per_group(rows, ["prefix"], [F.col("path"), F.col("method")], most)
    shown = first.where((F.col("more") == 0) | (F.col("rank") <= examples)).groupBy("prefix").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(" ", "method", "path").alias("t")))), lambda x: x["t"]), "; ").alias("examples"))
    return sums.join(shown, "prefix").select("prefix", "n", "methods", "auth", "examples", (F.col("n") > most).alias("collapsed"))
