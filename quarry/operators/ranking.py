"""Top-N per group with remainders, and the orders of listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import KIND_RANK, case_map


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group, with rank and more, the number of rows left out.

    Counts are joined and not taken over the window, so Spark keeps n rows of a group before it sorts and shuffles."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= n)
    counts = df.groupBy(*(F.col(g).alias(f"_{g}") for g in group)).agg(F.greatest(F.lit(0), F.count("*") - n).cast("long").alias("more"))
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group]
    return ranked.join(counts, same).select(*df.columns, "rank", "more")


def kind_order(kind: str = "kind", name: str = "name") -> list[Column]:
    """Functions first, variables last; then by name."""
    return [case_map(kind, KIND_RANK, 99), F.col(name)]


def first_by(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def primary_and_related(members: DataFrame, group: str, member: str, heat: str) -> DataFrame:
    """For each group the hottest member and the others in order of heat, then name."""
    ranked = F.array_sort(F.collect_set(F.struct((-F.col(heat)).alias("h"), F.col(member).alias("m"))))
    g = members.groupBy(group).agg(ranked.alias("all"))
    return g.select(group, F.col("all")[0]["m"].alias("primary"), (-F.col("all")[0]["h"]).alias("heat"), F.transform(F.slice("all", 2, F.greatest(F.size("all"), F.lit(1))), lambda x: x["m"]).alias("related"))
