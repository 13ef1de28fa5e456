"""Snapshot differences for incremental refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """key and status (added, changed, unchanged, deleted). One full outer join on the key, nulls compared as values."""
    o = old.select(key, F.struct(*compare).alias("o"))
    n = new.select(key, F.struct(*compare).alias("n"))
    same = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "deleted").when(F.col("o").eqNullSafe(F.col("n")), "unchanged").otherwise("changed")
    return o.join(n, key, "full").select(key, same.alias("status"))


def refresh(facts: DataFrame, diff: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """facts of unchanged keys with fresh ones for added and changed keys; deleted keys lose theirs."""
    kept = facts.join(diff.where("status = 'unchanged'").select(key), key, "left_semi")
    return kept.unionByName(fresh.join(diff.where("status IN ('added', 'changed')").select(key), key, "left_semi"))
