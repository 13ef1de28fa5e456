"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed in the folder of spark.checkpoint.dir, which executors share and which outlives them; only where
    that is unset and the session is local, in a temporary one."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors and driver need a folder that they share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
    return df.checkpoint(eager=True)
