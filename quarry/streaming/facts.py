"""Facts from a stream of source files: each micro-batch is parsed and appended, keyed by batch.

The batch difference of plans.index is the default, because a file stream sees neither deletions nor renames; this
is for trees that only grow, such as a landing folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from .. import extract
from ..sources.scan import LANGUAGES, select_files

BINARY = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, root: str) -> DataFrame:
    """file_path, language and text of files as they arrive under root."""
    glob = "*.{" + ",".join(e[1:] for e in LANGUAGES) + "}"
    found = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    rows = found.select(F.regexp_replace("path", r"^.*?" + root.rstrip("/").rpartition("/")[2] + "/", "").alias("relative_path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return select_files(rows).select(F.col("relative_path").alias("file_path"), "language", "text")


def start(spark: SparkSession, root: str, target: str, checkpoint: str) -> StreamingQuery:
    """Parse what has arrived and stop; a batch that is run again replaces its own folder, so facts appear once."""

    def put(batch: DataFrame, number: int) -> None:
        extract.facts(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return arriving(spark, root).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
