"""What the corpus operators share: cutting lineage, hashing on Arrow buffers, id filters, components."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_own: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share, spark.checkpoint.dir; only where that is unset and the
    session is local, in a temporary one. It is deleted when the session's JVM ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and (known := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        base = known.get()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: executors and driver need a folder that they share")
    if not base:
        _own[:] = _own or [f"file://{tempfile.mkdtemp(prefix='quarry-')}"]
        base = _own[0]
    path = f"{base.rstrip('/')}/quarry-{uuid.uuid4().hex}"
    fs, p = hadoop_path(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """df, written to the shared folder and read back: cuts lineage and survives the loss of executors."""
    path = path or f"{work_dir(df.sparkSession)}/step"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) as Hadoop has them, on the driver; for metadata only."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


def memo(name: str, make: Callable[[], object]) -> object:
    """make(), kept in the Python worker under a name until another operator asks for its own.

    One worker runs the tasks of many stages; it holds one operator's vocabulary and memo at a time."""
    held = sys.modules.setdefault("_quarry_worker", types.ModuleType("_quarry_worker")).__dict__.setdefault("memo", {})
    if name not in held:
        held.clear()
        held[name] = make()
    return held[name]


def forget() -> None:
    """Drop what another operator has left in this worker, and give its memory back to the system."""
    import ctypes
    import gc

    memo("", lambda: None)
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # glibc keeps freed pages otherwise
        libc.malloc_trim(0)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; all else as it is."""
    return F.translate(text, UPPER, LOWER)


def strings(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array without nulls, as numpy views."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_batches(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds about `most` bytes of its column `text` (null: empty)."""
    for batch in batches:
        at = batch.schema.get_field_index("text")
        batch = batch.set_column(at, "text", batch.column(at).fill_null("" if pa.types.is_string(batch.column(at).type) or pa.types.is_large_string(batch.column(at).type) else b""))
        if not batch.num_rows:
            continue
        _, offsets = strings(batch.column(at))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, on a copy."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def byte_table(seed: int) -> np.ndarray:
    """A random 64-bit value for each byte."""
    return np.random.default_rng(seed).integers(0, 2**64, 256, dtype=np.uint64)


def id_slot(column: str, bits: int = 1 << 22) -> Column:
    """The bit, from 1, of a row's id in id_filter()."""
    return F.pmod(F.xxhash64(column), F.lit(bits)) + 1


def low_slot(column: str, bits: int = 1 << 22) -> Column:
    """A bit that Python can tell too: np.mod(id, bits) + 1."""
    return F.pmod(F.col(column), F.lit(bits)) + 1


def id_filter(ids: DataFrame, bits: int = 1 << 22, slot: Callable[[str, int], Column] = id_slot) -> bytes:
    """A bitmap of `bits` bits over the hashes of the one column of `ids`. Its size does not depend on the data;
    a filter too full lets rows pass that a join then drops."""
    slots = ids.select(slot(ids.columns[0], bits).alias("s"))
    rows = slots.groupBy(F.bitmap_bucket_number("s").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("b")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for n, b in rows:  # bits / 32768 rows at most
        out[(n - 1) * 4096 : n * 4096] = np.frombuffer(b, np.uint8)[: max(0, len(out) - (n - 1) * 4096)]
    return out.tobytes()


def passes(bitmap: bytes, slots: pa.Array) -> np.ndarray:
    """Which of the slots are set."""
    at = slots.to_numpy(zero_copy_only=False).astype(np.int64) - 1
    return (np.frombuffer(bitmap, np.uint8)[at // 8] >> (at % 8).astype(np.uint8)) & 1 == 1


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """(id, component): for each node of the undirected edges, the smallest node it is connected with.

    Large-star and small-star steps in turn until the edges stop changing; each round is written to the
    shared folder. Minima are pre-aggregated, so a node with very many neighbours costs one row a task."""
    spark = edges.sparkSession
    now = materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = materialise(small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components: no fixed point after {rounds} rounds")
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
