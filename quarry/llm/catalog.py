"""The corpus operators as named queries over the standard tables, with SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, near_dups, packing, quality, repeats, shards, token_counts, topk, warc
from .common import work_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_ids(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three arrivals, compaction, and every row read back through the manifest."""
    docs = table(spark, sf_dir, "documents")
    store = shards.ShardStore(spark, work_dir(spark))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(8))
    for low, high in ((0, 4), (4, 7), (7, 8)):
        store.append(docs.where(F.coalesce(part, F.lit(0)).between(low, high - 1)))
    store.compact()
    store.vacuum()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("text_md5"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op5_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_pieces(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), work_dir(spark))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_token_ids, op3_sharding, op4_repeats, op5_near_dups, op6_packing, op7_decontaminate, op8_top_k, op9_warc, op10_quality)}

ORACLES: dict[str, str] = {
    "op3_sharding": "SELECT doc_id, lang, source, n_chars, CAST(strlen(text) AS BIGINT) AS n_bytes, md5(text) AS text_md5 FROM documents",
    "op4_repeats": repeats.ORACLE,
    "op5_near_dups": near_dups.ORACLE,
    "op7_decontaminate": decontaminate.ORACLE,
    "op8_top_k": topk.ORACLE,
    "op9_warc": warc.ORACLE,
}
