"""The corpus pipeline over `documents`: five stages, each of one operator of quarry.llm.

1. quality: documents that the classifier rejects go.
2. near_dups: of each group of near copies the document with the smallest id stays.
3. repeats: passages of 100 bytes or more that also stand earlier are cut from the texts.
4. decontaminate: documents with a passage of a benchmark item go.
5. packing: the rest is packed into sequences of 1024 tokens.

Nulls, repeats and empty tables are treated as the operators state: rows without a doc_id have no near copies and no
repeats, and are judged by their text in stages 1 and 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontaminate, near_dups, packing, quality, repeats
from quarry.llm.catalog import table, tokenizer
from quarry.llm.common import materialise


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def drop_near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    dropped = near_dups.near_duplicates(docs).where("NOT kept").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeats.cut_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_pieces(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("quality", keep_quality), ("near_dups", drop_near_dups), ("repeats", cut_repeats), ("decontaminate", drop_contaminated), ("packing", pack)]

#: SQL can express neither the classifier nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
