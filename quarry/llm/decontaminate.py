"""Benchmark decontamination by a prefix-filtered join, in DataFrame functions alone.

A window is `width` consecutive words of a benchmark item, or the whole item if it is shorter. Its words are ordered
by rarity, their count over all documents; for exact containment the necessary prefix is the rarest word alone.
Document words join that word, the window's place follows from the word's offset in it, the positional and length
bounds drop what would overlap the document's ends, and the words there are compared with the window's. Positions
are exploded inside one code-generated stage; only words that are some window's rarest leave it.

Documents are told apart by a digest of their id and text, so rows with a null doc_id, or with one id and other texts,
are each searched for themselves.

Edge cases: null texts have no words and null item_ids take no part; documents and items of any length are read
whole; repeated rows come back each, with the same counts; items with equal windows each count; an empty benchmark hits
nothing and an empty documents table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: What lies between words, in ASCII after lower-casing; all else is part of a word.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def small(df: DataFrame, few: bool) -> DataFrame:
    """df, to be broadcast if its rows are known to be few; else Spark joins it by a shuffle."""
    return F.broadcast(df) if few else df


def windows(benchmark: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(win, words) of each distinct window, and (win, item_id) for each item that has it."""
    w = benchmark.where("item_id IS NOT NULL").select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.lit(width), F.size("w"))
    cut = w.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice("w", i, size))).alias("words"))
    cut = cut.select(F.sha2(F.array_join("words", " "), 256).alias("win"), "words", "item_id")
    return cut.select("win", "words").distinct(), cut.select("win", "item_id").distinct()


def row_key() -> Column:
    """A digest of a row's id and whole text, both of which may be null."""
    return F.sha1(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit("")))).alias("k")


def hits(docs: DataFrame, wins: DataFrame, few: bool) -> DataFrame:
    """(k, start, len, win): each occurrence of a window in a document."""
    texts = docs.where("text IS NOT NULL").select(row_key(), words(F.col("text")).alias("w"))
    vocabulary = wins.select(F.explode("words").alias("word")).distinct()
    counts = texts.select(F.explode("w").alias("word")).join(small(vocabulary, few), "word", "left_semi").groupBy("word").agg(F.count("*").alias("times"))
    rarity = F.coalesce("times", F.lit(0))
    tokens = wins.select("win", "words", F.posexplode("words").alias("off", "word")).join(counts, "word", "left")
    prefix = tokens.groupBy("win").agg(F.first("words").alias("words"), F.min(F.struct(rarity.alias("times"), "off", "word")).alias("p")).select("win", "words", "p.word", "p.off")
    start = F.col("pos") - F.col("off")
    inside = (start >= 0) & (start + F.size("words") <= F.col("n"))
    same = F.slice("w", F.col("start") + 1, F.size("words")) == F.col("words")
    if few:  # nothing moves, so the text's words may stay in the row
        at = texts.select("k", "w", F.size("w").alias("n"), F.posexplode("w").alias("pos", "word")).join(F.broadcast(prefix), "word").where(inside)
        return at.withColumn("start", start).where(same).select("k", "start", F.size("words").alias("len"), "win")
    # Words travel without their text, and those that may begin a window meet it once, by its key.
    at = texts.select("k", F.size("w").alias("n"), F.posexplode("w").alias("pos", "word")).join(prefix, "word").where(inside)
    return at.select("k", start.alias("start"), "words", "win").join(texts, "k").where(same).select("k", "start", F.size("words").alias("len"), "win")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, most: int = 200_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every row of docs.

    Up to `most` windows of items, of `width` words each, are broadcast; beyond that the same joins are shuffled. All is
    one plan: nothing is written on the way."""
    return _found(docs.select("doc_id", "text"), benchmark, width, most).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 10, most: int = 200_000) -> DataFrame:
    """The rows of docs, with all their columns, that hold no window."""
    row = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))  # apart from the names used here
    return _found(row, benchmark, width, most).where("NOT contaminated").select("row.*")


def _found(docs: DataFrame, benchmark: DataFrame, width: int, most: int) -> DataFrame:
    wins, items = windows(benchmark, width)
    few = items.limit(most + 1).count() <= most  # each window has an item, so this bounds both
    # A document's occurrences are bounded by its own words, so they may be gathered.
    found = hits(docs, wins, few).groupBy("k").agg(F.collect_set(F.struct("start", "len", "win")).alias("all"))
    places = F.array_distinct(F.flatten(F.transform("all", lambda x: F.sequence(x["start"], x["start"] + x["len"] - 1))))
    each = found.select("k", F.size(places).alias("n_hit"), F.explode(F.array_distinct(F.transform("all", lambda x: x["win"]))).alias("win"))
    named = each.join(small(items, few), "win").select("k", "n_hit", F.col("item_id").cast("string").alias("item"))
    hit = named.groupBy("k").agg(F.first("n_hit").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    n_words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), GAP_ANY_CASE), "")).cast("long")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    whole = [c for c in docs.columns if c != "text"]
    return (
        docs.select(*whole, n_words.alias("n_words"), row_key()).join(hit, "k", "left")
        .select(*whole, "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
    )


ORACLE = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
v AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT r, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM v) WHERE len(w) >= k)),
h AS (SELECT p.r, p.i, p.k, v.item_id FROM p JOIN v USING (win, k)),
c AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS pos FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""
