"""Near duplicates by tensored MinHash tables, confirmed on full shingle sets.

A document is the set of its 5-word shingles. Two collections of m small hashes, each of two minima, are drawn from
4m minima; the m * m tables are keyed by all pairs of one hash of each, so 56 minima make 196 tables of four. A
pair at Jaccard similarity s is missed with a probability of about 2 * (1 - s**2)**m, 2e-5 at 0.75. Keys that no
other document could share, because one of their halves is unique, are never formed.

Documents with equal sets form a class with one representative. In each bucket representatives are first held
against two leaders, its first and its most central document, which is linear in the bucket; what is connected so needs no more comparison. Pairs across
components are then compared all to all in buckets of at most `most` documents. For the documents of larger
buckets an exact prefix-filtered join takes over: shingles in order of rarity among them, pairs that share a shingle
of their necessary prefixes, and only those across components. All links are confirmed on the full sets.

Edge cases: null and empty texts, and texts without words, have no shingles and are linked with nothing; texts with
fewer than `width` words have one shingle; texts of any length are read whole; rows with a null doc_id have a null
component and are kept; doc_id is a key: rows repeated with their id count as one document and come back each;
an empty table gives no rows; other columns of docs are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import components, forget, id_filter, id_slot, materialise, mix, passes, strings, text_batches

BASE = 0x9E3779B97F4A7C15
SKETCH = "doc_id long, n long, h1 long, h2 long, a array<bigint>, b array<bigint>"
SETS = "doc_id long, n long, s array<bigint>"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a buffer of UTF-8 bytes."""
    n = len(data)
    docs = len(offsets) - 1
    if not n:
        yield from (np.zeros(0, np.uint64) for _ in range(docs))
        return
    word = ~_SPACE[data]
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | begins[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | begins[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    values = np.random.default_rng(11).integers(0, 2**64, 256, dtype=np.uint64)[_LOWER]
    power, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    power[0] = down[0] = 1
    np.multiply.accumulate(power, out=power)
    np.multiply.accumulate(down, out=down)
    power *= values[data]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(power, out=sums[1:])
    words = mix((sums[end] - sums[start]) * down[start])
    steps = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    whole = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for i in range(width):
        whole += words[i : i + len(whole)] * steps[i]
    whole = mix(whole)
    bounds = np.searchsorted(start, offsets)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= width:
            yield np.unique(whole[a : b - width + 1])
        elif b > a:
            yield mix(np.array([(words[a:b] * steps[: b - a]).sum() + np.uint64(b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def minima(s: np.ndarray, m: int) -> np.ndarray:
    """2m hashes of two minima each: first those of collection a, then those of b."""
    rng = np.random.default_rng(23)
    flip, times = rng.integers(0, 2**64, (4 * m, 1), dtype=np.uint64), rng.integers(0, 2**64, (4 * m, 1), dtype=np.uint64) | np.uint64(1)
    out = np.full(4 * m, 2**64 - 1, np.uint64)
    for i in range(0, len(s), 8192):
        h = (s[None, i : i + 8192] ^ flip) * times
        h ^= h >> np.uint64(32)
        np.minimum(out, h.min(axis=1), out=out)
    return mix(out[0::2] * np.uint64(0xD6E8FEB86659FD93) + out[1::2])


def sketches(docs: DataFrame, width: int, m: int) -> DataFrame:
    """One row a document: the size and a 128-bit hash of its set, and its two collections of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in text_batches(batches, 2 << 20):
            sets = list(shingle_sets(*strings(batch.column("text")), width))
            hashes = np.stack([minima(s, m) for s in sets]).view(np.int64)
            full = np.array([len(s) > 0 for s in sets])
            sums = [np.array([mix(s ^ np.uint64(x)).sum() for s in sets], np.uint64).view(np.int64) for x in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
            lists = [pa.array([list(r) if f else None for r, f in zip(half, full, strict=True)], pa.list_(pa.int64())) for half in (hashes[:, :m], hashes[:, m:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(x) for x in sums), *lists], names=["doc_id", "n", "h1", "h2", "a", "b"])

    return docs.select("doc_id", "text").mapInArrow(run, SKETCH)


def full_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """The shingle sets of the documents in ids, one row each."""
    bitmap = id_filter(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(pa.array(passes(bitmap, batch.column("slot"))))
            for part in text_batches(iter([kept]), 2 << 20):
                sets = list(shingle_sets(*strings(part.column("text")), width))
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = pa.array(np.concatenate(sets).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["doc_id", "n", "s"])

    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "text", id_slot("doc_id").alias("slot")).mapInArrow(run, SETS)
    return rows.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. Native."""
    left, right = (sets.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("s").alias(f"s{x}")) for x in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b")


def ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def alike(x: str, y: str, percent: int):
    """The length bound: the smaller set must be large enough."""
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def prefix_pairs(hot: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components among `hot` (doc_id, n, s, comp) that share a shingle of both necessary prefixes,
    in order of rarity. Exact: no pair that is similar enough is missed."""
    tokens = hot.select("doc_id", "n", "comp", F.explode("s").alias("t"))
    common = tokens.groupBy("t").agg(F.count("*").alias("df")).where("df > 1")
    shared = tokens.join(common, "t")
    mine = Window.partitionBy("doc_id")
    need = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    lone = F.col("n") - F.count("*").over(mine)  # shingles of one document come first and join nothing
    posted = shared.withColumn("at", F.row_number().over(mine.orderBy("df", "t")) + lone).where(F.col("at") <= need).select("t", "doc_id", "n", "comp", "at")
    posted = materialise(posted)
    by_comp = posted.groupBy("t", "comp").agg(F.count("*").alias("k"))
    # Written first, so that both sides of the next joins come from an exchange and a very common shingle can be split.
    mixed = materialise(by_comp.groupBy("t").agg(F.max_by("comp", "k").alias("main"), F.count("*").alias("comps")).where("comps > 1").select("t", "main"))
    # Two members of different components cannot both be in the list's main one, so its rows never meet each other.
    odd = posted.join(mixed, "t").where("comp <> main").select("t", F.col("doc_id").alias("x"), F.col("n").alias("nx"), F.col("comp").alias("cx"), F.col("at").alias("atx"))
    # At a pair's first common shingle, what is left of either set bounds their overlap.
    room = (100 + percent) * (F.least(F.col("nx") - F.col("atx"), F.col("n") - F.col("at")) + 1) >= percent * (F.col("nx") + F.col("n"))
    return odd.join(posted, "t").where((F.col("cx") != F.col("comp")) & alike("nx", "n", percent) & room).select(*ordered("x", "doc_id")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = 5, m: int = 14, most: int = 32) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) and kept for every row of docs."""
    sketched = materialise(sketches(docs, width, m))
    # Written first: then both sides of the join come from an exchange, and AQE can split a class of very many copies.
    classes = materialise(sketched.where("n > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")))
    named = materialise(sketched.join(classes, ["h1", "h2"], "left").select("doc_id", "n", "rep", "a", "b"))
    reps = named.where("doc_id = rep").dropDuplicates(["doc_id"])

    def shared_halves(side: str) -> DataFrame:
        rows = reps.select("doc_id", "n", F.posexplode(side).alias(f"i{side}", f"k{side}"))
        more = rows.groupBy(f"i{side}", f"k{side}").agg(F.count("*").alias("times")).where("times > 1").drop("times")
        return rows.join(more, [f"i{side}", f"k{side}"])

    keyed = shared_halves("a").join(shared_halves("b").drop("n"), "doc_id").select("doc_id", "n", F.struct("ia", "ib", "ka", "kb").alias("key"))
    keyed = materialise(keyed.select("doc_id", "n", F.xxhash64("key.ia", "key.ib", "key.ka", "key.kb").alias("key")))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    in_bucket = materialise(keyed.join(sizes, "key"))
    # What lies in the middle of a group is in most of its large buckets, and so makes a good leader.
    weight = in_bucket.where(F.col("size") > most).groupBy("doc_id").agg(F.count("*").alias("weight"))
    me = F.struct("doc_id", "n")
    leaders = in_bucket.join(weight, "doc_id", "left").groupBy("key").agg(F.min(me).alias("first"), F.max_by(me, F.struct(F.coalesce("weight", F.lit(0)), F.xxhash64("doc_id"))).alias("middle"))
    stars = in_bucket.join(leaders, "key").select("doc_id", "n", F.explode(F.array("first", "middle")).alias("l")).where("doc_id <> l.doc_id").where(alike("n", "l.n", percent))
    stars = materialise(stars.select(*ordered("doc_id", "l.doc_id")).distinct())
    sets = materialise(full_sets(docs, in_bucket.select("doc_id").distinct(), width))
    links = materialise(confirmed(stars, sets, percent))

    linked = components(links)
    labelled = in_bucket.select("key", "size", "doc_id", "n").join(linked.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id")).drop("component")
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("key")
    open_rows = materialise(labelled.join(mixed, "key"))
    small = open_rows.where(F.col("size") <= most).groupBy("key").agg(F.collect_list(F.struct("doc_id", "n", "comp")).alias("all"))
    x = small.select("all", F.explode("all").alias("x")).select("x", F.explode("all").alias("y"))
    across = x.where((F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.comp") != F.col("y.comp")) & alike("x.n", "y.n", percent)).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))
    hot_ids = open_rows.where(F.col("size") > most).select("doc_id", "comp").distinct()
    rest = across.unionByName(prefix_pairs(sets.join(hot_ids, "doc_id"), percent)).distinct().join(stars, ["a", "b"], "left_anti")
    every = links.unionByName(confirmed(rest, sets, percent))
    found = components(every).select(F.col("id").alias("rep"), "component")
    component = F.coalesce("component", "rep", "doc_id")
    out = named.select("doc_id", "n", "rep").join(found, "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


ORACLE = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
r(id, other) AS (SELECT a, b FROM l UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.other),
c AS (SELECT id, min(other) AS c FROM r GROUP BY id)
SELECT t.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(t.doc_id, coalesce(c.c, t.doc_id)) AS component_id, t.doc_id = least(t.doc_id, coalesce(c.c, t.doc_id)) AS kept
FROM t LEFT JOIN n ON n.doc_id = t.doc_id LEFT JOIN c ON c.id = t.doc_id
"""
