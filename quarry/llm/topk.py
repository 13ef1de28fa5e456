"""Exact top-k inner products by a Voronoi join.

Pivots, a bounded sample, split the vectors into cells. A cell is summarised by its size, its queries and its radius
around the pivot. Each query is first solved in its own cell, which gives it a floor: its k-th
best score so far. A cell can only hold better vectors if its bound, <q, p> + |q| * radius, reaches the floor;
queries go to those cells alone. Cells larger than a block are split by a hash, and so are the queries that ask for a
cell, so a vector that is a third of all rows, or a popular cell, fills no task. A vector is copied once for each
block of queries that its own cell is asked by: cells that no query asks for send nothing.

Edge cases: vectors that are null, or hold nulls or non-finite components, take no part; shorter vectors count as
padded with zeros; ties go to the smaller vec_id; equal rows count once, and of different vectors under one vec_id each
is a query and a candidate, of which the best score counts; integers beyond 2**28 either way count as that, so that
scores of 64 components fit in 64 bits; null ids take no part; with fewer than k candidates all are returned; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .common import materialise

FOUND = "query_id long, vec_id long, score long"
MOST = 1 << 28


def quantised(vectors: DataFrame, scale: float) -> DataFrame:
    """vec_id and v, the components as floor(scale * x); unusable vectors are left out."""
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform("embedding", lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(x.cast("double") * F.lit(scale)).cast("long"))))
    return vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where(ok).select("vec_id", v.alias("v")).distinct()


def matrix(column: pd.Series | list | pa.Array, width: int) -> np.ndarray:
    """Integer rows, padded with zeros to width."""
    if isinstance(column, pa.Array):
        lengths = np.diff(column.offsets.to_numpy())
        if (lengths == width).all():
            return column.flatten().to_numpy().reshape(-1, width)
        column = column.to_pylist()
    elif len(column) and all(len(v) == width for v in column):
        return np.stack(list(column)).astype(np.int64, copy=False)
    out = np.zeros((len(column), width), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles while every sum is below 2**53, else in 64-bit integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64) if most < 2**53 else a @ b.T


def best(scores: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int, floors: np.ndarray | None) -> pd.DataFrame:
    """The k best rows of each query, with scores of at least its floor; ties to the smaller id."""
    out = []
    order = np.argsort(ids, kind="stable")
    ids, scores = ids[order], scores[:, order]
    new = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1)) if len(ids) else ids
    if len(new) < len(ids):  # of several vectors under one id the best score counts
        ids, scores = ids[new], np.maximum.reduceat(scores, new, axis=1)
    for q, row, floor in zip(query_ids, scores, floors if floors is not None else [None] * len(query_ids), strict=True):
        keep = ids != q
        if floor is not None:
            keep &= row >= floor
        at = np.flatnonzero(keep)
        if len(at) > k:
            cut = np.partition(row[at], len(at) - k)[len(at) - k]
            at = at[row[at] >= cut]
            at = at[np.argsort(-row[at], kind="stable")[:k]]
        out.append(pd.DataFrame({"query_id": q, "vec_id": ids[at], "score": row[at]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")


def sent(placed: DataFrame, by: DataFrame) -> DataFrame:
    """The vectors of the cells of `by` (cell, chunks, parts), each in its chunk and once for each part."""
    rows = placed.select("vec_id", "v", "cell").join(by, "cell").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), "chunks").cast("int"))
    return rows.select("vec_id", "v", "cell", "chunk", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))


def by_score() -> WindowSpec:
    return Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")


def top_k(vectors: DataFrame, queries: Column, k: int = 20, scale: float = 64.0, pivots: int = 2048, block: int = 16384) -> DataFrame:
    """query_id, rank, vec_id and score of the k best vectors of each row for which `queries` holds.

    A quarter of the root of the number of vectors, `pivots` at most, become pivots, those of the smallest hash of
    their id; only they and their cells' summaries reach the driver. A task holds at most about `block` vectors and
    `block` queries."""
    vs = materialise(quantised(vectors, scale))
    width, n = vs.agg(F.max(F.size("v")), F.count("*")).first()
    sample = vs.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(pivots, max(8, round(n**0.5 / 4)))).collect()
    if not sample:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    centres = np.unique(matrix([r.v for r in sample], width), axis=0).astype(float)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"), width).astype(float)
            far = ((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None]).clip(0)
            cell = far.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), batch.column("is_query"), pa.array(cell.astype(np.int32)), pa.array(np.sqrt(far[np.arange(len(cell)), cell]))], names=["vec_id", "v", "is_query", "cell", "far"])

    placed = materialise(vs.withColumn("is_query", queries).mapInArrow(assign, "vec_id long, v array<bigint>, is_query boolean, cell int, far double"))
    summary = {r.cell: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"), F.count_if("is_query").alias("nq")).collect()}
    if not sum(r.nq for r in summary.values()):
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    spark = vectors.sparkSession

    def per_cell(asked: dict[int, int]) -> DataFrame:
        """(cell, chunks, parts): how many blocks its vectors and the queries that ask for it make. One row for each pivot
        at most, so this may be broadcast at any size."""
        return F.broadcast(spark.createDataFrame([(c, -(-summary[c].n // block), -(-n // block)) for c, n in asked.items() if n], "cell int, chunks int, parts int"))

    def solve(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        floors = left["floor"].to_numpy() if "floor" in left and left["floor"].notna().all() else None
        found = [best(products(matrix(part["v"], width), matrix(right["v"], width)), part["vec_id"].to_numpy(), right["vec_id"].to_numpy(), k, None if floors is None else floors[i : i + 512]) for i, part in ((i, left.iloc[i : i + 512]) for i in range(0, len(left), 512))]
        return pd.concat(found)

    def search(asked: DataFrame, n: dict[int, int]) -> DataFrame:
        """asked: vec_id, v, floor and the cell to search, for each query and cell; n counts its rows by cell."""
        by = per_cell(n)
        asked = asked.select(*(F.col(c).alias(c) for c in ("vec_id", "v", "cell", "floor")))  # columns apart from the vectors'
        left = asked.join(by, "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts").cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        return left.select("vec_id", "v", "floor", "cell", "chunk", "part").groupBy("cell", "chunk", "part").cogroup(sent(placed, per_cell(n)).groupBy("cell", "chunk", "part")).applyInPandas(solve, FOUND)

    asked = placed.where("is_query")
    none = F.lit(None).cast("long").alias("floor")
    own = materialise(search(asked.select("vec_id", "v", "cell", none), {c: r.nq for c, r in summary.items()}))
    rank = F.row_number().over(by_score())

    def merged(found: DataFrame) -> DataFrame:
        """The best score of each query and candidate, ranked; one shuffle, by query."""
        return found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", rank)

    floors = merged(own).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    cells = sorted(summary)
    radii = np.array([summary[c].radius for c in cells])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"), width).astype(float)
            most = x @ centres[cells].T + np.sqrt((x * x).sum(1))[:, None] * radii[None]
            floor = np.array([np.iinfo(np.int64).min if f is None else f for f in batch.column("floor").to_pylist()])
            reach = most * (1 + 1e-9) + 1e-6 >= floor[:, None].astype(float)  # a margin for rounding
            reach &= np.array(cells)[None] != batch.column("cell").to_numpy()[:, None]
            i, j = np.nonzero(reach)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(i)), batch.column("v").take(pa.array(i)), pa.array(np.array(cells, np.int32)[j]), pa.array(floor[i])], names=["vec_id", "v", "cell", "floor"])

    more = asked.join(floors, "vec_id", "left").select("vec_id", "v", "cell", "floor").mapInArrow(choose, "vec_id long, v array<bigint>, cell int, floor long")
    n = {r.cell: r.n for r in more.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row for each pivot
    every = own.unionByName(search(more, n)) if n else own
    return merged(every).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
