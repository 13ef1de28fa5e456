"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

A text's features are its words and pairs of neighbouring words, hashed into 2**bits slots; the score is a
sparse dot product through the logistic function. A word is a run of letters, digits and marks or a run of
punctuation, in lower case; runs of equal characters past three count as three, and a word equal to the one before
counts as a repeat mark, so that the model can learn repetition as such. Case and length shapes of words are
hashed as words too. Each feature counts by its share of the text, scaled by sqrt, so length has no weight of
its own.

Edge cases: null and empty texts have the bias alone as their score; texts of any length are read whole;
repeated rows get one row each; rows with a null doc_id are scored and never trained on; an empty table, or
one with no labelled rows, gives scores of 0.5; columns of `docs` other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import memo, text_batches

TOKEN = re.compile(r"\w+|[^\w\s]+")
RUN = re.compile(r"(.)\1{3,}")
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


class _Words(dict):
    """word -> (its hash, the hash of its shape), as Python ints; emptied when it holds too many."""

    def __missing__(self, word: str) -> tuple[int, int]:
        import xxhash

        if len(self) >= 150_000:
            self.clear()
        shape = "U" if word.isupper() and len(word) > 1 else "T" if word[:1].isupper() else "l" if word.isalpha() else "d" if word.isdigit() else "p"
        low = RUN.sub(r"\1\1\1", word.lower())
        pair = self[word] = (xxhash.xxh64_intdigest(low), xxhash.xxh64_intdigest(f"\0{shape}"))
        return pair


def features(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of one whole text; a slot may occur more than once."""
    words = memo("quality", _Words)
    found = TOKEN.findall(text)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0)
    pairs = np.array([words[w] for w in found], np.uint64)
    one, shape = pairs[:, 0].copy(), pairs[:, 1]
    one[1:][pairs[1:, 0] == pairs[:-1, 0]] = np.uint64(0x9E3779B97F4A7C15)  # the repeat mark
    two = one[:-1] * np.uint64(0x9DDFEA08EB382D69) + one[1:]
    form = shape[:-1] * np.uint64(0xD6E8FEB86659FD93) + shape[1:]
    h = np.concatenate([one, two, shape, form])
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    slots, counts = np.unique((h >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
    values = np.sqrt(counts / len(found))
    return slots, values / np.sqrt((values * values).sum())


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, updates: int = 36_000, weight_0: float = 3.0) -> np.ndarray:
    """Weights after about `updates` FTRL-proximal updates, one example at a time; the last weight is the bias.

    Examples of label 0, the rarer one, count weight_0 times."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weight(at: np.ndarray | slice) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(min(100, -(-updates // max(1, len(rows))))):
        for slots, values, label in rows:
            at, x = np.append(slots, 1 << bits), np.append(values, 1.0)
            w = weight(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * (1.0 if label else weight_0) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return weight(slice(None))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", bits: int = 20, most: int = 6000, folds: int = 5) -> np.ndarray:
    """Fit on at most `most` labelled documents, those of the smallest hash of doc_id, from outside the held-out fold.

    The bound keeps the sequential updates on one machine at every size of the input. Executors make the features, so the
    driver sees slots and values only, no texts."""
    chosen = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) != 0))
    chosen = chosen.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            found = [features(t, bits) for t in batch.column("text").to_pylist()]
            slots, values = (pa.array([x[i].astype(kind).tobytes() for x in found], pa.binary()) for i, kind in ((0, np.int32), (1, np.float32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), slots, values], names=["doc_id", "y", "slots", "vals"])

    # The chosen ids are bounded by `most`, so this side may be broadcast at any size.
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, slots binary, vals binary")
    rows = picked.orderBy(F.xxhash64("doc_id"), "doc_id", "slots", "vals").limit(2 * most).collect()
    return ftrl([(np.frombuffer(r.slots, np.int32), np.frombuffer(r.vals, np.float32), r.y) for r in rows], bits)


def score(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """docs' doc_id with held_out, score and predicted, for every row. One pass without a shuffle."""
    bits = int(np.log2(len(weights) - 1))
    used = np.flatnonzero(weights)
    sparse = (used.astype(np.int32), weights[used].astype(np.float32))  # L1 leaves few

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros((1 << bits) + 1, np.float32)
        w[sparse[0]] = sparse[1]
        for batch in text_batches(batches):
            out = np.empty(batch.num_rows)
            for i, text in enumerate(batch.column("text").to_pylist()):
                slots, values = features(text, bits)
                out[i] = w[-1] + w[slots] @ values
            out = 1 / (1 + np.exp(-np.clip(out, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(out), pa.array((out >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == 0, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(run, SCHEMA)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **fit: int) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""
    return score(docs, train(docs, labels, **fit), threshold)


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **fit: int) -> DataFrame:
    """The rows of docs that are predicted 1, with all their columns, in one pass without a shuffle."""
    weights = train(docs, labels, **fit)
    bits, used = int(np.log2(len(weights) - 1)), np.flatnonzero(weights)
    sparse, cut = (used.astype(np.int32), weights[used].astype(np.float32)), float(np.log(threshold / (1 - threshold)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros((1 << bits) + 1, np.float32)
        w[sparse[0]] = sparse[1]
        for batch in batches:
            good = []
            for part in text_batches(iter([batch.select(["text"])])):
                for text in part.column("text").to_pylist():
                    slots, values = features(text, bits)
                    good.append(bool(w[-1] + w[slots] @ values >= cut))
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
