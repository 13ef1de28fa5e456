"""Exact repeated passages by a logarithmic family of sparse suffix arrays.

A repeat is a string of `length` bytes that also starts earlier, in a smaller doc_id or earlier in its own.
Indexing every suffix would take several times the corpus in disk, so each array is sparse: it holds the suffixes
at content-defined sample positions only, the leftmost smallest k-mer hash of every window of `length` bytes. Equal
windows have their sample at the same place, so no match is lost. An entry stands for the run of windows that share
one sample. Its key is the first DEPTH bytes of the suffix itself, as far as the run's windows reach, and then a digest
of the run's whole context; arrays are sorted by key, that is in suffix order, and cut into ranges of keys.

RepeatIndex.add() samples a batch, sorts it in one shuffle by range and merges each range with the same range of the
existing levels, which are read in place and never shuffled again. Of equal contexts the earliest stays and the others are marked as its copies. A run can
share a window with another context only if its longest common prefix with one of its neighbours reaches the end of
its first window (or DEPTH): these runs become candidates, which are compared in blocks of windows and then window by
window. Levels of equal size then merge geometrically, as in a binary counter; others are scanned and not rewritten.

Every match is then held against bytes: the copies of a document are joined to long spans, each span fetches its
source's bytes, and only what equals them is cut. A digest that two contexts share can so never delete a text.

Skew: copies inside a batch are found before the shuffle, so a passage in a third of all rows sends one entry from each
batch, and its runs with different surroundings differ in their keys, which the ranges divide: split points come from a
bounded sample and bear on balance alone. The first and last run of a range count as candidates, so matches across
ranges are not lost.

Edge cases: null and empty texts have 0 bytes; rows with a null doc_id take no part and come back unchanged; a row
repeated with its id is one document and is no copy of itself; rows that share an id but not a text are each cut
only where their own bytes equal a source's; texts are sampled in segments, so memory grows by a few bytes a byte of
the longest text; an empty table gives no rows; other columns of docs are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_table, forget, id_filter, id_slot, low_slot, mix, passes, remove, strings, text_batches, work_dir

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
DEPTH, DIGEST = 32, 8
WIDTH = DEPTH + DIGEST
ENTRY, MARK, CANDIDATE = 0, 1, 2
#: kind; range of keys; key, or for a mark its source (doc_id and start); the run; the level it comes from.
ENTRIES = "kind int, part int, key binary, doc_id long, packed long, level int"
LEVEL = "part int, key binary, doc_id long, packed long, level int, kind int"  # as written: kind is in the path
NAMES = [f.split()[0] for f in ENTRIES.split(", ")]
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
SPANS = "doc_id long, start long, n long, src long, src_start long"
SEGMENT = 1 << 20


def binaries(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix of bytes as a binary array."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * width), pa.py_buffer(np.ascontiguousarray(rows))])


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a binary array of one width as a matrix of bytes."""
    return strings(column)[0].reshape(-1, width)


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each slice, as big-endian bytes."""
    from xxhash import xxh3_64_intdigest as digest

    view = memoryview(np.ascontiguousarray(data))
    return np.array([digest(view[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)], ">u8").reshape(-1, 1).view(np.uint8)


def keys(data: np.ndarray, at: np.ndarray, reach: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The suffix at `at`, `reach` bytes of it at most and zeros behind, and the digest of start..end."""
    out = np.empty((len(at), WIDTH), np.uint8)
    padded = np.concatenate([data, np.zeros(DEPTH, np.uint8)])
    out[:, :DEPTH] = np.lib.stride_tricks.sliding_window_view(padded, DEPTH)[at]
    short = np.flatnonzero(reach < DEPTH)
    out[short, :DEPTH] *= np.arange(DEPTH) < reach[short, None]
    out[:, DEPTH:] = digests(data, start, end)
    return out


def kmer_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A polynomial hash of every k bytes: (S[i + k] - S[i]) * BASE**-i, modulo 2**64. Equal bytes have equal hashes; they
    only choose sample positions, so what else collides does not matter."""
    n = len(data)
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    np.multiply.accumulate(up, out=up)
    np.multiply.accumulate(down, out=down)
    up *= byte_table(1)[data]
    np.cumsum(up, out=up)
    out = up[k - 1 :].copy()
    out[1:] -= up[: n - k]
    del up
    out *= down[: n + 1 - k]
    del down
    return mix(out)


def sample(data: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(document index, first window start in it, sample's distance, windows - 1, key) of each run that shares a sample."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros((0, WIDTH), np.uint8),)
    kmers = kmer_hashes(data, k)
    # The smallest hash, then the leftmost position, in one number: its sliding minimum by doubling.
    least = (kmers & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(kmers), dtype=np.uint64)
    del kmers
    width, have = length - k + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    edges = np.zeros(len(data) + 1, np.int32)
    np.add.at(edges, offsets[:-1], 1)
    np.add.at(edges, np.maximum(offsets[:-1], offsets[1:] - length + 1), -1)
    valid = np.cumsum(edges)[: len(anchor)] > 0
    new = np.ones(len(anchor), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    before, after = np.zeros(len(anchor), bool), np.zeros(len(anchor), bool)
    before[1:], after[:-1] = valid[:-1] & ~new[1:], valid[1:] & ~new[1:]
    first, last = np.flatnonzero(valid & ~before), np.flatnonzero(valid & ~after)
    at = anchor[first]
    doc = np.searchsorted(offsets, first, "right") - 1
    return doc, first - offsets[doc], at - first, last - first, keys(data, at, length - (at - last), first, last + length)


def sampled(batch: pa.RecordBatch, length: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """sample() of a batch; a text longer than a segment goes by segments, whose windows begin in turn. A run that a border
    divides is two runs, which are each other's neighbours and so candidates."""
    data, offsets = strings(batch.column("text"))
    if len(offsets) > 2 or len(data) <= 2 * SEGMENT:
        yield sample(data, offsets, length, k)
        return
    for a in range(0, len(data) - length + 1, SEGMENT):
        part = data[a : a + SEGMENT + length - 1]
        doc, first, lead, more, key = sample(part, np.array([0, len(part)]), length, k)
        yield doc, first + a, lead, more, key


def pack(start: np.ndarray, lead: np.ndarray, more: np.ndarray) -> np.ndarray:
    """A run in one number: its first window's start, the sample's distance from it, and its windows less one."""
    return start << 16 | lead << 8 | more


def source_of(doc_id: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """A mark's source as bytes."""
    return np.stack([doc_id, packed >> 16], axis=1).astype("<i8").view(np.uint8)


def emit(doc_id: np.ndarray, packed: np.ndarray, key: np.ndarray, place: Callable[[np.ndarray], np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
    """Entries of one batch; of equal ones the earliest is an entry and the others are marks. A row repeated with its
    id gives the same entries again, which are dropped: they are the entry itself and no copies of it."""
    order = np.lexsort((packed, doc_id, np.ascontiguousarray(key[:, DEPTH:]).view(">u8").ravel()))
    doc_id, packed, key = doc_id[order], packed[order], key[order]
    same = np.zeros(len(key), bool)
    same[1:] = (key[1:] == key[:-1]).all(1)
    again = same.copy()
    again[1:] &= (doc_id[1:] == doc_id[:-1]) & (packed[1:] == packed[:-1])
    if again.any():
        doc_id, packed, key, same = (x[~again] for x in (doc_id, packed, key, same))
    of = np.maximum.accumulate(np.where(same, 0, np.arange(len(key))))
    for kind, rows in ((ENTRY, ~same), (MARK, same)):
        if not rows.any():
            continue
        d, p = doc_id[rows], packed[rows]
        what = key[rows] if kind == ENTRY else source_of(doc_id[of[rows]], packed[of[rows]])
        # Marks go by their own document, so that a common passage's copies do not meet in one task.
        part = place(what) if kind == ENTRY else (mix(d.astype(np.uint64)) % np.uint64(parts)).astype(np.int32)
        yield batch_of(kind, part, what, d, p, -1)


def batch_of(kind: int, part: np.ndarray, key: np.ndarray, doc_id: np.ndarray, packed: np.ndarray, level: int = 0) -> pa.RecordBatch:
    n = len(doc_id)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(part.astype(np.int32)), binaries(key), pa.array(doc_id), pa.array(packed), pa.array(np.full(n, level, np.int32))], names=NAMES)


class Level:
    """The sorted rows of one range of a level, read from its files as far as asked for."""

    def __init__(self, rank: int, paths: list[str]):
        self.rank, self.batches, self.held = rank, self._read(paths), None

    def _read(self, paths: list[str]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        for path in paths:
            store, place = fs.FileSystem.from_uri(path)
            with store.open_input_file(place) as f:
                yield from pq.ParquetFile(f).iter_batches(20_000, columns=["key", "doc_id", "packed"])

    def until(self, bound: np.ndarray | None) -> Iterator[tuple[np.ndarray, ...]]:
        """Rows (key, doc_id, packed, level) of keys up to bound, or all that are left, a batch at a time."""
        while True:
            if self.held is None and (batch := next(self.batches, None)) is not None and batch.num_rows:
                self.held = (matrix(batch.column("key"), WIDTH), batch.column("doc_id").to_numpy(), batch.column("packed").to_numpy())
            if self.held is None:
                return
            n = len(self.held[0]) if bound is None else int(np.searchsorted(sortable(self.held[0]), bound, "right")[0])
            if n:
                yield (*(x[:n] for x in self.held), np.full(n, self.rank, np.int32))
            if n < len(self.held[0]):
                self.held = tuple(x[n:] for x in self.held)
                return
            self.held = None


def sortable(key: np.ndarray) -> np.ndarray:
    """Keys as byte strings, which compare like the keys."""
    return np.ascontiguousarray(key).view(f"S{WIDTH}").ravel()


def merge_scan(levels: dict[int, dict[int, list[str]]], merging: frozenset[int], length: int, tell: bool = True):
    """A merge of one range's new rows, sorted by kind, key, doc_id and packed, with its rows of every level.

    Gives the earliest entry of each context (as an entry if its level is among `merging`), marks for the others and, if
    asked to tell, candidates: earliest entries whose common prefix with a neighbour is long enough for a window, if
    either is new, and the range's ends. It holds a batch of each level and one row."""

    def chunks(batches: Iterator[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch | tuple]:
        """Marks as they come, and merged rows (key, doc_id, packed, level), no key's later rows before its earliest."""
        held = [Level(rank, paths[part]) for rank, paths in levels.items() if part in paths]
        for batch in batches:
            n = int(np.searchsorted(batch.column("kind").to_numpy(), MARK))
            if n < batch.num_rows:
                yield batch.slice(n)
            if n:
                batch = batch.slice(0, n)
                new = (matrix(batch.column("key"), WIDTH), *(batch.column(c).to_numpy() for c in ("doc_id", "packed", "level")))
                rows = [new, *(r for x in held for r in x.until(sortable(new[0][-1:])))]
                yield merged(rows) if len(rows) > 1 else new
        while held:  # what is left: in turn up to the least of the levels' next batches
            heads = []
            for x in list(held):
                if (row := next(x.until(None), None)) is None:
                    held.remove(x)
                else:
                    heads.append((x, row))
            if heads:
                bound = min((sortable(row[0][-1:]) for _, row in heads), key=lambda k: k[0])
                rows = []
                for x, row in heads:
                    n = int(np.searchsorted(sortable(row[0]), bound, "right")[0])
                    rows.append(tuple(c[:n] for c in row))
                    rest = tuple(c[n:] for c in row[:3])
                    x.held = rest if len(rest[0]) else None
                    rows += x.until(bound) if x.held is None else ()
                yield merged([r for r in rows if len(r[0])])

    def merged(rows: list[tuple]) -> tuple[np.ndarray, ...]:
        key, doc, packed, level = (np.concatenate(c) for c in zip(*rows, strict=True))
        order = np.lexsort((packed, doc, sortable(key)))
        return key[order], doc[order], packed[order], level[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() if TaskContext.get() else 0  # repartitionById: a partition is a range
        held: tuple | None = None  # the last context's earliest entry, whether it is to be kept, and whether it is a candidate already

        def out(kind: int, key: np.ndarray, doc: np.ndarray, packed: np.ndarray) -> pa.RecordBatch:
            return batch_of(kind, np.full(len(doc), part), key, doc, packed)

        for chunk in chunks(batches, part):
            if isinstance(chunk, pa.RecordBatch):
                yield chunk
                continue
            key, doc, packed, level = chunk
            given = held is not None
            if given:
                key, doc, packed, level = (np.concatenate([[h], x]) for h, x in zip(held[:4], chunk, strict=True))
            first = np.ones(len(key), bool)
            first[1:] = (key[1:] != key[:-1]).any(1)
            of = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
            copy = ~first & ((doc != doc[of]) | (packed != packed[of]))
            if copy.any():
                yield out(MARK, source_of(doc[of[copy]], packed[of[copy]]), doc[copy], packed[copy])
            # An entry kept by a level that is not merged stays there; equal rows of a merged level replace it here.
            f = np.flatnonzero(first)
            keep, fresh = np.isin(level[f], list(merging)), level[f] < 0
            near, told = np.zeros(len(f), bool), np.zeros(len(f), bool)
            equal = key[f[1:], :DEPTH] == key[f[:-1], :DEPTH]
            prefix = np.where(equal.all(1), DEPTH, equal.argmin(1))
            prefix[~(fresh[1:] | fresh[:-1])] = -1  # two old neighbours have met before
            need = np.minimum(DEPTH, length - (packed[f] >> 8 & 255))
            near[1:] |= prefix >= need[1:]
            near[:-1] |= prefix >= need[:-1]
            if given:
                keep[0], told[0] = held[4], held[5]
            else:
                near[0] = True  # the other side of the border is not seen
            new = near & ~told
            if tell and new.any():
                yield out(CANDIDATE, *(x[f][new] for x in (key, doc, packed)))
            done = keep.copy()
            last = f[-1]
            done[-1] = False  # the last one may go on in the next batch
            if done.any():
                yield out(ENTRY, *(x[f][done] for x in (key, doc, packed)))
            held = (key[last], doc[last], packed[last], level[last], bool(keep[-1]), bool(near[-1] or told[-1]))
        if held is not None:
            row = [np.array([x]) for x in held[:3]]
            if held[4]:
                yield out(ENTRY, *row)
            if tell and not held[5]:
                yield out(CANDIDATE, *row)

    return run


class RepeatIndex:
    """Levels of sorted entries in the shared folder; add() takes batches in any order of ids."""

    def __init__(self, spark: SparkSession, length: int = 100, k: int = 24, folder: str | None = None, parts: int | None = None):
        self.spark, self.length, self.k, self.folder = spark, length, k, folder or work_dir(spark)
        self.parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.splits: np.ndarray | None = None
        self.levels: dict[int, str] = {}  # rank -> path; rank r has the entries of 2**r batches
        self.steps: list[str] = []

    def _table(self, path: str, kind: int) -> DataFrame:
        return self.spark.read.schema(LEVEL).parquet(path).where(F.col("kind") == kind).select(*NAMES)

    def _fit(self, rows: DataFrame, make, most: int = 32) -> np.ndarray:
        """Split points of the keys that `make` gives for a batch, from some thousand rows and `most` keys of a batch."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in text_batches(batches, 1 << 20):
                for _, _, key in make(batch):
                    yield pa.RecordBatch.from_arrays([binaries(key[:: max(1, len(key) // (most * batch.num_rows))])], names=["key"])

        found = np.array([r.key.ljust(WIDTH, b"\0") for r in rows.mapInArrow(run, "key binary").limit(200_000).collect()], f"S{WIDTH}")
        found = np.unique(found)  # of a passage in very many documents only its different contexts divide ranges
        at = (np.arange(1, self.parts) * len(found)) // self.parts
        return np.unique(found[at]) if len(found) else found

    def _scan(self, rows: DataFrame, merging: frozenset[int], path: str, tell: bool = True, levels: dict[int, str] | None = None) -> None:
        """Sort new rows into ranges and merge each with the same range of the levels, which are read in place."""
        files: dict[int, dict[int, list[str]]] = {}
        for rank, level in (levels or {}).items():
            files[rank] = {}
            entries = self.spark.read.schema(LEVEL).parquet(level).where(F.col("kind") == ENTRY)
            for r in entries.select("part", "_metadata.file_path").distinct().collect():  # one row a range
                files[rank].setdefault(r.part, []).append(r.file_path)
        scan = merge_scan(files, merging, self.length, tell)
        rows.repartitionById(self.parts, F.col("part")).sortWithinPartitions("kind", "key", "doc_id", "packed").mapInArrow(scan, ENTRIES).write.partitionBy("kind").parquet(path)

    def _entries(self, rows: DataFrame, make, splits: np.ndarray | None) -> DataFrame:
        """Entries and marks of what `make` gives; without split points ranges go by the digest alone."""
        parts = self.parts

        def place(key: np.ndarray) -> np.ndarray:
            if splits is None:
                return (np.ascontiguousarray(key[:, DEPTH:]).view(">u8").ravel() % np.uint64(parts)).astype(np.int32)
            return np.searchsorted(splits, np.ascontiguousarray(key).view(f"S{WIDTH}").ravel(), "right").astype(np.int32)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget()
            for batch in text_batches(batches, 1 << 20):  # some 50 bytes of memory a byte while it is sampled
                for doc, packed, key in make(batch):
                    yield from emit(batch.column("doc_id").to_numpy()[doc], packed, key, place, parts)

        return rows.mapInArrow(run, ENTRIES)

    def add(self, docs: DataFrame) -> None:
        """Sample a batch, scan it against all levels and merge the levels of equal rank with it."""
        length, k = self.length, self.k

        def make(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
            for doc, first, lead, more, key in sampled(batch, length, k):
                yield doc, pack(first, lead, more), key

        texts = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
        if self.splits is None:
            some = max(1, texts.count() // 4000)
            self.splits = self._fit(texts.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(some)) == 0), make)
        rank = 0
        while rank in self.levels:
            rank += 1
        path = f"{self.folder}/step{len(self.steps)}"
        self._scan(self._entries(texts, make, self.splits), frozenset([-1, *range(rank)]), path, levels=self.levels)
        for r in range(rank):
            remove(self.spark, f"{self.levels.pop(r)}/kind={ENTRY}")
        self.levels[rank] = path
        self.steps.append(path)

    def spans(self, docs: DataFrame) -> DataFrame:
        """SPANS, the copies of n bytes found in the batches so far, each with a source; docs are their rows.

        Candidates are compared in blocks of windows first, and window by window where blocks differ in part. Of a
        document's spans those stay that cover the same bytes, else a text of a short period has one for each period. Where
        document or source is of an id with several rows each copy is a span of its own, because it may be of one of their
        texts only."""
        length = self.length
        shared = id_filter(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), slot=low_slot)
        found, near = (self._union(self.steps, kind) for kind in (MARK, CANDIDATE))
        for name, split in (("blocks", blocks), ("windows", single)):
            path = f"{self.folder}/{name}"
            self._refine(docs, near, split, path, split is blocks)
            found, near = found.unionByName(self._table(path, MARK)), self._table(path, CANDIDATE)
            release(self.spark)
        runs = found.groupBy("doc_id").agg(F.collect_set(F.struct("packed", "key")).alias("marks"))  # a document's own: bounded by its text
        names = [f.split()[0] for f in SPANS.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                marks = batch.column("marks")
                of = np.repeat(np.arange(batch.num_rows), np.diff(marks.offsets.to_numpy()))
                packed, key = marks.flatten().flatten()
                doc_id, packed, source = batch.column("doc_id").to_numpy(), packed.to_numpy(), matrix(key, 16).view("<i8")
                apart = np.logical_or(*(passes(shared, pa.array(np.mod(x, 8 * len(shared)) + 1)) for x in (doc_id[of], source[:, 0])))
                found = join_runs(doc_id, of[~apart], packed[~apart], source[~apart], length)
                keep = cover(*found[:3])
                own = (doc_id[of[apart]], packed[apart] >> 16, (packed[apart] & 255) + length, source[apart, 0], source[apart, 1])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[keep], y])) for x, y in zip(found, own, strict=True)], names=names)

        return runs.mapInArrow(run, SPANS)

    def drop_levels(self) -> None:
        """Delete the entries, when no more batches will come; marks and candidates stay."""
        for path in self.levels.values():
            remove(self.spark, f"{path}/kind={ENTRY}")
        self.levels.clear()

    def _union(self, paths: list[str], kind: int) -> DataFrame:
        out = self._table(paths[0], kind)
        for path in paths[1:]:
            out = out.unionByName(self._table(path, kind))
        return out

    def _refine(self, docs: DataFrame, near: DataFrame, split, path: str, tell: bool) -> None:
        """A merge-scan over what `split` makes of the candidates' runs, from their documents' texts."""
        length = self.length
        per_doc = near.groupBy("doc_id").agg(F.collect_set("packed").alias("runs"))  # a document's own: bounded by its text

        def make(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
            data, offsets = strings(batch.column("text"))
            runs = batch.column("runs")
            of = np.repeat(np.arange(batch.num_rows), np.diff(runs.offsets.to_numpy()))
            flat = runs.flatten().to_numpy()
            fits = offsets[of] + (flat >> 16) + (flat & 255) + length <= offsets[of + 1]  # not so only in another text of one id
            of, flat = of[fits], flat[fits]
            for i in range(0, len(of), 4000):  # runs at a time, of up to 77 windows each
                at, start, more, key = split(data, offsets[of[i : i + 4000]], flat[i : i + 4000], length)
                doc = of[i : i + 4000][at]
                yield doc, pack(start - offsets[doc], np.zeros(len(start), np.int64), more), key

        texts = only(docs, id_filter(near.select("doc_id"))).join(per_doc, "doc_id").select("doc_id", "text", "runs")
        splits = None
        if tell:
            some = max(1, per_doc.count() // 4000)
            splits = self._fit(texts.where(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(some)) == 0), make)
        self._scan(self._entries(texts, make, splits), frozenset(), path, tell)


def join_runs(doc_id: np.ndarray, of: np.ndarray, packed: np.ndarray, source: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(doc_id, start, n, src, src_start) of the longest spans that marks make: overlapping ones with one source and shift."""
    order = np.lexsort((source[:, 1], source[:, 0], packed, of))
    of, packed, source = of[order], packed[order], source[order]
    first = np.ones(len(of), bool)  # one source of a run is enough
    first[1:] = (of[1:] != of[:-1]) | (packed[1:] != packed[:-1])
    of, start, end, src, shift = of[first], packed[first] >> 16, (packed[first] >> 16) + (packed[first] & 255) + length, source[first, 0], (packed[first] >> 16) - source[first, 1]
    order = np.lexsort((start, shift, src, of))
    of, start, end, src, shift = (x[order] for x in (of, start, end, src, shift))
    group = np.ones(len(of), bool)
    group[1:] = (of[1:] != of[:-1]) | (src[1:] != src[:-1]) | (shift[1:] != shift[:-1])
    base = np.cumsum(group) << 36
    reach = np.maximum.accumulate(end + base) - base
    fresh = group.copy()
    fresh[1:] |= start[1:] > reach[:-1]
    a = np.flatnonzero(fresh)
    b = np.append(a[1:], len(of)) - 1 if len(a) else a
    return doc_id[of[a]], start[a], reach[b] - start[a], src[a], start[a] - shift[a]


def cover(doc_id: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which spans stay, so that fewest of a document cover the bytes that all of them do: of those that begin in or
    right behind what is covered, the one that reaches farthest."""
    end = start + n
    order = np.lexsort((start, doc_id))
    keep = np.zeros(len(order), bool)
    doc, reach, best, far = None, 0, -1, 0
    for i, d, a, b in zip(order.tolist(), doc_id[order].tolist(), start[order].tolist(), end[order].tolist(), strict=True):
        if d != doc or a > reach:
            if far > reach:
                keep[best] = True
            if d != doc or a > far:
                doc, reach, far = d, a, a
            else:
                reach = far
        if b > far:
            best, far = i, b
    if far > reach:
        keep[best] = True
    return keep


def spread(low: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, value): low[i], low[i] + 1 .. of counts[i] values each."""
    at = np.repeat(np.arange(len(low)), counts)
    return at, np.repeat(low, counts) + np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)


def blocks(data: np.ndarray, base: np.ndarray, runs: np.ndarray, length: int, step: int = 8) -> tuple[np.ndarray, ...]:
    """(run index, start, windows - 1, key) of blocks of at most `step` windows, cut by their distance from the sample, so
    equal texts are cut alike. A key begins with what all windows of a block of that place share: its first bytes and
    its digest; the digest behind is that of the block's whole context."""
    sample_at = base + (runs >> 16) + (runs >> 8 & 255)
    high, more = runs >> 8 & 255, runs & 255
    low = high - more
    at, block = spread(low // step, high // step - low // step + 1)
    near, far = np.maximum(block * step, low[at]), np.minimum(block * step + step - 1, high[at])
    first, last = sample_at[at] - far, sample_at[at] - near
    core = sample_at[at] - block * step
    key = keys(data, core, np.full(len(core), DEPTH - DIGEST), first, last + length)
    key[:, DEPTH - DIGEST : DEPTH] = digests(data, core, core + length - step + 1)
    return at, first, last - first, key


def single(data: np.ndarray, base: np.ndarray, runs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(run index, start, 0, key) of each window."""
    at, start = spread(base + (runs >> 16), (runs & 255) + 1)
    return at, start, np.zeros(len(at), np.int64), keys(data, start, np.full(len(at), length), start, start + length)


def only(docs: DataFrame, bitmap: bytes) -> DataFrame:
    """doc_id and text of rows that pass a filter of ids; some others may pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(bitmap, batch.column("slot")))).select(["doc_id", "text"])

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text", id_slot("doc_id").alias("slot")).mapInArrow(run, "doc_id long, text string")


def repeat_spans(docs: DataFrame, length: int, batches: int) -> tuple[DataFrame, bytes, str]:
    """(doc_id, spans) of documents with repeats, spans having a start and its source's bytes; a filter of their ids; and
    the folder of the index. Documents arrive in `batches` batches by a hash of their id."""
    spark = docs.sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # About three times the text is sorted, in ranges of some 128 MB.
    index = RepeatIndex(spark, length, parts=max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(3 * n_bytes / batches / (128 << 20))))
    for b in range(batches):
        index.add(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == b))
        release(spark)
    index.drop_levels()
    path = f"{index.folder}/spans"
    index.spans(docs).write.parquet(path)
    spans = spark.read.schema(SPANS).parquet(path)
    # Each slice is asked for once, however many documents copy it.
    asked = spans.select(F.col("src").alias("doc_id"), "src_start", "n").distinct()
    sources = only(docs, id_filter(spans.select("src"))).join(asked, "doc_id").select(F.col("doc_id").alias("src"), "src_start", "n", F.substring(F.col("text").cast("binary"), F.col("src_start").cast("int") + 1, F.col("n").cast("int")).alias("bytes"))
    with_bytes = spans.join(sources, ["src", "src_start", "n"]).groupBy("doc_id").agg(F.collect_list(F.struct("start", "bytes")).alias("spans"))  # a document's own: bounded by its text
    return with_bytes, id_filter(spans.select("doc_id")), index.folder


def confirmed(text: bytes, spans: pa.Scalar) -> list[tuple[int, int]]:
    """The spans whose bytes equal their source's, as maximal runs in order."""
    out: list[tuple[int, int]] = []
    found = spans.values
    for start, part in sorted(zip(found.field("start").to_pylist(), found.field("bytes").to_pylist(), strict=True)):
        end = start + len(part)
        if not part or text[start:end] != part:
            continue
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def rest(text: bytes, gone: list[tuple[int, int]]) -> Iterator[bytes]:
    """What is left of a text."""
    at = 0
    for a, b in gone:
        yield text[at:a]
        at = b
    yield text[at:]


def remove_repeats(docs: DataFrame, length: int = 100, batches: int = 3) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row of docs."""
    spans, bitmap, _ = repeat_spans(docs, length, batches)
    names = [f.split()[0] for f in RESULT.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.string()]

    def finish(doc_id: int | None, text: bytes, found: pa.Scalar | None) -> tuple:
        gone = confirmed(text, found) if found is not None and found.is_valid else []
        digest = hashlib.sha256()
        for part in rest(text, gone):
            digest.update(part)
        return doc_id, len(text), sum(b - a for a, b in gone), len(gone), digest.hexdigest()

    def table(rows: list[tuple]) -> dict[str, pa.Array]:
        return {n: pa.array(c, t) for n, c, t in zip(names, zip(*rows, strict=True), kinds, strict=True)}

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that the filter drops are finished here; for the others the text goes on to the join."""
        for batch in text_batches(batches, 8 << 20):
            hit = passes(bitmap, batch.column("slot").fill_null(1)) & batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            texts = batch.column("text")
            rows = [(d, 0, 0, 0, None) if h else finish(d, t.as_buffer().to_pybytes(), None) for d, t, h in zip(batch.column("doc_id").to_pylist(), texts, hit, strict=True)]
            going = texts.take(pa.array([i if h else None for i, h in enumerate(hit)], pa.int64()))
            yield pa.RecordBatch.from_pydict(table(rows) | {"text": going, "hit": pa.array(np.asarray(hit))})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit, rows = batch.column("hit").to_pylist(), list(zip(*(batch.column(n).to_pylist() for n in names), strict=True))
            texts, found = batch.column("text"), batch.column("spans")
            for i, h in enumerate(hit):
                if h:
                    rows[i] = finish(rows[i][0], texts[i].as_buffer().to_pybytes(), found[i])
            if rows:
                yield pa.RecordBatch.from_pydict(table(rows))

    first = docs.select("doc_id", "text", id_slot("doc_id").alias("slot")).mapInArrow(clean, f"{RESULT}, text string, hit boolean")
    return first.join(spans, "doc_id", "left").mapInArrow(cut, RESULT)


def cut_repeats(docs: DataFrame, length: int = 100, batches: int = 3) -> DataFrame:
    """docs with the repeats cut from their text, and n_chars to match where there is one. A character that a span cuts
    in two goes; a text that is all repeats becomes empty, and its row stays."""
    spans, _, _ = repeat_spans(docs, length, batches)
    columns = docs.columns
    own = F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row")  # apart from the names used here

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = pa.RecordBatch.from_struct_array(batch.column("row"))
            at = row.schema.get_field_index("text")
            texts = row.column(at).to_pylist()
            for i, found in enumerate(batch.column("spans")):
                if found.is_valid and texts[i] is not None:
                    data = texts[i].encode()
                    texts[i] = b"".join(rest(data, confirmed(data, found))).decode("utf-8", "ignore")
            yield row.set_column(at, row.schema.field(at), pa.array(texts, row.schema.field(at).type))

    keyed = docs.select(F.col("doc_id").alias("_id"), own).join(spans.withColumnRenamed("doc_id", "_id"), "_id", "left").select("row", "spans")
    out = keyed.mapInArrow(cut, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps, which otherwise stay until the driver collects its garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Windows as hex strings, so that they are cut at bytes.
ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d WHERE length(h) >= 200)),
m AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM m)),
s AS (SELECT doc_id, span, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, span),
k AS (SELECT s.doc_id, sum(b - a) AS removed, count(*) AS spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
  FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s) s JOIN d ON d.doc_id = s.doc_id GROUP BY s.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
