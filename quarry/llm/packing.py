"""Packing of token pieces into sequences: first-fit decreasing and best-fit decreasing.

Tokenizing is done where the text lies: each document is cut into full sequences and one remainder, and only
the pieces travel. Each piece goes to a random group by a seeded hash of itself (its document, start, ids and which of
the equal ones of its batch it is), and each group is packed on its own by one task: neither a hot source, nor null
ids, nor one row in very many copies fills a group, and a task's input has a bound.

Edge cases: a null or empty text has the end id alone; texts of any length are cut into as many pieces as needed;
repeated rows are packed once each, as rows of their own; null ids form a document like any other; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, memo, text_batches
from .token_ids import Encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, copy int"
PLACES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ROWS = "sequence_id long, n_tokens int, input_ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<bigint>, starts array<bigint>"
FILES = "file string, rows int, segments int"


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece: the first bin that has room, pieces from the largest.

    A tournament tree holds the most room of any bin below each node; the walk from its root goes left where it can."""
    leaves = 1 << max(0, int(len(sizes) - 1).bit_length())
    room = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        size, node = int(sizes[i]), 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - room[node]
        room[node] -= size
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return bins, offsets


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece: the fullest bin that has room, pieces from the largest.

    A segment tree over the capacities 0..capacity counts the bins that have exactly that room left; the search
    finds the least room of at least the piece's size in O(log capacity)."""
    leaves = 1 << int(capacity).bit_length()
    count = [0] * (2 * leaves)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)

    def add(room: int, by: int) -> None:
        node = room + leaves
        while node:
            count[node] += by
            node //= 2

    def at_least(room: int) -> int | None:
        node = room + leaves
        if count[node]:
            return room
        while node > 1:  # up to the first subtree on the right that has a bin
            if node % 2 == 0 and count[node + 1]:
                node += 1
                break
            node //= 2
        else:
            return None
        while node < leaves:
            node = 2 * node if count[2 * node] else 2 * node + 1
        return node - leaves

    used = 0
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        if (room := at_least(size)) is None:
            room, at, used = capacity, used, used + 1
        else:
            at = stacks[room].pop()
            add(room, -1)
        bins[i], offsets[i] = at, capacity - room
        if room > size:
            stacks[room - size].append(at)
            add(room - size, 1)
    return bins, offsets


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """The pieces of every document: all but the last are `capacity` long; `ids` (unsigned 32-bit, or 16-bit where
    the vocabulary allows) is null unless asked for. No shuffle. The tokenizer is read on the driver."""
    with open(tokenizer_file, encoding="utf-8") as f:
        tokenizer = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = memo(f"bpe {zlib.crc32(tokenizer.encode())}", lambda: Encoder(tokenizer))
        end = np.array([end_id], "<u4").tobytes()
        small = encoder.size <= 1 << 16
        for batch in text_batches(batches):
            out: list[tuple] = []
            seen: Counter = Counter()
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encoder.ids(text) + end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    kept = None if not with_ids else np.frombuffer(part, "<u4").astype("<u2").tobytes() if small else part
                    crc = zlib.crc32(part)
                    out.append((doc, start, len(part) // 4, crc, total, kept, seen[doc, start, crc]))
                    seen[doc, start, crc] += 1
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.binary()), pa.array(columns[6], pa.int32())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "copy"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def grouped(found: DataFrame, n_docs: int, group_docs: int, seed: int) -> DataFrame:
    """Pieces with `grp`, a random group of the pieces of about group_docs documents, one partition for some groups each."""
    n = max(1, -(-n_docs // group_docs))
    key = F.pmod(F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1)), "start", "ids_crc32", "copy"), F.lit(n))
    return found.withColumn("grp", key).drop("copy")


def pack_pieces(docs: DataFrame, tokenizer_file: str, capacity: int = 1024, end_id: int = 0, group_docs: int = 8192, seed: int = 17) -> DataFrame:
    """First-fit decreasing of all documents into sequences of at most `capacity` ids; one row for each piece.

    Ids do not travel: a piece's checksum is taken where its text is. A group pads about one sequence."""
    found = grouped(pieces(docs, tokenizer_file, capacity, end_id, False).drop("ids"), docs.count(), group_docs, seed)

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = first_fit_decreasing(table["length"].to_numpy(), capacity)
        ids = bins + (key[0].as_py() << 32)
        return table.drop_columns(["grp"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))

    return found.groupBy("grp").applyInArrow(pack, PLACES)


def pack_ids(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, end_id: int = 50256, group_docs: int = 2048, seed: int = 29) -> DataFrame:
    """Best-fit decreasing of all documents, one row for each sequence: `input_ids`, a row of the packed matrix
    (little-endian, unsigned 16-bit where the vocabulary allows, end_id as padding), `cu_seqlens`, the cumulative
    lengths of its pieces from 0, and `position_ids`, unsigned 16-bit positions that restart at each piece.

    Overlong documents are cut losslessly; for each piece, in order, doc_ids names its document and starts its place there."""
    found = grouped(pieces(docs, tokenizer_file, capacity, end_id, True), docs.count(), group_docs, seed)

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        sizes = table["length"].to_numpy()
        bins, offsets = best_fit_decreasing(sizes, capacity)
        order = np.lexsort((offsets, bins))
        docs_of, starts_of, ids_of = table["doc_id"].to_pylist(), table["start"].to_pylist(), table["ids"].to_pylist()
        kind, ramp = np.dtype("<u2" if len(ids_of[0]) == 2 * sizes[0] else "<u4"), np.arange(capacity, dtype="<u2")
        rows: dict[str, list] = {f.split()[0]: [] for f in ROWS.split(", ")}
        for one in np.split(order, np.flatnonzero(np.diff(bins[order])) + 1):
            row, places, ends = np.full(capacity, end_id, kind), np.zeros(capacity, "<u2"), np.concatenate([[0], np.cumsum(sizes[one])])
            for i, a, b in zip(one, ends[:-1], ends[1:], strict=True):
                row[a:b] = np.frombuffer(ids_of[i], kind)
                places[a:b] = ramp[: b - a]
            for c, v in zip(rows, ((key[0].as_py() << 32) + int(bins[one[0]]), int(ends[-1]), row.tobytes(), ends.tolist(), places.tobytes(), [docs_of[i] for i in one], [starts_of[i] for i in one]), strict=True):
                rows[c].append(v)
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(rows.items(), kinds, strict=True)})

    return found.groupBy("grp").applyInArrow(pack, ROWS)


def write_matrices(packed: DataFrame, folder: str, rows_per_file: int = 4096) -> DataFrame:
    """Write sequences as matrices: each file is a NumPy archive of `input_ids` and `position_ids`, one row a sequence,
    of `cu_seqlens` end to end with `bounds`, where each row's begin, and likewise `doc_ids` (-1 where `null_docs`),
    `starts` and `sequence_id`. The table of files is written last, so names of lost attempts are never read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        held: list[dict] = []

        def flush() -> pa.RecordBatch:
            # Positions have 16 bits up to 65536 ids a row; ids have as many or twice as many.
            capacity = len(held[0]["position_ids"]) // 2
            kind = "<u2" if len(held[0]["input_ids"]) == 2 * capacity else "<u4"
            docs = [d for r in held for d in r["doc_ids"]]
            arrays = {
                "input_ids": np.frombuffer(b"".join(r["input_ids"] for r in held), kind).reshape(len(held), -1),
                "position_ids": np.frombuffer(b"".join(r["position_ids"] for r in held), "<u2").reshape(len(held), -1),
                "cu_seqlens": np.array([x for r in held for x in r["cu_seqlens"]], np.int32),
                "bounds": np.cumsum([0, *(len(r["cu_seqlens"]) for r in held)]),
                "doc_ids": np.array([-1 if d is None else d for d in docs], np.int64),
                "null_docs": np.array([d is None for d in docs]),
                "starts": np.array([x for r in held for x in r["starts"]], np.int64),
                "sequence_id": np.array([r["sequence_id"] for r in held], np.int64),
            }
            name = f"{folder}/{uuid.uuid4().hex}.npz"
            store, path = fs.FileSystem.from_uri(name)
            store.create_dir(path.rpartition("/")[0], recursive=True)
            buffer = io.BytesIO()
            np.savez(buffer, **arrays)
            with store.open_output_stream(path, compression=None) as out:
                out.write(buffer.getvalue())
            row = pa.RecordBatch.from_pydict({"file": [name], "rows": pa.array([len(held)], pa.int32()), "segments": pa.array([len(docs)], pa.int32())})
            held.clear()
            return row

        for batch in batches:
            for row in batch.to_pylist():
                held.append(row)
                if len(held) == rows_per_file:
                    yield flush()
        if held:
            yield flush()

    return materialise(packed.mapInArrow(run, FILES), f"{folder}/files")


def read_matrices(files: DataFrame) -> DataFrame:
    """The sequences of written matrices, as pack_ids() gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for name in (x for batch in batches for x in batch.column("file").to_pylist()):
            store, path = fs.FileSystem.from_uri(name)
            with store.open_input_file(path) as f:
                m = dict(np.load(io.BytesIO(f.readall())))
            lengths = np.diff(m["bounds"])
            of = np.cumsum([0, *(lengths - 1)])  # a row has one segment less than bounds
            docs = [None if n else d for d, n in zip(m["doc_ids"].tolist(), m["null_docs"], strict=True)]
            cu = [m["cu_seqlens"][a:b].tolist() for a, b in zip(m["bounds"][:-1], m["bounds"][1:], strict=True)]
            columns = [m["sequence_id"], [c[-1] for c in cu], [r.tobytes() for r in m["input_ids"]], cu, [r.tobytes() for r in m["position_ids"]], [docs[a:b] for a, b in zip(of[:-1], of[1:], strict=True)], [m["starts"][a:b].tolist() for a, b in zip(of[:-1], of[1:], strict=True)]]
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in ROWS.split(", ")])

    return files.select("file").mapInArrow(run, ROWS)
