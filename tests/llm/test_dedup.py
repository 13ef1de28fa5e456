"""Repeats and near duplicates against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import repeats
from quarry.llm.near_dups import near_duplicates
from quarry.llm.repeats import RepeatIndex, cut_repeats, remove_repeats

DOCS = "doc_id long, text string, kind string, g string"


def brute_repeats(rows, length=100):
    rows = sorted({(d, t or "") for d, t in rows})
    seen, out = set(), {}
    for d, text in rows:
        data = text.encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def brute_links(rows, percent=75):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids, comp = sorted(sets), {d: d for d in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                comp[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d), root(d) == d) for d in ids}


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y") for d, t in rows], DOCS)


def corpus(seed, n=60):
    rnd = random.Random(seed)
    words = ["w%d" % rnd.randrange(500) + "é" * rnd.randrange(2) for _ in range(300)]
    line = " ".join(rnd.choice(words) for _ in range(40))
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 120))) for _ in range(n // 3)]
    out = []
    for i in range(n):
        t = rnd.choice(base)
        if rnd.random() < 0.5:
            w = t.split()
            for _ in range(rnd.randrange(4)):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            t = " ".join(w)
        if rnd.random() < 0.3:
            t = t + " " + line if rnd.random() < 0.5 else line + " " + t
        out.append((i * 3 + 1, t))
    return [*out, (500, None), (501, ""), (502, " \n "), (503, "ab " * 400), (504, "one two"), (505, "ONE two"), (506, "z" * 250), (507, "z" * 99)]


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_match_brute_force(spark, seed):
    rows = corpus(seed)
    got = {r.doc_id: tuple(r)[1:] for r in remove_repeats(frame(spark, rows)).collect()}
    assert got == brute_repeats(rows)


def test_repeats_over_the_small_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in remove_repeats(docs).collect()}
    assert got == brute_repeats(rows)


def test_repeats_of_repeated_and_null_rows(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text), (1, text), (None, text), (2, text + "x")]
    got = sorted((r.doc_id or -1, r.n_removed) for r in remove_repeats(frame(spark, rows)).collect())
    assert got == [(-1, 0), (1, 0), (1, 0), (2, len(text))]
    assert remove_repeats(frame(spark, rows).where("false")).count() == 0


def test_repeated_rows_of_one_arrow_batch_are_no_copies(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text), (1, text), (2, "a" + text), (2, "a" + text), (3, text + text), (3, text + text)]
    df = frame(spark, rows).coalesce(1)
    out = remove_repeats(df).collect()
    assert len(out) == len(rows) and {r.doc_id: tuple(r)[1:] for r in out} == brute_repeats(rows)
    assert len(set(out)) == 3
    assert [r.text for r in cut_repeats(df).collect() if r.doc_id == 1] == [text, text]


@pytest.mark.parametrize("parts", [1, 7])
def test_one_line_in_every_document(spark, parts):
    rnd = random.Random(7)
    line = "All rights reserved; this line of a license stands in every document of this test, word for word, and is longer than a window. "
    rows = [(i, " ".join(str(rnd.random()) for _ in range(rnd.randrange(12))) + line + " ".join(str(rnd.random()) for _ in range(rnd.randrange(12)))) for i in range(120)]
    got = {r.doc_id: tuple(r)[1:] for r in remove_repeats(frame(spark, rows).repartition(parts)).collect()}
    assert got == brute_repeats(rows)


def test_only_equal_bytes_are_cut():
    spans = pa.array([[{"start": 2, "bytes": b"cde"}, {"start": 4, "bytes": b"ef"}, {"start": 7, "bytes": b"!!"}, {"start": 9, "bytes": b"jkl"}]])
    assert repeats.confirmed(b"abcdefghij", spans[0]) == [(2, 6)]
    assert b"".join(repeats.rest(b"abcdefghij", [(2, 6)])) == b"abghij"


def test_rows_of_one_id_with_other_texts_do_not_crash(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text), (1, "other " + text), (1, "short"), (2, text)]
    out = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in remove_repeats(frame(spark, rows).coalesce(1)).collect())
    assert [r[:2] for r in out] == sorted((d, len(t)) for d, t in rows) and out[-1] == (2, len(text), len(text))


def test_segments_hold_every_window_once():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 2 * repeats.SEGMENT + 5000, dtype=np.uint8).tobytes()
    batch = pa.RecordBatch.from_pydict({"text": pa.array([data.decode()])})
    starts = np.concatenate([repeats.spread(first, more + 1)[1] for _, first, _, more, _ in repeats.sampled(batch, 100, 24)])
    assert len(starts) == len(data) - 99 and np.array_equal(np.sort(starts), np.arange(len(starts)))


def test_neighbours_need_a_long_common_prefix():
    def row(suffix, digest, doc, lead):
        return suffix.ljust(32, b"\0") + digest, doc, lead << 8

    a, b, c = (b"a" * 32, b"%08d" % 1, 1, 10), (b"a" * 32, b"%08d" % 2, 2, 10), (b"a" * 30 + b"xx", b"%08d" % 3, 3, 76)
    keys, docs, packed = zip(*(row(*r) for r in (a, b, c, (b"b" * 32, b"%08d" % 4, 4, 10), (b"c" * 32, b"%08d" % 5, 5, 10))), strict=True)
    matrix = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, repeats.WIDTH)
    batch = repeats.batch_of(repeats.ENTRY, np.zeros(5), matrix, np.array(docs), np.array(packed), -1)
    out = [x for x in repeats.merge_scan({}, frozenset([-1]), 100)(iter([batch.slice(0, 2), batch.slice(2)]))]
    near = sorted(d for x in out if x.column("kind")[0].as_py() == repeats.CANDIDATE for d in x.column("doc_id").to_pylist())
    assert near == [1, 2, 3, 5]  # 3 needs 24 bytes only; 5 ends the range; 4 is like nothing
    assert sorted(d for x in out if x.column("kind")[0].as_py() == repeats.ENTRY for d in x.column("doc_id").to_pylist()) == [1, 2, 3, 4, 5]


def test_cut_text_with_clashing_columns(spark):
    text = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(1, text, 1, "r", 2, "s"), (2, text, 3, "r", 4, "s")], "doc_id long, text string, _id int, row string, spans int, _runs string")
    out = {r.doc_id: tuple(r) for r in cut_repeats(df).collect()}
    assert out == {1: (1, text, 1, "r", 2, "s"), 2: (2, "", 3, "r", 4, "s")} and cut_repeats(df).schema == df.schema


def test_cut_text_is_valid_and_keeps_columns(spark):
    text = "é" * 120
    df = frame(spark, [(1, text), (2, "a" + text), (None, text), (4, None)])
    out = {r.doc_id: r for r in cut_repeats(df).collect()}
    assert cut_repeats(df).columns == df.columns
    assert out[1].text == "é" and out[2].text == "a" and out[None].text == text and out[4].text is None


def test_levels_merge_geometrically(spark):
    index = RepeatIndex(spark)
    ranks = []
    for i in range(4):
        index.add(frame(spark, [(i, " ".join(f"{i}-{j}" for j in range(80)))]))
        ranks.append(sorted(index.levels))
    assert ranks == [[0], [1], [0, 1], [2]]


@pytest.mark.parametrize("seed", [3, 4])
@pytest.mark.parametrize("most", [32, 2])
def test_near_duplicates_match_brute_force(spark, seed, most):
    rows = corpus(seed)
    got = {r.doc_id: tuple(r)[1:] for r in near_duplicates(frame(spark, rows), most=most).collect()}
    assert got == brute_links(rows)


def test_near_duplicates_over_the_small_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in near_duplicates(docs).collect()}
    assert got == brute_links([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_near_duplicates_of_repeated_null_and_no_rows(spark):
    rows = [(2, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (9, None)]
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in near_duplicates(frame(spark, rows)).collect())
    assert [g[:2] for g in got if g[0] > 0] == [(2, 2), (2, 2), (7, 2), (9, 9)]
    assert near_duplicates(frame(spark, rows).where("false")).count() == 0


def test_cover_keeps_the_same_bytes():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(0, 30))
        doc, start, size = rng.integers(0, 3, n), rng.integers(0, 60, n), rng.integers(1, 20, n)
        keep = repeats.cover(doc, start, size)

        def covered(rows, doc=doc, start=start, size=size):
            return {(doc[i], at) for i in rows for at in range(start[i], start[i] + size[i])}

        left = np.flatnonzero(keep)
        assert covered(left) == covered(range(n)) and all(covered(left[left != i]) != covered(left) for i in left)


def test_short_periods_make_few_spans(spark):
    """A text of period 5 has a run, and once had a span, for each period; each goes through the join with its source."""
    rng = random.Random(8)
    rows = [(i, "".join(rng.choices("abcdef", k=40)) + "qwert" * 600 + str(i), "", "") for i in range(4)]
    docs = spark.createDataFrame(rows, DOCS)
    _, _, folder = repeats.repeat_spans(docs, 100, 2)
    assert spark.read.parquet(f"{folder}/spans").count() < 4 * 45
    assert {r[0]: tuple(r)[1:] for r in remove_repeats(docs).collect()} == brute_repeats([r[:2] for r in rows])


def test_span_of_another_text_of_the_id_hides_none(spark):
    rng = random.Random(9)
    text = "".join(rng.choices("abcdefghij", k=450))
    source, other = text[:300], text[300:400] + text[100:250] + text[400:]
    docs = spark.createDataFrame([(0, source, "", ""), (5, source, "", ""), (5, other, "", "")], DOCS)
    assert sorted((r.doc_id, r.n_removed) for r in remove_repeats(docs).collect()) == [(0, 0), (5, 150), (5, 300)]
