"""Corpus operators against the libraries, brute force and round trips."""

import collections
import hashlib
import math
import random
import re
import zlib
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import catalog, decontaminate, packing, quality, shards, token_counts, topk, warc
from quarry.llm.common import components, work_dir
from quarry.llm.token_ids import Encoder

BPE, PIECES = catalog.tokenizer("byte_bpe_50k.json"), catalog.tokenizer("piece_bpe_32k.model")
ODD = [None, "", " ", "\n\n", "a" * 5000, "<|endoftext|> x", "日本語 text", "é \U0001f600", "'ll  it's\t x", "\x00 \x1c \x85 \xa0 ² ª"]
#: Columns whose names clash with those used inside.
DOCS = "doc_id long, text string, n long, rep string, slot int, runs string, kept string, grp int, w string, pos int, score double, length long"


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, 1, "x", 2, "y", "z", 3, "w", 4, 0.5, 6) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def corpus(spark, sf):
    return [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]


# --- token counts


def unigram(vocabulary, byte_fallback):
    from tokenizers import Tokenizer, models, pre_tokenizers

    extra = [(f"<0x{i:02X}>", -1e9) for i in range(256)] if byte_fallback else []
    t = Tokenizer(models.Unigram([("<unk>", 0.0), *extra, *vocabulary], 0, byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_counts_equal_the_librarys_ties_included(byte_fallback):
    rnd = random.Random(5)
    ties = [("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁a", -2.0), ("bb", -1.5)]
    for vocabulary, letters in ((ties, "aab bcé"), (token_counts.zipf_vocabulary(PIECES), "ab▁ c\n日\U0001f600\x00é  zt")):
        library, counter = unigram(vocabulary, byte_fallback), token_counts.Counter(vocabulary, byte_fallback, most=50)
        for _ in range(1500):
            text = "".join(rnd.choice(letters) for _ in range(rnd.randrange(14)))
            assert counter.text(text)[0] == (len(library.encode(text).ids) if text else 0), text


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_long_words_in_a_window(byte_fallback):
    rnd = random.Random(6)
    ties = [("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁a", -2.0), ("bb", -1.5)]
    for vocabulary, letters in ((ties, "abé"), (token_counts.zipf_vocabulary(PIECES), "ab日c😀\x00éztheingst")):
        counter = token_counts.Counter(vocabulary, byte_fallback)
        for n in [0, 1, 2, 3, 17, 200, 3000] * 3:
            word = "▁" + "".join(rnd.choice(letters) for _ in range(n))
            assert counter.count_long(word) == counter.count(word)
    assert counter.text("the" * 400_000)[1] == 1


def test_count_query(spark, sf):
    texts = corpus(spark, sf) + ODD
    library = unigram(token_counts.zipf_vocabulary(PIECES), True)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs(spark, texts), PIECES).collect()}
    assert got == {i: len(library.encode(t).ids) if t else 0 for i, t in enumerate(texts)}
    assert token_counts.count_tokens(docs(spark, ["a"]).where("false"), PIECES).count() == 0


# --- ids and packing


def test_ids_equal_the_librarys():
    with open(BPE, encoding="utf-8") as f:
        e = Encoder(f.read(), most=100)
    assert e.single is not None
    rnd = random.Random(2)
    letters = ["a", "B", " ", "  ", "\n", "\t", "'s", "'ll", "1", "é", "ß", "日", "\U0001f600", "<|endoftext|>", "\x00", "\x1c", "\x85", "\xa0", "…", "%", "¼", "²", "ª", "ʼ"]
    for _ in range(4000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randrange(11)))
        assert e.ids(text) == e.whole(text), text


def naive_first_fit(sizes, capacity):
    rooms, out = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = next((b for b, r in enumerate(rooms) if r >= sizes[i]), len(rooms))
        rooms += [capacity] * (b == len(rooms))
        out[i] = (b, capacity - rooms[b])
        rooms[b] -= sizes[i]
    return out


def test_first_fit_equals_the_naive_one():
    rnd = random.Random(3)
    for n in (0, 1, 2, 7, 300):
        sizes = [rnd.randrange(1, 65) for _ in range(n)]
        bins, offsets = packing.first_fit_decreasing(np.array(sizes, np.int64), 64)
        assert {i: (int(b), int(o)) for i, (b, o) in enumerate(zip(bins, offsets, strict=True))} == naive_first_fit(sizes, 64)


def test_best_fit_takes_the_fullest_bin():
    rnd = random.Random(4)
    for n in (1, 2, 7, 300):
        sizes = np.array([rnd.randrange(1, 65) for _ in range(n)])
        bins, offsets = packing.best_fit_decreasing(sizes, 64)
        rooms: dict[int, int] = {}
        for i in np.argsort(-sizes, kind="stable"):
            fits = [r for r in rooms.values() if r >= sizes[i]]
            before = rooms.get(int(bins[i]), 64)
            assert before == (min(fits) if fits else 64) and offsets[i] == 64 - before
            rooms[int(bins[i])] = before - int(sizes[i])
        assert min(rooms.values()) >= 0


def encoded(texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for x in texts]


def test_pieces_hold_every_id_once(spark, sf):
    texts = corpus(spark, sf)[:60] + ODD
    want = encoded(texts, 0)
    rows = packing.pack_pieces(docs(spark, texts), BPE, capacity=256, group_docs=20).collect()
    fill: dict[int, list] = {}
    seen: dict[int, int] = {}
    for r in rows:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(want[r.doc_id]) and len(ids) == r.length > 0
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {i: len(w) for i, w in enumerate(want)}
    for places in fill.values():
        ends = 0
        for offset, length in sorted(places):
            assert offset == ends
            ends += length
        assert ends <= 256


def test_packed_rows_give_the_documents_back(spark, sf):
    texts = corpus(spark, sf)[:40] + ODD
    want = encoded(texts, 50256)
    parts: dict[int, list] = {}
    packed = packing.pack_ids(docs(spark, texts), BPE, capacity=128, group_docs=15)
    folder = work_dir(spark)
    files = packing.write_matrices(packed, folder, rows_per_file=7)
    rows = packing.read_matrices(files).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, packed.collect())) and files.count() > 1 and files.agg(F.sum("rows")).first()[0] == len(rows)
    for r in rows:
        ids, places = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(places) == 128 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        assert set(ids[r.n_tokens :].tolist()) <= {50256}
        for d, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            assert places[a:b].tolist() == list(range(b - a))
            parts.setdefault(d, []).append((start, ids[a:b].tolist()))
    assert any(len(p) > 3 for p in parts.values())
    for d, w in enumerate(want):  # in the order of their starts
        assert [x for _, p in sorted(parts[d]) for x in p] == w and all(start % 128 == 0 for start, _ in parts[d])


def test_packing_of_repeats_nulls_and_nothing(spark):
    rows = packing.pack_pieces(docs(spark, ["a b", "a b", None], ids=[1, 1, None]), BPE).collect()
    assert sorted((r.doc_id is None, r.length) for r in rows) == [(False, 3), (False, 3), (True, 1)]
    assert packing.pack_pieces(docs(spark, ["a"]).where("false"), BPE).count() == 0
    assert packing.pack_ids(docs(spark, ["a"]).where("false"), BPE).count() == 0
    assert packing.write_matrices(packing.pack_ids(docs(spark, ["a"]).where("false"), BPE), work_dir(spark)).count() == 0


def test_equal_rows_and_null_ids_fill_no_group(spark):
    frame = docs(spark, ["a b"] * 200 + [f"x {i}" for i in range(200)], ids=[None] * 400).coalesce(1)
    found = packing.grouped(packing.pieces(frame, BPE, 1024, 0, False), 400, 40, 17)
    assert found.count() == 400 and max(r["count"] for r in found.groupBy("grp").count().collect()) < 80


# --- decontamination


def brute_hits(texts, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    wins = {}
    for k, t in items:
        w = words(t)
        if w and k is not None:
            n = min(10, len(w))
            for i in range(len(w) - n + 1):
                wins.setdefault(tuple(w[i : i + n]), set()).add(k)
    out = {}
    for d, t in texts:
        w, hit, names = words(t), set(), set()
        for i in range(len(w)):
            for n in {len(x) for x in wins}:
                if i + n <= len(w) and (found := wins.get(tuple(w[i : i + n]))):
                    hit |= set(range(i, i + n))
                    names |= found
        out[d] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(map(str, names))).encode()).hexdigest(), bool(hit))
    return out


def test_decontamination_against_brute_force(spark):
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "été", "A1", "the"]
    texts = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(80)))) for i in range(60)]
    items = [(1, texts[3][1][:90]), (10, texts[5][1]), (2, "The, W1"), (3, "the"), (4, None), (5, "..."), (None, "the"), (7, "the"), (7, "the"), (8, "the the the")]
    texts += [(100, None), (101, ""), (102, "the " * 300), (103, "THE-w1"), (104, "x" * 9000)]
    bench = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, win int")
    frame = docs(spark, [t for _, t in texts], ids=[d for d, _ in texts])
    for most in (1000, 0):  # broadcast, and the join by a shuffle
        got = {r.doc_id: tuple(r)[1:] for r in decontaminate.decontaminate(frame, bench, most=most).collect()}
        assert got == brute_hits(texts, items)
    none = decontaminate.decontaminate(frame, bench.where("false"))
    assert none.where("contaminated").count() == 0 and none.count() == len(texts)
    assert decontaminate.decontaminate(frame.where("false"), bench).count() == 0


def test_decontamination_searches_every_row_for_itself(spark):
    bench = spark.createDataFrame([(1, "the whole passage")], "item_id long, text string")
    texts = ["see the whole passage", "see the whole passage", "clean", None, "the whole passage", "nothing"]
    frame = docs(spark, texts, ids=[None, 4, None, None, 7, 7])
    for most in (1000, 0):
        for df in (frame, frame.coalesce(1)):
            got = sorted((r.doc_id or -1, r.n_words, r.n_hit, r.contaminated) for r in decontaminate.decontaminate(df, bench, most=most).collect())
            assert got == [(-1, 0, 0, False), (-1, 1, 0, False), (-1, 4, 3, True), (4, 4, 3, True), (7, 1, 0, False), (7, 3, 3, True)]
        kept = decontaminate.clean(frame, bench, most=most)
        assert kept.columns == frame.columns and sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == [(-1, ""), (-1, "clean"), (7, "nothing")]


# --- top k


@pytest.mark.parametrize("block", [4096, 16])
def test_top_k_against_brute_force(spark, block):
    rng = np.random.default_rng(9)
    vectors = [(i, [float(x) for x in rng.normal(size=6) / 3]) for i in range(150)]
    vectors += [(200 + i, [0.25, 0.5, -0.1, 0.0, 0.3, 0.2]) for i in range(90)]
    vectors += [(400, None), (401, [None] * 6), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (404, [1.0]), (405, []), (None, [0.1] * 6), (20, [-9.0] * 6), (21, [9.0] * 6), (22, [0.1] * 6), (22, [0.1] * 6), (406, [3e38] * 6)]
    df = spark.createDataFrame([(i, v, 1, 2.0, 3) for i, v in vectors], "vec_id long, embedding array<float>, cell int, far double, rank int")
    whole = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            q = [min(topk.MOST, int(np.floor(64 * float(np.float32(x))))) for x in v] + [0] * (6 - len(v))
            whole.setdefault(i, []).append(q)
    want = set()
    for i in whole:
        if i % 20 == 0:  # of several vectors under one id the best score counts
            best = sorted(((-max(sum(a * b for a, b in zip(p, q, strict=True)) for p in whole[i] for q in v), j) for j, v in whole.items() if j != i))[:20]
            want |= {(i, n, j, -s) for n, (s, j) in enumerate(best, 1)}
    out = topk.top_k(df, F.col("vec_id") % 20 == 0, pivots=8, block=block)
    assert {tuple(r) for r in out.collect()} == want
    assert topk.top_k(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    few = topk.top_k(df.where("vec_id IN (20, 21, 22)"), F.col("vec_id") % 20 == 0)
    assert [(r.query_id, r["rank"]) for r in few.orderBy("rank").collect()] == [(20, 1), (20, 2)]


def test_vectors_go_only_to_blocks_that_ask(spark):
    placed = spark.createDataFrame([(i, [i], i % 3) for i in range(90)], "vec_id long, v array<bigint>, cell int")
    by = spark.createDataFrame([(0, 2, 4), (1, 1, 1)], "cell int, chunks int, parts int")  # no query asks for cell 2
    rows = topk.sent(placed, by).groupBy("cell").agg(F.count("*"), F.countDistinct("vec_id"), F.countDistinct("chunk", "part")).collect()
    assert sorted(map(tuple, rows)) == [(0, 120, 30, 8), (1, 30, 30, 1)]


# --- WARC


def test_warc_round_trip_and_lookup(spark, sf):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    pages += [(9001, "http://A.Example.org/x?y", "same"), (9002, None, "same"), (9003, "http://a.example.org/x?y", "same"), (9004, "not a url\r\nX: y", None), (9005, "http://b/", ""), (None, "http://c/", "null id"), (9006, "u", "é" * 30000)]
    df = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, html string, key string, last string")
    folder = work_dir(spark)
    captures = warc.write_archives(df, f"{folder}/warc", roll=60_000)
    directory = warc.build_index(captures, f"{folder}/index", lines=7)
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to, r.payload) for r in warc.read_all(directory, payloads=True).collect()}
    last: dict[bytes, int] = {}
    for i, _, h in pages:
        if i is not None:
            last[(h or "").encode()] = max(last.get((h or "").encode(), i), i)
    for i, _, h in pages:
        body = (h or "").encode()
        revisit = last.get(body) is not None and i != last[body]
        assert got[i] == (len(body), "revisit" if revisit else "response", last[body] if revisit else None, None if revisit else bytearray(body))
    assert len(got) == len(pages) and captures.select("file").distinct().count() > 1
    assert sorted(r[0] for r in warc.lookup(spark, directory, "https://a.EXAMPLE.org/x?y")) == [9001, 9003]
    assert warc.lookup(spark, directory, "http://nothing/") == []
    assert warc.round_trip(df.where("false"), work_dir(spark)).count() == 0
    one, many = warc.read_all(directory), warc.read_all(directory, slab=8192)
    assert one.rdd.getNumPartitions() == 1 and many.rdd.getNumPartitions() > 5 and many.count() == len(pages)


# --- shards


def test_shards_compact_and_commit(spark):
    store = shards.ShardStore(spark, work_dir(spark), target=40_000, least=1_000, fanout=3)
    df = docs(spark, ["text %d" % i * 20 for i in range(600)] + [None])
    for i in range(4):
        store.append(df.where(F.pmod("doc_id", F.lit(4)) == i).repartition(2), shard_rows=40)
    before = store.manifest()
    small, version = before.count(), store.version()
    store.compact()
    after = store.manifest()
    assert after.count() < small and after.agg(F.sum("rows")).first()[0] == 601 and store.version() > version == 4
    assert store.tiers(after).where("tier >= 0").groupBy("tier").count().where("count >= 3").count() == 0
    assert sorted(map(str, store.read().collect())) == sorted(map(str, df.collect()))
    assert store.read(1).count() == 151
    with pytest.raises(shards.CommitConflict):
        store._commit(version - 1, before)
    (spark.range(3).write.parquet(f"{store.root}/data/failed"))  # what a writer that died has left
    store.vacuum(older_than_s=3600)
    assert spark.read.parquet(f"{store.root}/data/failed").count() == 3
    store.vacuum()
    assert store.read().count() == 601 and store.oldest() == store.version()
    left = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{store.root}/data").count()
    assert left == store.manifest().count()
    with pytest.raises(ValueError):
        store.read(1)
    assert store.append(df.where("false")) == store.version() and store.read().count() == 601


def test_of_two_writers_one_commits_and_the_other_tries_again(spark):
    store = shards.ShardStore(spark, work_dir(spark))
    store.append(spark.range(5).coalesce(1))
    files, schema = store.manifest(1), store.schema(1)

    def commit(_):
        try:
            return store._commit(1, files, schema)
        except shards.CommitConflict:
            return None

    with ThreadPoolExecutor(4) as pool:
        assert sorted(pool.map(commit, range(4)), key=str) == [2, None, None, None]
        versions = sorted(pool.map(lambda i: store.append(spark.range(10 * i, 10 * i + 3).coalesce(1)), range(1, 5)))
    assert versions == [3, 4, 5, 6] and store.read().count() == 5 + 4 * 3


def test_shards_of_an_empty_table(spark, tmp_path):
    from quarry.llm import catalog

    docs(spark, ["a"]).selectExpr("doc_id", "text", "'en' AS lang", "'web' AS source", "1L AS n_chars").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert catalog.op3_sharding(spark, str(tmp_path)).count() == 0


def test_shards_keep_a_column_that_some_arrivals_have(spark):
    store = shards.ShardStore(spark, work_dir(spark), least=1_000_000, fanout=3)
    plain, more = spark.range(3).coalesce(1), spark.range(3, 5).selectExpr("id", "'x' AS extra").coalesce(1)
    for rows in (plain, more, plain):
        store.append(rows)
    want = [(0, None)] * 2 + [(1, None)] * 2 + [(2, None)] * 2 + [(3, "x"), (4, "x")]
    assert sorted(map(tuple, store.read().collect()), key=lambda r: r[0]) == want and store.read(1).columns == ["id"]
    assert store.compact() == 4
    store.vacuum()
    assert sorted(map(tuple, store.read().collect()), key=lambda r: r[0]) == want
    with pytest.raises(TypeError):
        store.append(spark.range(1).selectExpr("id", "1 AS extra"))
    assert store.version() == 4


# --- quality


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    out = catalog.op10_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert len(out) > 50 and ((out.predicted == out.quality).mean()) > 0.97
    assert out.score.between(0, 1).all()


def naive_ftrl(rows, bits, alpha=0.5, beta=1.0, l1=0.02, l2=0.1, updates=36_000, weight_0=3.0):
    """The published update, one feature at a time, in plain Python."""
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    for _ in range(min(100, math.ceil(updates / len(rows)))):
        for slots, values, label in rows:
            x = [*zip(slots.tolist(), values.tolist(), strict=True), (1 << bits, 1.0)]
            p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in x)))
            for i, v, w in [(i, v, weight(i)) for i, v in x]:
                g = (p - label) * (1.0 if label else weight_0) * v
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i], n[i] = z.get(i, 0.0) + g - sigma * w, n.get(i, 0.0) + g * g
    return np.array([weight(i) for i in range((1 << bits) + 1)])


def naive_features(text, bits):
    """Counts of words, pairs, shapes and pairs of shapes, each hashed as the operator says, by a plain loop."""
    words = re.findall(r"\w+|[^\w\s]+", text)
    mask, mark = (1 << 64) - 1, 0x9E3779B97F4A7C15
    low = [xxhash.xxh64_intdigest(re.sub(r"(.)\1{3,}", r"\1\1\1", w.lower())) for w in words]
    one = [mark if i and low[i] == low[i - 1] else h for i, h in enumerate(low)]
    shape = [xxhash.xxh64_intdigest("\0" + ("U" if w.isupper() and len(w) > 1 else "T" if w[:1].isupper() else "l" if w.isalpha() else "d" if w.isdigit() else "p")) for w in words]
    every = one + [(a * 0x9DDFEA08EB382D69 + b) & mask for a, b in zip(one, one[1:], strict=False)]
    every += shape + [(a * 0xD6E8FEB86659FD93 + b) & mask for a, b in zip(shape, shape[1:], strict=False)]
    counts = collections.Counter((((h ^ h >> 32) * 0xFF51AFD7ED558CCD) & mask) >> (64 - bits) for h in every)
    norm = math.sqrt(sum(c / len(words) for c in counts.values())) if words else 1
    return {s: math.sqrt(c / len(words)) / norm for s, c in counts.items()}


def test_ftrl_and_scores_equal_naive_ones(spark, sf):
    texts = corpus(spark, sf)[:40] + ODD
    for t in texts:
        slots, values = quality.features(t or "", 12)
        assert dict(zip(slots.tolist(), values.tolist(), strict=True)) == pytest.approx(naive_features(t or "", 12))
    labels = [(i, i % 3 > 0) for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    frame = docs(spark, texts)
    weights = quality.train(frame, spark.createDataFrame([(i, int(y)) for i, y in labels], "doc_id long, quality int"), bits=12)
    # The order of updates is that of the ids' hashes, as Spark has them.
    order = [r.doc_id for r in spark.createDataFrame([(i,) for i, _ in labels], "doc_id long").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    rows = [(*(x.astype(t) for x, t in zip(quality.features(texts[i] or "", 12), (np.int32, np.float32), strict=True)), int(dict(labels)[i])) for i in order]
    assert weights == pytest.approx(naive_ftrl(rows[:], 12, updates=36_000), abs=1e-6)
    got = {r.doc_id: r.score for r in quality.score(frame, weights).collect()}
    want = {i: 1 / (1 + math.exp(-weights[-1] - sum(v * weights[s] for s, v in naive_features(t or "", 12).items()))) for i, t in enumerate(texts)}
    assert got == pytest.approx(want, abs=1e-5)


def test_quality_of_odd_rows(spark):
    frame = docs(spark, ODD)
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(frame, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert {r.doc_id: r.held_out for r in rows} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(len(ODD))}
    assert {r.score for r in quality.classify(frame, labels.where("false")).collect()} == {0.5}
    assert quality.classify(frame.where("false"), labels).count() == 0


# --- components


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(5, 5)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 1), **dict.fromkeys(range(100, 140), 100)}
