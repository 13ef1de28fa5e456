"""The pipeline's stages, each against brute force on what the stage before kept."""

import re

import corpus_pipeline
from quarry.llm import quality
from quarry.llm.common import materialise
from test_dedup import brute_links, brute_repeats


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dups", "repeats", "decontaminate", "packing"]
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name == "packing":
            sums = {r.doc_id: (r.n, r.t) for r in out.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).toDF("doc_id", "n", "t").collect()}
            assert set(sums) == set(before) and all(n == t for n, t in sums.values())
            continue
        assert out.columns == columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        docs = materialise(out)
        after = {r.doc_id: r for r in docs.collect()}
        if name == "quality":
            scored = quality.classify(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
            assert set(after) == {r.doc_id for r in scored.where("predicted = 1").collect()}
        if name == "near_dups":
            assert set(after) == {d for d, (_, _, kept) in brute_links([(d, r.text) for d, r in before.items()]).items() if kept}
        if name == "repeats":
            want = brute_repeats([(d, r.text) for d, r in before.items()])
            assert set(after) == set(before)
            assert all((after[d].text == before[d].text) == (want[d][1] == 0) and after[d].n_chars == len(after[d].text) for d in after)
            assert all(0 <= want[d][0] - want[d][1] - len(after[d].text.encode()) <= 6 * want[d][2] for d in after)
        if name == "decontaminate":
            items = [words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            wins = {tuple(w[i : i + min(10, len(w))]) for w in items for i in range(len(w) - min(10, len(w)) + 1) if w}
            sizes = {len(x) for x in wins}
            texts = {d: words(r.text) for d, r in before.items()}
            dirty = {d for d, w in texts.items() if any(tuple(w[i : i + n]) in wins for n in sizes for i in range(len(w) - n + 1))}
            assert set(after) == set(before) - dirty
        before = after
