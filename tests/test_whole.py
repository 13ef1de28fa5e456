"""Graph queries read whole tables: cases that the standard tables lack, on small ones."""

import random

import pytest

import __spark_entry__
from quarry import catalog


def save(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def lines(orders, quantity=50.0):
    return [(o, n, p, 1, quantity) for o, parts in enumerate(orders) for n, p in enumerate(parts)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double"


def brute_scc(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)

    def reach(a):
        seen, todo = set(), [a]
        while todo:
            for b in out.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    far = {n: reach(n) for e in edges for n in e}
    groups = {n: [m for m in far[n] if n in far[m]] for n in far}
    return sorted((n, min(g)) for n, g in groups.items() if len(g) > 1)


@pytest.mark.parametrize("few", [0, None])
def test_components_of_all_lines(spark, tmp_path, few):
    rng = random.Random(5)
    orders = [[1, 101, 1], [2, 102, 202], [202, 2], [7, 8]] + [[rng.randrange(300, 330), rng.randrange(300, 330)] for _ in range(35)]
    sf = save(spark, tmp_path, lineitem=lines(orders))
    want = brute_scc([(a, b) for o in orders for a, b in zip(o, o[1:], strict=False) if a != b])
    run = __spark_entry__.queries()["scc_components"]
    got = run(spark, sf) if few is None else run(spark, sf, few)
    assert sorted(map(tuple, got.collect())) == want and {(1, 1), (101, 1), (2, 2), (102, 2), (202, 2)} <= set(want)


def test_every_event_has_its_place(spark, tmp_path):
    kinds = ["view", "click", "other", "purchase", "signup"]
    rows = [(i, kinds[i * 7 % 5]) for i in range(1000)]
    random.Random(6).shuffle(rows)
    sf = save(spark, tmp_path, events=(rows, "event_id long, event_type string"))
    order = {"purchase": 0, "signup": 1, "click": 2, "view": 3, "other": 99}
    want = [(i, k, n + 1) for n, (i, k) in enumerate(sorted(rows, key=lambda r: (order[r[1]], r[0])))]
    got = catalog.QUERIES["kind_rank_sort"](spark, sf)
    assert [tuple(r) for r in got.collect()] == want
    spark.createDataFrame([], "event_id long, event_type string").write.parquet(f"{sf}/none/events.parquet")
    assert catalog.QUERIES["kind_rank_sort"](spark, f"{sf}/none").count() == 0


def test_graph_queries_of_all_lines(spark, tmp_path):
    orders = [[1, 2, 3], [4, 2], [2, 3]]  # 1 and 4 are sources, 5 has no edge; no line is of 10 or less
    part = [(i, "STANDARD" if i == 4 else "PROMO", "Brand#1", 30) for i in range(1, 6)]
    sf = save(spark, tmp_path, lineitem=lines(orders), part=(part, "p_partkey long, p_type string, p_brand string, p_size int"))

    def run(name):
        return sorted(map(tuple, catalog.QUERIES[name](spark, sf).collect()))

    assert run("edge_build_distinct") == [(1, 2), (2, 3), (4, 2)]
    assert run("isolated_nodes") == [(5,)] and run("source_only_nodes") == [(1, 1), (4, 1)]
    assert run("connected_node_count") == [(4,)] and run("reach_within_3_hops") == [(1, 1), (4, 1)]
    assert run("layer_violation_edges") == [(4, 2, "STANDARD", "PROMO")]
    assert [r[:3] for r in run("heat_score")] == [(1, "high", 0), (2, "high", 2), (3, "high", 1), (4, "high", 0), (5, "high", 0)]


def test_queries_read_every_line():
    assert not [n for n, sql in catalog.ORACLES.items() if "l_quantity" in sql or "%" in sql and "lineitem" in sql and "LIKE" not in sql]
