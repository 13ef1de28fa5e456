"""The dependency graph: edges (src, dst), degrees, bounded reach, strongly connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import package_name
from ..plans.cut import cut


def edges_from_imports(imports: DataFrame) -> DataFrame:
    """Distinct internal edges; unresolved and external imports make none, self-imports do."""
    inside = imports.where(F.col("resolved_path").isNotNull() & ~F.col("is_external"))
    return inside.select(F.col("file_path").alias("src"), F.col("resolved_path").alias("dst")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """node, imported_by, imports: in- and out-degree of every node with an edge, in one aggregation.

    A union of both ends is cheaper than a full outer join of two aggregates: it shuffles partial counts once."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.i").cast("long").alias("imported_by"), F.sum("e.o").cast("long").alias("imports"))


def hottest(edges: DataFrame, k: int) -> DataFrame:
    """The k nodes with the highest in-degree, then out-degree, then the smallest name; `more` counts the rest."""
    d = degrees(edges)
    top = d.orderBy(F.desc("imported_by"), F.desc("imports"), "node").limit(k)
    total = d.agg(F.count("*").alias("total"))
    return top.crossJoin(F.broadcast(total)).select("node", "imported_by", "imports", F.greatest(F.lit(0), F.col("total") - k).cast("long").alias("more"))


def connected_count(edges: DataFrame) -> DataFrame:
    """How many nodes have an edge."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).agg(F.countDistinct("node").alias("nodes"))


def reach(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """node, hop: what the nodes of `start` (node) reach along src -> dst within `hops` steps, without start itself.

    One join and one anti-join a hop; the frontier is cut each time, so the plan does not grow. Reverse the edges for
    the blast radius, the nodes that depend on start."""
    seen = cut(start.select("node").distinct().withColumn("hop", F.lit(0)))
    frontier = seen
    for hop in range(1, hops + 1):
        step = frontier.select("node").join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("hop > 0")


def _spread(labels: DataFrame, edges: DataFrame, steps: int = 3) -> DataFrame:
    """labels (node, label) with the smallest label that flows along src -> dst, at a fixed point. Several steps go
    into one job, so a graph of diameter d takes about d / steps jobs."""
    while True:
        now = labels.withColumn("start", F.col("label"))
        for _ in range(steps):
            flow = edges.join(now, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("other"))
            now = now.join(flow, "node", "left").select("node", F.least("label", "other").alias("label"), "start")
        now = cut(now)
        labels = now.select("node", "label")
        if now.where("label < start").isEmpty():
            return labels


def _scc_local(edges: list[tuple]) -> list[tuple]:
    """(node, component) of components of two nodes or more: two depth-first passes without recursion."""
    out: dict = {}
    back: dict = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        back.setdefault(b, []).append(a)
    order, seen = [], set()
    for root in out:
        stack = [(root, iter(out[root]))] if root not in seen else []
        seen.add(root)
        while stack:
            node, rest = stack[-1]
            nxt = next((n for n in rest if n not in seen), None)
            if nxt is None:
                order.append(node)
                stack.pop()
            else:
                seen.add(nxt)
                stack.append((nxt, iter(out.get(nxt, ()))))
    rows, done = [], set()
    for root in reversed(order):
        group, todo = [], [root]
        while todo:
            n = todo.pop()
            if n not in done:
                done.add(n)
                group.append(n)
                todo += back.get(n, ())
        if len(group) > 1:
            first = min(group)
            rows += [(n, first) for n in group]
    return rows


def scc(edges: DataFrame, few: int = 100_000) -> DataFrame:
    """node, component: strongly connected components of two nodes or more, named by their smallest node.

    Up to `few` edges, a bound on what reaches the driver, are solved there; more are solved by joins, with the same result.
    Each round trims nodes that have no way in or out, colours the rest by the smallest node that reaches them,
    and takes for each colour the nodes that reach the node of that name inside it. Iterative, no recursion and no collect."""
    left = cut(edges.where("src <> dst").select("src", "dst").distinct())
    head = left.limit(few + 1).collect()
    if len(head) <= few:
        node, _ = left.schema.fields
        return edges.sparkSession.createDataFrame(_scc_local([tuple(e) for e in head]), f"node {node.dataType.simpleString()}, component {node.dataType.simpleString()}")
    found = None
    while n := left.count():
        while n:  # trim, until a pass takes little; what is left of the leaves costs time, not correctness
            keep = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
            left = cut(keep.select("src", "dst"))
            before, n = n, left.count()
            if before - n <= before // 50:
                break
        if not n:
            break
        nodes = left.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        colour = _spread(cut(nodes.withColumn("label", F.col("node"))), left)
        inside = left.join(colour.select(F.col("node").alias("src"), F.col("label").alias("c")), "src").join(colour.select(F.col("node").alias("dst"), F.col("label").alias("d")), "dst").where("c = d").select("src", "dst")
        # Backwards inside each colour: the root's name flows against the edges; nodes that get it are its component.
        back = _spread(cut(colour.select("node", F.when(F.col("node") == F.col("label"), F.lit(0)).otherwise(1).alias("label"))), cut(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
        part = cut(back.where("label = 0").join(colour.withColumnRenamed("label", "component"), "node").select("node", "component"))
        found = part if found is None else found.unionByName(part)
        gone = part.select("node")
        left = cut(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    if found is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).where("false")
    many = found.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    return found.join(many, "component").select("node", "component")


def external_packages(imports: DataFrame) -> DataFrame:
    """package, used_by: distinct files that import each external package."""
    out = imports.where("is_external").select("file_path", package_name("source", "language").alias("package"))
    return out.groupBy("package").agg(F.countDistinct("file_path").alias("used_by"))


def file_tree(paths: DataFrame, column: str = "relative_path") -> DataFrame:
    """path, parent, name, depth, is_dir: every file and folder once."""
    parts = paths.select(F.array_remove(F.split(column, "/"), "").alias("p")).where(F.size("p") > 0)
    each = parts.select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("depth"))
    rows = each.select(F.array_join(F.slice("p", 1, F.col("depth")), "/").alias("path"), F.array_join(F.slice("p", 1, F.col("depth") - 1), "/").alias("parent"), F.element_at("p", F.col("depth")).alias("name"), "depth", (F.col("depth") < F.size("p")).alias("is_dir"))
    return rows.groupBy("path", "parent", "name", "depth").agg(F.bool_or("is_dir").alias("is_dir"))
