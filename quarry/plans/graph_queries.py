"""Graph operators on a dependency graph of parts: in each order, a part points to the next line's part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import case_map, heat_score
from ..operators import graph
from ..operators.ranking import primary_and_related
from .cut import cut
from .registry import WITHOUT_SQL, query, table


def part_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct (src, dst) over all lines; one shuffle by order, one of the pairs."""
    lines = table(spark, sf, "lineitem")
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return lines.select(F.col("l_partkey").alias("src"), after.alias("dst")).where("dst IS NOT NULL AND src <> dst").distinct()


E = "e AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem) WHERE dst IS NOT NULL AND src <> dst)"
DEGREES = "d AS (SELECT node, CAST(sum(i) AS BIGINT) AS imported_by, CAST(sum(o) AS BIGINT) AS imports FROM (SELECT dst AS node, 1 AS i, 0 AS o FROM e UNION ALL SELECT src, 0, 1 FROM e) GROUP BY node)"
SCORE = "CAST(floor((CASE severity WHEN 'critical' THEN 100 WHEN 'high' THEN 50 WHEN 'medium' THEN 20 WHEN 'low' THEN 5 ELSE 0 END) * (1.0 + log10(1.0 + greatest(0, heat))) + 0.5) AS BIGINT)"


@query(f"WITH {E} SELECT src, dst FROM e")
def edge_build_distinct(spark, sf):
    return part_edges(spark, sf)


@query(f"WITH {E}, {DEGREES} SELECT node, imported_by, imports, CAST(greatest(0, (SELECT count(*) FROM d) - 15) AS BIGINT) AS more FROM d ORDER BY imported_by DESC, imports DESC, node LIMIT 15")
def degree_rank_topk(spark, sf):
    return graph.hottest(part_edges(spark, sf), 15)


@query(f"WITH {E} SELECT count(DISTINCT node) AS nodes FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e)")
def connected_node_count(spark, sf):
    return graph.connected_count(part_edges(spark, sf))


def _blast(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(start, reach) of the most depended-on part, against the edges."""
    edges = part_edges(spark, sf)
    start = graph.degrees(edges).orderBy(F.desc("imported_by"), F.desc("imports"), "node").limit(1).select("node")
    return start, graph.reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start, 3)


REACH = f"""WITH RECURSIVE {E}, {DEGREES}, s AS (SELECT node FROM d ORDER BY imported_by DESC, imports DESC, node LIMIT 1),
r(node, hop) AS (SELECT node, 0 FROM s UNION SELECT e.src, r.hop + 1 FROM r JOIN e ON e.dst = r.node WHERE r.hop < 3),
m AS (SELECT node, CAST(min(hop) AS INTEGER) AS hop FROM r GROUP BY node)"""


@query(f"{REACH} SELECT node, hop FROM m WHERE hop > 0")
def reach_within_3_hops(spark, sf):
    return _blast(spark, sf)[1]


@query(f"{REACH} SELECT DISTINCT l_orderkey AS orderkey FROM lineitem WHERE l_partkey IN (SELECT node FROM m)")
def reach_semi_join_orders(spark, sf):
    start, found = _blast(spark, sf)
    hit = found.select("node").unionByName(start)
    return table(spark, sf, "lineitem").join(hit, F.col("l_partkey") == F.col("node"), "left_semi").select(F.col("l_orderkey").alias("orderkey")).distinct()


def scc_components(spark: SparkSession, sf: str, few: int = 100_000) -> DataFrame:
    """Components of the graph of all parts. Recursive SQL would need the closure of the whole graph, so there is none."""
    return graph.scc(part_edges(spark, sf), few)


def scc_components_by_joins(spark: SparkSession, sf: str) -> DataFrame:
    """The same by joins alone, as for graphs that are too large for the driver."""
    return graph.scc(part_edges(spark, sf), 0)


WITHOUT_SQL |= {"scc_components": scc_components, "scc_components_by_joins": scc_components_by_joins}


LAYERS = ("STANDARD", "ECONOMY"), ("PROMO", "LARGE")


@query(f"""WITH {E} SELECT src, dst, s.p_type AS src_type, t.p_type AS dst_type FROM e JOIN part s ON s.p_partkey = src JOIN part t ON t.p_partkey = dst
WHERE (s.p_type LIKE '%STANDARD%' OR s.p_type LIKE '%ECONOMY%') AND (t.p_type LIKE '%PROMO%' OR t.p_type LIKE '%LARGE%')""")
def layer_violation_edges(spark, sf):
    from ..functions.scalars import any_of

    part = table(spark, sf, "part")
    low = part.where(any_of("p_type", list(LAYERS[0]))).select(F.col("p_partkey").alias("src"), F.col("p_type").alias("src_type"))
    high = part.where(any_of("p_type", list(LAYERS[1]))).select(F.col("p_partkey").alias("dst"), F.col("p_type").alias("dst_type"))
    return part_edges(spark, sf).join(low, "src").join(high, "dst").select("src", "dst", "src_type", "dst_type")


SEVERITY = "CASE WHEN p_size > 40 THEN 'critical' WHEN p_size > 25 THEN 'high' WHEN p_size > 10 THEN 'medium' ELSE 'low' END"


def _severity():
    return F.when(F.col("p_size") > 40, "critical").when(F.col("p_size") > 25, "high").when(F.col("p_size") > 10, "medium").otherwise("low")


@query(f"WITH {E}, {DEGREES}, f AS (SELECT p_partkey AS node, {SEVERITY} AS severity, coalesce(imported_by, 0) AS heat FROM part LEFT JOIN d ON node = p_partkey) SELECT node, severity, heat, {SCORE} AS score FROM f", "heat_score")
def heat_score_parts(spark, sf):
    d = graph.degrees(part_edges(spark, sf))
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("node"), _severity().alias("severity"))
    rows = parts.join(d, "node", "left").select("node", "severity", F.coalesce("imported_by", F.lit(0)).cast("long").alias("heat"))
    return rows.withColumn("score", heat_score("severity", "heat"))


@query(f"WITH {E} SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT src FROM e) AND p_partkey NOT IN (SELECT dst FROM e)")
def isolated_nodes(spark, sf):
    nodes = part_edges(spark, sf).select(F.explode(F.array("src", "dst")).alias("node"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("node")).join(nodes, "node", "left_anti")


@query(f"WITH {E}, {DEGREES} SELECT node, imports FROM d WHERE imports > 0 AND imported_by = 0")
def source_only_nodes(spark, sf):
    return graph.degrees(part_edges(spark, sf)).where("imports > 0 AND imported_by = 0").select("node", "imports")


@query(f"""WITH {E}, {DEGREES}, r AS (SELECT p_brand AS brand, p_partkey AS part, coalesce(imported_by, 0) AS heat, row_number() OVER (PARTITION BY p_brand ORDER BY coalesce(imported_by, 0) DESC, p_partkey) AS n FROM part LEFT JOIN d ON node = p_partkey)
SELECT brand, max(part) FILTER (n = 1) AS "primary", max(heat) FILTER (n = 1) AS heat, coalesce(string_agg(CAST(part AS VARCHAR), ',' ORDER BY n) FILTER (n > 1), '') AS related FROM r GROUP BY brand""", "primary_and_related")
def primary_and_related_parts(spark, sf):
    d = graph.degrees(part_edges(spark, sf)).withColumnRenamed("node", "part")
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("part")).join(d, "part", "left").select("brand", "part", F.coalesce("imported_by", F.lit(0)).cast("long").alias("heat"))
    out = primary_and_related(rows, "brand", "part", "heat")
    return out.withColumn("related", F.array_join(F.transform("related", lambda x: x.cast("string")), ","))


@query(f"""WITH {E}, {DEGREES}, f AS (
  SELECT 'hot-part' AS rule, 1 AS rule_order, CASE WHEN imported_by >= 8 THEN 'critical' WHEN imported_by >= 5 THEN 'high' ELSE 'medium' END AS severity, node, imported_by AS heat FROM d WHERE imported_by >= 3
  UNION ALL SELECT 'isolated', 2, 'medium', p_partkey, 0 FROM part WHERE p_partkey NOT IN (SELECT node FROM d)
  UNION ALL SELECT 'source-only', 3, 'low', node, 0 FROM d WHERE imported_by = 0 AND imports > 0)
SELECT rule, rule_order, severity, node, heat, {SCORE} AS score FROM f""")
def rules_union_ranked(spark, sf):
    d = graph.degrees(part_edges(spark, sf))
    heat = F.col("imported_by")
    ladder = F.when(heat >= 8, "critical").when(heat >= 5, "high").otherwise("medium")

    def finding(rows, rule, order, severity, h):
        return rows.select(F.lit(rule).alias("rule"), F.lit(order).alias("rule_order"), severity.alias("severity"), "node", h.cast("long").alias("heat"))

    lone = table(spark, sf, "part").select(F.col("p_partkey").alias("node")).join(d, "node", "left_anti")
    every = finding(d.where(heat >= 3), "hot-part", 1, ladder, heat).unionByName(finding(lone, "isolated", 2, F.lit("medium"), F.lit(0)))
    every = every.unionByName(finding(d.where("imported_by = 0 AND imports > 0"), "source-only", 3, F.lit("low"), F.lit(0)))
    return every.withColumn("score", heat_score("severity", "heat")).orderBy(F.desc("score"), "rule_order", "node")


@query("""SELECT severity, CAST(count(s) AS BIGINT) AS n FROM (VALUES ('critical'), ('high'), ('medium'), ('low')) v(severity) LEFT JOIN (SELECT CASE WHEN n >= 70 THEN 'critical' WHEN n >= 60 THEN 'high' WHEN n >= 50 THEN 'medium' ELSE 'low' END AS s FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey)) ON s = severity GROUP BY severity""")
def severity_ladder_counts(spark, sf):
    n = F.col("n")
    per = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    bucket = F.when(n >= 70, "critical").when(n >= 60, "high").when(n >= 50, "medium").otherwise("low")
    counts = per.groupBy(bucket.alias("severity")).agg(F.count("*").alias("k"))
    levels = spark.createDataFrame([(s,) for s in ("critical", "high", "medium", "low")], "severity string")
    return levels.join(counts, "severity", "left").select("severity", F.coalesce("k", F.lit(0)).cast("long").alias("n"))


@query("""SELECT l_suppkey AS supplier, count(*) AS n, CASE WHEN count(*) >= 25 THEN 'critical' ELSE 'high' END AS severity FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY l_suppkey HAVING count(*) >= 15""")
def monolith_exempt(spark, sf):
    exempt = table(spark, sf, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    rows = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n")).where("n >= 15").join(exempt, "l_suppkey", "left_anti")
    return rows.select(F.col("l_suppkey").alias("supplier"), "n", F.when(F.col("n") >= 25, "critical").otherwise("high").alias("severity"))


@query("""SELECT event_id, event_type, row_number() OVER (ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 99 END, event_id) AS place FROM events""")
def kind_rank_sort(spark, sf):
    """Every event in order; a place is its row number in its partition and the counts of the partitions before."""
    rank = case_map("event_type", {"purchase": 0, "signup": 1, "click": 2, "view": 3}, 99)
    rows = cut(table(spark, sf, "events").select("event_id", "event_type").orderBy(rank, "event_id"))  # written, so partitions stay as they are
    rows = rows.select("*", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("i"))
    before, offsets = 0, []
    for r in rows.groupBy("p").agg(F.count("*").alias("n")).orderBy("p").collect():  # one row for each partition
        offsets.append((r.p, before))
        before += r.n
    base = F.broadcast(spark.createDataFrame(offsets, "p int, base long"))
    return rows.join(base, "p").select("event_id", "event_type", (F.col("base") + F.col("i") + 1).alias("place"))
