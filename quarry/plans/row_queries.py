"""Row, group, path and lookup operators over the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import routes
from ..operators.delta import snapshot_diff
from ..operators.graph import file_tree
from ..operators.ranking import first_by, top_per_group
from .registry import query, table

HOST = r"^[a-z]+://([^/?#]+)"
PATH = r"^[a-z]+://[^/?#]+([^?#]*)"


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """page_id, url, host and path; only two columns are read."""
    p = table(spark, sf, "pages").select("page_id", "url")
    return p.select("page_id", "url", F.regexp_extract("url", HOST, 1).alias("host"), F.regexp_extract("url", PATH, 1).alias("path"))


P = "p AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages)"
SEGMENTS = "list_filter(string_split(path, '/'), lambda x: x <> '')"


@query("""SELECT o_custkey AS customer, o_orderkey AS orderkey, o_totalprice AS price, CAST(rank AS INTEGER) AS rank, CAST(greatest(0, n - 4) AS BIGINT) AS more FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE rank <= 4""")
def top_n_per_group_remainder(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("orderkey"), F.col("o_totalprice").alias("price"))
    return top_per_group(rows, ["customer"], [F.desc("price"), F.col("orderkey")], 4)


@query("""SELECT md5(text) AS text_md5, count(*) AS n, min(doc_id) AS first_doc, min(lang) AS lang FROM documents GROUP BY text HAVING count(*) >= 2 AND count(DISTINCT lang) = 1 AND count(DISTINCT doc_id) >= 2""")
def group_having_distinct(spark, sf):
    """Groups by the text's hash: the texts themselves are not shuffled."""
    d = table(spark, sf, "documents").select(F.md5("text").alias("text_md5"), "doc_id", "lang")
    g = d.groupBy("text_md5").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.min("lang").alias("lang"), F.max("lang").alias("lang2"), F.max("doc_id").alias("last_doc"))
    return g.where("n >= 2 AND lang = lang2 AND first_doc < last_doc").select("text_md5", "n", "first_doc", "lang")


VARIANTS = ["", "Data", "Info", "Dto", "Props"]
WORD = "concat(upper(substr(split_part(p_name, ' ', 1), 1, 1)), substr(split_part(p_name, ' ', 1), 2))"


@query(f"""WITH v AS (SELECT concat(CASE WHEN p_partkey % 4 = 0 THEN 'I' ELSE '' END, {WORD}, CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN 'Data' WHEN 2 THEN 'Info' WHEN 3 THEN 'Dto' ELSE 'Props' END) AS name, {WORD} AS root FROM part)
SELECT root, count(DISTINCT name) AS variants, count(*) AS n FROM v WHERE length(root) >= 3 GROUP BY root HAVING count(DISTINCT name) >= 3""")
def root_variant_groups(spark, sf):
    word = F.initcap(F.split_part("p_name", F.lit(" "), F.lit(1)))
    name = F.concat(F.when(F.col("p_partkey") % 4 == 0, "I").otherwise(""), word, S.case_map(F.col("p_size") % 5, dict(enumerate(VARIANTS))))
    named = table(spark, sf, "part").select(name.alias("name")).withColumn("root", S.type_root("name")).where("root IS NOT NULL")
    return named.groupBy("root").agg(F.countDistinct("name").alias("variants"), F.count("*").alias("n")).where("variants >= 3")


@query(f"WITH {P} SELECT page_id, path, regexp_matches(lower(path), '(^|[/_])(old|legacy|deprecated|backup|v[0-9]+|de|fr)($|[/_])') AS marked FROM p")
def legacy_regex_flags(spark, sf):
    """Markers as whole segments; two languages stand in for them, because no page has a marker."""
    return pages(spark, sf).select("page_id", "path", F.col("path").rlike(r"(?i)(^|[/_])(old|legacy|deprecated|backup|v[0-9]+|de|fr)(\z|[/_])").alias("marked"))


@query("""WITH n AS (SELECT p_brand AS brand, CASE WHEN p_partkey % 3 = 0 THEN concat(split_part(p_name, ' ', 1), '_', split_part(p_name, ' ', 2)) WHEN p_partkey % 3 = 1 THEN concat(split_part(p_name, ' ', 1), upper(substr(split_part(p_name, ' ', 2), 1, 1)), substr(split_part(p_name, ' ', 2), 2)) ELSE upper(p_name) END AS name FROM part),
s AS (SELECT brand, CASE WHEN regexp_full_match(name, '[A-Z][A-Z0-9_]*') OR regexp_full_match(name, '[A-Z][a-zA-Z0-9]*') THEN NULL WHEN regexp_matches(name, '^[a-z]') AND contains(name, '_') THEN 'snake' WHEN regexp_full_match(name, '[a-z][a-zA-Z0-9]*') AND regexp_matches(name, '[A-Z]') THEN 'camel' END AS style FROM n)
SELECT brand, count(*) FILTER (style = 'camel') AS camel, count(*) FILTER (style = 'snake') AS snake FROM s GROUP BY brand HAVING count(*) >= 4 AND camel >= 2 AND snake >= 2""")
def naming_mix(spark, sf):
    a, b = (F.split_part("p_name", F.lit(" "), F.lit(i)) for i in (1, 2))
    key = F.col("p_partkey") % 3
    name = F.when(key == 0, F.concat(a, F.lit("_"), b)).when(key == 1, F.concat(a, F.initcap(b))).otherwise(F.upper("p_name"))
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("brand"), S.naming_style(name).alias("style"))
    g = rows.groupBy("brand").agg(F.count("*").alias("n"), F.count_if(F.col("style") == "camel").alias("camel"), F.count_if(F.col("style") == "snake").alias("snake"))
    return g.where("n >= 4 AND camel >= 2 AND snake >= 2").select("brand", "camel", "snake")


@query("""SELECT p_brand AS brand, count(*) AS n, CASE WHEN count(*) >= 85 THEN 'critical' WHEN count(*) >= 80 THEN 'high' ELSE 'medium' END AS severity FROM part WHERE regexp_full_match(p_brand, 'Brand#[1-3][0-9]') GROUP BY p_brand HAVING count(*) >= 5""")
def junk_bucket(spark, sf):
    g = table(spark, sf, "part").where(F.col("p_brand").rlike(r"\ABrand#[1-3][0-9]\z")).groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n")).where("n >= 5")
    return g.select("brand", "n", F.when(F.col("n") >= 85, "critical").when(F.col("n") >= 80, "high").otherwise("medium").alias("severity"))


@query(f"WITH {P}, s AS (SELECT host, {SEGMENTS} AS s FROM p) SELECT host, CASE WHEN len(s) = 0 THEN '/' ELSE concat('/', s[1]) END AS prefix, count(*) AS n FROM s GROUP BY ALL")
def route_prefix_groups(spark, sf):
    return pages(spark, sf).groupBy("host", S.route_prefix("path", 1).alias("prefix")).agg(F.count("*").alias("n"))


@query(f"""WITH {P}, r AS (SELECT concat('/', array_to_string(list_slice({SEGMENTS}, 1, 1), '/'), '/', host) AS prefix, concat('/', array_to_string(list_slice({SEGMENTS}, 1, 1), '/'), '/', host, path) AS path, CASE page_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'PUT' END AS method, page_id % 7 = 0 AS auth FROM p WHERE len({SEGMENTS}) > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY path, method) AS rank, count(*) OVER (PARTITION BY prefix) AS c FROM r)
SELECT prefix, count(*) AS n, string_agg(DISTINCT method, ',' ORDER BY method) AS methods, bool_or(auth) AS auth, string_agg(concat(method, ' ', path), '; ' ORDER BY rank) FILTER (rank <= CASE WHEN c > 5 THEN 3 ELSE 5 END) AS examples, count(*) > 5 AS collapsed FROM k GROUP BY prefix""")
def route_collapse_summary(spark, sf):
    first = F.regexp_replace(S.route_prefix("path", 1), "^/", "")
    rows = pages(spark, sf).where(first != "").select(F.concat(F.lit("/"), first, F.lit("/"), "host", "path").alias("path"), S.case_map(F.col("page_id") % 3, {0: "GET", 1: "POST"}, "PUT").alias("method"), (F.col("page_id") % 7 == 0).alias("auth"))
    return routes.prefix_groups(rows)


@query(f"WITH {P} SELECT page_id, regexp_replace(path, '/[0-9]+', '/:id', 'g') AS route FROM p")
def path_param_rewrite(spark, sf):
    bracketed = F.regexp_replace("path", "/[0-9]+", "/[id]")
    return pages(spark, sf).select("page_id", S.path_parameters(bracketed).alias("route"))


@query("""WITH t(form, method, action, tail) AS (VALUES ('resources', 'GET', 'index', ''), ('resources', 'GET', 'new', '/new'), ('resources', 'POST', 'create', ''), ('resources', 'GET', 'show', '/:id'), ('resources', 'GET', 'edit', '/:id/edit'), ('resources', 'PATCH', 'update', '/:id'), ('resources', 'DELETE', 'destroy', '/:id'),
 ('resource', 'GET', 'new', '/new'), ('resource', 'POST', 'create', ''), ('resource', 'GET', 'show', ''), ('resource', 'GET', 'edit', '/edit'), ('resource', 'PATCH', 'update', ''), ('resource', 'DELETE', 'destroy', ''))
SELECT lower(n_name) AS name, action, method, concat('/', lower(n_name), tail) AS path FROM nation JOIN t ON form = CASE WHEN n_nationkey % 2 = 0 THEN 'resources' ELSE 'resource' END
WHERE (n_regionkey <> 1 OR action IN ('index', 'show')) AND (n_regionkey <> 2 OR action NOT IN ('destroy', 'edit'))""")
def rest_template_expand(spark, sf):
    options = F.when(F.col("n_regionkey") == 1, "only: [:index, :show] do").when(F.col("n_regionkey") == 2, "except: [:destroy, :edit]").otherwise("")
    n = table(spark, sf, "nation").select(F.lower("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, "resources").otherwise("resource").alias("form"), S.parse_actions(options, "only").alias("only"), S.parse_actions(options, "except").alias("except"))
    return routes.expand(n)


@query("""WITH v AS (SELECT n_nationkey AS k, CASE n_nationkey % 4 WHEN 0 THEN '' WHEN 1 THEN lower(r_name) WHEN 2 THEN concat('/', lower(r_name), '/') ELSE concat('/', lower(r_name)) END AS b, CASE n_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN lower(n_name) ELSE concat('/', lower(n_name)) END AS p FROM nation JOIN region ON r_regionkey = n_regionkey),
c AS (SELECT *, CASE WHEN b LIKE '%/' THEN substr(b, 1, length(b) - 1) ELSE b END AS bc, CASE WHEN p LIKE '/%' THEN substr(p, 2) ELSE p END AS pc FROM v)
SELECT k, CASE WHEN b = '' THEN p WHEN p = '' THEN bc WHEN p LIKE '/%' THEN concat(bc, p) ELSE concat(bc, '/', p) END AS jvm,
 CASE WHEN bc = '' AND pc = '' THEN '/' WHEN bc = '' THEN concat('/', pc) WHEN pc = '' THEN bc ELSE concat(bc, '/', pc) END AS kotlin,
 concat('/', CASE WHEN bc = '' THEN pc WHEN pc = '' THEN bc ELSE concat(bc, '/', pc) END) AS dotnet FROM c""")
def path_join_rules(spark, sf):
    r, n, k = F.lower("r_name"), F.lower("n_name"), F.col("n_nationkey")
    base = F.when(k % 4 == 0, "").when(k % 4 == 1, r).when(k % 4 == 2, F.concat(F.lit("/"), r, F.lit("/"))).otherwise(F.concat(F.lit("/"), r))
    path = F.when(k % 3 == 0, "").when(k % 3 == 1, n).otherwise(F.concat(F.lit("/"), n))
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select(k.alias("k"), base.alias("b"), path.alias("p"))
    return rows.select("k", S.join_route_jvm("b", "p").alias("jvm"), S.join_route_kotlin("b", "p").alias("kotlin"), S.join_route_dotnet("b", "p").alias("dotnet"))


FAMILIES = ["python", "java", "csharp", "ruby"]


@query(f"""WITH {P}, h AS (SELECT page_id, string_split(host, '.') AS s, host, CASE page_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'java' WHEN 2 THEN 'csharp' ELSE 'ruby' END AS family FROM p)
SELECT family, CASE family WHEN 'python' THEN s[1] WHEN 'java' THEN array_to_string(list_slice(s, 1, 3), '.') WHEN 'csharp' THEN array_to_string(list_slice(s, 1, 2), '.') ELSE host END AS package, count(DISTINCT page_id) AS used_by FROM h GROUP BY ALL""")
def package_name_by_family(spark, sf):
    rows = pages(spark, sf).select("page_id", "host", S.case_map(F.col("page_id") % 4, dict(enumerate(FAMILIES))).alias("family"))
    return rows.groupBy("family", S.package_name("host", "family").alias("package")).agg(F.countDistinct("page_id").alias("used_by"))


@query("""WITH l AS (SELECT page_id, unnest(links) AS link, generate_subscripts(links, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS links FROM pages)) SELECT page_id, link, CAST(min(pos) AS INTEGER) AS pos FROM l GROUP BY page_id, link""")
def link_extract_dedupe(spark, sf):
    return links(spark, sf)


def links(spark: SparkSession, sf: str) -> DataFrame:
    """Each link of a page once, at its first place from 1. The duplicates go inside the row, before anything is shuffled."""
    found = table(spark, sf, "pages").select("page_id", F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1).alias("all"))
    each = found.select("page_id", "all", F.explode(F.array_distinct("all")).alias("link"))
    return each.select("page_id", "link", F.array_position("all", F.col("link")).cast("int").alias("pos"))


@query("""SELECT doc_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(m), lambda x: printf('%08d %s', list_position(m, x), x))), lambda y: substr(y, 10)), ',') AS verbs FROM (SELECT doc_id, regexp_extract_all(text, '\\b(the|and|of|in)\\s+[a-z]', 1) AS m FROM documents)""")
def verb_extract_all(spark, sf):
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b(the|and|of|in)\s+[a-z]"), 1))
    return table(spark, sf, "documents").select("doc_id", F.array_join(found, ",").alias("verbs"))


@query(f"""WITH {P}, f AS (SELECT DISTINCT path FROM p), l AS (SELECT DISTINCT page_id, path FROM p),
c AS (SELECT page_id, 0 AS pr, path || '/index' AS cand FROM l UNION ALL SELECT page_id, 1, regexp_replace(path, '/+$', '') FROM l UNION ALL SELECT page_id, 2, regexp_replace(path, '/[^/]*/?$', '') || '/100' FROM l UNION ALL SELECT page_id, 3, path FROM l)
SELECT page_id, arg_min(f.path, pr) AS target, CAST(min(pr) AS INTEGER) AS priority FROM c JOIN f ON f.path = cand GROUP BY page_id""")
def priority_lookup_join(spark, sf):
    p = pages(spark, sf)
    files = p.select(F.col("path").alias("target")).distinct()
    cands = F.array(F.concat("path", F.lit("/index")), F.regexp_replace("path", r"/+\z", ""), F.concat(F.regexp_replace("path", r"/[^/]*/?\z", ""), F.lit("/100")), F.col("path"))
    rows = p.select("page_id", F.posexplode(cands).alias("priority", "target"))
    return rows.join(files, "target").groupBy("page_id").agg(F.min_by("target", "priority").alias("target"), F.min("priority").alias("priority"))


@query(f"""WITH {P}, h AS (SELECT DISTINCT host FROM p), x AS (SELECT host, string_split(host, '.') AS s FROM h), u AS (SELECT host, unnest(range(2, len(s) + 1)) AS i, s FROM x), w AS (SELECT host, array_to_string(list_slice(s, i, len(s)), '.') AS suffix, len(s) - i + 1 AS n FROM u),
k AS (SELECT suffix, min(host) AS first_host FROM w GROUP BY suffix HAVING count(*) > 1)
SELECT host, arg_max(suffix, n) AS suffix, arg_max(first_host, n) AS first_host FROM w JOIN k USING (suffix) GROUP BY host""")
def longest_suffix_lookup(spark, sf):
    """Each host's longest suffix that another host shares: a table of suffixes and an equi-join, no pairwise scan."""
    s = F.split("host", r"\.")
    hosts = pages(spark, sf).select("host").distinct().where(F.size(s) > 1)
    cut = hosts.select("host", F.explode(F.sequence(F.lit(2), F.size(s))).alias("i")).select("host", F.array_join(F.slice(F.split("host", r"\."), F.col("i"), F.size(F.split("host", r"\."))), ".").alias("suffix"), (-F.col("i")).alias("n"))
    known = cut.groupBy("suffix").agg(F.min("host").alias("first_host"), F.count("*").alias("k")).where("k > 1")
    return cut.join(known, "suffix").groupBy("host").agg(F.max_by("suffix", "n").alias("suffix"), F.max_by("first_host", "n").alias("first_host"))


@query("""SELECT 'part' AS kind, p_name AS name, p_partkey AS key FROM part WHERE contains(lower(p_name), 'an') UNION ALL SELECT 'supplier', s_name, s_suppkey FROM supplier WHERE contains(lower(s_name), 'an') OR contains(lower(s_name), '#00000001')""")
def lookup_substring_union(spark, sf):
    part = table(spark, sf, "part").where(F.lower("p_name").contains("an")).select(F.lit("part").alias("kind"), F.col("p_name").alias("name"), F.col("p_partkey").alias("key"))
    low = F.lower("s_name")
    supplier = table(spark, sf, "supplier").where(low.contains("an") | low.contains("#00000001")).select(F.lit("supplier"), "s_name", "s_suppkey")
    return part.union(supplier)


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'deleted' WHEN doc_id % 7 = 1 THEN 'changed' ELSE 'unchanged' END AS status FROM documents UNION ALL SELECT -doc_id - 1, 'added' FROM documents WHERE doc_id % 7 = 2""", "snapshot_diff")
def snapshot_diff_documents(spark, sf):
    old = table(spark, sf, "documents").select("doc_id", "n_chars", "source")
    new = old.where("doc_id % 7 <> 0").withColumn("n_chars", F.when(F.col("doc_id") % 7 == 1, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    new = new.unionByName(old.where("doc_id % 7 = 2").withColumn("doc_id", -F.col("doc_id") - 1))
    return snapshot_diff(old, new, "doc_id", ["n_chars", "source"])


@query("""SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total, CAST(sum(CAST(ceil(n_chars / 3.5) AS BIGINT)) AS BIGINT) AS tokens FROM documents GROUP BY source""")
def token_estimate_totals(spark, sf):
    d = table(spark, sf, "documents")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("total"), F.sum(S.token_estimate("n_chars")).alias("tokens"))


@query("""SELECT doc_id, CASE WHEN length(text) > 40 THEN concat(substr(text, 1, 37), '...') ELSE text END AS short FROM documents""")
def truncate_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.truncate("text", 40).alias("short"))


@query("""SELECT conv_id, string_agg(concat(CAST(turn AS VARCHAR), ':', role), ',' ORDER BY rank) FILTER (rank <= 5) AS head, CAST(greatest(0, count(*) - 5) AS BIGINT) AS more FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rank FROM conversations) GROUP BY conv_id""")
def array_fields_head(spark, sf):
    """Five rows of each conversation are kept before anything is gathered."""
    first = top_per_group(table(spark, sf, "conversations").select("conv_id", "turn", "role"), ["conv_id"], [F.col("turn"), F.col("role")], 5)
    rows = first.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("rank", "turn", "role"))).alias("all"), F.max("more").alias("more"))
    head = F.transform("all", lambda x: F.concat(x["turn"].cast("string"), F.lit(":"), x["role"]))
    return rows.select("conv_id", F.array_join(head, ",").alias("head"), "more")


@query(f"""WITH {P}, s AS (SELECT DISTINCT {SEGMENTS} AS s FROM p WHERE len({SEGMENTS}) > 0), u AS (SELECT s, CAST(unnest(range(1, len(s) + 1)) AS INTEGER) AS depth FROM s)
SELECT array_to_string(list_slice(s, 1, depth), '/') AS path, array_to_string(list_slice(s, 1, depth - 1), '/') AS parent, s[depth] AS name, depth, bool_or(depth < len(s)) AS is_dir FROM u GROUP BY ALL""")
def tree_prefixes(spark, sf):
    return file_tree(pages(spark, sf), "path")


@query(f"""WITH {P} SELECT page_id, CASE WHEN url LIKE '%.html' THEN 'static' WHEN contains(url, '?') THEN 'dynamic' WHEN contains(url, '#') THEN 'anchor' WHEN path LIKE '%/' THEN 'folder' ELSE 'generic' END AS kind FROM p""")
def first_match_case(spark, sf):
    u = F.col("url")
    kind = F.when(u.endswith(".html"), "static").when(u.contains("?"), "dynamic").when(u.contains("#"), "anchor").when(F.col("path").endswith("/"), "folder").otherwise("generic")
    return pages(spark, sf).select("page_id", kind.alias("kind"))


@query(f"""WITH {P} SELECT page_id, url FROM p WHERE len({SEGMENTS}) > 0 AND {SEGMENTS}[1] IN ('en', 'de') AND len(list_filter({SEGMENTS}, lambda x: x IN ('100', '200'))) = 0 AND NOT contains(url, 'ref=')""")
def include_exclude_filter(spark, sf):
    parts = F.array_remove(F.split("path", "/"), "")
    inside = F.get(parts, F.lit(0)).isin("en", "de") & ~F.arrays_overlap(parts, F.array(F.lit("100"), F.lit("200"))) & ~F.col("url").contains("ref=")
    return pages(spark, sf).where(inside).select("page_id", "url")


@query("""SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents GROUP BY source, lang) WHERE r = 1""")
def dedupe_keep_first(spark, sf):
    """Keep-first by key: the most frequent language of each source."""
    g = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return first_by(g, ["source"], [F.desc("n"), F.col("lang")])
