"""Column functions, one table of cases each; and settings and hook."""

import json

import pytest
from pyspark.sql import functions as F

from quarry import hook
from quarry.functions import scalars as S
from quarry.operators.delta import refresh, snapshot_diff
from quarry.operators.ranking import kind_order, top_per_group
from quarry.operators.routes import expand, prefix_groups
from quarry.sources.config import Config, load_config

CASES = [
    (lambda: S.truncate(F.lit("abcdef"), 5), "ab..."), (lambda: S.truncate(F.lit("abcde"), 5), "abcde"),
    (lambda: S.heat_score(F.lit("medium"), F.lit(50)), 54), (lambda: S.heat_score(F.lit("high"), F.lit(0)), 50), (lambda: S.heat_score(F.lit("low"), F.lit(-3)), 5),
    (lambda: S.stem(F.lit("a/b.c.ts")), "b.c"), (lambda: S.dir_name(F.lit("a/b.ts")), "a"), (lambda: S.dir_name(F.lit("b.ts")), "."),
    (lambda: S.normalise_path(F.lit("a/./b//../c")), "a/c"), (lambda: S.normalise_path(F.lit("../a/..")), ".."), (lambda: S.normalise_path(F.lit("a/../../b")), "../b"),
    (lambda: S.package_name(F.lit("@s/p/x"), F.lit("tsx")), "@s/p"), (lambda: S.package_name(F.lit("lodash/fp"), F.lit("astro")), "lodash"), (lambda: S.package_name(F.lit("a.b.c"), F.lit("python")), "a"),
    (lambda: S.package_name(F.lit("github.com/u/p/x"), F.lit("go")), "github.com/u/p"), (lambda: S.package_name(F.lit("a.b.c.D"), F.lit("kotlin")), "a.b.c"), (lambda: S.package_name(F.lit("serde::de"), F.lit("rust")), "serde"),
    (lambda: S.package_name(F.lit("A\\B\\C"), F.lit("php")), "A"), (lambda: S.package_name(F.lit("A.B.C"), F.lit("csharp")), "A.B"), (lambda: S.package_name(F.lit("a/b"), F.lit("ruby")), "a/b"),
    (lambda: S.app_route(F.lit("app/(shop)/items/[id]/route.ts")), "/items/:id"), (lambda: S.app_route(F.lit("app/x/[...all]/route.js")), "/x/:all"), (lambda: S.app_route(F.lit("app/route.ts")), "/"),
    (lambda: S.page_route(F.lit("src/pages/blog/[...s].astro")), "/blog/*"), (lambda: S.page_route(F.lit("src/pages/index.astro")), "/"), (lambda: S.page_route(F.lit("src/pages/404.astro")), None), (lambda: S.page_route(F.lit("src/pages/a/404.astro")), "/a/404"),
    (lambda: S.route_prefix(F.lit("/api//users/1")), "/api/users"), (lambda: S.route_prefix(F.lit("/")), "/"),
    (lambda: S.join_route_jvm(F.lit("/a/"), F.lit("b")), "/a/b"), (lambda: S.join_route_jvm(F.lit(""), F.lit("b")), "b"), (lambda: S.join_route_kotlin(F.lit(""), F.lit("")), "/"), (lambda: S.join_route_kotlin(F.lit("a/"), F.lit("/b")), "a/b"),
    (lambda: S.join_route_dotnet(F.lit("api/x"), F.lit("{id}")), "/api/x/{id}"), (lambda: S.join_route_dotnet(F.lit("/api"), F.lit("")), "//api"),
    (lambda: S.strip_quotes(F.lit("r'^a$'")), "^a$"), (lambda: S.type_root(F.lit("IUserDto")), "User"), (lambda: S.type_root(F.lit("UserDataInfo")), "UserData"), (lambda: S.type_root(F.lit("TInfo")), None), (lambda: S.type_root(F.lit("Item")), "Item"),
    (lambda: S.naming_style(F.lit("some_name")), "snake"), (lambda: S.naming_style(F.lit("someName")), "camel"), (lambda: S.naming_style(F.lit("SOME_NAME")), None), (lambda: S.naming_style(F.lit("SomeName")), None), (lambda: S.naming_style(F.lit("name")), None), (lambda: S.naming_style(F.lit("abC\n")), None),
    (lambda: S.token_estimate(F.lit(350)), 100), (lambda: S.token_estimate(F.lit(1)), 1), (lambda: S.format_bytes(F.lit(1023)), "1023 B"), (lambda: S.format_bytes(F.lit(1536)), "1.5 KB"),
    (lambda: S.is_entry_point(F.lit("src/main.py")), True), (lambda: S.is_entry_point(F.lit("src/domain.py")), False), (lambda: S.is_entry_point(F.lit("types/a.ts")), True), (lambda: S.is_entry_point(F.lit("vite.config.ts")), True),
    (lambda: S.parse_actions(F.lit("only: [:a, :b] do"), "only"), ["a", "b"]), (lambda: S.parse_actions(F.lit("x do only: [:a]"), "only"), None), (lambda: S.parse_actions(F.lit("except: %i[a b]"), "except"), ["a", "b"]), (lambda: S.parse_actions(F.lit("only: :show"), "only"), ["show"]),
    (lambda: S.frontmatter(F.lit("---\na\nb\n---\nc")), "a\nb"), (lambda: S.frontmatter(F.lit("a")), None), (lambda: S.verbs_in(F.lit("get(a).put (b).get(c)"), ["get", "put"]), ["get", "put"]), (lambda: S.any_of(F.lit("mylib/x"), ["lib/"]), True),
]


def test_scalars(spark):
    row = spark.range(1).select(*(c().alias(f"c{i}") for i, (c, _) in enumerate(CASES))).first()
    got = {i: row[i] for i in range(len(CASES))}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}


def test_top_per_group_orders_and_counts(spark):
    rows = [("g", "variable", "a"), ("g", "function", "z"), ("g", "class", "b"), ("g", "odd", "a"), ("h", "type", "x")]
    out = top_per_group(spark.createDataFrame(rows, "g string, kind string, name string"), ["g"], kind_order(), 2)
    assert {(r.g, r["rank"], r.name, r.more) for r in out.collect()} == {("g", 1, "z", 2), ("g", 2, "b", 2), ("h", 1, "x", 0)}


def test_diff_and_refresh(spark):
    old = spark.createDataFrame([("a", 1.0, 1), ("b", 1.0, 1), ("c", None, 1), ("d", 1.0, 1)], "relative_path string, mtime_ms double, size long")
    new = spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 1), ("c", None, 1), ("e", 1.0, 1)], old.schema)
    diff = snapshot_diff(old, new, "relative_path", ["mtime_ms", "size"])
    assert {tuple(r) for r in diff.collect()} == {("a", "unchanged"), ("b", "changed"), ("c", "unchanged"), ("d", "deleted"), ("e", "added")}
    facts = spark.createDataFrame([(p, "old") for p in "aabcd"], "relative_path string, v string")
    fresh = spark.createDataFrame([(p, "new") for p in "abe"], facts.schema)
    assert sorted(tuple(r) for r in refresh(facts, diff, fresh, "relative_path").collect()) == [("a", "old"), ("a", "old"), ("b", "new"), ("c", "old"), ("e", "new")]


def test_templates_and_groups(spark):
    schema = "name string, form string, only array<string>, except array<string>"
    out = expand(spark.createDataFrame([("a", "resources", None, None), ("b", "resource", None, None), ("c", "resources", ["index"], None), ("d", "resources", None, ["edit", "new"])], schema))
    assert {r.name: r.n for r in out.groupBy("name").agg(F.count("*").alias("n")).collect()} == {"a": 7, "b": 6, "c": 1, "d": 5}
    routes = spark.createDataFrame([("GET", f"/api/users/{i}", i == 3) for i in range(6)] + [("POST", "/api/x", False)], "method string, path string, auth boolean")
    got = {r.prefix: (r.n, r.methods, r.auth, r.examples.count(";") + 1, r.collapsed) for r in prefix_groups(routes).collect()}
    assert got == {"/api/users": (6, "GET", True, 3, True), "/api/x": (1, "POST", False, 1, False)}


def test_config(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"include": ["src"], "exclude": ["a"], "output": "o"}))
    assert load_config(str(path), include=["lib"], exclude=["b"], output=None) == Config(("lib",), ("a", "b"), "o")
    assert load_config(str(tmp_path / "none.json")) == Config()
    with pytest.raises(ValueError):
        load_config(str(path), exclude="a")


def test_hook(tmp_path):
    with pytest.raises(FileNotFoundError):
        hook.install(str(tmp_path))
    (tmp_path / ".git").mkdir()
    assert hook.install(str(tmp_path)) and not hook.install(str(tmp_path))
    assert (tmp_path / ".git/hooks/pre-commit").read_text().count(hook.MARK) == 1
