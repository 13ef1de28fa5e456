"""Rules, graph, index refresh, scan, frameworks and reports on small projects."""

import random

import pytest

from quarry import __version__, schemas
from quarry.__main__ import main
from quarry.operators import graph, rules
from quarry.plans import index, reports
from quarry.sources import frameworks, scan
from quarry.streaming import facts as stream


def project(spark, files):
    rows = [(p, float(len(t)), len(t), t) for p, t in files.items()]
    return scan.select_files(spark.createDataFrame(rows, "relative_path string, mtime_ms double, size long, text string")).select("relative_path", "language", "mtime_ms", "size", "text")


FILES = {
    "src/cli.ts": "import { a } from './utils';\nimport x from 'react';\nexport function main() {}",
    "src/utils.ts": "export function a() {}\nexport function b() {}\nexport function c() {}\nexport function d() {}\nexport function e() {}\nimport './cycle';",
    "src/cycle.ts": "import './utils';\nexport interface UserData { a: string }\nexport interface UserInfo { a: string }\nexport interface User { a: string; b?: number }",
    "src/db/users_old.ts": "import '../pages/home';\nexport const q = 1;",
    "src/pages/home.ts": "export const some_snake = 1;\nexport const other_snake = 1;\nexport const camelOne = 1;\nexport const camelTwo = 1;",
    "src/lonely.ts": "const x = 1;",
    "app/models.py": "class A(models.Model):\n  name = models.CharField()",
    "web/urls.py": "urlpatterns = [path('a/', v)]",
    "node_modules/x/i.ts": "export const no = 1;",
    "src/x.test.ts": "export const no = 1;",
}


def test_rules_over_a_project(spark):
    ix = index.build(project(spark, FILES))
    found = {(r.rule, r.file_path) for r in ix.findings().collect()}
    assert {("junk-drawer", "src/utils.ts"), ("circular-dependency", "src/utils.ts"), ("type-sprawl", "src/cycle.ts"), ("legacy-marker", "src/db/users_old.ts"), ("layer-violation", "src/db/users_old.ts"), ("naming-inconsistency", "src/pages/home.ts"), ("dead-file", "src/lonely.ts"), ("unused-export", "src/db/users_old.ts")} <= found
    assert not any("node_modules" in p or "test" in p for _, p in found)
    scores = [r.score for r in ix.findings().collect()]
    assert scores == sorted(scores, reverse=True)


def facts(spark, symbols=(), types=(), edges=(), files=()):
    s = [(n, k, "", p, 1, x, False, lang, i) for i, (n, k, p, x, lang) in enumerate(symbols)]
    t = [(n, "interface", [], p, 1, True, "typescript", i) for i, (n, p) in enumerate(types)]
    f = [(p, "typescript", 0.0, 0) for p in {*files, *(x[2] for x in symbols)}]
    return rules.Facts(spark.createDataFrame(f, schemas.FILES), spark.createDataFrame(s, schemas.SYMBOLS), spark.createDataFrame(t, schemas.TYPES), spark.createDataFrame(list(edges), schemas.EDGES))


@pytest.mark.parametrize("n,severity", [(4, None), (5, "medium"), (8, "high"), (15, "critical")])
def test_junk_drawer_thresholds(spark, n, severity):
    f = facts(spark, [(f"f{i}", "function", "src/helpers.ts", True, "typescript") for i in range(n)])
    assert [r.severity for r in rules.audit(f, ["junk-drawer"]).collect()] == ([severity] if severity else [])


def test_monolith_and_its_exemptions(spark):
    code = [(f"f{i}", "function", "src/big.ts", True, "typescript") for i in range(25)]
    only = [(f"T{i}", "interface", "src/shapes.ts", True, "typescript") for i in range(20)]
    junk = [(f"f{i}", "function", "src/utils.ts", True, "typescript") for i in range(20)]
    f = facts(spark, code + only + junk, [("T0", "src/shapes.ts")])
    assert [(r.file_path, r.severity) for r in rules.audit(f, ["monolith"]).collect()] == [("src/big.ts", "critical")]


def test_duplicates_skip_other_languages_and_common_names(spark):
    f = facts(spark, [("pay", "function", "a.ts", True, "typescript"), ("pay", "function", "b.ts", True, "typescript"), ("x", "function", "a.ts", True, "typescript"), ("x", "function", "c.py", True, "python"), ("main", "function", "a.ts", True, "typescript"), ("main", "function", "b.ts", True, "typescript")], edges=[("c.ts", "b.ts")])
    assert [(r.file_path, r.related_files, r.heat) for r in rules.audit(f, ["duplicated-domain"]).collect()] == [("b.ts", ["a.ts"], 1)]


def test_a_hot_medium_beats_a_cold_high(spark):
    symbols = [(f"f{i}", "function", "src/utils.ts", True, "typescript") for i in range(5)]
    f = facts(spark, symbols, files=["src/x_old.ts"], edges=[(f"u{i}.ts", "src/utils.ts") for i in range(50)])
    assert [(r.rule, r.score) for r in rules.audit(f, ["junk-drawer", "legacy-marker"]).collect()] == [("junk-drawer", 54), ("legacy-marker", 50)]


def test_refresh_equals_a_full_build(spark, tmp_path):
    before = dict(FILES)
    after = {**{k: v for k, v in FILES.items() if k != "src/cycle.ts"}, "src/new.ts": "import './utils';", "src/utils.ts": FILES["src/utils.ts"] + "\nexport function z() {}"}
    index.build(project(spark, before)).save(str(tmp_path / "ix"))
    new = index.update(index.load(spark, str(tmp_path / "ix")), project(spark, after))
    full = index.build(project(spark, after))
    for kind in index.RELATIONS:
        assert sorted(map(str, new.relation(kind).collect())) == sorted(map(str, full.relation(kind).collect())), kind
    assert {tuple(e) for e in new.edges.collect()} == {tuple(e) for e in full.edges.collect()}
    assert index.load(spark, str(tmp_path / "none")) is None


def test_order_of_rows_does_not_matter(spark):
    df = project(spark, FILES)
    a = [tuple(r) for r in index.build(df).findings().collect()]
    b = [tuple(r) for r in index.build(df.orderBy("size").repartition(3)).findings().collect()]
    assert a == b


def test_blast_and_lookup(spark):
    files = {"a.ts": "export interface Thing { x: string }", "b.ts": "import './a';\nrouter.get('/users', f);", "c.ts": "import './b';", "d.ts": "import './c';", "e.ts": "import './d';"}
    ix = index.build(project(spark, files))
    hit = ix.blast("a.ts")
    assert sorted((r.node, r.hop) for r in hit["files"].collect()) == [("b.ts", 1), ("c.ts", 2), ("d.ts", 3)]
    assert [r.route for r in hit["routes"].collect()] == ["GET /users"]
    assert ix.blast("nothing.ts")["files"].count() == 0
    assert sorted((r.name, r["kind"]) for r in ix.lookup("THIN").collect()) == [("Thing", "interface"), ("Thing", "interface")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    edges = {(rnd.randrange(14), rnd.randrange(14)) for _ in range(22)}
    go = {n: {n} for n in range(14)}
    for _ in range(14):
        for a, b in edges:
            for n in go:
                if a in go[n]:
                    go[n].add(b)
    want = {(n, min(m for m in range(14) if m in go[n] and n in go[m])) for n in range(14) if any(m != n and m in go[n] and n in go[m] for m in range(14))}
    for few in (100, 0):  # on the driver, and by joins
        got = graph.scc(spark.createDataFrame([*edges], "src long, dst long"), few)
        assert {tuple(r) for r in got.collect()} == want


def test_counts(spark):
    row = index.build(project(spark, {**FILES, "bad.py": "def ("})).counts().first()
    assert (row.files, row.languages, row.models, row.errors, row.routes) == (9, "python,typescript", 1, 1, 1)


def test_packages(spark):
    rows = [("react", None, "a.ts", 1, True, "typescript", 0), ("react", None, "b.ts", 1, True, "typescript", 0), ("@scope/pkg/x", None, "a.ts", 2, True, "typescript", 1), ("./x", None, "a.ts", 3, False, "typescript", 2), ("java.util.List", None, "A.java", 1, True, "java", 0)]
    got = graph.external_packages(spark.createDataFrame(rows, schemas.IMPORTS)).collect()
    assert {tuple(r) for r in got} == {("react", 2), ("@scope/pkg", 1), ("java.util.List", 1)}


def test_scan_and_stream(spark, tmp_path):
    for path, text in FILES.items():
        p = tmp_path / "tree" / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    df = scan.scan(spark, str(tmp_path / "tree"))
    assert {r.relative_path for r in df.select("relative_path").collect()} == {p for p in FILES if "node_modules" not in p and ".test." not in p}
    assert scan.scan(spark, str(tmp_path / "tree"), include=["app"]).count() == 1
    assert scan.scan(spark, str(tmp_path / "tree"), exclude=["pages", "*_old.ts"]).count() == 6
    stream.start(spark, str(tmp_path / "tree"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where("kind = 'symbol'").count() == index.build(df).relation("symbols").count()
    assert scan.ignore_names("# c\nlogs/\n\n*.tmp\n") == ["logs", "*.tmp"]


def tree(folder, files):
    for path, text in files.items():
        p = folder / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(folder)


@pytest.mark.parametrize("files,want", [
    ({"next.config.mjs": "", "app/x.tsx": "export const a = 1;"}, "nextjs-app"), ({"package.json": '{"dependencies": {"express": "1"}}', "src/a.ts": ""}, "express"),
    ({"astro.config.mjs": "", "src/pages/a.astro": ""}, "astro"), ({"manage.py": "", "package.json": "{"}, "django"), ({"lib/package.json": '{"dependencies": {"express": "1"}}', "a.ts": ""}, "generic"),
])
def test_frameworks_of_scanned_trees(spark, tmp_path, files, want):
    root = tree(tmp_path, files)
    assert frameworks.detect_tree(spark, root, scan.scan(spark, root)).id == want


def test_the_command_line_from_a_folder(spark, tmp_path, capsys):
    root = tree(tmp_path, {
        "next.config.mjs": "", "app/api/carts/[id]/route.ts": "import '../../../../src/db';\nexport async function GET() {}", "src/db.ts": "export function open() {}", ".gitignore": "# c\nskipped/\n",
        "skipped/no.ts": "export const no = 1;", "prisma/schema.prisma": "model Cart {\n id Int @id\n}\n", "quarry.json": '{"exclude": ["*_gen.ts"], "output": "docs/index"}', "src/a_gen.ts": "export const gen = 1;", ".git/HEAD": "",
    })
    out = tmp_path / "docs/index"

    def run(*args):
        assert main([args[0], root, *args[1:]]) == 0
        return capsys.readouterr().out

    first = run("index")
    assert "Next.js" in first and "2 files" in first and "1 models" in first and "1 routes" in first
    assert "[route]" in (out / "structure.md").read_text() and "Cart" in (out / "schema.md").read_text() and "/api/carts/:id" in (out / "routes.md").read_text()
    assert "nothing has changed" in run("index")
    (tmp_path / "src/new.ts").write_text("import './db';\nexport const fresh = 1;")
    (tmp_path / "prisma/schema.prisma").unlink()
    assert "3 files" in run("index") and "fresh" in (out / "exports.md").read_text() and not (out / "schema.md").exists()
    hit = run("blast", "src/db.ts")
    assert "2 files depend" in hit and "app/api/carts/[id]/route.ts (1)" in hit and "GET /api/carts/:id" in hit
    stats = run("stats")
    assert "exports.md" in stats and "total" in stats
    assert "installed" in run("hook") and (tmp_path / ".git/hooks/pre-commit").exists()
    with pytest.raises(SystemExit):
        main(["--version"])
    assert capsys.readouterr().out.strip() == __version__


def test_explicit_schemas(spark, tmp_path):
    root = tree(tmp_path, {"a.prisma": "model A {\n id Int @id\n}", "schema.prisma": "model B {\n id Int @id\n}", "x.ts": ""})
    found = scan.schema_files(spark, root, ["a.prisma", "gone.prisma", "b.sql"])
    ix = index.build(scan.scan(spark, root), schemas_of=found)
    assert [(r.name, r.orm) for r in ix.relation("models").collect()] == [("A", "prisma")] and ix.counts().first().files == 1
    assert [r.relative_path for r in scan.schema_files(spark, root).collect()] == ["schema.prisma"]
    assert scan.schema_files(spark, str(tmp_path / "none")) is None


@pytest.mark.parametrize("files,want", [
    ({"next.config.js": "", "app/x.tsx": ""}, "nextjs-app"), ({"next.config.mjs": "", "pages/x.tsx": "", "app/x.tsx": ""}, "nextjs-both"), ({"next.config.ts": "", "pages/x.tsx": ""}, "nextjs-pages"), ({"astro.config.mjs": ""}, "astro"),
    ({"package.json": '{"dependencies": {"express": "1", "fastify": "1"}}'}, "fastify"), ({"package.json": '{"devDependencies": {"express": "1"}}'}, "express"), ({"package.json": "{", "manage.py": ""}, "django"), ({"src/app.py": "from flask import Flask"}, "flask"), ({"x.py": ""}, "generic"),
])
def test_frameworks(spark, files, want):
    assert frameworks.detect(spark.createDataFrame(list(files.items()), "relative_path string, text string")).id == want


def test_the_tree_has_every_level_and_counts_what_it_leaves_out(spark):
    deep = "/".join(f"d{i}" for i in range(9))
    files = {f"{deep}/f{i}.ts": "" for i in range(10)} | {f"d0/x{i}.ts": "" for i in range(3)}
    lines = list(reports.structure(index.build(project(spark, files))))
    at = lines.index("d0/")
    assert lines[at : at + 16] == [*("  " * i + f"d{i}/" for i in range(9)), *("  " * 9 + f"f{i}.ts" for i in range(5)), "  " * 9 + "...5 more", "  x0.ts"]


def test_reports(spark):
    def write_all(files):
        return {k: "\n".join(v) or None for k, v in reports.reports(index.build(project(spark, files))).items()}

    out = write_all(FILES)
    assert "src/utils.ts" in out["exports.md"] and "+1 more" in out["exports.md"]
    assert "User { a: string, b?: number }" in out["types.md"] and "critical" in out["audit.md"]
    findings = index.build(project(spark, FILES)).findings().cache()
    short, n = "\n".join(reports.audit_report(findings, top=3)), findings.count()
    assert n == 10 and "...and 7 more findings" in short and short.count("\n- [") == n + 3
    assert "imported by" in out["graph.md"] and "react: 1 files" in out["graph.md"] and "django" in out["schema.md"] and "/a" in out["routes.md"]
    empty = write_all({"a.ts": ""})
    assert [k for k, v in empty.items() if v is None] == ["exports.md", "types.md", "routes.md", "schema.md", "graph.md"]


def test_blast_resolves_imports_once(spark, sf, monkeypatch):
    """The start, and each hop, read edges that are cut, and do not resolve every import again."""
    from quarry.plans import operator_queries

    calls, resolve = [], index.resolve
    monkeypatch.setattr(index, "resolve", lambda *a: calls.append(a) or resolve(*a))
    found = operator_queries.index_blast(spark, sf)
    assert len(calls) == 1 and found.where("hop = 1").count() > 0
