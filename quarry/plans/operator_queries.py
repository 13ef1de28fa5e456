"""Rows that run the operators themselves over projects made from the standard tables.

Sources, imports and facts are written from templates, one copy for each row of a table, so that SQL can state by hand what
must be found in them: {k} is the row's key and {d} its key modulo 7, the number of a folder."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import extract
from ..functions import scalars as S
from ..operators import graph, rules
from ..operators.delta import refresh, snapshot_diff
from ..operators.resolve import resolve
from ..sources import frameworks, scan
from . import reports
from .index import Index
from .registry import query, table


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _filled(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("{k}"), F.col("k")), F.lit("{d}"), F.col("d"))


def _fill(c: str) -> str:
    return f"replace(replace({c}, '{{k}}', k), '{{d}}', d)"


KEYS = "p AS (SELECT p_partkey AS n, CAST(p_partkey AS VARCHAR) AS k, CAST(p_partkey % 7 AS VARCHAR) AS d FROM part)"


def keys(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_partkey")
    return table(spark, sf, "part").select(n.alias("n"), n.cast("string").alias("k"), (n % 7).cast("string").alias("d"))


# --- extraction: (language, path, text, facts); a fact is kind, line, name, what, detail, exported, extra, fields

Fact = tuple[str, int, str, str, str, bool, str, str]


def fact(kind: str, line: int, name: str, what: str = "", detail: str = "", exported: bool = True, extra: str = "", fields: str = "") -> Fact:
    return kind, line, name, what, detail, exported, extra, fields


def imported(line: int, name: str, external: bool) -> Fact:
    return fact("import", line, name, exported=external)


def route(line: int, method: str, path: str, framework: str, handler: str = "", auth: bool = False) -> Fact:
    return fact("route", line, path, method, handler, auth, framework)


SOURCES: dict[str, list[tuple[str, str, str, list[Fact]]]] = {
    "typescript": [("typescript", "src/m{k}.ts", """import { a } from './b{k}';
import React from 'react';
export function run{k}(a: string, b = 1) {}
export class Store{k} {}
export interface Shape{k} { id: string; size?: number }
export enum Tone{k} { Low, High }
export type Alias{k} = string;
export const limit{k} = 5;
// export function gone() {}
app.get('/items/{k}', f);
cache.get('/no');
""", [
        imported(1, "./b{k}", False), imported(2, "react", True), fact("symbol", 3, "run{k}", "function", "(a: string, b = 1)"), fact("symbol", 4, "Store{k}", "class"),
        fact("symbol", 5, "Shape{k}", "interface"), fact("symbol", 6, "Tone{k}", "enum"), fact("symbol", 7, "Alias{k}", "type"), fact("symbol", 8, "limit{k}", "constant"),
        fact("type", 5, "Shape{k}", "interface", fields="id:string:false;size:number:true"), fact("type", 6, "Tone{k}", "enum", fields="Low::false;High::false"), fact("type", 7, "Alias{k}", "type"), route(10, "GET", "/items/{k}", "express"),
    ])],
    "javascript": [("javascript", "lib/m{k}.js", "const x = require('./y{k}');\nexport function go{k}() {}\nexport const skip = 1;\nrouter.post(\"/p{k}\", f);\n", [imported(1, "./y{k}", False), fact("symbol", 2, "go{k}", "function", "()"), route(4, "POST", "/p{k}", "express")])],
    "astro": [("astro", "src/pages/p{k}/[...rest].astro", "---\nimport Card from '../Card{k}.astro';\n---\n<Card/>\n", [imported(2, "../Card{k}.astro", False), route(1, "GET", "/p{k}/*", "astro")]), ("astro", "src/pages/q{k}/index.astro", "<p/>", [route(1, "GET", "/q{k}", "astro")])],
    "next": [("typescript", "app/(shop)/i{k}/[id]/route.ts", "export async function GET() { return withAuth(); }\n", [fact("symbol", 1, "GET", "function", "()"), route(1, "GET", "/i{k}/:id", "nextjs", "GET", True)])],
    "python": [("python", "pkg{k}/models.py", """import os
from .base{k} import Base
class User{k}(models.Model):
    id = models.AutoField(primary_key=True)
    email = models.CharField(unique=True)
    owner = models.ForeignKey(Team)
    bio = models.TextField(null=True)
    created_at = models.DateTimeField()
class Row{k}:
    name: str
    size: Optional[int]
@app.route('/r{k}', methods=['POST'])
def make{k}(a, b=2) -> int:
    pass
def _hide{k}():
    pass
""", [
        imported(1, "os", True), imported(2, ".base{k}", False), fact("symbol", 3, "User{k}", "class"), fact("symbol", 9, "Row{k}", "class"), fact("symbol", 13, "make{k}", "function", "(a, b=2) -> int"), fact("symbol", 15, "_hide{k}", "function", "()", False),
        fact("type", 9, "Row{k}", "interface", fields="name:str:false;size:Optional[int]:true"), route(12, "POST", "/r{k}", "flask", "make{k}"),
        fact("model", 3, "User{k}", "django", exported=False, fields="id:AutoField:true:false:PK;email:CharField:true:false:UQ;owner:ForeignKey:true:true:FK;bio:TextField:false:false:"),
    ]), ("python", "app{k}/urls.py", "urlpatterns = [path('a{k}/', v)]\n", [route(1, "ALL", "/a{k}/", "django")]), ("python", "db{k}/models.py", """class Post{k}(Base):
    id = Column(Integer, primary_key=True)
    title: Mapped[str] = mapped_column(String(9), nullable=True)
    user_id = Column(ForeignKey('u.id'))
""", [fact("symbol", 1, "Post{k}", "class"), fact("type", 1, "Post{k}", "interface", fields="title:Mapped[str]:false"), fact("model", 1, "Post{k}", "sqlalchemy", exported=False, fields="id:Integer:true:false:PK;title:String:false:false:;user_id:ForeignKey:true:true:FK")]),
        ("python", "bad{k}.py", "import os\ndef f{k}(:\n    pass\n", [imported(1, "os", True), fact("symbol", 2, "f{k}", "function"), fact("error", 1, "SyntaxError", exported=False)])],
    "go": [("go", "svc/m{k}.go", """package svc
import "fmt"
import (
	"net/http"
)
type User{k} struct {
	Name string
	next *User{k}
}
type Store{k} interface {
	Get() int
}
func Run{k}(a int) {}
func (s *User{k}) save() {}
func routes() { r.GET("/g{k}", h) }
""", [
        imported(2, "fmt", True), imported(4, "net/http", True), fact("symbol", 13, "Run{k}", "function", "(a int)"), fact("symbol", 14, "save", "method", "(s *User{k}) ()", False), fact("symbol", 15, "routes", "function", "()", False),
        fact("type", 6, "User{k}", "interface", fields="Name:string:false;next:*User{k}:true"), fact("type", 10, "Store{k}", "interface"), route(15, "GET", "/g{k}", "go-http"),
    ])],
    "rust": [("rust", "src/m{k}.rs", """use crate::db{k};
use serde::Serialize;
pub struct Item{k} { pub id: u32, note: Option<String> }
pub enum Kind{k} { A, B(u8) }
trait Hide{k} { fn x(&self); }
pub fn run{k}(a: u8) -> u8 { a }
fn quiet{k}() {}
fn app() -> Router { Router::new().route("/r{k}", get(run).post(run)) }
#[delete("/d{k}")]
async fn del{k}() {}
""", [
        imported(1, "crate::db{k}", False), imported(2, "serde::Serialize", True), fact("symbol", 5, "x", "function", "(&self)", False), fact("symbol", 6, "run{k}", "function", "(a: u8)"), fact("symbol", 7, "quiet{k}", "function", "()", False), fact("symbol", 8, "app", "function", "()", False), fact("symbol", 10, "del{k}", "function", "()", False),
        fact("type", 3, "Item{k}", "interface", fields="id:u32:false;note:Option<String>:true"), fact("type", 4, "Kind{k}", "enum", fields="A::false;B::false"), fact("type", 5, "Hide{k}", "interface", exported=False), route(8, "GET", "/r{k}", "axum"), route(8, "POST", "/r{k}", "axum"), route(9, "DELETE", "/d{k}", "actix"),
    ])],
    "java": [("java", "src/A{k}.java", """import java.util.List;
import static app.Tools.*;
@RequestMapping("/api{k}")
public class A{k} {
  @GetMapping("/all")
  public List<String> all(int n) { return null; }
  @PostMapping
  private void make() {}
}
interface Port{k} {}
enum Mode{k} { ON, OFF(1); int x; }
""", [
        imported(1, "java.util.List", True), imported(2, "app.Tools", True), fact("symbol", 4, "A{k}", "class"), fact("symbol", 6, "all", "method", "List<String> (int n)"), fact("symbol", 8, "make", "method", "void ()", False),
        fact("type", 10, "Port{k}", "interface", exported=False), fact("type", 11, "Mode{k}", "enum", fields="ON::false;OFF::false"), route(5, "GET", "/api{k}/all", "spring", "all"), route(7, "POST", "/api{k}", "spring", "make"),
    ])],
    "kotlin": [("kotlin", "src/K{k}.kt", """import a.b.C{k}
class K{k}(val db: Db) {
  val id: Int = 1
  var note: String? = null
  @GetMapping("/k{k}")
  fun list(n: Int): List<Int> { return x }
}
object O{k}
""", [
        imported(1, "a.b.C{k}", True), fact("symbol", 2, "K{k}", "class"), fact("symbol", 6, "list", "function", "(n: Int)"), fact("symbol", 8, "O{k}", "class"),
        fact("type", 2, "K{k}", "interface", fields="id:Int:false;note:String?:true;list:List<Int>:false"), route(5, "GET", "/k{k}", "spring", "list"),
    ])],
    "csharp": [("csharp", "src/C{k}.cs", """using System;
using App.Core{k};
[Route("api/c{k}")]
public class C{k} : Controller {
  [HttpGet("{id}")]
  public Task<Item> Get(int id) { return null; }
  [HttpPost]
  private Task Make() => null;
}
public interface IPort{k} {}
public enum Mode{k} { On, Off = 2 }
""", [
        imported(1, "System", True), imported(2, "App.Core{k}", True), fact("symbol", 4, "C{k}", "class"), fact("symbol", 6, "Get", "method", "Task<Item> (int id)"), fact("symbol", 8, "Make", "method", "Task ()", False),
        fact("type", 10, "IPort{k}", "interface"), fact("type", 11, "Mode{k}", "enum", fields="On::false;Off::false"), route(5, "GET", "/api/c{k}/{id}", "aspnet", "Get"), route(7, "POST", "/api/c{k}", "aspnet", "Make"),
    ])],
    "php": [("php", "app/P{k}.php", """<?php
use App\\Models\\User{k};
require './x{k}.php';
interface Port{k} { public function open(); }
enum Suit{k} { case Red; case Black; }
class P{k} {
  public function show($id) { return 1; }
  private function hide() {}
}
function free{k}($a) { return $a; }
Route::get('/p{k}', [P::class, 'show']);
""", [
        imported(2, "App\\Models\\User{k}", True), imported(3, "./x{k}.php", False), fact("symbol", 4, "Port{k}", "interface"), fact("symbol", 4, "Port{k}::open", "method", "()"), fact("symbol", 6, "P{k}", "class"), fact("symbol", 7, "P{k}::show", "method", "($id)"), fact("symbol", 10, "free{k}", "function", "($a)"),
        fact("type", 4, "Port{k}", "interface", fields="open:method:false"), fact("type", 5, "Suit{k}", "enum", fields="Red::false;Black::false"), route(11, "GET", "/p{k}", "laravel"),
    ])],
    "ruby": [("ruby", "lib/r{k}.rb", """require 'json'
require_relative './base{k}'
class R{k}
  attr_accessor :name, :size
  def go(a)
  end
  def self.make
  end
end
""", [imported(1, "json", True), imported(2, "./base{k}", False), fact("symbol", 3, "R{k}", "class"), fact("symbol", 5, "go", "method", "(a)"), fact("symbol", 7, "self.make", "method", "()"), fact("type", 3, "R{k}", "interface", fields="name:Object:false;size:Object:false")]),
        ("ruby", "config/routes/r{k}.rb", "resources :p{k}, only: [:index, :show]\nresource :s{k}, except: %i[new edit destroy]\nget '/h{k}', to: 'x#y'\n", [route(1, "GET", "/p{k}", "rails", "index"), route(1, "GET", "/p{k}/:id", "rails", "show"), route(2, "POST", "/s{k}", "rails", "create"), route(2, "GET", "/s{k}", "rails", "show"), route(2, "PATCH", "/s{k}", "rails", "update"), route(3, "GET", "/h{k}", "rails")])],
    "prisma": [("prisma", "s{k}.prisma", "model User{k} {\n  id Int @id\n  email String? @unique\n  posts Post[]\n  teamId Int\n  createdAt DateTime\n}\nenum Role {\n  A\n}\n", [fact("model", 1, "User{k}", "prisma", exported=False, fields="id:Int:true:false:PK;email:String:false:false:UQ;posts:Post[]:true:true:;teamId:Int:true:false:FK")])],
}


def extracted(spark: SparkSession, sf: str, group: str) -> DataFrame:
    """All facts of the group's sources, one copy of them for each part."""
    made = F.explode(F.array(*(F.struct(F.lit(lang).alias("language"), F.lit(path).alias("path"), F.lit(text).alias("text")) for lang, path, text, _ in SOURCES[group]))).alias("s")
    files = keys(spark, sf).select("k", "d", made).select(_filled(F.col("s.path")).alias("file_path"), "s.language", _filled(F.col("s.text")).alias("text"))
    found = extract.facts(files, "nextjs-app" if group == "next" else "generic")
    plain = F.transform("fields", lambda f: F.concat_ws(":", f["name"], f["type"], f["optional"].cast("string")))
    model = F.transform("model_fields", lambda f: F.concat(F.concat_ws(":", f["name"], f["type"], f["required"].cast("string"), f["is_relation"].cast("string")), F.lit(":"), F.array_join(f["attributes"], ",")))
    detail = F.when(F.col("kind") == "error", "").otherwise(F.col("detail"))  # the parser's own words
    return found.select("file_path", "language", "kind", "line", "name", "what", detail.alias("detail"), "exported", "extra", F.array_join(F.concat(plain, model), ";").alias("fields"))


def _extract_sql(group: str) -> str:
    rows = ", ".join(f"({_text(lang)}, {_text(path)}, {_text(kind)}, {line}, {_text(name)}, {_text(what)}, {_text(detail)}, {exported}, {_text(extra)}, {_text(fields)})" for lang, path, _, facts in SOURCES[group] for kind, line, name, what, detail, exported, extra, fields in facts)
    return f"""WITH {KEYS}, f(language, file_path, kind, line, name, what, detail, exported, extra, fields) AS (VALUES {rows})
SELECT {_fill("file_path")} AS file_path, language, kind, CAST(line AS INTEGER) AS line, {_fill("name")} AS name, what, {_fill("detail")} AS detail, exported, extra, {_fill("fields")} AS fields FROM p CROSS JOIN f"""


for _group in SOURCES:
    query(_extract_sql(_group), f"extract_{_group}")(partial(extracted, group=_group))


# --- resolution: files (modulus, rest, path) and imports (file, source, marked external, found); a found one is the file of its key

Files = list[tuple[int, int, str]]
RESOLVED: dict[str, list[tuple[str, Files, list[tuple[str, str, bool, bool]]]]] = {
    "scripts": [("typescript", [(3, 0, "src/d{d}/m{k}.ts"), (3, 1, "src/d{d}/m{k}/index.tsx"), (3, 2, "src/d{d}/m{k}.js")], [("src/d{d}/use.ts", "./m{k}", False, True), ("web/x.ts", "@/d{d}/m{k}", False, True), ("src/z/use.ts", "../d{d}/m{k}.ts", False, True), ("src/z/use.ts", "./m{k}", False, False), ("src/use.ts", "lib{k}", True, False)]),
                ("astro", [(1, 0, "src/ui/C{k}.astro")], [("src/pages/p.astro", "../ui/C{k}.astro", False, True), ("src/pages/p.astro", "../ui/D{k}.astro", False, False)])],
    "python": [("python", [(2, 0, "pkg{d}/m{k}.py"), (2, 1, "pkg{d}/m{k}/__init__.py")], [("pkg{d}/use.py", ".m{k}", False, True), ("main.py", "pkg{d}.m{k}", True, True), ("pkg{d}/sub/x.py", "..m{k}", False, True), ("main.py", "os{k}", True, False), ("pkg{d}/use.py", ".n{k}", False, False)])],
    "go": [("go", [(1, 0, "internal/p{k}/a.go"), (1, 0, "internal/p{k}/b.go")], [("main.go", "example.com/app/internal/p{k}", True, True), ("main.go", "fmt{k}", True, False), ("main.go", "example.com/other/q{k}", True, False)])],
    "rust": [("rust", [(2, 0, "src/m{k}.rs"), (2, 1, "src/m{k}/mod.rs")], [("src/main.rs", "crate::m{k}", False, True), ("src/a/x.rs", "super::m{k}", False, True), ("src/lib.rs", "self::m{k}", False, True), ("src/main.rs", "serde::M{k}", True, False)])],
    "jvm": [("java", [(1, 0, "src/main/java/com/e{d}/T{k}.java")], [("src/main/java/App.java", "com.e{d}.T{k}", True, True), ("src/main/java/App.java", "java.util.X{k}", True, False)]),
            ("kotlin", [(1, 0, "src/main/kotlin/com/e{d}/S{k}.kt")], [("src/main/kotlin/App.kt", "com.e{d}.S{k}", True, True), ("src/main/kotlin/App.kt", "kotlin.io.X{k}", True, False)])],
    "csharp": [("csharp", [(1, 0, "src/Core{d}/Sub{k}/Thing.cs")], [("src/Program.cs", "App.Core{d}.Sub{k}", True, True), ("src/Program.cs", "System.X{k}", True, False)])],
    "php": [("php", [(1, 0, "app/M{k}.php")], [("app/x.php", "App\\M{k}", True, True), ("app/sub/x.php", "../M{k}.php", False, True), ("app/x.php", "Vendor\\X{k}", True, False), ("app/x.php", "./x{k}.php", False, False)])],
    "ruby": [("ruby", [(1, 0, "lib/r{k}.rb")], [("lib/a.rb", "./r{k}", False, True), ("app/b.rb", "r{k}", True, True), ("app/b.rb", "gem{k}", True, False)])],
}


def resolved(spark: SparkSession, sf: str, group: str) -> DataFrame:
    """Every import of the group's projects, resolved among all their files."""
    k = keys(spark, sf)
    files = [F.when(F.col("n") % m == r, F.lit(path)) for _, paths, _ in RESOLVED[group] for m, r, path in paths]
    paths = k.select("k", "d", F.explode(F.array_compact(F.array(*files))).alias("path")).select(_filled(F.col("path")).alias("relative_path"))
    rows = [F.struct(F.lit(lang).alias("language"), F.lit(path).alias("file_path"), F.lit(source).alias("source"), F.lit(ext).alias("ext")) for lang, _, imports in RESOLVED[group] for path, source, ext, _ in imports]
    asked = k.select("k", "d", F.posexplode(F.array(*rows)).alias("seq", "i")).select(_filled(F.col("i.source")).alias("source"), F.lit(None).cast("string").alias("resolved_path"), _filled(F.col("i.file_path")).alias("file_path"), F.lit(1).alias("line"), F.col("i.ext").alias("is_external"), "i.language", "seq")
    return resolve(asked, paths).select("language", "file_path", "source", "resolved_path", "is_external")


def _resolve_sql(group: str) -> str:
    out = []
    for lang, files, imports in RESOLVED[group]:
        first: dict[tuple[int, int], str] = {}
        for m, r, path in files:  # of several files the first in order of paths
            first[m, r] = min(path, first.get((m, r), path))
        target = "CASE " + " ".join(f"WHEN n % {m} = {r} THEN {_text(path)}" for (m, r), path in first.items()) + " END"
        rows = ", ".join(f"({_text(path)}, {_text(source)}, {ext}, {hit})" for path, source, ext, hit in imports)
        out.append(f"SELECT {_text(lang)} AS language, {_fill('file_path')} AS file_path, {_fill('source')} AS source, CASE WHEN hit THEN {_fill(target)} END AS resolved_path, ext AND NOT hit AS is_external FROM p CROSS JOIN (VALUES {rows}) i(file_path, source, ext, hit)")
    return f"WITH {KEYS} " + " UNION ALL ".join(out)


for _group in RESOLVED:
    query(_resolve_sql(_group), f"resolve_{_group}")(partial(resolved, group=_group))


# --- an index of customers: a file each, their orders as exported symbols, the next customer of the day as an import

PATH = """concat(CASE {c} % 4 WHEN 0 THEN 'lib' WHEN 1 THEN 'pages' WHEN 2 THEN 'core' ELSE 'services' END, '/c', {c}, '/', CASE {c} % 3 WHEN 0 THEN 'helpers.ts' WHEN 1 THEN 'order.ts' ELSE 'stock_old.ts' END)"""
NAME = "CASE {o} % 3 WHEN 0 THEN concat('ord_', {o}) WHEN 1 THEN concat('ordNo', {o}) ELSE concat('day', {day}) END"
TYPE = "concat('Acct', chr(CAST(65 + c_nationkey AS INTEGER)), CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Data' WHEN 2 THEN 'Info' ELSE 'Dto' END)"
KIND = "CASE WHEN o_orderkey % 5 = 0 THEN 'interface' ELSE 'function' END"

C = f"c AS (SELECT c_custkey AS c, {PATH.format(c='c_custkey')} AS path, {TYPE} AS type_name FROM customer)"
SYMBOLS = f"s AS (SELECT path, o_orderkey AS seq, {NAME.format(o='o_orderkey', day='CAST(CAST(o_orderdate AS DATE) AS VARCHAR)')} AS name, {KIND} AS kind, o_orderstatus <> 'P' AS exported FROM orders JOIN c ON c = o_custkey), x AS (SELECT * FROM s WHERE exported)"
EDGES = "e AS (SELECT DISTINCT a.path AS src, b.path AS dst FROM (SELECT o_custkey AS a, lead(o_custkey) OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS b FROM orders) JOIN c a ON a.c = a JOIN c b ON b.c = b)"
HEAT = "h AS (SELECT path, CAST(sum(i) AS BIGINT) AS heat, CAST(sum(o) AS BIGINT) AS imports FROM (SELECT dst AS path, 1 AS i, 0 AS o FROM e UNION ALL SELECT src, 0, 1 FROM e) GROUP BY path)"
SCORE = "CAST(floor((CASE severity WHEN 'critical' THEN 100 WHEN 'high' THEN 50 WHEN 'medium' THEN 20 ELSE 5 END) * (1.0 + log10(1.0 + heat)) + 0.5) AS BIGINT)"


def customers(spark: SparkSession, sf: str) -> Index:
    """Facts as the extractor gives them, so that relations, resolution, graph and rules run on them as on a project's."""
    day = F.expr("CAST(o_orderdate AS DATE)").cast("string")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("c"), F.expr(PATH.format(c="c_custkey")).alias("path"), F.expr(TYPE.replace("VARCHAR", "STRING")).alias("type_name"))
    orders = table(spark, sf, "orders").withColumn("day", day)
    none, no = F.lit(""), F.array().cast("array<struct<name:string,type:string,optional:boolean>>")
    models = F.array().cast("array<struct<name:string,type:string,required:boolean,is_relation:boolean,attributes:array<string>>>")

    def facts(rows: DataFrame, kind: str, name: Column, what: Column, exported: Column, seq: Column) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), F.col("path").alias("file_path"), F.lit("typescript").alias("language"), seq.cast("int").alias("seq"), F.lit(1).alias("line"), name.alias("name"), what.alias("what"), none.alias("detail"), exported.alias("exported"), none.alias("extra"), no.alias("fields"), models.alias("model_fields"))

    own = orders.join(c, F.col("c") == F.col("o_custkey"))
    symbols = facts(own, "symbol", F.expr(NAME.format(o="o_orderkey", day="day")), F.expr(KIND), F.col("o_orderstatus") != "P", F.col("o_orderkey"))
    types = facts(c, "type", F.col("type_name"), F.lit("interface"), F.lit(True), F.lit(0))
    pairs = orders.selectExpr("o_custkey AS a", "lead(o_custkey) OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS b").where("b IS NOT NULL").distinct()
    to = c.select(F.col("c").alias("b"), F.concat(F.lit("../../"), F.regexp_replace("path", r"\.ts\z", "")).alias("source"))
    imports = facts(pairs.join(c, F.col("a") == F.col("c")).join(to, "b"), "import", F.col("source"), none, F.lit(False), F.col("b"))
    files = c.select(F.col("path").alias("relative_path"), F.lit("typescript").alias("language"), F.lit(0.0).alias("mtime_ms"), F.col("c").cast("long").alias("size"))
    return Index(files, symbols.unionByName(types).unionByName(imports))


def audited(spark: SparkSession, sf: str, rule: str) -> DataFrame:
    ix = customers(spark, sf)
    found = rules.audit(rules.Facts(ix.files, ix.relation("symbols"), ix.relation("types"), ix.edges), [rule])
    return found.select("rule", "severity", "file_path", F.size("related_files").alias("n_related"), F.size("signals").alias("n_signals"), "heat", "score")


BASE = "regexp_replace(path, '^.*/', '')"
MEMBERS = "row_number() OVER (PARTITION BY g ORDER BY coalesce(heat, 0) DESC, path) AS r, count(*) OVER (PARTITION BY g) AS m"
#: severity, path, related files, signals and heat of each rule's findings; rules of the reference's thresholds.
FINDINGS = {
    "junk-drawer": f"SELECT CASE WHEN n >= 15 THEN 'critical' WHEN n >= 8 THEN 'high' ELSE 'medium' END AS severity, path, 0 AS related, 2 AS signals, coalesce(heat, 0) AS heat FROM (SELECT path, count(*) AS n FROM x WHERE {BASE} = 'helpers.ts' GROUP BY path HAVING count(*) >= 5) LEFT JOIN h USING (path)",
    "monolith": f"SELECT CASE WHEN n >= 25 THEN 'critical' ELSE 'high' END AS severity, path, 0 AS related, 1 AS signals, coalesce(heat, 0) AS heat FROM (SELECT path, count(*) AS n FROM x WHERE {BASE} <> 'helpers.ts' GROUP BY path HAVING count(*) >= 15 AND count(*) FILTER (kind = 'function') > 0) LEFT JOIN h USING (path)",
    "layer-violation": "SELECT 'high' AS severity, src AS path, 1 AS related, 1 AS signals, coalesce(heat, 0) AS heat FROM e LEFT JOIN h ON h.path = src WHERE (src LIKE 'lib/%' OR src LIKE 'services/%') AND dst LIKE 'pages/%'",
    "duplicated-domain": f"SELECT 'high' AS severity, path, CAST(m - 1 AS INTEGER) AS related, 1 AS signals, coalesce(heat, 0) AS heat FROM (SELECT *, {MEMBERS} FROM (SELECT DISTINCT name AS g, path FROM x) LEFT JOIN h USING (path)) WHERE r = 1 AND m > 1",
    "type-sprawl": f"SELECT 'high' AS severity, path, CAST(m - 1 AS INTEGER) AS related, 2 AS signals, coalesce(heat, 0) AS heat FROM (SELECT *, {MEMBERS} FROM (SELECT DISTINCT substr(type_name, 1, 5) AS g, path FROM c WHERE substr(type_name, 1, 5) IN (SELECT substr(type_name, 1, 5) FROM c GROUP BY ALL HAVING count(DISTINCT type_name) >= 3)) LEFT JOIN h USING (path)) WHERE r = 1",
    "legacy-marker": f"SELECT 'high' AS severity, path, 0 AS related, 1 AS signals, coalesce(heat, 0) AS heat FROM c LEFT JOIN h USING (path) WHERE {BASE} = 'stock_old.ts'",
    "dead-file": "SELECT 'medium' AS severity, path, 0 AS related, 2 AS signals, 0 AS heat FROM c WHERE path NOT IN (SELECT path FROM h)",
    "unused-export": "SELECT DISTINCT 'medium' AS severity, path, 0 AS related, 2 AS signals, 0 AS heat FROM x JOIN h USING (path) WHERE heat = 0 AND imports > 0",
    "naming-inconsistency": "SELECT 'low' AS severity, path, 0 AS related, 2 AS signals, coalesce(heat, 0) AS heat FROM (SELECT path FROM x GROUP BY path HAVING count(*) >= 4 AND count(*) FILTER (name LIKE 'ordNo%') >= 2 AND count(*) FILTER (name LIKE 'ord!_%' ESCAPE '!') >= 2) LEFT JOIN h USING (path)",
}
for _rule, _sql in FINDINGS.items():
    query(f"WITH {C}, {SYMBOLS}, {EDGES}, {HEAT}, f AS ({_sql}) SELECT '{_rule}' AS rule, severity, path AS file_path, CAST(related AS INTEGER) AS n_related, CAST(signals AS INTEGER) AS n_signals, CAST(heat AS BIGINT) AS heat, {SCORE} AS score FROM f", f"rule_{_rule.replace('-', '_')}")(partial(audited, rule=_rule))


@query("""WITH s AS (SELECT s_suppkey AS s, s_nationkey AS g, concat('src/s', s_suppkey, '.ts') AS path, count(*) OVER (PARTITION BY s_nationkey) AS m FROM supplier)
SELECT 'circular-dependency' AS rule, min(path) AS file_path, CAST(count(*) - 1 AS INTEGER) AS n_related, CAST(1 AS BIGINT) AS heat, CAST(floor(100 * (1.0 + log10(2.0)) + 0.5) AS BIGINT) AS score FROM s WHERE m > 1 GROUP BY g""")
def rule_circular_dependency(spark, sf):
    """A ring of each nation's suppliers: every ring of two or more is one cycle."""
    s = table(spark, sf, "supplier").selectExpr("concat('src/s', s_suppkey, '.ts') AS src", "coalesce(lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey), min(s_suppkey) OVER (PARTITION BY s_nationkey)) AS t")
    edges = s.select("src", F.concat(F.lit("src/s"), "t", F.lit(".ts")).alias("dst"))
    ix = customers(spark, sf)
    found = rules.audit(rules.Facts(ix.files, ix.relation("symbols"), ix.relation("types"), edges), ["circular-dependency"])
    return found.select("rule", "file_path", F.size("related_files").alias("n_related"), "heat", "score")


@query(f"WITH {C}, {SYMBOLS}, {EDGES} SELECT (SELECT count(*) FROM c) AS files, 'typescript' AS languages, (SELECT count(*) FROM s) AS symbols, (SELECT count(*) FROM c) AS types, CAST(0 AS BIGINT) AS routes, CAST(0 AS BIGINT) AS models, (SELECT count(*) FROM e) AS imports, CAST(0 AS BIGINT) AS errors")
def index_counts(spark, sf):
    return customers(spark, sf).counts()


@query(f"WITH {C}, {SYMBOLS}, {EDGES} SELECT src, dst FROM e")
def index_edges(spark, sf):
    return customers(spark, sf).edges


@query(f"WITH {C}, {SYMBOLS} SELECT name, kind, path AS file_path, CAST(1 AS INTEGER) AS line FROM s WHERE contains(lower(name), 'o1') UNION ALL SELECT type_name, 'interface', path, 1 FROM c WHERE contains(lower(type_name), 'o1')")
def index_lookup(spark, sf):
    return customers(spark, sf).lookup("O1")


@query(f"""WITH RECURSIVE {C}, {EDGES}, {HEAT}, t AS (SELECT path FROM h ORDER BY heat DESC, path LIMIT 1), r(path, hop) AS (SELECT path, 0 FROM t UNION SELECT e.src, r.hop + 1 FROM r JOIN e ON e.dst = r.path WHERE r.hop < 3)
SELECT path AS node, CAST(min(hop) AS INTEGER) AS hop FROM r GROUP BY path HAVING min(hop) > 0""")
def index_blast(spark, sf):
    ix = customers(spark, sf)
    start = graph.degrees(ix.kept_edges).orderBy(F.desc("imported_by"), "node").first()  # one row
    return ix.blast(start.node if start else "")["files"]


@query(f"WITH {C}, {SYMBOLS} SELECT file_path, name, kind, CAST(rank AS INTEGER) AS rank, CAST(greatest(0, n - 4) AS BIGINT) AS more FROM (SELECT path AS file_path, name, kind, row_number() OVER (PARTITION BY path ORDER BY CASE kind WHEN 'function' THEN 0 ELSE 3 END, name, seq) AS rank, count(*) OVER (PARTITION BY path) AS n FROM x) WHERE rank <= 4")
def exports_listing(spark, sf):
    return reports.export_rows(customers(spark, sf)).select("file_path", "name", "kind", "rank", "more")


@query(f"""WITH {C}, t AS (SELECT DISTINCT path, parent, name, depth, is_dir FROM (SELECT path, regexp_replace(path, '/[^/]*$', '') AS parent, {BASE} AS name, 3 AS depth, false AS is_dir FROM c UNION ALL SELECT regexp_replace(path, '/[^/]*$', ''), split_part(path, '/', 1), split_part(path, '/', 2), 2, true FROM c UNION ALL SELECT split_part(path, '/', 1), '', split_part(path, '/', 1), 1, true FROM c)),
k AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY is_dir DESC, name) AS r, count(*) OVER (PARTITION BY parent) AS n FROM t), v AS (SELECT * FROM k WHERE n <= 8 OR r <= 5),
w AS (SELECT * FROM v WHERE depth = 1 OR (depth = 2 AND parent IN (SELECT path FROM v WHERE depth = 1)) OR (depth = 3 AND parent IN (SELECT path FROM v WHERE depth = 2) AND split_part(path, '/', 1) IN (SELECT path FROM v WHERE depth = 1)))
SELECT parent, name, CAST(depth AS INTEGER) AS depth, is_dir, CASE WHEN path LIKE 'pages/%' AND NOT is_dir THEN 'route' END AS annotation, CAST(0 AS BIGINT) AS more FROM w UNION ALL SELECT parent, NULL, CAST(depth AS INTEGER), false, NULL, n - 5 FROM w WHERE n > 8 AND r = 5""")
def tree_listing(spark, sf):
    """The lines of the structure report, for a framework whose pages are routes."""
    pages = frameworks.Framework("nextjs-pages", "pages")
    return reports.tree_rows(customers(spark, sf), pages).select(S.dir_name("path").alias("folder"), "name", "depth", "is_dir", "annotation", "more").select(F.when(F.col("depth") == 1, "").otherwise(F.col("folder")).alias("parent"), "name", "depth", "is_dir", "annotation", "more")


# --- sources


FRAMEWORKS = [
    ("nextjs-app", [("next.config.mjs", ""), ("app/page.tsx", "")]), ("nextjs-both", [("next.config.ts", ""), ("app/a.ts", ""), ("pages/b.tsx", "")]), ("nextjs-pages", [("next.config.js", ""), ("pages/b.tsx", "")]),
    ("astro", [("astro.config.mjs", ""), ("package.json", '{"dependencies": {"express": "1"}}')]), ("fastify", [("package.json", '{"dependencies": {"express": "1", "fastify": "1"}}')]), ("express", [("package.json", '{"devDependencies": {"express": "^4"}}')]),
    ("django", [("manage.py", ""), ("package.json", "{")]), ("flask", [("src/app.py", "from flask import Flask")]), ("generic", [("next.config.js", ""), ("lib/app/x.ts", ""), ("app.py", "import os")]),
]


@query("SELECT s_suppkey AS project, CASE s_suppkey % 9 " + " ".join(f"WHEN {i} THEN '{name}'" for i, (name, _) in enumerate(FRAMEWORKS)) + " END AS id FROM supplier")
def framework_detect(spark, sf):
    """A project for each supplier, of one of nine kinds."""
    kinds = F.array(*(F.array(*(F.struct(F.lit(p).alias("relative_path"), F.lit(t).alias("text")) for p, t in files)) for _, files in FRAMEWORKS))
    files = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("project"), F.explode(kinds[(F.col("s_suppkey") % 9).cast("int")]).alias("f")).select("project", "f.*")
    return frameworks.detect_projects(files, ["project"]).select("project", "id")


SCANNED = ["src/m{k}.ts", "src/deep/x/m{k}.py", "node_modules/p{k}/i.js", "src/gen{k}/y.go", "web/m{k}.test.ts", "m{k}.rs", "docs/m{k}.md", "src/m{k}_tmp.rb", "src/m{k}.d.ts", "logs/m{k}.php", "web/M{k}.kts"]
KEPT = {"src/m{k}.ts": "typescript", "src/deep/x/m{k}.py": "python", "m{k}.rs": "rust"}


@query(f"WITH {KEYS}, f(path, language) AS (VALUES " + ", ".join(f"({_text(p)}, {_text(lang)})" for p, lang in KEPT.items()) + f") SELECT {_fill('path')} AS relative_path, language FROM p CROSS JOIN f")
def scan_select(spark, sf):
    """Top folders asked for, folder names, globs and an ignore file's names left out, tests and unknown endings skipped."""
    paths = keys(spark, sf).select("k", "d", F.explode(F.array(*map(F.lit, SCANNED))).alias("p")).select(_filled(F.col("p")).alias("relative_path"))
    return scan.select_files(paths, include=["src", "logs"], exclude=["*_tmp.*", "gen*"], ignore=scan.ignore_names("# comment\nlogs/\n\n*.ts\n")).select("relative_path", "language")


@query(f"""WITH {C}, {SYMBOLS}, g AS (SELECT path, seq, c % 5 AS m FROM s JOIN c USING (path))
SELECT path AS file_path, CAST(seq AS INTEGER) AS seq, CASE WHEN m = 1 THEN 'new' ELSE 'old' END AS origin FROM g WHERE m <> 0""")
def refresh_facts(spark, sf):
    """Facts after a refresh: of five files one is deleted, one changed and three as they were."""
    ix = customers(spark, sf)
    new = ix.files.where("size % 5 <> 0").withColumn("mtime_ms", F.when(F.col("size") % 5 == 1, 1.0).otherwise(F.col("mtime_ms")))
    diff = snapshot_diff(ix.files, new, "relative_path", ["mtime_ms", "size"]).withColumnRenamed("relative_path", "file_path")
    old = ix.relation("symbols").select("file_path", "seq")
    return refresh(old.withColumn("origin", F.lit("old")), diff, old.withColumn("origin", F.lit("new")), "file_path")


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages), q AS (SELECT page_id, path, regexp_replace(path, '^/+', '') AS rel FROM p)
SELECT page_id, regexp_extract(rel, '[^/]*$') AS base, CASE WHEN contains(rel, '/') THEN regexp_replace(rel, '/[^/]*$', '') ELSE '.' END AS dir, trim(regexp_replace(rel, '/+', '/', 'g'), '/') AS normal, concat('/x', page_id, '/*') AS page, CASE page_id % 3 WHEN 0 THEN true WHEN 1 THEN true ELSE false END AS entry,
 CASE page_id % 3 WHEN 0 THEN 'Configuration' WHEN 1 THEN 'Command line' ELSE 'Entry point' END AS role, concat('t', page_id) AS quoted, CASE WHEN page_id % 2 = 0 THEN concat('a: ', page_id) END AS front, 'GET,PUT' AS verbs, concat('/api/', page_id, '/:id') AS app FROM q""")
def path_scalars(spark, sf):
    """Column functions over paths, routes and texts."""
    k = F.col("page_id").cast("string")
    rel = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1), "^/+", "")
    file = F.element_at(F.array(F.concat(F.lit("a"), k, F.lit("/vite.config.ts")), F.concat(F.lit("b"), k, F.lit("/cli.py")), F.concat(F.lit("c"), k, F.lit("/part.ts"))), (F.col("page_id") % 3 + 1).cast("int"))
    front = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("---\na: "), k, F.lit("\n---\nrest"))).otherwise("no fences")
    return table(spark, sf, "pages").select(
        "page_id", S.base_name(rel).alias("base"), S.dir_name(rel).alias("dir"), S.normalise_path(F.concat(F.lit("./z/../"), rel, F.lit("/."))).alias("normal"), S.page_route(F.concat(F.lit("web/src/pages/x"), k, F.lit("/[...all].astro"))).alias("page"),
        S.is_entry_point(file).alias("entry"), S.entry_role(file).alias("role"), S.strip_quotes(F.concat(F.lit("'t"), k, F.lit("'"))).alias("quoted"), S.frontmatter(front).alias("front"),
        F.array_join(S.verbs_in(F.lit("GET(a); PUT (b); GET(c); POSTED(d)"), ["GET", "POST", "PUT"]), ",").alias("verbs"), S.app_route(F.concat(F.lit("app/(x)/api/"), k, F.lit("/[id]/route.ts"))).alias("app"),
    )
