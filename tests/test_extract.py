"""Facts from source strings."""

import pytest

from quarry import extract as X
from quarry.extract.jvm import java_enum, kotlin_body
from quarry.extract.prisma import prisma_models


def routes(text, language, path, framework="generic"):
    return sorted((r["what"], r["name"]) for r in X.extract(path, language, text, framework) if r["kind"] == "route")


ROUTES = [
    ("typescript", "a.ts", "router.get('/pallets', f); app.post(\"/pallets\", g);", [("GET", "/pallets"), ("POST", "/pallets")]),
    ("typescript", "a.ts", "router.get(\n  '/crates/newest',\n  guard.signed,\n  async (req, res) => {});", [("GET", "/crates/newest")]),
    ("typescript", "a.ts", "cache.get('pallets'); store.post(row); // app.get('/x')", []),
    ("python", "app/urls.py", "urlpatterns = [path('crates/', v), re_path(r'^bins/?$', w), url(r'^x', y)]", [("ALL", "/^bins/?$"), ("ALL", "/^x"), ("ALL", "/crates/")]),
    ("python", "app/views.py", "@app.route('/pallets', methods=['POST'])\ndef users(): pass\n@bp.get('/u')\ndef u(): pass", [("GET", "/u"), ("POST", "/pallets")]),
    ("go", "main.go", 'func r() {\n router.GET("/pallets", a)\n router.DELETE("/pallets/:id", b)\n http.HandleFunc("/h", c)\n db.Get("k")\n}', [("ALL", "/h"), ("DELETE", "/pallets/:id"), ("GET", "/pallets")]),
    ("rust", "api.rs", 'fn f() { Router::new().route("/v1/pallet", get(a).put(b).delete(c)).route("/d", routing::post(d)) }', [("DELETE", "/v1/pallet"), ("GET", "/v1/pallet"), ("POST", "/d"), ("PUT", "/v1/pallet")]),
    ("rust", "api.rs", '#[get("/pallets")]\nasync fn l() {}\n#[post("/pallets")]\nasync fn c() {}', [("GET", "/pallets"), ("POST", "/pallets")]),
    ("java", "A.java", '@RequestMapping(path = "/shelves/{code}")\npublic class A {\n @GetMapping\n public D get() { return null; }\n @PostMapping(value = "/notes", produces = "x")\n public void c() {}\n}', [("GET", "/shelves/{code}"), ("POST", "/shelves/{code}/notes")]),
    ("java", "U.java", '@RestController\npublic class U {\n @GetMapping("/pallets")\n public List get() { return null; }\n}', [("GET", "/pallets")]),
    ("kotlin", "U.kt", '@RestController\nclass U {\n @PostMapping("/gate/open")\n fun login(): Any { return "" }\n @GetMapping\n fun l(): Any { return "" }\n}', [("GET", "/"), ("POST", "/gate/open")]),
    ("csharp", "U.cs", '[Route("depot/crates")]\npublic class U : Controller {\n [HttpGet]\n public Task G() => null;\n [HttpDelete("{id}")]\n public Task D(int id) => null;\n}', [("DELETE", "/depot/crates/{id}"), ("GET", "/depot/crates")]),
    ("php", "routes/api.php", "<?php\nRoute::get('pallets', 'U@i');\nRoute::any(\"x\", 'U@x');\n# Route::get('no')", [("ALL", "x"), ("GET", "pallets")]),
    ("ruby", "config/routes.rb", "resources :bins, only: [:index]\nresource :dock, except: [:edit, :new]\nget :newest\nget '/pulse', to: 'm#h'", [("DELETE", "/dock"), ("GET", "/newest"), ("GET", "/pulse"), ("GET", "/bins"), ("GET", "/dock"), ("PATCH", "/dock"), ("POST", "/dock")]),
    ("ruby", "app/c.rb", "resources :widgets", []),
    ("astro", "src/pages/blog/[...slug].astro", "", [("GET", "/blog/*")]),
    ("astro", "src/pages/404.astro", "", []),
]


@pytest.mark.parametrize("language,path,text,want", ROUTES)
def test_routes(language, path, text, want):
    assert routes(text, language, path) == sorted(want)


def test_rails_resources_make_seven_and_six():
    assert len(routes("resources :a", "ruby", "config/routes.rb")) == 7
    assert len(routes("resource :a", "ruby", "config/routes.rb")) == 6


def test_app_router_needs_its_framework():
    text = "export async function GET() { await requireAuth() }"
    found = [r for r in X.extract("app/(shop)/items/[id]/route.ts", "typescript", text, "nextjs-app") if r["kind"] == "route"]
    assert [(r["what"], r["name"], r["exported"]) for r in found] == [("GET", "/items/:id", True)]
    assert not routes(text, "typescript", "app/items/route.ts")


def kinds(language, path, text, kind):
    return [(r["name"], r["what"], r["exported"]) for r in X.extract(path, language, text) if r["kind"] == kind]


def test_symbols():
    ts = "export function f(a: string) {}\nexport class C {}\nexport interface I { a: string; b?: number }\nexport type T = string;\nexport const k = 1;\nexport { x } from './y';\n// export function no() {}"
    assert kinds("typescript", "a.ts", ts, "symbol") == [("f", "function", True), ("C", "class", True), ("I", "interface", True), ("T", "type", True), ("k", "constant", True)]
    assert kinds("javascript", "a.js", "export const k = 1; export function f() {}", "symbol") == [("f", "function", True)]
    assert kinds("python", "a.py", "def f(): pass\n@d\nclass C: pass\ndef _g(): pass", "symbol") == [("f", "function", True), ("C", "class", True), ("_g", "function", False)]
    assert kinds("go", "a.go", "func F() {}\nfunc (s *S) g() {}", "symbol") == [("F", "function", True), ("g", "method", False)]
    assert kinds("rust", "a.rs", "pub fn a() {}\nfn b() {}", "symbol") == [("a", "function", True), ("b", "function", False)]
    assert ("m", "method", True) in kinds("java", "A.java", "public class A { public int m(int x) { return 1; } private void p() {} }", "symbol")
    assert ("M", "method", True) in kinds("csharp", "A.cs", "public class A { public int M() { return 1; } }", "symbol")
    assert ("C::m", "method", True) in kinds("php", "a.php", "<?php class C { public function m() {} private function p() {} }", "symbol")
    assert kinds("ruby", "a.rb", "class C\n  def a\n  end\n  def self.b\n  end\nend", "symbol") == [("C", "class", True), ("a", "method", True), ("self.b", "method", True)]
    assert ("f", "function", True) in kinds("kotlin", "a.kt", "fun f() {}\nobject O {}", "symbol")


def test_imports_keep_the_first_of_each_source():
    ts = "import a from 'react';\nimport { b,\n c } from './b';\nexport * from '@/d';\nconst e = require('e');\nawait import('./f');\nimport z from 'react';"
    assert {(n, e) for n, _, e in kinds("typescript", "a.ts", ts, "import")} == {("react", True), ("./b", False), ("@/d", False), ("e", True), ("./f", False)}
    assert [(n, e) for n, _, e in kinds("python", "a.py", "import os.path as p\nfrom . import x\nfrom ..y import z", "import")] == [("os.path", True), (".", False), ("..y", False)]
    assert [n for n, _, _ in kinds("go", "a.go", 'import (\n "fmt"\n x "a/b"\n)', "import")] == ["fmt", "a/b"]
    assert [(n, e) for n, _, e in kinds("rust", "a.rs", "use crate::a;\nuse serde::B as C;", "import")] == [("crate::a", False), ("serde::B", True)]
    assert [n for n, _, _ in kinds("java", "A.java", "import static a.b.C;\nimport a.d.*;", "import")] == ["a.b.C", "a.d"]
    assert [n for n, _, _ in kinds("csharp", "A.cs", "using System;\nusing X = A.B;", "import")] == ["System", "A.B"]
    assert [(n, e) for n, _, e in kinds("php", "a.php", "<?php\nuse App\\M;\nrequire './x.php';", "import")] == [("App\\M", True), ("./x.php", False)]
    assert [(n, e) for n, _, e in kinds("ruby", "a.rb", "require 'a'\nrequire_relative './b'", "import")] == [("a", True), ("./b", False)]
    assert [n for n, _, _ in kinds("astro", "src/pages/i.astro", "---\nimport A from '../A.astro';\n---\n<A/>", "import")] == ["../A.astro"]


def models(text, path="app/models.py"):
    return {r["name"]: r for r in X.extract(path, "python", text) if r["kind"] == "model"}


def test_models():
    text = "class A(models.Model):\n  id = models.BigAutoField(primary_key=True)\n  slug = models.CharField(max_length=2, unique=True)\n  who = models.ForeignKey(U, models.CASCADE)\n  bio = models.TextField(blank=True)\n  created_at = models.DateTimeField()\nclass H(B):\n  f = models.CharField()\nclass S(Base):\n  __tablename__ = 's'\n  id: Mapped[int] = mapped_column(primary_key=True)\n  name = Column(String(9), nullable=True)\n  user_id: Mapped[int] = mapped_column(ForeignKey('u.id'))\nclass N(Base):\n  foo = 'bar'\n"
    found = models(text)
    assert set(found) == {"A", "S"} and (found["A"]["what"], found["S"]["what"]) == ("django", "sqlalchemy")
    a = {f["name"]: f for f in found["A"]["model_fields"]}
    assert list(a) == ["id", "slug", "who", "bio"] and a["id"]["attributes"] == ["PK"] and a["slug"]["attributes"] == ["UQ"] and a["who"]["is_relation"] and not a["bio"]["required"]
    b = {f["name"]: f for f in found["S"]["model_fields"]}
    assert list(b) == ["id", "name", "user_id"] and not b["name"]["required"] and b["user_id"]["attributes"] == ["FK"]
    assert not models(text, "app/views.py")


def test_bodies_and_prisma():
    assert [f["name"] for f in java_enum(" A(1), B { }; int x; void m() {} ")] == ["A", "B"]
    assert [(f["name"], f["optional"]) for f in kotlin_body("val a: Int\nprivate var b: String? = null\nfun c(): Any {")] == [("a", False), ("b", True), ("c", False)]
    found = prisma_models("model User {\n  id Int @id\n  email String? @unique\n  posts Post[]\n  teamId Int\n  createdAt DateTime\n  @@index([email])\n}\nenum Role {\n  A\n}\n")
    assert [m["name"] for m in found] == ["User"] and [(f["name"], f["type"], f["required"], f["is_relation"]) for f in found[0]["fields"]] == [("id", "Int", True, False), ("email", "String", False, False), ("posts", "Post[]", True, True), ("teamId", "Int", True, False)]


def test_bad_files_give_an_error_row(spark):
    df = spark.createDataFrame([("a.py", "python", "def ("), ("b.py", "python", None), ("c.xx", "cobol", "x"), ("d.py", "python", "def f(): pass")], "file_path string, language string, text string")
    found = X.facts(df)
    assert [r.file_path for r in X.relation(found, "errors").collect()] == ["a.py"]
    assert [r.name for r in X.relation(found, "symbols").collect()] == ["f"]
