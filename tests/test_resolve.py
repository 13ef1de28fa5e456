"""One file set a language; expected paths by reading the rules."""

import posixpath
import random
import re

import pytest

from quarry import catalog, schemas
from quarry.operators.resolve import resolve

SCRIPT = ["src/words.ts", "src/sizes.ts", "src/box/lid.ts", "src/box/index.ts", "src/ui/Panel.tsx"]
PYTHON = ["store/goods.py", "store/desk.py", "store/__init__.py", "store/tools/saw.py", "store/tools/__init__.py", "src/motor/gear.py"]
GO = ["inner/gate/a_key.go", "inner/gate/lock.go", "kit/text/cut.go"]
RUST = ["src/main.rs", "src/lib.rs", "src/gate.rs", "src/gate/mod.rs", "src/vault/mod.rs"]
JAVA = ["src/main/java/org/yard/Crate.java", "src/main/java/org/yard/CrateDesk.java"]
CS = ["src/Yard/Dock/Things/Crane.cs", "src/Yard/Dock/Shapes/Raw/CraneRow.cs", "src/Web/Desks/CraneDesk.cs", "Shapes/Crate.cs"]
PHP = ["app/Goods/Crate.php", "src/Tools.php"]
RUBY = ["lib/knots.rb", "app/goods/crate.rb"]

CASES = [
    ("typescript", SCRIPT, "src/start.ts", "./words", "src/words.ts"), ("typescript", SCRIPT, "src/start.ts", "./sizes.ts", "src/sizes.ts"), ("typescript", SCRIPT, "src/start.ts", "./box", "src/box/index.ts"),
    ("typescript", SCRIPT, "src/box/index.ts", "./lid", "src/box/lid.ts"), ("typescript", SCRIPT, "src/box/lid.ts", "../sizes", "src/sizes.ts"), ("typescript", SCRIPT, "src/start.ts", "react", None),
    ("typescript", SCRIPT, "src/start.ts", "./absent", None), ("tsx", SCRIPT, "src/start.ts", "./ui/Panel", "src/ui/Panel.tsx"), ("typescript", SCRIPT, "x/y.ts", "@/words", "src/words.ts"),
    ("python", PYTHON, "store/desk.py", ".goods", "store/goods.py"), ("python", PYTHON, "test.py", "store.goods", "store/goods.py"), ("python", PYTHON, "test.py", "store.tools", "store/tools/__init__.py"),
    ("python", PYTHON, "store/desk.py", "os", None), ("python", PYTHON, "t.py", "motor.gear", "src/motor/gear.py"), ("python", PYTHON, "store/tools/saw.py", "..goods", "store/goods.py"), ("python", PYTHON, "store/desk.py", ".", None),
    ("go", GO, "main.go", "example.org/yard/inner/gate", "inner/gate/a_key.go"), ("go", GO, "main.go", "fmt", None),
    ("rust", RUST, "src/main.rs", "crate::gate", "src/gate.rs"), ("rust", RUST, "src/main.rs", "crate::vault", "src/vault/mod.rs"), ("rust", RUST, "src/main.rs", "serde::Serialize", None), ("rust", RUST, "src/main.rs", "self::lib", "src/lib.rs"),
    ("java", JAVA, "App.java", "org.yard.Crate", "src/main/java/org/yard/Crate.java"), ("java", JAVA, "App.java", "java.util.List", None),
    ("csharp", CS, "Program.cs", "Shapes", "Shapes/Crate.cs"), ("csharp", CS, "Foo.cs", "Big.Yard.Dock.Things", "src/Yard/Dock/Things/Crane.cs"),
    ("php", PHP, "app/index.php", "../src/Tools.php", "src/Tools.php"), ("php", PHP, "app/index.php", "App\\Goods\\Crate", "app/Goods/Crate.php"), ("php", PHP, "app/index.php", "Illuminate\\Support\\DB", None),
    ("ruby", RUBY, "lib/main.rb", "./knots", "lib/knots.rb"), ("ruby", RUBY, "app/main.rb", "knots", "lib/knots.rb"),
]


@pytest.mark.parametrize("files", [SCRIPT, PYTHON, GO, RUST, JAVA, CS, PHP, RUBY])
def test_resolution(spark, files):
    cases = [c for c in CASES if c[1] is files]
    rows = [(source, None, path, i, True, language, i) for i, (language, _, path, source, _) in enumerate(cases)]
    out = resolve(spark.createDataFrame(rows, schemas.IMPORTS), spark.createDataFrame([(f,) for f in files], "relative_path string"))
    got = {r.line: (r.resolved_path, r.is_external) for r in out.collect()}
    assert got == {i: (want, want is None) for i, (_, _, _, _, want) in enumerate(cases)}


def test_script_endings_and_folders_in_order(spark):
    """Every import of a random tree against the candidates in their order, one path at a time."""
    rng, ends = random.Random(4), [".ts", ".tsx", ".js", ".jsx", ".astro"]
    names = [f"{d}{n}" for d in ("", "a/", "a/b/", "src/") for n in ("m", "m.x", "m.ts", "m/index", "m.js/index", "b/index", "index")]
    files = sorted({n + e for n in names for e in [*ends, ".css"] if rng.random() < 0.3})
    sources = [f"{d}{n}{e}" for d in ("./", "../", "@/", "./b/", "") for n in ("m", "m.x", "b", "index") for e in ("", ".ts", ".js", ".astro", ".css")]
    asked = [(f, s) for f in ("x.ts", "a/x.ts", "a/b/x.ts") for s in sources]

    def naive(file, source):
        if not source.startswith((".", "@/")):
            return None
        base = f"src/{source[2:]}" if source.startswith("@/") else "/".join(p for p in posixpath.normpath(posixpath.join(posixpath.dirname(file), source)).split("/") if p != ".")
        cut = re.sub(r"\.(ts|tsx|js|jsx)\Z", "", base)
        return next((c for c in [base, *(cut + e for e in ends), *(f"{b}/index{e}" for b in (cut, base) for e in ends)] if c in files), None)

    rows = [(s, None, f, i, True, "typescript", i) for i, (f, s) in enumerate(asked)]
    got = resolve(spark.createDataFrame(rows, schemas.IMPORTS), spark.createDataFrame([(f,) for f in files], "relative_path string"))
    want = {i: naive(*a) for i, a in enumerate(asked)}
    assert {r.line: r.resolved_path for r in got.collect()} == want and len(set(want.values())) > 15


@pytest.mark.parametrize("group", ["scripts", "csharp", "jvm"])
def test_no_keys_through_the_driver(spark, sf, group):
    """Spark's estimate of the exploded keys of a small table is far below the limit of a broadcast, whatever they are."""
    plan = catalog.QUERIES[f"resolve_{group}"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Broadcast" not in plan
