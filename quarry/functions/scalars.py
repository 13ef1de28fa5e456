"""Column functions over names, paths, routes and sizes. All are built-in expressions, so they stay in code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weight of each severity in a finding's score.
SEVERITY_WEIGHT = {"critical": 100, "high": 50, "medium": 20, "low": 5}
#: The order of symbol kinds in listings; other kinds come last.
KIND_RANK = {"function": 0, "method": 1, "class": 2, "interface": 3, "type": 4, "enum": 5, "constant": 6, "variable": 7}
#: Endings that make variants of one type name.
VARIANT_SUFFIXES = ["Data", "Info", "Dto", "Model", "Type", "Entity", "Record", "Schema", "Props", "Config", "Options", "Payload"]

Text = str | Column


def _c(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def truncate(s: Text, n: int) -> Column:
    """At most n characters, the last three being dots where some were cut."""
    return F.when(F.length(_c(s)) > n, F.concat(F.substring(_c(s), 1, max(0, n - 3)), F.lit("..."))).otherwise(_c(s))


def case_map(x: Text, values: dict, default: object = None) -> Column:
    """values[x], as one CASE."""
    out = None
    for k, v in values.items():
        out = F.when(_c(x) == k, F.lit(v)) if out is None else out.when(_c(x) == k, F.lit(v))
    return out.otherwise(F.lit(default))


def heat_score(severity: Text, heat: Text) -> Column:
    """Severity weight times 1 + log10(1 + heat), rounded half up."""
    warm = F.lit(1.0) + F.log10(F.lit(1.0) + F.greatest(F.lit(0), _c(heat)))
    return F.floor(case_map(severity, SEVERITY_WEIGHT, 0) * warm + F.lit(0.5)).cast("long")


def base_name(path: Text) -> Column:
    return F.regexp_extract(_c(path), r"([^/]*)$", 1)


def stem(path: Text) -> Column:
    """The base name up to its last dot."""
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def dir_name(path: Text) -> Column:
    """The folder of a path; `.` for a file at the root."""
    cut = F.regexp_replace(_c(path), r"/?[^/]*$", "")
    return F.when(cut == "", F.lit(".")).otherwise(cut)


def normalise_path(path: Text) -> Column:
    """A relative path without empty, `.` and `..` segments; `..` at the root stays."""
    def step(acc: Column, x: Column) -> Column:
        up = (x == "..") & (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) != "..")
        return F.when((x == "") | (x == "."), acc).when(up, F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1))).otherwise(F.array_append(acc, x))
    return F.array_join(F.aggregate(F.split(_c(path), "/"), F.array().cast("array<string>"), step), "/")


def package_name(source: Text, family: Text) -> Column:
    """The package that an import names, by the rules of its language family."""
    s, f = _c(source), _c(family)
    def head(sep: str, n: int, pattern: str | None = None) -> Column:
        return F.array_join(F.slice(F.split(s, pattern or sep), 1, n), sep)
    scoped = F.when(s.startswith("@"), head("/", 2)).otherwise(head("/", 1))
    return (F.when(f.isin("typescript", "javascript", "tsx", "jsx", "astro"), scoped).when(f == "python", head(".", 1, r"\."))
            .when(f == "go", head("/", 3)).when(f.isin("java", "kotlin"), head(".", 3, r"\.")).when(f == "rust", head("::", 1))
            .when(f == "php", head("\\", 1, r"\\")).when(f == "csharp", head(".", 2, r"\.")).otherwise(s))


def path_parameters(path: Text) -> Column:
    """[...x] and [x] segments as :x."""
    return F.regexp_replace(_c(path), r"\[(?:\.\.\.)?([^\]]+)\]", ":$1")


def app_route(path: Text) -> Column:
    """The URL of an app-router file: without app/, route.ext and (groups)."""
    p = F.regexp_replace(_c(path), r"^app/", "")
    p = F.regexp_replace(p, r"/?route\.(?:ts|tsx|js|jsx)\z", "")
    p = path_parameters(F.regexp_replace(p, r"\([^)]*\)/?", ""))
    return F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))


def page_route(path: Text) -> Column:
    """The URL of a page file under src/pages/; null for the top-level 404."""
    p = F.regexp_replace(F.regexp_replace(_c(path), r"^.*?src/pages/", ""), r"\.astro\z", "")
    q = F.regexp_replace(p, r"(^|/)index\z", "")
    q = F.regexp_replace(F.regexp_replace(q, r"\[\.\.\.[^\]]+\]", "*"), r"\[([^\]]+)\]", ":$1")
    return F.when(p == "404", F.lit(None)).otherwise(F.concat(F.lit("/"), q))


def route_prefix(path: Text, n: int = 2) -> Column:
    """The first n segments that are not empty, with a leading slash."""
    return F.concat(F.lit("/"), F.array_join(F.slice(F.array_remove(F.split(_c(path), "/"), ""), 1, n), "/"))


def join_route_jvm(base: Text, path: Text) -> Column:
    """Annotation style: no base leaves the path as it is; else exactly one slash between."""
    b, p = _c(base), _c(path)
    cut = F.regexp_replace(b, r"/\z", "")
    return F.when(b == "", p).when(p == "", cut).when(p.startswith("/"), F.concat(cut, p)).otherwise(F.concat(cut, F.lit("/"), p))


def join_route_kotlin(base: Text, path: Text) -> Column:
    """One slash is cut from either side; both empty give /, and an empty path the base."""
    b, p = F.regexp_replace(_c(base), r"/\z", ""), F.regexp_replace(_c(path), r"^/", "")
    return F.when((b == "") & (p == ""), "/").when(b == "", F.concat(F.lit("/"), p)).when(p == "", b).otherwise(F.concat(b, F.lit("/"), p))


def join_route_dotnet(base: Text, path: Text) -> Column:
    """Always a leading slash, even before a base that has one; an empty path gives the base."""
    b, p = F.regexp_replace(_c(base), r"/\z", ""), F.regexp_replace(_c(path), r"^/", "")
    return F.concat(F.lit("/"), F.when(b == "", p).when(p == "", b).otherwise(F.concat(b, F.lit("/"), p)))


def strip_quotes(s: Text) -> Column:
    return F.regexp_replace(_c(s), r"""^[rRbBuUfF]{0,2}["'`]+|["'`]+\z""", "")


def type_root(name: Text) -> Column:
    """A type's name without a leading I before a capital and without one variant ending; null for short roots."""
    r = F.regexp_replace(F.regexp_replace(_c(name), r"^I(?=[A-Z])", ""), f"(?:{'|'.join(VARIANT_SUFFIXES)})\\z", "")
    return F.when(F.length(r) >= 3, r)


def naming_style(name: Text) -> Column:
    """snake, camel or null; constants and Pascal case have no style."""
    n = _c(name)
    skip = n.rlike(r"\A[A-Z][A-Z0-9_]*\z") | n.rlike(r"\A[A-Z][a-zA-Z0-9]*\z")
    return F.when(~skip, F.when(n.rlike(r"\A[a-z]") & n.contains("_"), "snake").when(n.rlike(r"\A[a-z][a-zA-Z0-9]*\z") & n.rlike("[A-Z]"), "camel"))


def token_estimate(n_bytes: Text) -> Column:
    return F.ceil(_c(n_bytes) / F.lit(3.5)).cast("long")


def format_bytes(n: Text) -> Column:
    return F.when(_c(n) < 1024, F.format_string("%d B", _c(n))).otherwise(F.format_string("%.1f KB", _c(n) / F.lit(1024.0)))


#: Paths of files that start a program or are read by a tool, so nothing needs to import them.
ENTRY_POINTS = [
    r"(^|/)cli\.(ts|js|mjs|cjs|py)\z",
    r"(^|/)main\.(ts|js|mjs|cjs|py|go|rs|java|kt)\z",
    r"(^|/)index\.(ts|js|mjs|cjs)\z",
    r"(^|/)__main__\.py\z",
    r"(^|/)app\.(ts|js|mjs|py)\z",
    r"(^|/)server\.(ts|js|mjs|py|go)\z",
    r"(^|/)bin/",
    r"\.config\.(ts|js|mjs|cjs)\z",
    r"(^|/)(vite|webpack|rollup|esbuild|next|astro|svelte|nuxt|tailwind|postcss)\.config\.",
    r"(^|/)tsconfig\.",
    r"(^|/)types(\.ts|/)",
]


def is_entry_point(path: Text) -> Column:
    return _c(path).rlike("|".join(ENTRY_POINTS))


def entry_role(path: Text) -> Column:
    """What an entry point is, for listings."""
    p = base_name(path)
    return (F.when(p.contains("config"), "Configuration").when(p.startswith("cli"), "Command line").when(p.rlike("^(main|app|server|manage|wsgi|asgi)"), "Application start")
            .when(p.contains("middleware"), "Middleware").when(p.startswith("layout"), "Layout").when(p.startswith("index"), "Index").otherwise("Entry point"))


def tree_annotation(path: Text, framework: str, entry_points: tuple[str, ...] = ()) -> Column:
    """entry, route or schema, the first that holds for a file of a project of some framework; else null."""
    p = _c(path)
    routes = {"nextjs-app": p.contains("/route.") | p.contains("/page."), "nextjs-pages": p.startswith("pages/"), "astro": p.startswith("src/pages/"), "django": p.endswith("urls.py")}
    routes["nextjs-both"] = routes["nextjs-app"]
    schema = p.contains("schema.prisma") | p.contains("models.py") | p.endswith(".entity.ts") | p.contains("drizzle/schema")
    return F.when(p.isin(*entry_points) if entry_points else F.lit(False), "entry").when(routes.get(framework, F.lit(False)), "route").when(schema, "schema")


def parse_actions(options: Text, key: str) -> Column:
    """The names in `key: [..]` of a resource's options, up to ` do`; null where there is no such list.
    %i[..], and a single :name, are read too."""
    text = F.regexp_replace(_c(options), r"(?s)\sdo\b.*\z", "")
    inside = F.coalesce(F.nullif(F.regexp_extract(text, key + r":\s*(?:%i)?\[([^\]]*)\]", 1), F.lit("")), F.nullif(F.regexp_extract(text, key + r":\s*:(\w+)", 1), F.lit("")))
    return F.when(inside.isNotNull(), F.regexp_extract_all(inside, F.lit(r"(\w+)"), 1))


def frontmatter(text: Text) -> Column:
    """What stands between leading --- fences; null without them."""
    return F.nullif(F.regexp_extract(_c(text), r"\A---\r?\n([\s\S]*?)\r?\n---", 1), F.lit(""))


def verbs_in(text: Text, verbs: list[str]) -> Column:
    """The distinct verbs that are called in a text, in order of first use."""
    return F.array_distinct(F.regexp_extract_all(_c(text), F.lit(rf"\b({'|'.join(verbs)})\s*\("), 1))


def any_of(x: Text, parts: list[str]) -> Column:
    """Whether x contains one of some literal strings."""
    out = F.lit(False)
    for p in parts:
        out = out | _c(x).contains(p)
    return out
