"""Python, by the standard library's parser."""

from __future__ import annotations

import ast
import re

from . import Source, extractor, field_row
from .mask import mask

#: Columns that an ORM keeps itself.
AUDIT_COLUMNS = {"createdAt", "updatedAt", "deletedAt", "isDeleted", "created_at", "updated_at", "deleted_at", "is_deleted"}
VERBS = {"get", "post", "put", "patch", "delete", "head", "options"}
RELATIONS = {"ForeignKey", "OneToOneField", "ManyToManyField"}


def shape(call: ast.AST) -> str:
    return call.attr if isinstance(call, ast.Attribute) else call.id if isinstance(call, ast.Name) else ""


def text_of(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def model_field(name: str, kind: str, call: ast.Call, relation: bool, not_null: bool) -> dict:
    true = {k.arg for k in call.keywords if isinstance(k.value, ast.Constant) and k.value.value is True}
    attributes = [a for a, on in (("PK", "primary_key" in true), ("UQ", "unique" in true), ("FK", relation)) if on]
    optional = true & ({"nullable"} if not_null else {"null", "blank"})
    return {"name": name, "type": kind, "required": not optional, "is_relation": relation, "attributes": attributes}


def model(s: Source, node: ast.ClassDef) -> None:
    bases = [ast.unparse(b) for b in node.bases]
    django = "models.Model" in bases
    fields = []
    for item in node.body:
        target = item.targets[0] if isinstance(item, ast.Assign) else item.target if isinstance(item, ast.AnnAssign) else None
        value = getattr(item, "value", None)
        if not isinstance(target, ast.Name) or not isinstance(value, ast.Call) or target.id in AUDIT_COLUMNS or target.id.startswith("__"):
            continue
        if django and isinstance(value.func, ast.Attribute) and shape(value.func.value) == "models":
            fields.append(model_field(target.id, value.func.attr, value, value.func.attr in RELATIONS, False))
        elif not django and shape(value.func) in ("Column", "mapped_column"):
            first = value.args[0] if value.args else None
            kind = shape(first.func if isinstance(first, ast.Call) else first) if first is not None else ""
            fields.append(model_field(target.id, kind or "unknown", value, any(isinstance(a, ast.Call) and shape(a.func) == "ForeignKey" for a in value.args), True))
    if django or (fields and len(bases) == 1):
        s.add("model", None, node.name, "django" if django else "sqlalchemy", line=node.lineno, model_fields=fields)


def decorated(s: Source, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
    for d in node.decorator_list:
        if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.args and (path := text_of(d.args[0])) is not None:
            verb = d.func.attr.lower()
            if verb == "route":
                listed = next((k.value for k in d.keywords if k.arg == "methods"), None)
                first = text_of(listed.elts[0]) if isinstance(listed, (ast.List, ast.Tuple)) and listed.elts else None
                s.add("route", None, path, (first or "GET").upper(), node.name, extra="flask", line=d.lineno)
            elif verb in VERBS:
                s.add("route", None, path, verb.upper(), node.name, extra="flask", line=d.lineno)


@extractor("python")
def python(s: Source) -> None:
    try:
        tree = ast.parse(s.text)
    except (SyntaxError, ValueError, RecursionError):
        by_patterns(s)
        raise
    models_file = bool(re.search(r"(^|/)models(\.py\Z|/)", s.path))
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            params = ast.unparse(node.args)
            ret = f" -> {ast.unparse(node.returns)}" if node.returns else ""
            s.add("symbol", None, node.name, "function", f"({params[:57] + '...' if len(params) > 60 else params}){ret}", not node.name.startswith("_"), line=node.lineno)
        elif isinstance(node, ast.ClassDef):
            s.add("symbol", None, node.name, "class", exported=not node.name.startswith("_"), line=node.lineno)
            typed = [x for x in node.body if isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name)]
            if typed:
                s.add("type", None, node.name, "interface", exported=not node.name.startswith("_"), line=node.lineno, fields=[field_row(x.target.id, ast.unparse(x.annotation), "Optional" in ast.unparse(x.annotation) or "None" in ast.unparse(x.annotation)) for x in typed])
            if models_file:
                model(s, node)
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            decorated(s, node)
        elif isinstance(node, ast.Call) and s.path.endswith("urls.py") and shape(node.func) in ("path", "re_path", "url") and node.args and (p := text_of(node.args[0])) is not None:
            s.add("route", None, p if p.startswith("/") else f"/{p}", "ALL", extra="django", line=node.lineno)
        elif isinstance(node, ast.Import):
            for a in node.names:
                s.imported(None, a.name, True, node.lineno)
        elif isinstance(node, ast.ImportFrom):
            source = "." * node.level + (node.module or "")
            s.imported(None, source, not node.level, node.lineno)


def by_patterns(s: Source) -> None:
    """Top-level functions, classes and imports of a file that does not parse, from its masked text."""
    masked = mask(s.text, "python")
    for m in re.finditer(r"^(?:async[ \t]+)?(def|class)[ \t]+(\w+)", masked, re.M):
        s.symbol(m.start(), m[2], "function" if m[1] == "def" else "class", exported=not m[2].startswith("_"))
    for m in re.finditer(r"^[ \t]*(?:from[ \t]+(\.*[\w.]*)[ \t]+import\b|import[ \t]+([\w., \t]+))", masked, re.M):
        if m[1]:
            s.imported(m.start(), m[1], not m[1].startswith("."))
        for name in re.findall(r"([\w.]+)(?:[ \t]+as[ \t]+\w+)?[ \t]*(?:,|\Z)", (m[2] or "").strip()):
            s.imported(m.start(), name, True)
