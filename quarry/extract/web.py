"""TypeScript, JavaScript and their JSX forms, and Astro."""

from __future__ import annotations

import re

from . import Source, extractor, field_row
from .mask import FILL, block, mask

#: Objects whose verbs are routes, and objects whose verbs never are.
ROUTERS = {"app", "router", "server", "api", "route", "routes", "express", "fastify", "hono", "koa"}
NOT_ROUTERS = {"supabase", "client", "db", "prisma", "fetch", "axios", "http", "https", "request", "response", "cache", "store", "storage", "map", "set"}
#: Words that show a handler checks its user.
AUTH = ["auth", "authenticate", "requireAuth", "isAuthenticated", "protect", "login_required", "requires_auth", "Authorize", "withAuth", "checkPermissions", "createPermissionHandler"]

STRING = rf"""(["'`])({FILL}*)\1"""
IMPORTS = [re.compile(p) for p in (rf"\bimport\s+(?:type\s+)?(?:[\w*${{}}\s,]+?\s+from\s+)?{STRING}", rf"\bexport\s+(?:type\s+)?(?:\*(?:\s+as\s+\w+)?|\{{[^}}]*\}})\s+from\s+{STRING}", rf"\brequire\s*\(\s*{STRING}\s*\)", rf"\bimport\s*\(\s*{STRING}\s*\)")]
ROUTE = re.compile(rf"\b(\w+)\s*\.\s*(get|post|put|patch|delete|all|use)\s*\(\s*([\"'])({FILL}*)\3", re.I)
DECLARED = re.compile(r"\bexport\s+(?:default\s+)?(?:declare\s+)?(?:(?:async\s+)?(function)\b\s*\*?\s*(\w+)|(?:abstract\s+)?(class)\s+(\w+)|(interface)\s+(\w+)|(?:const\s+)?(enum)\s+(\w+)|(type)\s+(\w+)|(const|let)\s+(\w+))")
TYPED = re.compile(r"\b(interface|enum|type)\s+(\w+)")


def members(text: str) -> list[dict]:
    """Fields of an interface body: one for each member, nested braces kept together."""
    out, depth, part = [], 0, ""
    for c in text + ";":
        depth += (c in "{([<") - (c in "})]" or (c == ">" and not part.endswith("=")))
        if c in ";,\n" and depth <= 0:
            if m := re.match(r"\s*(?:readonly\s+)?(\w+)(\?)?\s*:\s*(.+?)\s*\Z", part, re.S):
                out.append(field_row(m[1], " ".join(m[3].split()), bool(m[2])))
            part = ""
        else:
            part += c
    return out


def enum_members(text: str) -> list[dict]:
    return [field_row(m[1], "") for part in text.split(",") if (m := re.match(r"\s*(\w+)", part))]


def code(s: Source, text: str, base: int = 0) -> None:
    """Imports of a script; base is its offset in the file."""
    masked = mask(text, s.language)
    for pattern in IMPORTS:
        for m in pattern.finditer(masked):
            source = text[m.start(2) : m.end(2)]
            s.imported(base + m.start(), source, not source.startswith((".", "@/")))


@extractor("typescript", "javascript", "tsx", "jsx")
def web(s: Source) -> None:
    text, masked = s.text, mask(s.text, s.language)
    typed = s.language in ("typescript", "tsx")
    for m in DECLARED.finditer(masked):
        kind, name = next((k, n) for k, n in zip(m.groups()[::2], m.groups()[1::2], strict=True) if k)
        if kind == "function":
            a, b = block(masked, m.end(), "(", ")")
            params = " ".join(text[a:b].split())
            s.symbol(m.start(), name, "function", f"({params[:77] + '...' if len(params) > 80 else params})")
        elif kind == "class":
            s.symbol(m.start(), name, "class")
        elif typed:
            s.symbol(m.start(), name, "constant" if kind in ("const", "let") else kind)
    if typed:
        for m in TYPED.finditer(masked):
            if m[1] == "type":
                if re.match(r"\s*(?:<[^=]*>)?\s*=", masked[m.end() :]):
                    s.type(m.start(), m[2], "type")
                continue
            a, b = block(masked, m.end())
            s.type(m.start(), m[2], m[1], members(text[a:b]) if m[1] == "interface" else enum_members(masked[a:b]))
    if s.framework in ("nextjs-app", "nextjs-both") and re.search(r"route\.(ts|js)", s.path):
        for verb in ("GET", "POST", "PUT", "DELETE", "PATCH"):
            if re.search(rf"export\s+(async\s+)?function\s+{verb}\b", masked):
                s.route(None, verb, app_path(s.path), "nextjs", verb, any(a in text for a in AUTH))
    else:
        for m in ROUTE.finditer(masked):
            path, obj = text[m.start(4) : m.end(4)], m[1].lower()
            if obj not in NOT_ROUTERS and (obj in ROUTERS or path.startswith("/")):
                s.route(m.start(), m[2].upper(), path, "express")
    code(s, text)


def app_path(path: str) -> str:
    """URL of an app-router file; the Column form is functions.scalars.app_route."""
    p = re.sub(r"/?route\.\w+\Z", "", re.sub(r"\Aapp/", "", path))
    p = re.sub(r"\[(?:\.\.\.)?(\w+)\]", r":\1", re.sub(r"\([\w-]+\)/?", "", p))
    return p if p.startswith("/") else f"/{p}"


@extractor("astro")
def astro(s: Source) -> None:
    if head := re.match(r"---\r?\n([\s\S]*?)\r?\n---", s.text):
        code(s, head[1], head.start(1))
    if "src/pages/" in s.path:
        p = re.sub(r"\.astro\Z", "", s.path.split("src/pages/", 1)[1])
        if p != "404":
            p = re.sub(r"(^|/)index\Z", "", p)
            s.route(None, "GET", "/" + re.sub(r"\[(\w+)\]", r":\1", re.sub(r"\[\.\.\.\w+\]", "*", p)), "astro")
