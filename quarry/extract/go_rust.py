"""Go and Rust."""

from __future__ import annotations

import re

from . import Source, extractor, field_row
from .mask import FILL, block, mask

#: Receivers whose verbs are routes.
GO_ROUTERS = {"router", "r", "app", "mux", "srv", "server", "api", "group", "gin", "engine", "route", "routes", "rg", "rt"}
GO_VERBS = "get|post|put|patch|delete|head|options|handlefunc|handle|any"
RUST_VERBS = re.compile(r"\b(get|post|put|patch|delete|head|options|any)\s*\(")


@extractor("go")
def go(s: Source) -> None:
    text, masked = s.text, mask(s.text, "go")
    for m in re.finditer(r"^func\s+(?:\(([^)]*)\)\s*)?(\w+)", masked, re.M):
        a, b = block(masked, m.end(), "(", ")")
        receiver = f"({' '.join(m[1].split())}) " if m[1] else ""
        s.symbol(m.start(), m[2], "method" if m[1] else "function", f"{receiver}({' '.join(text[a:b].split())})", m[2][0] == m[2][0].upper() and m[2][0] != "_")
    for m in re.finditer(r"\btype\s+(\w+)\s+(struct|interface)\b", masked):
        a, b = block(masked, m.end())
        fields = [field_row(f[1], f[2].strip(), f[2].startswith("*")) for line in masked[a:b].split("\n") if (f := re.match(r"\s*(\w+)\s+([^`\n]+?)\s*(?:`.*)?\Z", line))] if m[2] == "struct" else []
        s.type(m.start(), m[1], "interface", fields, m[1][0].isupper())
    for m in re.finditer(rf'\b(\w+)\s*\.\s*({GO_VERBS})\s*\(\s*"({FILL}*)"', masked, re.I):
        path, verb = text[m.start(3) : m.end(3)], m[2].lower()
        if m[1].lower() in GO_ROUTERS or path == "" or path.startswith("/") or "/:" in path:
            s.route(m.start(), "ALL" if verb in ("handlefunc", "handle", "any") else verb.upper(), path, "go-http")
    for m in re.finditer(rf'^import\s+(?:[\w.]+\s+)?"({FILL}*)"', masked, re.M):
        s.imported(m.start(), text[m.start(1) : m.end(1)], True)
    for m in re.finditer(r"^import\s*\(", masked, re.M):
        a, b = block(masked, m.start(), "(", ")")
        for q in re.finditer(rf'"({FILL}*)"', masked[a:b]):
            s.imported(a + q.start(), text[a + q.start(1) : a + q.end(1)], True)


@extractor("rust")
def rust(s: Source) -> None:
    text, masked = s.text, mask(s.text, "rust")
    pub = r"(pub(?:\([^)]*\))?\s+)?"
    for m in re.finditer(rf"{pub}(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+\S+\s+)?\bfn\s+(\w+)", masked):
        a, b = block(masked, m.end(), "(", ")")
        s.symbol(m.start(), m[2], "function", f"({' '.join(text[a:b].split())})", bool(m[1]))
    for m in re.finditer(rf"{pub}\b(struct|enum|trait)\s+(\w+)", masked):
        tail = re.match(r"[^;{(]*([;{(])", masked[m.end() :])
        a, b = block(masked, m.end()) if tail and tail[1] == "{" else (0, 0)
        if m[2] == "struct":
            fields = [field_row(f[1], f[2].strip(), f[2].strip().startswith("Option<")) for f in re.finditer(r"(?:pub(?:\([^)]*\))?\s+)?(\w+)\s*:\s*((?:[^,<]|<[^>]*>+)+)", masked[a:b])]
        else:
            fields = [field_row(f[1], "") for f in re.finditer(r"(?:^|,)\s*(?:#\[[^\]]*\]\s*)*(\w+)", re.sub(r"\{[^}]*\}|\([^)]*\)", "", masked[a:b]))] if m[2] == "enum" else []
        s.type(m.start(), m[3], "enum" if m[2] == "enum" else "interface", fields, bool(m[1]))
    for m in re.finditer(rf'\.\s*route\s*\(\s*"({FILL}*)"\s*,', masked):
        a, b = block(masked, m.start(), "(", ")")
        for verb in dict.fromkeys(v.upper() for v in RUST_VERBS.findall(masked[m.end() : b])):
            s.route(m.start(), verb, text[m.start(1) : m.end(1)], "axum")
    for m in re.finditer(rf'#\[\s*(get|post|put|patch|delete|head|options)\s*\(\s*"({FILL}*)"', masked):
        s.route(m.start(), m[1].upper(), text[m.start(2) : m.end(2)], "actix")
    for m in re.finditer(r"\b(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", masked):
        source = re.sub(r"\s+as\s+\w+", "", " ".join(m[1].split()))
        s.imported(m.start(), source, not source.startswith(("crate::", "super::", "self::")))
