"""C#."""

from __future__ import annotations

import re

from . import Source, extractor, field_row
from .mask import FILL, block, mask

MODIFIERS = r"((?:\b(?:public|private|protected|internal|static|sealed|abstract|partial|virtual|override|async|readonly|new)\s+)*)"


#: What may stand between a route's attribute and its method's name: its end, other attributes, modifiers and types.
HANDLER = re.compile(r"[^\]]*\](?:\s*\[[^\]]*\])*\s*(?:[\w.?]+(?:<[^(){};]*?>)?(?:\[\])?\??\s+)+(\w+)\s*(?:<[^>]+>)?\s*\(")


def handler(masked: str, at: int) -> str:
    found = HANDLER.match(masked, at)
    return found[1] if found else ""


def join(base: str, path: str) -> str:
    b, p = base.removesuffix("/"), path.removeprefix("/")
    return "/" + (f"{b}/{p}" if b and p else b or p)


@extractor("csharp")
def csharp(s: Source) -> None:
    text, masked = s.text, mask(s.text, "csharp")
    for m in re.finditer(MODIFIERS + r"\b(?:class|record|struct)\s+(\w+)", masked):
        s.symbol(m.start(), m[2], "class", exported="public" in m[1])
    for m in re.finditer(r"((?:\b(?:public|private|protected|internal|static|virtual|override|async|abstract)\s+)+)([\w.<>\[\],? ]+?)\s+(\w+)\s*(?:<[^>]+>)?\s*\(([^)]*)\)\s*(?:where[^{;]*)?(?:\{|=>|;)", masked):
        s.symbol(m.start(), m[3], "method", f"{m[2].strip()} ({' '.join(text[m.start(4) : m.end(4)].split())})", "public" in m[1])
    for m in re.finditer(MODIFIERS + r"\b(interface|enum)\s+(\w+)", masked):
        a, b = block(masked, m.end())
        s.type(m.start(), m[3], m[2], [field_row(x[1], "") for part in masked[a:b].split(",") if (x := re.match(r"\s*(?:\[[^\]]*\]\s*)*(\w+)", part))] if m[2] == "enum" else [], "public" in m[1])
    first = re.search(r"\bclass\s+\w+", masked)
    head = masked[: first.start()] if first else ""
    base = re.search(rf'\[\s*Route\s*\(\s*"({FILL}*)"', head)
    prefix = text[base.start(1) : base.end(1)] if base else ""
    for m in re.finditer(rf'\[\s*Http(Get|Post|Put|Patch|Delete|Head|Options)\s*(?:\(\s*(?:"({FILL}*)")?[^)]*\))?', masked):
        path = text[m.start(2) : m.end(2)] if m[2] is not None else ""
        s.route(m.start(), m[1].upper(), join(prefix, path), "aspnet", handler(masked, m.end()))
    if first:
        for m in re.finditer(rf'\[\s*Route\s*\(\s*"({FILL}*)"', masked[first.end() :]):
            s.route(first.end() + m.start(), "ALL", join(prefix, text[first.end() + m.start(1) : first.end() + m.end(1)]), "aspnet", handler(masked, first.end() + m.end()))
    for m in re.finditer(r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;", masked, re.M):
        s.imported(m.start(), m[1], True)
