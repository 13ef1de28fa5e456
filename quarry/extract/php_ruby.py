"""PHP and Ruby."""

from __future__ import annotations

import re

from ..operators.routes import RESOURCE, RESOURCES
from . import Source, extractor, field_row
from .mask import FILL, block, mask


@extractor("php")
def php(s: Source) -> None:
    text, masked = s.text, mask(s.text, "php")
    classes = [(m.start(), m[1], m[2]) for m in re.finditer(r"\b(class|interface|trait|enum)\s+(\w+)", masked)]
    for at, kind, name in classes:
        if kind != "enum":
            s.symbol(at, name, "class" if kind == "class" else "interface")
    for m in re.finditer(r"((?:\b(?:public|private|protected|static|final|abstract)\s+)*)\bfunction\s+&?(\w+)\s*\(", masked):
        a, b = block(masked, m.start(), "(", ")")
        inside = next((n for at, _, n in reversed(classes) if at < m.start() and block(masked, at)[1] > m.start()), None)
        signature = f"({' '.join(text[a:b].split())})"
        if inside is None:
            s.symbol(m.start(), m[2], "function", signature)
        elif not re.search("private|protected", m[1]):
            s.symbol(m.start(), f"{inside}::{m[2]}", "method", signature)
    for at, kind, name in classes:
        a, b = block(masked, at)
        if kind == "interface":
            s.type(at, name, "interface", [field_row(x, "method") for x in re.findall(r"\bfunction\s+(\w+)", masked[a:b])])
        elif kind == "enum":
            s.type(at, name, "enum", [field_row(x, "") for x in re.findall(r"\bcase\s+(\w+)", masked[a:b])])
    for m in re.finditer(rf"\bRoute::(get|post|put|patch|delete|options|any)\s*\(\s*([\"'])({FILL}*)\2", masked):
        s.route(m.start(), "ALL" if m[1] == "any" else m[1].upper(), text[m.start(3) : m.end(3)], "laravel")
    for m in re.finditer(r"^\s*use\s+(?:function\s+|const\s+)?([\w\\]+)", masked, re.M):
        s.imported(m.start(), m[1].removeprefix("\\"), True)
    for m in re.finditer(rf"\b(?:require|include)(?:_once)?\s*\(?\s*(?:__DIR__\s*\.\s*)?([\"'])({FILL}*)\1", masked):
        source = text[m.start(2) : m.end(2)]
        source = f".{source}" if "__DIR__" in m[0] and source.startswith("/") else source
        s.imported(m.start(), source, not source.startswith(("./", "../")))


def actions(options: str, key: str) -> set[str] | None:
    """The names of an only: or except: option, as a list, %i list or single symbol."""
    if m := re.search(key + r":\s*(?:%i)?\[([^\]]*)\]", options):
        return set(re.findall(r"\w+", m[1]))
    m = re.search(key + r":\s*:(\w+)", options)
    return {m[1]} if m else None


@extractor("ruby")
def ruby(s: Source) -> None:
    text, masked = s.text, mask(s.text, "ruby")
    for m in re.finditer(r"^[ \t]*(class|module)\s+([\w:]+)", masked, re.M):
        s.symbol(m.start(), m[2], "class")
    for m in re.finditer(r"^[ \t]*def\s+(self\.)?(\w+[?!=]?)(?:\s*\(([^)]*)\))?", masked, re.M):
        s.symbol(m.start(), f"self.{m[2]}" if m[1] else m[2], "method", f"({m[3] or ''})", not m[2].startswith("_"))
    for m in re.finditer(r"^([ \t]*)class\s+([\w:]+).*?^\1end\b", masked, re.M | re.S):
        names = [n for a in re.finditer(r"\battr_(?:accessor|reader|writer)\s+([^\n]+)", m[0]) for n in re.findall(r":(\w+)", a[1])]
        if names:
            s.type(m.start(), m[2], "interface", [field_row(n, "Object") for n in names])
    if s.path.endswith("routes.rb") or "routes/" in s.path:
        for m in re.finditer(rf"^[ \t]*(get|post|put|patch|delete)\s+(?:([\"'])({FILL}*)\2|:(\w+))", masked, re.M):
            path = m[4] or text[m.start(3) : m.end(3)]
            s.route(m.start(), m[1].upper(), path if path.startswith("/") else f"/{path}", "rails")
        for m in re.finditer(r"^[ \t]*(resources|resource)\s+:(\w+)([^\n]*)", masked, re.M):
            options = re.sub(r"\sdo\b.*", "", m[3])
            only, out = actions(options, "only"), actions(options, "except") or set()
            for method, action, tail in RESOURCES if m[1] == "resources" else RESOURCE:
                if (only is None or action in only) and action not in out:
                    s.route(m.start(), method, f"/{m[2]}{tail}", "rails", action)
    for m in re.finditer(rf"^[ \t]*(require|require_relative)\s*\(?\s*([\"'])({FILL}*)\2", masked, re.M):
        s.imported(m.start(), text[m.start(3) : m.end(3)], m[1] == "require")
