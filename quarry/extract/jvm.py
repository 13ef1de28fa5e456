"""Java and Kotlin."""

from __future__ import annotations

import re

from . import Source, extractor, field_row
from .mask import FILL, block, mask

MAPPING = re.compile(r"@(Get|Post|Put|Patch|Delete|Request)Mapping\b\s*")


def join_java(base: str, path: str) -> str:
    if not base:
        return path
    cut = base.removesuffix("/")
    return cut if not path else cut + path if path.startswith("/") else f"{cut}/{path}"


def join_kotlin(base: str, path: str) -> str:
    b, p = base.removesuffix("/"), path.removeprefix("/")
    return f"{b}/{p}" if b and p else b or f"/{p}"


#: What may stand between a mapping and its method's name: other annotations, modifiers and types.
ANNOTATIONS = r"(?:\s*@[\w.]+(?:\s*\((?:[^()]|\([^()]*\))*\))?)*\s*"
HANDLER = {"java": re.compile(ANNOTATIONS + r"(?:[\w.?]+(?:<[^(){};]*?>)?(?:\[\])*\s+)+(\w+)\s*\("), "kotlin": re.compile(ANNOTATIONS + r"(?:\w+\s+)*?fun\s+(?:<[^>]+>\s*)?(\w+)\s*\(")}


def spring(s: Source, masked: str, join) -> None:
    """Mapping annotations; those before the file's first class give the prefix."""
    base, found = "", []
    first_class = re.search(r"\b(class|interface)\s+\w+", masked)
    for m in MAPPING.finditer(masked):
        a, b = block(masked, m.end(), "(", ")") if masked[m.end() : m.end() + 1] == "(" else (0, 0)
        # A bare string, or one named path or value; other arguments are not paths.
        arg = re.search(rf'(?:^|\b(?:path|value)\s*=)\s*[\[{{]?\s*"({FILL}*)"', masked[a:b])
        path = s.text[a + arg.start(1) : a + arg.end(1)] if arg else ""
        if first_class and m.start() < first_class.start():
            base = base or path
        else:
            verb = re.search(r"RequestMethod\s*\.\s*(\w+)", masked[a:b])
            handler = HANDLER[s.language].match(masked, b + 1 if b else m.end())
            found.append((m.start(), m[1].upper() if m[1] != "Request" else verb[1] if verb else "ALL", path, handler[1] if handler else ""))
    for at, method, path, handler in found:
        s.route(at, method, join(base, path), "spring", handler)


@extractor("java")
def java(s: Source) -> None:
    text, masked = s.text, mask(s.text, "java")
    for m in re.finditer(r"((?:\b(?:public|protected|private|static|final|abstract|sealed)\s+)*)\b(class|record)\s+(\w+)", masked):
        s.symbol(m.start(), m[3], "class", exported="public" in m[1])
    for m in re.finditer(r"((?:\b(?:public|protected|private|static|final|abstract|synchronized|default)\s+)+)(?:<[^>]+>\s*)?([\w.<>\[\],? ]+?)\s+(\w+)\s*\(([^)]*)\)\s*(?:throws\s+[\w.,\s]+)?[{;]", masked):
        if m[2].strip() not in ("new", "return", "else"):
            s.symbol(m.start(), m[3], "method", f"{m[2].strip()} ({' '.join(text[m.start(4) : m.end(4)].split())})", "public" in m[1])
    for m in re.finditer(r"((?:\b(?:public|protected|private|static)\s+)*)\b(interface|enum)\s+(\w+)", masked):
        a, b = block(masked, m.end())
        s.type(m.start(), m[3], m[2], java_enum(masked[a:b]) if m[2] == "enum" else [], m[2] == "enum" or "public" in m[1])
    spring(s, masked, join_java)
    for m in re.finditer(r"^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", masked, re.M):
        s.imported(m.start(), m[1].removesuffix(".*"), True)


def java_enum(body: str) -> list[dict]:
    """Constants up to the first semicolon, without their arguments and bodies."""
    head = re.sub(r"\([^)]*\)|\{[^}]*\}", "", body.split(";")[0])
    return [field_row(m[1], "") for part in head.split(",") if (m := re.match(r"\s*(?:@\w+\s*)*(\w+)\s*\Z", part))]


@extractor("kotlin")
def kotlin(s: Source) -> None:
    text, masked = s.text, mask(s.text, "kotlin")
    for m in re.finditer(r"\bfun\s+(?:<[^>]+>\s*)?(?:[\w.<>?]+\.)?(\w+)\s*\(", masked):
        a, b = block(masked, m.start(), "(", ")")
        s.symbol(m.start(), m[1], "function", f"({' '.join(text[a:b].split())})")
    for m in re.finditer(r"\b(class|object|interface)\s+(\w+)", masked):
        s.symbol(m.start(), m[2], "class")
        opened = re.match(r"[^{}\n]*(?:\([^)]*\))?[^{}\n]*\{", masked[m.end() :])
        if opened:
            a, b = block(masked, m.end())
            fields = kotlin_body(masked[a:b])
            if fields:
                s.type(m.start(), m[2], "interface", fields)
    spring(s, masked, join_kotlin)
    for m in re.finditer(r"^\s*import\s+([\w.]+(?:\.\*)?)", masked, re.M):
        s.imported(m.start(), m[1].removesuffix(".*"), True)


def kotlin_body(body: str) -> list[dict]:
    """val, var and fun lines."""
    out = []
    for line in body.split("\n"):
        if m := re.match(r"\s*(?:(?:override|private|protected|internal|public|open|lateinit|abstract|const|suspend)\s+)*(val|var|fun)\s+(\w+)", line):
            kind = re.search(r":\s*([\w<>?., ]+?)\s*(?:=|\{|\Z)", line[line.find(")") + 1 if m[1] == "fun" else m.end() :])
            out.append(field_row(m[2], kind[1] if kind else "function" if m[1] == "fun" else "", bool(kind and kind[1].endswith("?"))))
    return out
