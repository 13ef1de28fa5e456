"""A length-preserving masker: comments become spaces and the insides of strings \\x01, newlines stay.

Patterns run on the masked text, so they never match inside comments or strings; literals are read from the original
at the same offsets."""

from __future__ import annotations

import re

FILL = "\x01"
_DOUBLE, _SINGLE, _BACK = r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'", r"`(?:\\.|[^`\\])*`"
_SLASHES, _BLOCK, _HASH = r"//[^\n]*", r"/\*.*?\*/", r"#[^\n]*"
_TRIPLE = r'"""(?:\\.|.)*?"""' + r"|'''(?:\\.|.)*?'''"
_RUST_CHAR = r"'(?:\\.|[^'\\\n])'"

PATTERNS = {
    "typescript": "|".join([_SLASHES, _BLOCK, _DOUBLE, _SINGLE, _BACK]),
    "go": "|".join([_SLASHES, _BLOCK, _DOUBLE, _SINGLE, _BACK]),
    "java": "|".join([_SLASHES, _BLOCK, r'"""(?:\\.|.)*?"""', _DOUBLE, _SINGLE]),
    "kotlin": "|".join([_SLASHES, _BLOCK, r'""".*?"""', _DOUBLE, _SINGLE]),
    "csharp": "|".join([_SLASHES, _BLOCK, r'@"(?:""|[^"])*"', _DOUBLE, _SINGLE]),
    "rust": "|".join([_SLASHES, _BLOCK, r'r#*".*?"#*', _DOUBLE, _RUST_CHAR]),
    "php": "|".join([_SLASHES, _BLOCK, r"#(?!\[)[^\n]*", _DOUBLE, _SINGLE]),
    "ruby": "|".join([r"^=begin.*?^=end", _HASH, _DOUBLE, _SINGLE]),
    "python": "|".join([_TRIPLE, _HASH, _DOUBLE, _SINGLE]),
}
FAMILY = {"javascript": "typescript", "tsx": "typescript", "jsx": "typescript", "astro": "typescript"}
_COMPILED = {k: re.compile(v, re.S | re.M) for k, v in PATTERNS.items()}


def mask(text: str, language: str) -> str:
    """The masked text, of the same length."""

    def blank(m: re.Match) -> str:
        s = m[0]
        if s[0] in "\"'`" or s[:2] == '@"' or (s[0] == "r" and '"' in s[:4]):
            a = s.index(s.lstrip("@r#")[0])
            n = 3 if s[a : a + 3] in ('"""', "'''") and len(s) >= a + 6 else 1
            inner = "".join("\n" if c == "\n" else FILL for c in s[a + n : len(s) - n])
            return s[: a + n] + inner + s[len(s) - n :]
        return "".join("\n" if c == "\n" else " " for c in s)

    return _COMPILED[FAMILY.get(language, language)].sub(blank, text)


def block(masked: str, start: int, opening: str = "{", closing: str = "}") -> tuple[int, int]:
    """(start, end) of what stands inside the first bracket at or after start; empty where there is none."""
    at = masked.find(opening, start)
    if at < 0:
        return start, start
    depth = 0
    for m in re.compile(f"[{re.escape(opening + closing)}]").finditer(masked, at):
        depth += 1 if m[0] == opening else -1
        if not depth:
            return at + 1, m.start()
    return at + 1, len(masked)

