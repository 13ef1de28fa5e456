"""Prisma schemas: model blocks with their fields."""

from __future__ import annotations

import re

from . import Source, extractor
from .py import AUDIT_COLUMNS

#: Scalar types; any other capitalised type is a relation.
SCALARS = {"String", "Int", "Float", "Boolean", "DateTime", "Json", "BigInt", "Decimal", "Bytes"}


def prisma_models(text: str) -> list[dict]:
    """(name, fields) of each model, in order; enums are left out."""
    out = []
    for m in re.finditer(r"^[ \t]*model\s+(\w+)\s*\{(.*?)^[ \t]*\}", text, re.M | re.S):
        fields = []
        for line in map(str.strip, m[2].split("\n")):
            f = re.match(r"(\w+)\s+(\w+)(\[\])?(\?)?", line)
            if not f or line.startswith(("//", "@@")):
                continue
            key, unique, linked = re.search(r"@id\b", line), "@unique" in line, "@relation" in line
            if f[1] in AUDIT_COLUMNS and not key and not unique:
                continue
            marks = [a for a, on in (("PK", key), ("UQ", unique), ("FK", f[1].endswith(("Id", "_id"))), ("relation", linked)) if on]
            fields.append({"name": f[1], "type": f[2] + (f[3] or ""), "required": not f[4], "is_relation": linked or (f[2][0].isupper() and f[2] not in SCALARS), "attributes": marks})
        out.append({"name": m[1], "fields": fields})
    return out


@extractor("prisma")
def prisma(s: Source) -> None:
    for m in prisma_models(s.text):
        s.add("model", None, m["name"], "prisma", model_fields=m["fields"])
