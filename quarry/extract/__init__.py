"""Facts from source text: one Arrow table function gives symbols, types, routes, imports and models in one pass.

Each language registers a function (Source) -> rows. A file that cannot be read gives a row of kind `error`
instead of failing the task, beside what patterns still find in it."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .. import schemas

EXTRACTORS: dict[str, Callable] = {}
#: How many languages register; with fewer, some module is not loaded yet.
LANGUAGES = 14


@dataclass
class Source:
    """A file and the rows found in it."""

    path: str
    language: str
    text: str
    framework: str = "generic"
    masked: str = ""
    rows: list[dict] = field(default_factory=list)
    sources: set[str] = field(default_factory=set)

    @cached_property
    def newlines(self) -> list[int]:
        return [i for i, c in enumerate(self.text) if c == "\n"]

    def line(self, at: int) -> int:
        return bisect_left(self.newlines, at) + 1

    def add(self, kind: str, at: int | None, name: str, what: str = "", detail: str = "", exported: bool = False, extra: str = "", line: int | None = None, fields: list | None = None, model_fields: list | None = None) -> None:
        self.rows.append({"kind": kind, "file_path": self.path, "language": self.language, "seq": len(self.rows), "line": line or (self.line(at) if at is not None else 1), "name": name, "what": what, "detail": detail, "exported": exported, "extra": extra, "fields": fields or [], "model_fields": model_fields or []})

    def symbol(self, at: int, name: str, kind: str, signature: str = "", exported: bool = True) -> None:
        self.add("symbol", at, name, kind, signature, exported)

    def type(self, at: int, name: str, kind: str, fields: list | None = None, exported: bool = True) -> None:
        self.add("type", at, name, kind, exported=exported, fields=fields)

    def route(self, at: int | None, method: str, path: str, framework: str, handler: str = "", auth: bool = False) -> None:
        self.add("route", at, path, method, handler, auth, framework)

    def imported(self, at: int | None, source: str, external: bool, line: int | None = None) -> None:
        """The first import of each source counts."""
        if source and source not in self.sources:
            self.sources.add(source)
            self.add("import", at, source, exported=external, line=line)


def extractor(*languages: str) -> Callable:
    def put(f: Callable) -> Callable:
        EXTRACTORS.update(dict.fromkeys(languages, f))
        return f

    return put


def field_row(name: str, type_: str, optional: bool = False) -> dict:
    return {"name": name, "type": type_, "optional": optional}


def extract(path: str, language: str, text: str, framework: str = "generic") -> list[dict]:
    """The facts of one text; an `error` row where it cannot be parsed."""
    if len(EXTRACTORS) < LANGUAGES:
        register()
    source = Source(path, language, text, framework)
    try:
        if language in EXTRACTORS:
            EXTRACTORS[language](source)
    except (SyntaxError, ValueError, RecursionError) as problem:
        source.add("error", None, type(problem).__name__, detail=str(problem)[:200])
    return source.rows


def register() -> None:
    """Load the languages. Done on the driver, so that executors get the full registry with the function."""
    from . import dotnet, go_rust, jvm, php_ruby, prisma, py, web  # noqa: F401


def facts(files: DataFrame, framework: str = "generic") -> DataFrame:
    """All facts of files (file_path, language, text); filter by kind, or use relation()."""
    register()
    schema = to_arrow_schema(_parse_datatype_string(schemas.FACTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for p, lang, t in zip(*(batch.column(c).to_pylist() for c in ("file_path", "language", "text")), strict=True) for r in extract(p, lang, t or "", framework)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("file_path", "language", "text").mapInArrow(run, schemas.FACTS)


def relation(found: DataFrame, kind: str) -> DataFrame:
    """symbols, types, routes, imports or models of a facts table, in their own schema."""
    rows = found.where(F.col("kind") == kind.removesuffix("s"))
    name, what, detail, flag = F.col("name"), F.col("what"), F.col("detail"), F.col("exported")
    columns = {
        "symbols": [name, what.alias("kind"), detail.alias("signature"), "file_path", "line", flag.alias("is_exported"), F.lit(False).alias("is_default"), "language", "seq"],
        "types": [name, what.alias("kind"), "fields", "file_path", "line", flag.alias("is_exported"), "language", "seq"],
        "routes": [what.alias("method"), name.alias("path"), "file_path", "line", detail.alias("handler"), flag.alias("auth"), F.col("extra").alias("framework"), "seq"],
        "imports": [name.alias("source"), F.lit(None).cast("string").alias("resolved_path"), "file_path", "line", flag.alias("is_external"), "language", "seq"],
        "models": [name, F.col("model_fields").alias("fields"), "file_path", what.alias("orm"), "seq"],
        "errors": [name, detail, "file_path"],
    }
    return rows.select(*columns[kind])
