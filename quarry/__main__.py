"""Index a source tree, and ask its index.

index ROOT writes reports and a saved index, and parses only what has changed since; blast and lookup answer from an index
that is up to date; stats measures the reports; hook installs a pre-commit hook that keeps them fresh."""

from __future__ import annotations

import argparse
import os
import sys

from . import __version__, hook
from .plans import index, reports
from .session import local_session
from .sources import frameworks, scan
from .sources.config import Config, load_config

SETTINGS = "quarry.json"


def arguments(args: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="quarry", description=__doc__.split("\n")[0])
    parser.add_argument("--version", action="version", version=__version__)
    actions = parser.add_subparsers(dest="action", required=True)
    for name, help_text, extra in (("index", "write reports and the saved index", ()), ("blast", "what depends on a file", ("file",)), ("lookup", "symbols and types by a part of their name", ("text",)), ("stats", "bytes and tokens of the reports", ()), ("hook", "install the pre-commit hook", ())):
        p = actions.add_parser(name, help=help_text)
        p.add_argument("root")
        for x in extra:
            p.add_argument(x)
        p.add_argument("--output", help=f"folder of the reports, under ROOT (default: {Config().output})")
        for option in ("--include", "--exclude", "--schema"):
            p.add_argument(option, action="append", default=[])
        p.add_argument("--force", action="store_true", help="parse every file anew")
        p.add_argument("-q", "--quiet", action="store_true")
    return parser.parse_args(args)


def fresh(spark, root: str, config: Config, saved: str, force: bool) -> tuple[index.Index, frameworks.Framework, bool]:
    """The index of a tree, its framework, and whether it differs from the saved one."""
    exclude = [*config.exclude, os.path.basename(config.output.rstrip("/"))]
    files = scan.scan(spark, root, list(config.include), exclude)
    framework, schemas = frameworks.detect_tree(spark, root, files), scan.schema_files(spark, root, list(config.schema))
    old = None if force else index.load(spark, saved)
    if old is None:
        return index.build(files, framework.id, schemas), framework, True
    changed = not index.changes(old, files).where("status <> 'unchanged'").isEmpty()
    new = index.update(old, files, framework.id, schemas)
    return new, framework, changed


def main(args: list[str]) -> int:
    given = arguments(args)
    root = given.root.rstrip("/") or "/"
    say = (lambda *a: None) if given.quiet else print
    if given.action == "hook":
        say("installed" if hook.install(root) else "there already")
        return 0
    config = load_config(os.path.join(root, SETTINGS), **{k: v for k, v in (("output", given.output), ("include", given.include), ("exclude", given.exclude), ("schema", given.schema)) if v})
    output = os.path.join(root, config.output)
    spark = local_session()
    if given.action == "stats":
        if not os.path.isdir(output):
            say("no reports yet")
            return 1
        print(*reports.stats_lines(index.report_stats(spark, output)), sep="\n")
        return 0
    ix, framework, changed = fresh(spark, root, config, os.path.join(output, "saved"), given.force)
    if given.action == "blast":
        print(*reports.blast_lines(given.file, ix.blast(given.file)), sep="\n")
    elif given.action == "lookup":
        for r in ix.lookup(given.text).orderBy("file_path", "line", "name").toLocalIterator():
            print(f"{r.file_path}:{r.line} {r['kind']} {r['name']}")
    elif changed:
        names = reports.write_all(ix, output, framework)
        ix.save(os.path.join(output, "saved"))
        row = ix.counts().first()
        say(f"{framework.name}: {row.files} files, {row.symbols} symbols, {row.types} types, {row.routes} routes, {row.models} models, {row.imports} imports, {row.errors} errors; {', '.join(names)}")
    else:
        say("nothing has changed")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
