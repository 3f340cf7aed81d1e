"""Command line and interactive shell over a database's root folder.

    python -m tesserine create ROOT
    python -m tesserine query ROOT "MATCH (n) RETURN count(n) AS n" --format json
    python -m tesserine ROOT            # the shell; .help lists its commands
"""

from __future__ import annotations

import argparse
import csv
import io
import json
import sys
import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .api import Database, QueryError, TransactionError
from .sources import files

VERSION = "0.2"
FORMATS = ("table", "json", "csv")
#: Rows that are printed unless --rows says otherwise; as a screen holds no more.
ROWS = 1000


def rendered(df: DataFrame | None, form: str, rows: int = ROWS) -> str:
    """The first rows of a result as text; says if there are more."""
    if df is None:
        return "ok"
    found = df.limit(rows + 1).collect()
    more, found = len(found) > rows, found[:rows]
    columns = df.columns
    if form == "json":
        return json.dumps([r.asDict(True) for r in found], default=str, ensure_ascii=False)
    cells = [["" if v is None else v if isinstance(v, str) else json.dumps(v, default=str, ensure_ascii=False) for v in r] for r in found]
    if form == "csv":
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([columns, *cells])
        return out.getvalue().rstrip("\n")
    widths = [max(len(x) for x in col) for col in zip(columns, *cells, strict=True)] if columns else []
    lines = [" | ".join(x.ljust(w) for x, w in zip(row, widths, strict=True)).rstrip() for row in (columns, *cells)]
    lines.insert(1, "-+-".join("-" * w for w in widths))
    return "\n".join([*lines, f"({len(found)} rows{', and more' if more else ''})"])


def load(db: Database, path: str, edges: str | None = None) -> None:
    """Imports a JSON file, or CSV files of nodes and edges, as one commit."""
    with db.write() as tx:
        tx.graph = files.import_csv(tx.graph, path, edges) if path.endswith(".csv") or edges else files.import_json(tx.graph, path)


EXPORTS = {"json": files.export_json, "jsonl": files.export_jsonl, "csv": files.export_csv, "dot": files.export_dot}


def listing(db: Database, what: str) -> Any:
    """What labels, types, count, schema and info show."""
    if what == "labels":
        return db.graph.label_counts().orderBy("label")
    if what == "types":
        return db.graph.edge_type_counts().orderBy("type")
    if what == "count":
        return f"nodes: {db.node_count()}\nedges: {db.edge_count()}"
    return json.dumps(db.graph.schema() if what == "schema" else db.info(), indent=2)


def shown(value: Any, form: str, rows: int = ROWS) -> str:
    return value if isinstance(value, str) else rendered(value, form, rows)


HELP = """.labels .types .schema .count .info   what the graph holds
.format table|json|csv               how results are shown
.timing on|off                       whether times are shown
.multiline on|off                    statements end with ;
.history                             statements so far
.clear                               clears the screen
.help .exit"""


class Shell:
    """Reads statements and dot commands, a line at a time, until .exit or the end."""

    def __init__(self, db: Database, form: str = "table", out=None):
        self.db, self.form, self.out = db, form, out or sys.stdout
        self.timing = self.multiline = False
        self.running, self.held, self.history = True, [], []

    def say(self, text: str) -> None:
        print(text, file=self.out)

    def run(self, lines) -> None:
        for line in lines:
            self.line(line.rstrip("\n"))
            if not self.running:
                break

    def line(self, line: str) -> None:
        if line.startswith(".") and not self.held:
            self.command(line.split())
            return
        if self.multiline and not line.rstrip().endswith(";"):
            self.held += [line] if line.strip() or self.held else []
            return
        statement = "\n".join([*self.held, line]).strip().removesuffix(";")
        self.held = []
        if statement:
            self.statement(statement)

    def statement(self, source: str) -> None:
        self.history.append(source)
        began = time.time()
        try:
            self.say(rendered(self.db.query(source), self.form))
        except (QueryError, TransactionError) as e:
            self.say(f"error: {e}")
        if self.timing:
            self.say(f"{time.time() - began:.3f} s")

    def command(self, words: list[str]) -> None:
        name, given = words[0], words[1] if len(words) > 1 else None
        if name in (".exit", ".quit", ".q"):
            self.running = False
        elif name in (".help", ".h"):
            self.say(HELP)
        elif name == ".tables" or name[1:] in ("labels", "types", "schema", "count", "info"):
            self.say(shown(listing(self.db, "labels" if name == ".tables" else name[1:]), self.form))
        elif name == ".format" and given in (None, *FORMATS):
            self.form = given or self.form
            self.say(f"format: {self.form}")
        elif name in (".timing", ".multiline") and given in (None, "on", "off"):
            if given:
                setattr(self, name[1:], given == "on")
            self.say(f"{name[1:]}: {'on' if getattr(self, name[1:]) else 'off'}")
        elif name == ".history":
            self.say("\n".join(f"{i}  {x}" for i, x in enumerate(self.history, 1)))
        elif name == ".clear":
            self.say("\x1b[2J\x1b[H")
        else:
            self.say(f"unknown command or argument: {' '.join(words)}; .help lists them")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("tesserine")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *given: str, **options):
        c = sub.add_parser(name)
        c.add_argument("root")
        for g in given:
            c.add_argument(g.rstrip("?"), nargs="?" if g.endswith("?") else None)
        c.add_argument("--format", choices=FORMATS, default="table")
        c.add_argument("--rows", type=int, default=ROWS)
        for o, d in options.items():
            c.add_argument(f"--{o}", default=d)
        return c

    for name in ("create", "info", "compact", "check", "labels", "types", "schema", "count", "repl"):
        add(name)
    add("query", "statement", params=None)
    add("exec", "file")
    add("import", "path", "edges?")
    add("export", "path", kind="json", labels=None)
    add("dump", "path")
    sub.add_parser("version")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None, lines=None) -> int:
    """Runs one command; 0 if it went well, 1 if not."""
    argv = list(sys.argv[1:] if argv is None else argv)
    if len(argv) == 1 and argv[0] not in ("version", "-h", "--help"):
        argv.insert(0, "repl")
    a = parser().parse_args(argv)
    say = lambda text: print(text, file=out or sys.stdout)
    if a.command == "version":
        say(VERSION)
        return 0
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        db = Database.open(spark, a.root, create=a.command in ("create", "import", "repl"))
        if a.command == "query":
            say(rendered(db.query(a.statement, json.loads(a.params) if a.params else None), a.format, a.rows))
        elif a.command == "exec":
            text = "\n".join(r[0] for r in spark.read.text(a.file, wholetext=True).collect())  # a script
            for statement in filter(str.strip, text.split(";\n")):
                say(rendered(db.query(statement.strip().removesuffix(";")), a.format, a.rows))
        elif a.command == "import":
            load(db, a.path, a.edges)
            say(listing(db, "count"))
        elif a.command in ("export", "dump"):
            EXPORTS[a.kind if a.command == "export" else "json"](db.graph, a.path, a.labels if a.command == "export" else None)
        elif a.command == "compact":
            say(f"removed: {db.compact()}")
        elif a.command == "check":
            found = db.check()
            say("\n".join(found) or "ok")
            return int(bool(found))
        elif a.command == "repl":
            Shell(db, a.format, out).run(sys.stdin if lines is None else lines)
        elif a.command != "create":
            say(shown(listing(db, a.command), a.format, a.rows))
    except (QueryError, TransactionError, FileNotFoundError, ValueError, KeyError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0
