"""Command line: ``python -m quireforge.cli [--root DIR] [--json] COMMAND ...``."""

from __future__ import annotations

import argparse
import json
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quireforge")
    p.add_argument("--root", default=".")
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init").add_argument("--pack", default="generic")
    c = sub.add_parser("ingest")
    c.add_argument("folder", nargs="?")
    c.add_argument("--force", action="store_true")
    c.add_argument("--ocr", choices=["auto", "never", "always"])
    sub.add_parser("index").add_argument("--pack")
    c = sub.add_parser("explore")
    c.add_argument("query")
    c.add_argument("--budget", type=int, default=8000)
    c.add_argument("--hops", type=int, default=2)
    c.add_argument("--kind")
    sub.add_parser("get").add_argument("entity")
    c = sub.add_parser("page")
    c.add_argument("doc")
    c.add_argument("n", type=int)
    c = sub.add_parser("compile")
    c.add_argument("--out")
    c.add_argument("--min-centrality", type=float, default=0.0)
    sub.add_parser("lint")
    sub.add_parser("stats")
    return p


def main(args: list[str] | None = None, spark=None) -> int:
    from .engine import Engine
    from .session import local_session

    a = parser().parse_args(args)
    spark = spark or local_session()
    if a.command == "init":
        Engine.init(spark, a.root, a.pack)
        return 0
    e = Engine(spark, a.root)
    try:
        out = {
            "ingest": lambda: e.ingest(a.folder, a.force, a.ocr), "index": lambda: e.index(a.pack), "explore": lambda: e.explore_text(a.query, a.json, budget=a.budget, hops=a.hops, kind=a.kind),
            "get": lambda: e.get(a.entity, a.json), "page": lambda: e.page(a.doc, a.n), "compile": lambda: e.compile(a.out, a.min_centrality), "lint": lambda: e.lint(a.json), "stats": lambda: e.stats(),
        }[a.command]()
    except KeyError as x:
        print(f"not found: {x.args[0]}", file=sys.stderr)
        return 1
    print(out if isinstance(out, str) else json.dumps(out))
    return 0


if __name__ == "__main__":
    sys.exit(main())
