"""Commands over corpora: python -m quarrylake --home FOLDER COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys


def parser() -> argparse.ArgumentParser:
    """The commands and their options."""
    top = argparse.ArgumentParser(prog="quarrylake", description=__doc__)
    top.add_argument("--home", default="quarrylake-home")
    commands = top.add_subparsers(dest="command", required=True)
    add = commands.add_parser("add", help="take a folder, a packed dump or a git address in")
    add.add_argument("source")
    add.add_argument("--name")
    add.add_argument("--no-semantic", action="store_true")
    add.add_argument("--max-bytes", type=int, default=2_000_000)
    add.add_argument("--binary", action="store_true")
    commands.add_parser("list", help="all corpora")
    commands.add_parser("serve", help="answer tool calls on standard input")
    for name, extra in (("map", ()), ("modules", ()), ("search", ("query",)), ("read", ("target",)), ("neighbors", ("target",)), ("history", ()), ("verify", ()), ("remove", ())):
        one = commands.add_parser(name)
        one.add_argument("corpus")
        for x in extra:
            one.add_argument(x)
        if name == "map":
            one.add_argument("--level", type=int, default=0)
            one.add_argument("--budget", type=int, default=25_000)
            one.add_argument("--glob")
        if name == "search":
            one.add_argument("-k", type=int, default=10)
            one.add_argument("--mode", default="auto")
            one.add_argument("--diversify", action="store_true")
        if name == "read":
            one.add_argument("--start", type=int)
            one.add_argument("--end", type=int)
        if name == "history":
            one.add_argument("target", nargs="?")
            one.add_argument("--limit", type=int, default=25)
    return top


def main(args: list[str] | None = None) -> int:
    """Run one command and print its result."""
    from pyspark.sql import SparkSession

    from quarrylake.plans.corpus import Store

    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("quarrylake").getOrCreate()
    store = Store(spark, a.home)
    rows = lambda df: [r.asDict() for r in df.collect()]
    if a.command == "add":
        told = store.add(a.source, a.name, not a.no_semantic, a.max_bytes, a.binary).meta
    elif a.command == "list":
        told = store.list()
    elif a.command == "serve":
        from quarrylake.plans.serve import Server

        Server(store).run()
        return 0
    elif a.command == "remove":
        told = {"removed": store.remove(a.corpus)}
    else:
        corpus = store.open(a.corpus)
        told = {
            "map": lambda: corpus.map(a.level, a.budget, a.glob), "modules": lambda: rows(corpus.modules()), "search": lambda: rows(corpus.search(a.query, a.k, a.mode, a.diversify)), "read": lambda: corpus.read(a.target, a.start, a.end),
            "neighbors": lambda: corpus.neighbors(a.target), "history": lambda: rows(corpus.history(a.target, a.limit)), "verify": corpus.verify,
        }[a.command]()
    print(told if isinstance(told, str) else json.dumps(told, indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
