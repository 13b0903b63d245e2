"""Corpora as tools over JSON-RPC lines on standard input and output."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import Any

from quarrylake import __version__
from quarrylake.plans.corpus import NotFound, Store

PROTOCOL = "2024-11-05"
TEXT, NUMBER, FLAG = {"type": "string"}, {"type": "integer"}, {"type": "boolean"}
#: Tools with their arguments; those named first are required. Defaults are fixed values.
TOOLS: dict[str, tuple[str, dict[str, dict], list[str]]] = {
    "list": ("All corpora", {}, []),
    "map": ("A summary within a budget of tokens", {"corpus": TEXT, "level": NUMBER, "budget": NUMBER, "glob": TEXT}, ["corpus"]),
    "modules": ("Modules with files, languages and dependents", {"corpus": TEXT}, ["corpus"]),
    "search": ("Ranked results for a query", {"corpus": TEXT, "query": TEXT, "k": NUMBER, "mode": TEXT, "diversify": FLAG}, ["corpus", "query"]),
    "read": ("Lines of a file or a symbol's body", {"corpus": TEXT, "target": TEXT, "start": NUMBER, "end": NUMBER}, ["corpus", "target"]),
    "neighbors": ("Imports, importers and definitions", {"corpus": TEXT, "target": TEXT, "limit": NUMBER}, ["corpus", "target"]),
    "history": ("Commits of a source or a file", {"corpus": TEXT, "target": TEXT, "limit": NUMBER}, ["corpus"]),
    "verify": ("Integrity and completeness", {"corpus": TEXT}, ["corpus"]),
}


class Server:
    """Answers one message at a time; a list of messages gives a list of answers."""

    def __init__(self, store: Store) -> None:
        self.store = store

    def call(self, name: str, given: dict[str, Any]) -> Any:
        """The result of a tool."""
        if name == "list":
            return self.store.list()
        corpus = self.store.open(given["corpus"])
        rest = {k: v for k, v in given.items() if k != "corpus"}
        rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
        return {
            "map": lambda: corpus.map(**rest), "modules": lambda: rows(corpus.modules()), "search": lambda: rows(corpus.search(**rest)), "read": lambda: corpus.read(**rest),
            "neighbors": lambda: corpus.neighbors(**rest), "history": lambda: rows(corpus.history(**rest)), "verify": corpus.verify,
        }[name]()

    def answer(self, message: Any) -> Any:
        """The answer to a message, or None for a notification."""
        if isinstance(message, list):
            return [a for a in map(self.answer, message) if a is not None] or None
        method, number = message.get("method"), message.get("id")
        known: dict[str, Callable[[], Any]] = {
            "initialize": lambda: {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "quarrylake", "version": __version__}},
            "ping": dict,
            "tools/list": lambda: {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (d, p, r) in TOOLS.items()]},
            "tools/call": lambda: self._tool(message.get("params") or {}),
        }
        if number is None:
            return None
        if method not in known:
            return {"jsonrpc": "2.0", "id": number, "error": {"code": -32601, "message": f"unknown method {method}"}}
        return {"jsonrpc": "2.0", "id": number, "result": known[method]()}

    def _tool(self, params: dict[str, Any]) -> dict[str, Any]:
        name, given = params.get("name"), params.get("arguments") or {}
        try:
            if name not in TOOLS:
                raise NotFound(f"tool {name}")
            told, failed = self.call(name, given), False
        except (LookupError, ValueError, TypeError, OSError) as error:
            told, failed = f"{type(error).__name__}: {error}", True
        body = told if isinstance(told, str) else json.dumps(told, default=str)
        return {"content": [{"type": "text", "text": body}], "isError": failed}

    def run(self, lines=None, out=None) -> None:
        """Answer each line until they end."""
        for line in lines or sys.stdin:
            if not line.strip():
                continue
            try:
                told = self.answer(json.loads(line))
            except ValueError:
                told = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
            if told is not None:
                print(json.dumps(told), file=out or sys.stdout, flush=True)
