"""Outliners as table functions of SQL: the engine's own, or one that a user brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from quarrylake.operators import outline

SYMBOLS = "kind string, name string, signature string, parent string, start_line int, end_line int, docstring string"
#: A path, a text and a language in; symbols (in the order of SYMBOLS) and imports out.
Outliner = Callable[[str, str, str], tuple[list[tuple], list[str]]]


def register(spark: SparkSession, name: str = "outline", outliner: Outliner = outline.outline) -> None:
    """Make ``name(path, text, lang)`` a table function that gives a file's symbols, and ``name_imports`` one that gives its imports.

    In SQL: SELECT f.path, s.* FROM files f, LATERAL outline(f.path, f.text, f.lang) s.
    A null text or language has no symbols.
    """

    class Symbols:
        def eval(self, path: str, text: str, lang: str) -> Iterator[tuple]:
            yield from outliner(path, text, lang)[0] if text is not None and lang is not None else ()

    class Imports:
        def eval(self, path: str, text: str, lang: str) -> Iterator[tuple]:
            yield from ((token,) for token in outliner(path, text, lang)[1]) if text is not None and lang is not None else ()

    spark.udtf.register(name, udtf(Symbols, returnType=SYMBOLS))
    spark.udtf.register(f"{name}_imports", udtf(Imports, returnType="token string"))
