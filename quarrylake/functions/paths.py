"""Column functions over paths: language, tests, globs, modules, import keys and names."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions, base names and directories with a meaning of their own.
EXTENSIONS = {
    "python": "py pyi pyw", "javascript": "js mjs cjs", "jsx": "jsx", "typescript": "ts mts cts", "tsx": "tsx", "go": "go", "rust": "rs", "java": "java", "kotlin": "kt kts", "c": "c h",
    "cpp": "cc cpp cxx hpp hh hxx", "csharp": "cs", "ruby": "rb", "php": "php", "swift": "swift", "scala": "scala sc", "shell": "sh bash zsh",
    "markdown": "md markdown mdx", "json": "json jsonl", "yaml": "yaml yml", "toml": "toml", "ini": "ini cfg", "xml": "xml", "html": "html htm", "css": "css scss", "sql": "sql",
    "text": "txt rst csv tsv", "proto": "proto", "graphql": "graphql gql", "dockerfile": "dockerfile", "makefile": "makefile",
}
BASENAMES = {"dockerfile": "dockerfile", "makefile": "makefile", "cmakelists.txt": "cmake", "go.mod": "gomod", "cargo.toml": "toml", "package.json": "json"}
CODE_LANGUAGES = "python javascript jsx typescript tsx go rust java kotlin c cpp csharp ruby php swift scala shell".split()
TEST_DIRS = "test tests spec specs __tests__ testing".split()
TEST_BASE = r"^test[_-]|[_.-](test|spec)\."
PRUNED_DIRS = (
    ".git .hg .svn node_modules .venv venv env __pycache__ .mypy_cache .pytest_cache .ruff_cache .tox dist build target "
    ".next .nuxt .cache .gradle vendor .idea .vscode coverage .terraform .serena .codegraph"
).split()
ENTRY_POINTS = "main.py __main__.py cli.py app.py server.py index.ts index.js main.ts main.go main.rs manage.py wsgi.py asgi.py".split()
DOCUMENT_EXTENSIONS = "md mdx rst".split()
DOC_DIRS = "doc docs".split()
DECISION_WORDS = "adr /spec/ proposal decision /rfc realignment architecture vision".split()
KEY_EXTENSIONS = "py pyi ts tsx js jsx mjs cjs go rs java kt rb".split()
KEY_SKIPS = "__init__ mod index".split()
NEIGHBOUR_EXTENSIONS = "py pyi ts tsx js jsx go rs java".split()
PROBES = ".ts .tsx .js .jsx /index.ts /index.js .py /__init__.py .go .rs".split()


def base_name(path: Column) -> Column:
    """The last segment."""
    return F.element_at(F.split(path, "/"), -1)


def directories(path: Column) -> Column:
    """All segments but the last."""
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def language(path: Column) -> Column:
    """The language of a file by its base name, then by its extension; text if neither is known."""
    base = F.lower(base_name(path))
    by_name = F.create_map(*(F.lit(x) for kv in BASENAMES.items() for x in kv))
    by_ext = F.create_map(*(F.lit(x) for lang, exts in EXTENSIONS.items() for ext in exts.split() for x in (ext, lang)))
    dotted = F.when(base.contains("."), F.try_element_at(by_ext, F.element_at(F.split(base, r"\."), -1)))
    return F.coalesce(F.try_element_at(by_name, base), dotted, F.lit("text"))


def is_code(lang: Column) -> Column:
    """True for languages that have symbols."""
    return lang.isin(CODE_LANGUAGES)


def is_test(path: Column) -> Column:
    """True for files in test directories or named like tests."""
    low = F.lower(path)
    return F.arrays_overlap(directories(low), F.array(*map(F.lit, TEST_DIRS))) | base_name(low).rlike(TEST_BASE)


def asks_for_tests(query: Column) -> Column:
    """True if a query is about tests itself."""
    words = F.split(F.translate(F.lower(query), "-_", "  "), r"\s+")
    return F.arrays_overlap(words, F.array(*map(F.lit, ("test", "tests", "spec", "specs", "testing"))))


def is_readme(path: Column) -> Column:
    """True for files named readme, in any case, with an extension of letters or none."""
    parts = F.split(F.lower(base_name(path)), r"\.")
    return (parts[0] == "readme") & ((F.size(parts) == 1) | ((F.size(parts) == 2) & F.get(parts, F.lit(1)).rlike("^[a-z]+$")))


def is_document(path: Column) -> Column:
    """True for files of prose by their extension."""
    return F.lower(path).rlike(r"\.(" + "|".join(DOCUMENT_EXTENSIONS) + ")$")


def in_docs(path: Column) -> Column:
    """True for files below a documentation directory at the top."""
    return path.contains("/") & F.lower(F.substring_index(path, "/", 1)).isin(DOC_DIRS)


def tells_decisions(path: Column) -> Column:
    """True for paths with a word that decisions about a design go by."""
    low = F.lower(path)
    return reduce(or_, (F.contains(low, F.lit(w)) for w in DECISION_WORDS))


def is_pruned(path: Column) -> Column:
    """True for files in vendored or generated directories."""
    return F.arrays_overlap(directories(path), F.array(*map(F.lit, PRUNED_DIRS)))


def matches_glob(path: Column, glob: str) -> Column:
    """Shell-style matching in which a star also crosses slashes."""
    if re.fullmatch(r"[^*?\[]*\*+", glob):
        return path.startswith(glob.rstrip("*"))
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        end = glob.find("]", k + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            inside = glob[k + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += "[" + ("^" + inside[1:] if inside[0] == "!" else "\\^" + inside[1:] if inside[0] == "^" else inside) + "]"
            k = end
        else:
            out += re.escape(c)
        k += 1
    return path.rlike(f"(?s)^(?:{out})\\z")


def module(path: Column) -> Column:
    """The first directory, or (root) for files without one."""
    return F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise(F.lit("(root)"))


def _bare(path: Column, extensions: list[str]) -> Column:
    return F.regexp_replace(path, r"\.(" + "|".join(extensions) + r")$", "")


def index_keys(path: Column) -> Column:
    """Import keys under which a file is known: dotted, with slashes, bare path, and dotted endings of two segments or more.

    A single name is a key only of a file at the top, so common names of deep
    files are not taken for them.
    """
    bare = _bare(path, KEY_EXTENSIONS)
    parts = F.filter(F.split(bare, "/"), lambda s: (s != "") & ~s.isin(KEY_SKIPS))
    n = F.size(parts)
    endings = F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.array_join(F.slice(parts, k, n), "."))).otherwise(F.array().cast("array<string>"))
    keys = F.array_distinct(F.concat(F.array(F.array_join(parts, "."), F.array_join(parts, "/"), bare), endings))
    return F.when(n > 0, F.filter(keys, lambda k: k != "")).otherwise(F.array().cast("array<string>"))


def neighbour_keys(path: Column) -> Column:
    """Import tokens that may mean a file, its bare name among them."""
    bare = _bare(path, NEIGHBOUR_EXTENSIONS)
    parts = F.filter(F.split(bare, "/"), lambda s: (s != "") & (s != "__init__"))
    n = F.size(parts)
    endings = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.array_join(F.slice(parts, k, F.greatest(n, F.lit(1))), "."))
    keys = F.array_distinct(F.concat(F.array(F.array_join(parts, "/"), bare), endings))
    return F.when(n > 0, F.filter(keys, lambda k: k != "")).otherwise(F.array().cast("array<string>"))


def import_candidates(token: Column, source: Column) -> Column:
    """What an import token of a file may mean, best first: structs of the kind (key or path) and the value."""
    t = F.trim(token)
    as_key = lambda v: F.struct(F.lit("key").alias("kind"), v.alias("value"))
    as_path = lambda v: F.struct(F.lit("path").alias("kind"), v.alias("value"))
    plain = F.replace(F.replace(t, F.lit("::"), F.lit(".")), F.lit("/"), F.lit("."))
    absolute = F.array(as_key(t), as_key(plain), as_key(F.substring_index(plain, ".", 1)), as_key(F.substring_index(plain, ".", -1)))
    dots = F.length(F.regexp_extract(t, r"^(\.+)", 1))
    rest = F.trim(F.replace(F.regexp_replace(F.regexp_replace(t, r"^\.+", ""), "^/+|/+$", ""), F.lit("."), F.lit("/")))
    base = directories(source)
    kept = F.slice(base, 1, F.greatest(F.size(base) - F.greatest(dots - 1, F.lit(0)), F.lit(0)))
    relative = F.regexp_replace(F.concat_ws("/", F.array_join(kept, "/"), F.when(rest != "", rest)), "^/+|/+$", "")
    near = F.array(as_key(relative), as_key(F.replace(relative, F.lit("/"), F.lit("."))), *(as_path(F.concat(relative, F.lit(x))) for x in PROBES))
    none = F.array().cast("array<struct<kind:string,value:string>>")
    return F.when(t == "", none).when(~t.startswith("."), absolute).when(relative == "", none).otherwise(near)


def slug(raw: Column) -> Column:
    """A safe name: lower case, other characters as single hyphens, no marks at its ends, at most 100 characters; null if nothing is left."""
    made = F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.trim(raw)), r"[^a-z0-9._-]+", "-"), r"^[._-]+|[._-]+$", ""), 1, 100), r"^[._-]+|[._-]+$", "")
    return F.when(made != "", made)
