"""Declarations and imports of source lines, found by a scanner that takes words apart.

A line is read word by word: words that only modify a declaration are passed
over, a keyword tells the kind, and the name follows by the rules of the
language's grammar. What languages differ in is data: their keywords, their
modifiers and how names are written. Forms without a keyword (methods behind an
access modifier, function definitions of C, arrow functions, constants) have a
reader of their own.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

WORD = re.compile(r"\s*([^\W\d][\w$]*|\$[\w$]*)")
#: The kinds of symbols; fixed values.
CLASS, FUNCTION, METHOD, CONST, TYPE, STRUCT, ENUM, INTERFACE = "class", "function", "method", "const", "type", "struct", "enum", "interface"


@dataclass(frozen=True)
class Grammar:
    """What tells the declarations of a language."""

    #: Keyword -> kind.
    kinds: dict[str, str]
    #: Words that may stand before the keyword.
    modifiers: frozenset[str] = frozenset()
    #: Readers of forms without a keyword, tried first or last.
    first: tuple[Callable[[str, Grammar], tuple[str, str] | None], ...] = ()
    last: tuple[Callable[[str, Grammar], tuple[str, str] | None], ...] = ()
    #: Access modifiers, one of which a method has.
    access: frozenset[str] = frozenset()
    #: Keywords whose names may hold other characters, and those whose names begin with a capital.
    names: dict[str, str] = field(default_factory=dict)
    capital: frozenset[str] = frozenset()
    #: Keywords whose name must have a parameter list.
    called: frozenset[str] = frozenset()


def word_at(line: str, at: int) -> tuple[str, int]:
    """The word that begins at a place or after white space there, and where it ends; an empty word if there is none."""
    found = WORD.match(line, at)
    return (found[1], found.end()) if found else ("", at)


def past_brackets(line: str, at: int, opening: str, closing: str) -> int:
    """The place after a bracketed part that begins at a place or after white space there; the same place if none does."""
    start = at + len(line[at:]) - len(line[at:].lstrip())
    if line[start : start + 1] != opening:
        return at
    depth = 0
    for k in range(start, len(line)):
        depth += (line[k] == opening) - (line[k] == closing)
        if not depth:
            return k + 1
    return len(line)


def follows(line: str, at: int) -> str:
    """What comes next, white space apart."""
    return line[at:].lstrip()


def name_at(line: str, at: int, extra: str = "") -> tuple[str, int]:
    """A name, and where it ends; characters of ``extra`` may go on in it."""
    name, end = word_at(line, at)
    while name and end < len(line) and (line[end] in extra or line[end].isalnum() or line[end] == "_"):
        name += line[end]
        end += 1
    return name, end


def by_keyword(line: str, grammar: Grammar) -> tuple[str, str] | None:
    """A declaration that a keyword tells, behind any modifiers."""
    at = 0
    while True:
        word, end = word_at(line, at)
        if word == "template":
            at = past_brackets(line, end, "<", ">")
        elif word in grammar.modifiers and not (word in grammar.kinds and word_at(line, end)[0] not in grammar.kinds):
            at = past_brackets(line, end, "(", ")")
        else:
            break
    kind = grammar.kinds.get(word)
    if kind is None:
        return None
    if line[end : end + 1] in ("*", "!"):  # generators, macro definitions
        end += 1
    elif kind == FUNCTION and word == "func":
        end = past_brackets(line, end, "(", ")")  # a receiver
    if word in ("fun", "impl"):
        end = past_brackets(line, end, "<", ">")
    if line[end : end + 1] not in (" ", "\t") and line[end - 1 : end] not in (")", ">", "*"):
        return None
    name, end = name_at(line, end, grammar.names.get(word, ""))
    if not name or (word in grammar.capital and not name[0].isupper()):
        return None
    if word in grammar.called and not follows(line, end).startswith("("):
        return None
    return kind, name


def by_access(line: str, grammar: Grammar) -> tuple[str, str] | None:
    """A method: an access modifier, other modifiers, a type, a name and a parameter list."""
    word, at = word_at(line, 0)
    if word not in grammar.access:
        return None
    while True:
        word, end = word_at(line, at)
        if word not in grammar.modifiers and word not in grammar.access:
            break
        at = end
    while True:  # the type, with its parts and brackets
        before = end
        end = past_brackets(line, past_brackets(line, end, "<", ">"), "[", "]")
        if line[end : end + 1] == ".":
            end = word_at(line, end + 1)[1]
        if end == before:
            break
    name, after = word_at(line, end)
    return (METHOD, name) if word and word not in grammar.kinds and name and line[end : end + 1].isspace() and follows(line, after).startswith("(") else None


def by_call_form(line: str, grammar: Grammar) -> tuple[str, str] | None:
    """A function definition of C: at the start of a line a type, a name, parameters, and nothing but an opening brace after them."""
    if not line[:1].isalpha() and line[:1] != "_" or ";" in line:
        return None
    opening, closing = line.find("("), line.rfind(")")
    tail = line[closing + 1 :].split() if closing > opening > 0 else ["none"]
    if [t for t in tail if t not in ("const", "{", "const{")]:
        return None
    head = line[:opening].rstrip()
    name = re.search(r"[^\W\d]\w*$", head)
    kind_of = head[: name.start()] if name else ""
    if not kind_of.strip() or kind_of[-1] not in " \t" or any(not (c.isalnum() or c in "_ \t*:<>,&") for c in kind_of) or kind_of.split()[0] in ("return", "else"):
        return None
    return FUNCTION, name[0]


def by_arrow(line: str, grammar: Grammar) -> tuple[str, str] | None:
    """A variable that is given an arrow function, or an exported variable."""
    at, exported = 0, False
    while (found := word_at(line, at))[0] in ("export", "default", "declare"):
        exported, at = exported or found[0] == "export", found[1]
    word, at = found
    if word not in ("const", "let", "var"):
        return None
    name, at = word_at(line, at)
    given = line[at:].find("=")
    if name in grammar.kinds:
        return None
    if name and given >= 0 and "=>" in line[at:] and follows(line, at)[:1] in ("=", *(":" * ("interface" in grammar.kinds))):
        return FUNCTION, name
    return (CONST, name) if name and exported else None


def by_capitals(line: str, grammar: Grammar) -> tuple[str, str] | None:
    """A constant of Python: capitals at the start of a line that are given a value or a type."""
    name, end = word_at(line, 0) if line[:1].isupper() else ("", 0)
    return (CONST, name) if len(name) > 1 and name.isascii() and name == name.upper() and "$" not in name and follows(line, end)[:1] in ("=", ":") else None


def by_parentheses(line: str, grammar: Grammar) -> tuple[str, str] | None:
    """A function of a shell: a name, empty parentheses and a brace."""
    word, at = word_at(line, 0)
    if word == "function":
        word, at = word_at(line, at)
    return (FUNCTION, word) if word and re.match(r"\s*\(\)\s*\{", line[at:]) else None


def _kinds(told: str, **renamed: str) -> dict[str, str]:
    return {w: w for w in told.split()} | {v: k for k, vs in renamed.items() for v in vs.split()}


def _words(told: str) -> frozenset[str]:
    return frozenset(told.split())


_SCRIPT = _words("export default async")
_C_TYPES = _words("typedef static inline extern")
_GRAMMARS = {
    "python": Grammar(_kinds("class", function="def"), _words("async"), last=(by_capitals,)),
    "javascript": Grammar(_kinds("class function"), _SCRIPT, last=(by_arrow,)),
    "typescript": Grammar(_kinds("class interface enum type namespace function", namespace="module"), _SCRIPT | _words("declare abstract const"), first=(by_arrow,), names={"namespace": ".", "module": "."}),
    "go": Grammar(_kinds("type", function="func"), called=_words("func")),
    "rust": Grammar(_kinds("struct enum trait impl", function="fn", macro="macro_rules"), _words("pub async unsafe const extern"), names={"impl": ":<>, "}),
    "java": Grammar(_kinds("class interface enum record"), _words("export public private protected abstract final static synchronized sealed default"), last=(by_access,), access=_words("public private protected")),
    "kotlin": Grammar(_kinds("class interface object", function="fun"), _words("open abstract sealed data suspend public private internal override inline enum"), called=_words("fun")),
    "c": Grammar(_kinds("struct"), _C_TYPES, first=(by_call_form,)),
    "cpp": Grammar(_kinds("class struct"), _C_TYPES, last=(by_call_form,)),
    "csharp": Grammar(_kinds("class interface enum struct"), _words("export public private protected internal abstract final static virtual override async sealed partial readonly"), last=(by_access,), access=_words("public private protected internal")),
    "ruby": Grammar(_kinds("class module", function="def"), names={"def": "!?="}, capital=_words("class module")),
    "php": Grammar(_kinds("class interface function"), _words("abstract final public private protected static")),
    "swift": Grammar(_kinds("class struct protocol enum", function="func"), _words("public open final private static internal")),
    "scala": Grammar(_kinds("class object trait", function="def"), _words("abstract final sealed case override private")),
    "shell": Grammar({}, last=(by_parentheses,)),
    "generic": Grammar(_kinds("class struct interface function", function="func fn def"), _words("export public async")),
}
#: Languages that are read by the grammar of another.
_SAME = {"tsx": "typescript", "jsx": "javascript"}


def declaration(line: str, lang: str) -> tuple[str, str] | None:
    """(kind, name) of what a line declares, or None."""
    grammar = _GRAMMARS.get(_SAME.get(lang, lang), _GRAMMARS["generic"])
    for reader in (*grammar.first, by_keyword, *grammar.last):
        found = reader(line, grammar)
        if found:
            return found
    return None


def quoted_at(text: str) -> str | None:
    """What stands in quotes at the beginning of a text, if it is not empty."""
    text = text.lstrip()
    end = text.find(text[0], 1) if text[:1] in ("'", '"') else -1
    return text[1:end] if end > 1 else None


def dotted_at(text: str, signs: str) -> str | None:
    """A name with signs in it at the beginning of a text."""
    text = text.lstrip()
    end = next((k for k, c in enumerate(text) if not (c.isalnum() or c == "_" or c in signs)), len(text))
    return text[:end] or None


def _after(line: str, *words: str, optional: str = "") -> str | None:
    """What follows the words, in this order, at the beginning of a line; None if they are not there."""
    at = 0
    for wanted in words:
        word, end = word_at(line, at)
        if word != wanted or not line[end : end + 1].isspace():
            return None
        at = end
    word, end = word_at(line, at)
    return line[end:] if optional and word == optional and line[end : end + 1].isspace() else line[at:]


def imports(line: str, lang: str) -> list[str]:
    """What a line imports, as it is written there."""
    lang = {"cpp": "c", "typescript": "javascript", "tsx": "javascript", "jsx": "javascript"}.get(lang, lang)
    found: list[str | None] = []
    if lang == "python":
        told = _after(line, "from")
        if told is not None:
            name = dotted_at(told, ".")
            rest = told.lstrip()[len(name or "") :].split()
            found.append(name if rest[:1] == ["import"] else None)
        elif (told := _after(line, "import")) is not None:
            found.append(dotted_at(told, "."))
    elif lang == "javascript":
        at = line.find("import")
        if at >= 0 and line[at + 6 : at + 7].isspace():
            found += [quoted_at(part) for part in line[at:].split("from")[1:] if part[:1].isspace()][:1]
        found += [quoted_at(part.lstrip()[1:]) for part in line.split("require")[1:] if part.startswith("(")][:1]
    elif lang == "go":
        word, end = word_at(line, 0)
        found.append(quoted_at(line[end:]) if word and line[end : end + 1].isspace() else quoted_at(line))
    elif lang == "c":
        told = line.lstrip()
        rest = told[1:].lstrip() if told.startswith("#") else ""
        part = rest.removeprefix("include").lstrip() if rest.startswith("include") else ""
        end = part.find({"<": ">", '"': '"'}.get(part[:1], "\0"), 1)
        found.append(part[1:end] if end > 1 else None)
    elif lang == "ruby":
        found += [quoted_at(told) for w in ("require", "require_relative") if (told := _after(line, w)) is not None]
    else:
        keyword, signs, optional = {"rust": ("use", ":", ""), "java": ("import", ".", "static"), "csharp": ("using", ".", "static"), "php": ("use", "\\", ""), "swift": ("import", ".", ""), "scala": ("import", ".", "")}.get(lang, ("", "", ""))
        told = _after(line, keyword, optional=optional) if keyword else None
        found.append(dotted_at(told, signs) if told is not None else None)
    return [m for m in found if m]
