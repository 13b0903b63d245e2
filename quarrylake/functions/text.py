"""Column functions over text: tokens, lines, chunks, snippets and clean-up."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the text rules.
CHARS_PER_TOKEN = 4
CHUNK_TOKENS, CHUNK_OVERLAP, CHUNK_LINES = 400, 10, 600
SNIPPET_LINES, SNIPPET_CHARS = 16, 1000
DOC_CHARS, SIGNATURE_CHARS = 240, 200
#: A letter that is not folded in spite of its decomposition.
UNFOLDED = "ǡ"
#: Most characters are ASCII, so these are looked for first; a text of ASCII alone has no others.
TERM, ASCII_TERM = r"[a-z0-9\p{L}\p{N}\p{Co}]+", "[a-z0-9]+"


def token_estimate(text: Column) -> Column:
    """A quarter of the code points, rounded up; none for the empty text."""
    return F.ceil(F.char_length(text) / CHARS_PER_TOKEN).cast("int")


def lines(text: Column) -> Column:
    """The lines of a text, cut at line feeds alone."""
    return F.split(text, "\n", -1)


def line_count(text: Column) -> Column:
    """Lines of a text; none for the empty text."""
    return F.when(F.length(text) == 0, 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)


def line_slice(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end, counted from one; both are moved into the text, and the end to the start if it lies before."""
    whole = lines(text)
    first = F.least(F.greatest(start, F.lit(1)), F.greatest(F.size(whole), F.lit(1)))
    last = F.greatest(first, F.least(end, F.size(whole)))
    return F.array_join(F.slice(whole, first, last - first + 1), "\n")


def snippet(text: Column) -> Column:
    """The first lines, cut to a number of characters with an ellipsis."""
    head = F.array_join(F.slice(lines(text), 1, SNIPPET_LINES), "\n")
    cut = F.regexp_replace(F.substring(head, 1, SNIPPET_CHARS), r"\s+$", "")
    return F.when(F.char_length(head) > SNIPPET_CHARS, F.concat(cut, F.lit("…"))).otherwise(head)


def clip_doc(doc: Column) -> Column:
    """A docstring on one line, cut with an ellipsis; null if nothing is left."""
    flat = F.trim(F.regexp_replace(doc, r"(?U)\s+", " "))
    cut = F.when(F.char_length(flat) > DOC_CHARS, F.concat(F.rtrim(F.substring(flat, 1, DOC_CHARS - 1)), F.lit("…"))).otherwise(flat)
    return F.when(F.char_length(flat) > 0, cut)


@cache
def folding() -> tuple[str, str]:
    """Accented Latin letters and what they are folded to, made from their canonical decompositions; last, with nothing to fold to, the marks in these."""
    found, marks = {}, set()
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(code).lower())
        if len(parts) > 1 and parts[0].isascii() and parts[0].isalpha() and len(chr(code).lower()) == 1 and chr(code).lower() != UNFOLDED:
            found[chr(code).lower()] = parts[0]
            marks |= set(parts[1:])
    for code in range(0x80, 0x2000):  # letters that stand for another, such as a final sigma
        low = chr(code).lower()
        other = low.casefold()
        if len(low) == len(other) == 1 and other != low:
            found[low] = found.get(other, other)
    return "".join(found) + "".join(sorted(marks)), "".join(found.values())


def terms(text: Column) -> Column:
    """The terms of a text in order: runs of letters and digits, in lower case, without accents on Latin letters, composed or not."""
    low = F.lower(text)
    plain = F.octet_length(low) == F.char_length(low)  # nothing to fold; folding looks every character up
    found = lambda s, term: F.regexp_extract_all(s, F.lit(term), F.lit(0))
    return F.when(plain, found(low, ASCII_TERM)).otherwise(found(F.translate(low, *folding()), TERM))


def phrases(query: str) -> list[list[str]]:
    """A query's phrases: one per word between white space, each a list of terms; words without terms are dropped.

    Every phrase must occur for a row to match.
    """
    import regex

    source, target = folding()
    table = str.maketrans(source[: len(target)], target, source[len(target) :])
    found = [regex.findall(TERM, word.lower().translate(table)) for word in query.replace("\n", " ").split(" ")]
    return [p for p in found if p]


def word_set(text: Column) -> Column:
    """The distinct ASCII words of two characters or more, in lower case."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) > 1))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


#: Words too common to tell one query from another; fixed values.
STOP_WORDS = (
    "the a an of to and or is are be from for in on how what so it that with while keep can "
    "right kind piece number many were was this"
).split()


def content_words(text: Column) -> Column:
    """Ordered distinct words of three letters or more that are not too common."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z_]{3,}"), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, STOP_WORDS)))


def stripped(value: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def strip_markdown_noise(text: Column) -> Column:
    """Without lines that start with markup or badges, and without runs of blank lines."""
    keep = F.filter(lines(text), lambda x: ~F.ltrim(x).rlike(r"^(<|!\[|\[!\[)"))
    return stripped(F.regexp_replace(F.array_join(keep, "\n"), r"\n{3,}", "\n\n"))


def first_paragraph(text: Column, most: int = 200) -> Column:
    """The first paragraph that is neither empty nor an image, without heading marks, cut to a length."""
    paragraphs = F.transform(F.split(strip_markdown_noise(text), "\n\n", -1), lambda p: stripped(F.regexp_replace(stripped(p), r"^#+", "")))
    return F.substring(F.get(F.filter(paragraphs, lambda p: (F.length(p) > 0) & ~p.startswith("!")), 0), 1, most)


def embed_text(kind: Column, name: Column, signature: Column, doc: Column) -> Column:
    """What of a symbol is embedded: its kind, name and signature, then its docstring."""
    filled = lambda c: F.when(F.length(c) > 0, c)
    head = F.concat_ws(" ", filled(kind), filled(name), filled(signature))
    return F.when(F.length(F.coalesce(doc, F.lit(""))) > 0, F.concat(head, F.lit(": "), doc)).otherwise(head)


#: The mark of a stripped body and the form of a numbered line in packed dumps; fixed values.
STRIPPED_MARK = "⋮"
NUMBERED = r"^\s*\d+[:|]\s?"
NUMBERED_SHARE = 0.6


def clean_dump_text(text: Column) -> Column:
    """A packed file's text without marks of stripped bodies, and without line numbers where most lines carry one."""
    given = lines(text)
    filled = F.filter(given, lambda x: F.trim(x) != "")
    numbered = F.size(F.filter(filled, lambda x: x.rlike(NUMBERED))) >= NUMBERED_SHARE * F.size(filled)
    kept = F.filter(given, lambda x: ~F.ltrim(x).startswith(STRIPPED_MARK))
    bare = F.transform(kept, lambda x: F.regexp_replace(x, NUMBERED, ""))
    return F.array_join(F.when((F.size(filled) > 0) & numbered, bare).otherwise(kept), "\n")
