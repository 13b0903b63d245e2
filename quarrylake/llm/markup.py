"""A small reader of HTML: block elements as nodes, and the runs of text between their borders as blocks."""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^<>]*(?:>|\Z)|([^<]+)|(<)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)|(\bhidden\b)")
NAMING = re.compile(r"[a-z]+")

# Fixed values of HTML.
BLOCKS = frozenset(
    "html head body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What is between their tags is no markup, or is not shown.
RAW = frozenset("script style iframe noembed noframes noscript template textarea title xmp".split())
#: An opening tag ends open ones of the first set, unless one of the second lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
NOT_SHOWN = frozenset("object svg canvas audio video map button datalist".split())


class Node(NamedTuple):
    """A block element: its parent's number, tag, label (tag, classes and id without digits), words of class, id and role, and whether it is hidden."""

    parent: int
    tag: str
    label: str
    words: frozenset
    hidden: bool


class Block(NamedTuple):
    """A run of text: its node's number, the text, and the share of it inside links."""

    node: int
    text: str
    linked: float


_TAGS: dict[str, tuple[str, frozenset, bool]] = {}


def _naming(tag: str, rest: str) -> tuple[str, frozenset, bool]:
    """The label, naming words and hiddenness of a tag; those of short tags are kept."""
    if "=" not in rest and "hidden" not in rest:
        return tag, frozenset(), False
    key = f"{tag} {rest}" if len(rest) < 120 else ""
    found = _TAGS.get(key) if key else None
    if found is None:
        names, hidden = [], False
        for name, value, bare in ATTRIBUTE.findall(rest):
            value = value.strip("\"'")
            name = name.lower()
            if bare or name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                hidden = True
            elif name in ("class", "id", "role", "itemprop"):
                names += [f"{name}={part}" for part in sorted(unescape(value).lower().split())]
        words = frozenset(w for part in names for w in _words(part.partition("=")[2]))
        found = " ".join([tag, *(re.sub(r"\d+", "#", n) for n in names)]), words, hidden
        if key:
            if len(_TAGS) >= 5000:
                _TAGS.clear()
            _TAGS[key] = found
    return found


def _words(token: str) -> list[str]:
    """The words of one class, unless it tells what is not there."""
    words = NAMING.findall(token)
    return [] if words[:1] and words[0] in ("no", "has", "with", "without", "is", "hide") else [*words, "".join(words)]


def read(html: str) -> tuple[list[Node], list[Block]]:
    """All nodes, a parent before its children, and all blocks in page order; node 0 is the page.

    Start and end tags may be missing as HTML allows; comments, scripts and
    styles give nothing; white space in a block becomes one space.
    """
    nodes, blocks = [Node(-1, "#page", "#page", frozenset(), False)], []
    stack, tags, open_tags = [0], ["#page"], {}
    run: list[str] = []
    links, in_link, skipped, at = 0, False, None, 0

    def flush() -> None:
        nonlocal links, skipped
        if run:
            text = " ".join(unescape("".join(run)).split())
            if text:
                blocks.append(Block(stack[-1], text, min(1.0, links / len(text))))
            run.clear()
        links, skipped = 0, None

    def pop_to(depth: int) -> None:
        flush()
        while len(stack) > depth:
            stack.pop()
            open_tags[tags.pop()] -= 1

    while at < len(html):
        m = TOKEN.match(html, at)
        if m is None:
            at += 1
            continue
        at = m.end()
        text = m[4] or m[5]
        if text is not None:
            if skipped is None:
                run.append(text)
                if in_link:
                    links += len(text.strip())
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                in_link = False
            elif tag == skipped:
                skipped = None
            elif tag in BLOCKS and open_tags.get(tag):
                depth = len(tags) - 1
                while tags[depth] != tag:
                    depth -= 1
                if tag != "p" or depth == len(tags) - 1:
                    pop_to(depth)
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}", re.I).search(html, at)
            at = end.start() if end else len(html)
            continue
        if tag == "br":
            run.append(" ")
            continue
        if tag not in BLOCKS:
            if tag == "a":
                in_link = True
            if skipped is None and tag not in VOID and not m[3].endswith("/"):
                if tag in NOT_SHOWN:
                    skipped = tag
                elif "=" in m[3]:
                    _, words, hidden = _naming(tag, m[3])
                    if hidden or not words.isdisjoint(BOILERPLATE):
                        skipped = tag
            continue
        if open_tags.get("p") and tags[-1] == "p":
            pop_to(len(stack) - 1)
        if tag in ENDS:
            ended, border = ENDS[tag]
            depth = len(tags) - 1
            while depth and tags[depth] not in ended and tags[depth] not in border:
                depth -= 1
            if tags[depth] in ended:
                pop_to(depth)
        flush()
        if tag in VOID:
            continue
        nodes.append(Node(stack[-1], tag, *_naming(tag, m[3])))
        stack.append(len(nodes) - 1)
        tags.append(tag)
        open_tags[tag] = open_tags.get(tag, 0) + 1
    flush()
    return nodes, blocks


#: Words in class, id and role that name parts of a page that are not its article; fixed values.
BOILERPLATE = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar footer contentinfo masthead banner ad ads adv advert advertisement advertising adsbygoogle sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "comment comments disqus reply replies respond related recommended recommendations widget toolbar pagination pager skip skiplink copyright complementary search dialog".split()
)
