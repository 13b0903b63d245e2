"""Token ids of a byte-level BPE vocabulary file of the tokenizers library.

The vocabulary and merges of the file are given to tiktoken, whose encoder for
the same pattern is several times as fast. Of each Arrow batch the first text and
one in CHECK_EVERY after it are encoded by the tokenizers library too, and a
difference stops the job.

As in that library, the content of an added token stands for its own id, and
what lies between is encoded by itself. Texts of any length are encoded in
segments (:func:`segments`), so what is held at once does not grow with them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np

from quarrylake.llm import _common as C

DEFAULT_FILE = "byte_bpe_50k.json"
#: Characters of a segment that is encoded at once, about.
SEGMENT = 32_768
#: One text in so many of each Arrow batch is encoded by the tokenizers library too.
CHECK_EVERY = 64
#: The library is given so many characters at most; of longer texts each segment by itself.
CHECKED_CHARS = 200_000
#: The white space of every engine's pattern, and visible ASCII by class without the apostrophe.
WHITE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
LETTERS, DIGITS, SIGNS = "A-Za-z", "0-9", r"!-&(-/:-@\[-`{-~"
#: Runs of white space longer than this are one pre-token each, and are not given to the pattern's engine, which would run out of stack.
LONG_RUN = re.compile(f"[{WHITE}]{{2000,}}")
GAP = re.compile(r"(?<=[!-~\w])(?=[ \t\n\r])")
CHANGE = re.compile(f"(?<=[{LETTERS}])(?=[{DIGITS}{SIGNS}'])|(?<=[{DIGITS}])(?=[{LETTERS}{SIGNS}'])|(?<=[{SIGNS}])(?=[{LETTERS}{DIGITS}])")
#: White space nearer than so many times a segment's length is preferred to another cut.
PATIENCE = 4


def segments(text: str, length: int = SEGMENT, avoid: frozenset[str] = frozenset()) -> list[str]:
    """The text cut where every pre-token of it ends, each part at least ``length`` long but the last.

    No pre-token goes on from a visible character to white space, so cuts lie
    there; in a long run without white space they lie between ASCII letters,
    digits and signs (no pre-token holds two of these kinds but a contraction,
    which begins with an apostrophe), and not beside characters to ``avoid``.
    What precedes a cut does not depend on what follows it, nor the other way.
    A longer part without such a place stays whole.
    """
    out, begin = [], 0
    while len(text) - begin > length:
        near = GAP.search(text, begin + length, begin + PATIENCE * length)
        if near is None:
            near = next((m for m in CHANGE.finditer(text, begin + length) if text[m.start() - 1] not in avoid and text[m.start()] not in avoid), None)
            gap = GAP.search(text, begin + PATIENCE * length, near.start() if near else len(text))
            near = gap or near
        if near is None:
            break
        out.append(text[begin : near.start()])
        begin = near.start()
    out.append(text[begin:])
    return out


def _byte_letters() -> dict[str, int]:
    """The letter that such vocabularies write for each byte -> the byte: printable bytes stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str) -> None:
        C.single_threaded()
        import public_tokenizers
        import tiktoken

        self.path, self._library = path, None
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.added = {t["content"]: t["id"] for t in told.get("added_tokens", [])}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in told.get("added_tokens", [])):
            raise ValueError("added tokens that take in what is beside them are not supported")
        self.split = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.avoid = frozenset("".join(self.added))
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in told["model"]["vocab"].items() if token not in self.added}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @property
    def library(self):
        """The tokenizers library's own encoder, loaded where it is asked for."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def whole(self, text: str) -> bytes:
        """Ids by the tokenizers library."""
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, part: str) -> Iterator[list[int]]:
        """Ids of a part without added tokens; a long run of white space is a pre-token but for its last character, if text follows."""
        begin = 0
        for run in LONG_RUN.finditer(part):
            end = run.end() - (run.end() < len(part))
            yield self.fast.encode_ordinary(part[begin : run.start()])
            yield self.fast._encode_single_piece(part[run.start() : end])
            begin = end
        yield self.fast.encode_ordinary(part[begin:])

    def parts(self, text: str) -> Iterator[list[int]]:
        """Ids of a text, segment by segment."""
        begin = 0
        for token in self.split.finditer(text) if self.split else ():
            for segment in segments(text[begin : token.start()], avoid=self.avoid):
                yield from self._plain(segment)
            yield [self.added[token[0]]]
            begin = token.end()
        for segment in segments(text[begin:] if begin else text, avoid=self.avoid):
            yield from self._plain(segment)

    def ids(self, text: str) -> bytes:
        """Ids of a whole text."""
        return b"".join(np.array(part, "<u4").tobytes() for part in self.parts(text))

    def count(self, text: str) -> int:
        """Ids of a whole text, counted."""
        return sum(map(len, self.parts(text)))

    def check(self, texts, every: int = CHECK_EVERY) -> None:
        """Stop if the two encoders differ on the first of the texts or one in ``every`` after it."""
        for text in texts[::every]:
            for part in [text] if len(text) <= CHECKED_CHARS else segments(text, avoid=self.avoid):
                if self.ids(part) != self.whole(part):
                    raise ValueError(f"the encoders differ on {part[:200]!r}")


_LOADED: dict[str, Encoder] = {}


def load(name: str = DEFAULT_FILE) -> Encoder:
    """The encoder of a tokenizer file, once per Python worker."""
    if name not in _LOADED:
        _LOADED[name] = Encoder(C.tokenizer_file(name))
    return _LOADED[name]
