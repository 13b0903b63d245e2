"""Token counts that follow edits: a segment tree over pre-tokens per document.

A text is cut into segments of about LEAF characters before white space that
follows a visible character. There the vocabulary's pattern always starts a new
pre-token, so the tokens of the text are those of its segments. A binary tree
keeps the sums of characters and of tokens of each subtree. An edit finds its
segments by descending on the sums of characters; they and one segment on either
side, the boundary context, are joined and encoded again, and the sums on the
paths above them are updated. Nothing else is encoded again.

Defined cases: a null text is the empty text; null edits are none; positions
beyond the text's ends are moved to them; a null replacement is the empty text;
repeated rows are counted each; extra columns are kept by :func:`edited_counts`
unless they have the name of an output, which replaces them; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.llm import _common as C
from quarrylake.llm import byte_bpe

LEAF = 160
#: A segment that edits have made longer than so many leaves is cut again.
GROWN = 8
EDITS = "array<struct<start:long,length:long,replacement:string>>"
COUNTED = "n_tokens long, edited_tokens long, edited_chars long, reencoded_chars long, edited_sha256 string"


def segments(text: str, leaf: int = LEAF) -> list[str]:
    """The text cut before white space that follows a visible character, each part at least ``leaf`` long but the last.

    No added token holds white space, so none lies across such a cut.
    """
    out, begin = [], 0
    while len(text) - begin > leaf and (gap := byte_bpe.GAP.search(text, begin + leaf)):
        out.append(text[begin : gap.start()])
        begin = gap.start()
    out.append(text[begin:])
    return out


class TokenTree:
    """Characters and tokens of a text, by segment and by subtree."""

    def __init__(self, text: str, count: Callable[[str], int], leaf: int = LEAF) -> None:
        self.count, self.leaf, self.reencoded = count, leaf, 0
        parts = segments(text, leaf)
        self._plant(parts, [count(p) for p in parts])

    @classmethod
    def of_leaves(cls, text: str, chars: list[int], tokens: list[int], count: Callable[[str], int], leaf: int = LEAF) -> TokenTree:
        """A tree from the segments that were kept, without encoding anything."""
        tree = cls.__new__(cls)
        tree.count, tree.leaf, tree.reencoded = count, leaf, 0
        ends = [0]
        for n in chars:
            ends.append(ends[-1] + n)
        tree._plant([text[a:b] for a, b in zip(ends, ends[1:], strict=False)], list(tokens))
        return tree

    def _plant(self, parts: list[str], tokens: list[int]) -> None:
        size = 1 << max(0, len(parts) - 1).bit_length()
        self.size = size
        self.parts = parts + [""] * (size - len(parts))
        self.chars = [0] * size + [len(p) for p in self.parts]
        self.tokens = [0] * size + tokens + [0] * (size - len(tokens))
        for k in range(size - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def n_tokens(self) -> int:
        """Tokens of the whole text."""
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        """Code points of the whole text."""
        return self.chars[1]

    def text(self) -> str:
        """The text as it stands."""
        return "".join(self.parts)

    def leaves(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of the segments that are not empty."""
        some = [k for k in range(self.size) if self.parts[k]] or [0]
        return [self.chars[self.size + k] for k in some], [self.tokens[self.size + k] for k in some]

    def find(self, at: int) -> tuple[int, int]:
        """The segment that holds a position (the last of the text: its last segment), and the position where it starts."""
        k, before = 1, 0
        while k < self.size:
            k *= 2
            if at - before >= self.chars[k] and self.chars[k + 1]:
                before += self.chars[k]
                k += 1
        return k - self.size, before

    def edit(self, start: int, length: int, replacement: str) -> None:
        """Replace ``length`` characters from ``start`` on."""
        start = min(max(0, start), self.n_chars)
        end = min(start + max(0, length), self.n_chars)
        first, before = self.find(start)
        last, _ = self.find(end)
        while first and not (before and self.parts[first - 1]):
            if not before:
                break
            first -= 1
        if before:
            first -= 1
            before -= len(self.parts[first])
        last += 1
        while last < self.size - 1 and not self.parts[last]:
            last += 1
        last = min(last, self.size - 1)
        old = "".join(self.parts[first : last + 1])
        new = old[: start - before] + replacement + old[end - before :]
        self.reencoded += len(new)
        if len(new) > GROWN * self.leaf:
            fresh = segments(new, self.leaf)
            keep = [k for k in range(self.size) if self.parts[k] and not first <= k <= last]
            cut = sum(k < first for k in keep)
            tokens = [self.tokens[self.size + k] for k in keep]
            parts = [self.parts[k] for k in keep]
            self._plant(parts[:cut] + fresh + parts[cut:], tokens[:cut] + [self.count(p) for p in fresh] + tokens[cut:])
            return
        for k in range(first, last + 1):
            self.parts[k] = new if k == first else ""
            self.chars[self.size + k] = len(self.parts[k])
            self.tokens[self.size + k] = self.count(new) if k == first else 0
        level = {(self.size + k) // 2 for k in range(first, last + 1)}
        while level - {0}:
            for k in level:
                self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
                self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]
            level = {k // 2 for k in level if k > 1}


def trees(docs: DataFrame, file: str = byte_bpe.DEFAULT_FILE, leaf: int = LEAF) -> DataFrame:
    """Add leaf_chars and leaf_tokens, the segments of each text's tree, to be kept with the text."""

    @F.pandas_udf("leaf_chars array<int>, leaf_tokens array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        count = byte_bpe.load(file).count
        for batch in batches:
            yield pd.DataFrame([TokenTree(t, count, leaf).leaves() for t in batch], columns=["leaf_chars", "leaf_tokens"])

    kept = C.without(docs.columns, ["leaf_chars", "leaf_tokens"])
    return docs.withColumn("__tree", run(C.whole_text())).select(*kept, "__tree.*")


def edited_counts(kept: DataFrame, edits: Column, file: str = byte_bpe.DEFAULT_FILE, leaf: int = LEAF) -> DataFrame:
    """Apply each row's edits, in order, to its text: token counts before and after, and what was encoded again.

    Rows with leaf_chars and leaf_tokens (see :func:`trees`) are not encoded but
    where they are edited; for others the tree is built first.
    """
    has = {"leaf_chars", "leaf_tokens"} <= set(kept.columns)
    none = F.lit(None).cast("array<int>")

    @F.pandas_udf(COUNTED)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        encoder = byte_bpe.load(file)
        for texts, edits, chars, tokens in batches:
            rows = []
            for k, (text, changes, c, t) in enumerate(zip(texts, edits, chars, tokens, strict=True)):
                tree = TokenTree(text, encoder.count, leaf) if c is None else TokenTree.of_leaves(text, list(c), list(t), encoder.count, leaf)
                before = tree.n_tokens
                for change in changes if changes is not None else ():
                    tree.edit(int(change["start"] or 0), int(change["length"] or 0), change["replacement"] or "")
                done = tree.text()
                if k % byte_bpe.CHECK_EVERY == 0:
                    encoder.check([done])
                    if tree.n_tokens != encoder.count(done):
                        raise ValueError(f"the tree and the encoder differ on {done[:200]!r}")
                rows.append((before, tree.n_tokens, len(done), tree.reencoded, hashlib.sha256(done.encode("utf-8", "replace")).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "edited_tokens", "edited_chars", "reencoded_chars", "edited_sha256"])

    counted = run(C.whole_text(), edits.cast(EDITS), F.col("leaf_chars") if has else none, F.col("leaf_tokens") if has else none)
    out = [part.strip().split(" ")[0] for part in COUNTED.split(",")]
    return kept.withColumn("__counted", counted).select(*C.without(kept.columns, out), "__counted.*")


def sample_edits(text: Column) -> Column:
    """Three edits that depend on the text's length alone: an insertion, a deletion and a new beginning."""
    n = F.char_length(text)
    change = lambda start, length, new: F.struct(start.cast("long").alias("start"), length.cast("long").alias("length"), F.lit(new).alias("replacement"))
    return F.array(change(F.floor(n / 3), F.lit(0), " [edited in place]"), change(F.floor(n / 2), F.least(F.lit(40), F.floor(n / 4)), ""), change(F.lit(0), F.lit(0), "Revised: "))
