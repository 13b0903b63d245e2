"""SentencePiece encoding and decoding of merge-type vocabularies.

The encoder keeps an agenda (an array for words, a heap for longer runs) of adjacent symbol pairs ordered by the
merged piece's score, the leftmost first among equals, and merges until no pair
is in the vocabulary. Text is first cut where no piece of the vocabulary can
reach across, so each distinct segment is encoded once per Python worker. In
each Arrow batch the first text and one in CHECK_EVERY after it are checked
against the sentencepiece library; a difference stops the job.

Defined cases: a null text is the empty text and has no ids; a very long text is
encoded whole, its segments one by one, and long segments are not kept in the
worker's cache, which is bounded by characters; extra columns are
kept by :func:`encode` unless they have the name of an output, which replaces
them; repeated rows are encoded each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain
from operator import add

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylake.llm import _common as C

SPACE = "▁"
DEFAULT_MODEL = "piece_bpe_32k.model"
#: Segments kept per generation of a worker's cache; two generations exist at most.
CACHE_SEGMENTS = 500_000
#: Longer segments, such as unbroken runs of a script without spaces, are not kept; nor more characters than this.
CACHED_CHARS, CACHE_CHARS = 64, 8_000_000
#: One text in so many of each Arrow batch is encoded and decoded by the library too.
CHECK_EVERY = 64
#: Segments of at most so many symbols keep their agenda as an array, longer ones as a heap.
ARRAY_AGENDA = 48
NEVER = float("inf")
#: Marks the parts of words in the cache; texts that contain it are encoded whole.
NO_SPACE = "\ue000"
RUNS = re.compile(f"{SPACE}+[^{SPACE}]*")


class AgendaBpe:
    """Encoder and decoder for one merge-type model; needs an identity normaliser with a dummy prefix."""

    def __init__(self, library) -> None:
        size = library.get_piece_size()
        pieces = [library.id_to_piece(i) for i in range(size)]
        normal = [not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i)) for i in range(size)]
        self.ids = {p: i for i, p in enumerate(pieces) if normal[i]}
        self.order = {p: -library.get_score(i) for p, i in self.ids.items()}
        self.decimals = list(map(str, range(size)))
        self.byte_ids = [library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.neighbours = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.surfaces = [p if ok else "" for p, ok in zip(pieces, normal, strict=True)]
        self.surfaces[library.unk_id()] = " ⁇ "
        for b, i in enumerate(self.byte_ids):
            self.surfaces[i] = chr(b) if b < 128 else chr(0xDC00 + b)

    def merge(self, symbols: list[str]) -> list[str]:
        """Merge adjacent symbols, best score first and leftmost among equals."""
        return self.merge_heap(symbols) if len(symbols) > ARRAY_AGENDA else self.merge_array(symbols)

    def merge_array(self, symbols: list[str]) -> list[str]:
        """The agenda as an array of the pairs' scores: quicker for the few symbols of a word."""
        get = self.order.get
        agenda = [get(a + b, NEVER) for a, b in zip(symbols, symbols[1:], strict=False)]
        while agenda:
            best = min(agenda)
            if best == NEVER:
                break
            k = agenda.index(best)
            symbols[k] += symbols[k + 1]
            del symbols[k + 1], agenda[k]
            if k:
                agenda[k - 1] = get(symbols[k - 1] + symbols[k], NEVER)
            if k < len(agenda):
                agenda[k] = get(symbols[k] + symbols[k + 1], NEVER)
        return symbols

    def merge_heap(self, symbols: list[str]) -> list[str]:
        """The agenda as a heap, for long segments."""
        order, n = self.order, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[float, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            rank = order.get(symbols[a] + symbols[b])
            if rank is not None:
                heapq.heappush(agenda, (rank, a, b, len(symbols[a]) + len(symbols[b])))

        for k in range(n - 1):
            offer(k, k + 1)
        while agenda:
            _, a, b, length = heapq.heappop(agenda)
            if not symbols[a] or not symbols[b] or len(symbols[a]) + len(symbols[b]) != length:
                continue
            symbols[a] += symbols[b]
            symbols[b] = ""
            after[a] = after[b]
            if after[b] < n:
                before[after[b]] = a
                offer(a, after[b])
            if before[a] >= 0:
                offer(before[a], a)
        return [s for s in symbols if s]

    def apart(self, text: str) -> list[str]:
        """The text cut wherever no piece contains the two characters side by side."""
        near = self.neighbours
        cuts = [k for k, pair in enumerate(map(add, text, text[1:]), 1) if pair not in near]
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)] if cuts else [text]

    def part_ids(self, part: str) -> list[int]:
        """Ids of a part that :meth:`apart` leaves whole; unknown characters are written as bytes."""
        out: list[int] = []
        for piece in self.merge(list(part)):
            known = self.ids.get(piece)
            out.extend([known] if known is not None else [self.byte_ids[b] for b in piece.encode("utf-8", "replace")])
        return out

    def segment_ids(self, text: str) -> list[int]:
        """Ids of a text in which spaces are already written as the space symbol."""
        return [i for part in self.apart(text) for i in self.part_ids(part)] if text else []

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        return self.segment_ids(SPACE + text.replace(" ", SPACE)) if text else []

    def surface(self, ids) -> str:
        """What ids stand for, before the dummy prefix goes."""
        text = "".join(map(self.surfaces.__getitem__, ids)).replace(SPACE, " ")
        try:
            text.encode()
        except UnicodeEncodeError:
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return text

    def decode(self, ids) -> str:
        """The text of ids; the one space of the dummy prefix goes."""
        text = self.surface(ids)
        return text[1:] if text[:1] == " " and len(ids) and self.surfaces[ids[0]][:1] == SPACE else text


class Segments(dict):
    """Segment or part of one -> its ids; filled on first use.

    A word stands for itself after the space symbol. Parts of a word, which the
    cache holds too, start with NO_SPACE instead.
    """

    def __init__(self, codec: AgendaBpe, library) -> None:
        super().__init__()
        self.codec, self.library, self.older, self.chars = codec, library, {}, 0

    def __missing__(self, word: str) -> list[int]:
        found = self.older.get(word)
        if found is None:
            codec = self.codec
            parts = [SPACE + word] if word.isalpha() else codec.apart(word[1:] if word[:1] == NO_SPACE else SPACE + word)
            if len(parts) == 1:
                found = codec.part_ids(parts[0])
            else:
                found = [i for p in parts for i in self[p[1:] if p[0] == SPACE else NO_SPACE + p]]
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHE_SEGMENTS or self.chars >= CACHE_CHARS:
                self.older = dict(self)
                self.clear()
                self.chars = 0
            self[word] = found
            self.chars += len(word)
        return found

    def of(self, text: str) -> list[int]:
        """The ids of a whole text."""
        if not text:
            return []
        if NO_SPACE in text:
            return self.codec.encode(text)
        words = text.split(" ")
        if SPACE in text or "" in words:  # a run of spaces belongs to the word after it
            words = [part[1:] for part in RUNS.findall(SPACE + text.replace(" ", SPACE))]
        return list(chain.from_iterable(map(self.__getitem__, words)))

    def check(self, texts: pd.Series) -> None:
        """Compare every CHECK_EVERYth text of an Arrow batch, the first among them, with the library."""
        for text in texts.iloc[::CHECK_EVERY]:
            ids = self.of(text)
            if ids != self.library.encode(text) or self.codec.decode(ids) != self.library.decode(ids):
                raise ValueError(f"the agenda and the sentencepiece library differ on {text[:200]!r}")


_LOADED: dict[str, Segments] = {}


def load(path: str) -> Segments:
    """The codec of a model file, once per Python worker."""
    if path not in _LOADED:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        _LOADED[path] = Segments(AgendaBpe(library), library)
    return _LOADED[path]


def encode(docs: DataFrame, model: str = DEFAULT_MODEL, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the array of piece ids of a text column."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        segments = load(C.tokenizer_file(model))
        for batch in batches:
            segments.check(batch)
            yield pd.Series([segments.of(t) for t in batch], dtype=object)

    return docs.withColumn(ids, run(C.whole_text(text)))


def decode(df: DataFrame, model: str = DEFAULT_MODEL, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text that an array of piece ids stands for (null ids: the empty text)."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        segments = load(C.tokenizer_file(model))
        for batch in batches:
            yield pd.Series([segments.codec.decode(list(x)) for x in batch], dtype=object)

    return df.withColumn(text, run(F.coalesce(F.col(ids), F.array().cast("array<int>"))))


def round_trip_digest(docs: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """Encode and decode every text in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256.

    The ids stay in the Python worker, so neither they nor the text are sent
    back; the digests are what :func:`encode` and :func:`decode` would give.
    """
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        segments = load(C.tokenizer_file(model))
        for batch in batches:
            segments.check(batch)
            rows = []
            for t in batch:
                ids = segments.of(t)
                joined = ",".join(map(segments.codec.decimals.__getitem__, ids))
                rows.append((len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(segments.codec.decode(ids).encode("utf-8", "replace")).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", run(C.whole_text()).alias("found")).select("doc_id", "found.*")
