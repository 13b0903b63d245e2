"""Toxicity: a string-kernel support vector machine on windows of sentences, with Nystroem landmarks.

The kernel of two strings counts the subsequences of three characters that they
share, each weighted by LAMBDA to the power of the length it spans (at most
SPAN characters), so gaps and inserted characters lower a match without breaking
it; it is normalised to 1 for equal strings.

A sentence enters the kernel by its windows: every word with marks for its start
and end (a long one in overlapping windows, so no length is left out), and every
two words that follow one another, with the gap between them. A labelled text
tells that some of its windows are insults, not which. So the machine is trained
by multiple instances: in each toxic document the few windows that toxic
documents have most beyond others are its witnesses, and a squared hinge machine
separates witnesses from the windows of other documents; then windows of toxic
documents that the machine takes for insults join, and it is fitted again. Each
witness is also shown with one letter put in at each place (virtual examples), as
gapped insults are seldom among the labelled. Pairs are witnesses where neither
word tells anything but their order does, beyond chance (PAIR_CHANCE); where no
pair does, pairs are not looked at.

The machine works on Nystroem coordinates: kernel values against landmarks, which
are witnesses unlike one another and common other windows, times the inverse root
of the landmarks' own kernel matrix. As the kernel is a dot product over
subsequences, the fitted weights on landmarks add up to one weight per
subsequence, with which a window is scored without a loop over landmarks and
without a floor.

Labelled documents that were kept aside tell what share of the words at each
margin stand in toxic documents (isotonic regression); its log-odds above the
base rate are a word's evidence, and a word without evidence takes the little
from a document's that it is rarer in toxic ones, so a few doubtful words of a
long text weigh less than those of a short one. A document's evidence is the sum
over its words and pairs, each counted MOST_TIMES at most, and isotonic
regression on the documents kept aside turns it into the score.

A word is a run of characters without white space, in lower case, without
punctuation at its ends; runs of single characters are joined, so that
spaced-out words count too. A word is also read by its letters alone and with
stretched letters written once or twice.

Defined cases: a null text is the empty text and is scored as such; repeated
rows are scored each; extra columns are kept by :func:`add_score` except those
named like its outputs, in whatever case; very long texts are read whole, in
blocks; an empty table gives an empty result, and without labels of both kinds, or
without a window that tells them apart, every score is the share of label 1 (0
where there are no labels) and :func:`keep_clean` keeps every row.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylake.llm import _common as C
from quarrylake.llm import _training as L

LAMBDA = 0.6
SPAN = 6
#: Longest window that is read at once; the step of the windows over longer words.
WINDOW, STEP = 16, 4
#: Most landmarks among the witnesses and among other words.
LANDMARKS, OTHERS = 384, 128
#: A witness is no landmark if one chosen before is as like it as this.
ALIKE = 0.75
#: Eigenvalues of the landmarks' kernel below this are taken for noise.
LEAST_VALUE = 0.01
STRENGTH = 3e-6
#: Witnesses of one toxic document; a word is a witness if so many documents, and this share of those with it, chose it.
WITNESSES, CHOSEN, CHOSEN_SHARE = 6, 2, 0.15
#: Most words that the machine is fitted on: of those in toxic documents, and of the others.
MAX_WORDS = 20_000
#: Common words whose pairs are counted; how many toxic documents a pair must be in, and how many times as common as in others; chance that any pair is taken by mistake.
PAIR_WORDS, PAIR_TIMES, PAIR_RATIO, PAIR_CHANCE = 500, 8, 4.0, 0.001
#: Weight of the virtual examples of a witness, in parts of its own.
VIRTUAL = 0.5
CUT = 0.7
#: A word counts so many times in one document at most.
MOST_TIMES = 3
#: Words kept in a Python worker's cache.
CACHE_WORDS = 200_000
#: Longer words are not kept.
CACHED_CHARS = 64
#: Keys that a task sums before it sends them on.
SUMMED_KEYS = 120_000
#: Windows that are compared at once.
AT_ONCE = 8_000
#: Most labelled rows that the machine is fitted and calibrated on.
MAX_ROWS = 40_000
#: One labelled text in so many is for calibration.
CALIBRATE = 4
#: Margins are counted in bins of this width between these ends.
BIN, LEAST_MARGIN, MOST_MARGIN = 0.02, -3.0, 3.0
#: Punctuation that does not belong to a word where it stands at its ends.
OUTER = ".,;:!?\"'()[]{}|&%$#*-_<>"
#: Punctuation that ends a sentence.
ENDS = ".!?;:"
#: A letter written three times or more.
STRETCHED = re.compile(r"([^\W\d_])\1{2,}")

#: A window with a letter put in is one longer.
LONGEST_SHOWN = WINDOW + 1
_TRIPLES = {n: np.array([t for t in combinations(range(n), 3) if t[2] - t[0] < SPAN], dtype=np.intp).reshape(-1, 3) for n in range(LONGEST_SHOWN + 1)}


def words(text: str) -> Counter[str]:
    """The words of a text and how often each occurs; single characters that follow one another are one word."""
    raw: Counter[str] = Counter()
    run: list[str] = []
    joined: Counter[str] = Counter()
    for block in C.blocks(text):
        found = block.lower().split()
        counted = Counter(found)
        raw.update(counted)
        if run or any(len(w.strip(OUTER) or w) == 1 for w in counted):
            for w in found:
                bare = w.strip(OUTER) or w
                if len(bare) == 1:
                    run.append(bare)
                else:
                    if len(run) > 2:
                        joined["".join(run)] += 1
                    run = []
    if len(run) > 2:
        joined["".join(run)] += 1
    out: Counter[str] = Counter()
    for w, n in raw.items():
        out[w.strip(OUTER) or w] += n
    out.update(joined)
    return out


def pairs(text: str) -> Counter[str]:
    """Two words of a sentence that follow one another, with the gap between them, and how often each pair occurs."""
    out: Counter[str] = Counter()
    before = ""
    for block in C.blocks(text):
        for w in block.lower().split():
            bare = w.strip(OUTER) or w
            if before:
                out[f"{before} {bare}"] += 1
            before = "" if w[-1] in ENDS else bare
    return out


def contexts(text: str, known: frozenset[str]) -> set[str]:
    """Known pairs of a text with the words before and after them."""
    found = [w.strip(OUTER) or w for block in C.blocks(text) for w in block.lower().split()]
    around = ["", *found, ""]
    return {f"{a} {b}\0{around[k]}\0{around[k + 3]}" for k, (a, b) in enumerate(zip(found, found[1:], strict=False)) if f"{a} {b}" in known}


def readings(word: str) -> list[str]:
    """A word as it stands, with its letters alone, and with stretched letters written once or twice."""
    out = [word]
    if not word.isalpha():
        plain = "".join(c for c in word if unicodedata.category(c)[0] in "LM")
        out += [plain] * (plain != "")
    if STRETCHED.search(out[-1]):
        out += [STRETCHED.sub(r"\1", out[-1]), STRETCHED.sub(r"\1\1", out[-1])]
    return list(dict.fromkeys(out))


def parts_of(read: str) -> Iterator[str]:
    """A word with its marks, or the overlapping windows over one that is long."""
    marked = f"^{read}$"
    if len(marked) <= WINDOW:
        yield marked
    else:
        yield from (marked[k : k + WINDOW] for k in range(0, len(marked) - WINDOW + STEP, STEP))


def windows(word: str) -> Iterator[str]:
    """The windows of all of a word's readings."""
    for read in readings(word):
        yield from parts_of(read)


def _keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Per text of one length its subsequences as numbers, and their weights by place."""
    n = len(texts[0])
    triples = _TRIPLES[n]
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(texts), n).astype(np.int64)
    return (chars[:, triples[:, 0]] << 42) | (chars[:, triples[:, 1]] << 21) | chars[:, triples[:, 2]], LAMBDA ** (triples[:, 2] - triples[:, 0] + 1.0)


def _by_length(texts: list[str]) -> Iterator[np.ndarray]:
    """Places of the texts that have a subsequence, in groups of equal length."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    for n in np.unique(size):
        if n >= 3:
            yield np.flatnonzero(size == n)


def _summed(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, subsequence, total weight) of rows of keys, and the root of each row's kernel with itself."""
    order = np.argsort(key, axis=1)
    key = np.take_along_axis(key, order, 1)
    fresh = np.ones(key.shape, bool)
    fresh[:, 1:] = key[:, 1:] != key[:, :-1]
    start = np.flatnonzero(fresh.ravel())
    total = np.add.reduceat(weight[order].ravel(), start)
    row = start // key.shape[1]
    return row, key.ravel()[start], total, np.sqrt(np.bincount(row, total**2, len(key)))


class Kernel:
    """The landmarks' weights by subsequence: the columns of their normalised feature vectors."""

    def __init__(self, landmarks: list[str]) -> None:
        self.landmarks = landmarks
        rows, keys, weights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for at in _by_length(landmarks):
            row, key, total, norm = _summed(*_keys([landmarks[k] for k in at]))
            rows.append(at[row])
            keys.append(key)
            weights.append(total / norm[row])
        self.known, place = np.unique(np.concatenate(keys), return_inverse=True)
        self.columns = np.zeros((len(self.known), len(landmarks)))
        self.columns[place, np.concatenate(rows)] = np.concatenate(weights)

    def values(self, texts: list[str]) -> np.ndarray:
        """Normalised kernel of each text against each landmark."""
        out = np.zeros((len(texts), len(self.landmarks)))
        for at in _by_length(texts) if len(self.known) else ():
            for some in np.split(at, range(1000, len(at), 1000)):
                row, key, total, norm = _summed(*_keys([texts[k] for k in some]))
                place = np.minimum(np.searchsorted(self.known, key), len(self.known) - 1)
                hit = self.known[place] == key
                dense = np.zeros((len(some), len(self.known)))
                dense[row[hit], place[hit]] = total[hit] / norm[row[hit]]
                out[some] = dense @ self.columns
        return out

    def coordinates(self, texts: list[str], root: np.ndarray) -> np.ndarray:
        """Nystroem coordinates of texts."""
        parts = [(self.values(texts[k : k + AT_ONCE]) @ root).astype(np.float32) for k in range(0, len(texts), AT_ONCE)]
        return np.concatenate(parts) if parts else np.zeros((0, len(root)), np.float32)

    def root(self) -> np.ndarray:
        """The inverse root of the landmarks' own kernel matrix."""
        own = self.values(self.landmarks)
        value, vector = np.linalg.eigh((own + own.T) / 2)
        return vector @ np.diag(np.where(value > LEAST_VALUE, 1 / np.sqrt(np.maximum(value, LEAST_VALUE)), 0)) @ vector.T


def machine(parts: list[tuple[np.ndarray, float, np.ndarray]], start: np.ndarray | None = None, strength: float = STRENGTH, steps: int = 40) -> np.ndarray:
    """Weights and, last, the constant of a squared hinge machine by Newton steps.

    ``parts`` are rows of coordinates, their sign and their shares of the loss;
    rows are worked on in blocks, and only those on the wrong side of the margin count.
    """
    size = parts[0][0].shape[1] + 1
    ridge = strength * np.diag([*np.ones(size - 1), 1e-6])
    w, before = np.zeros(size) if start is None else start, None
    for step in range(steps):
        left, right, support = ridge.copy(), np.zeros(size), []
        for rows, sign, share in parts:
            for k in range(0, len(rows), AT_ONCE):
                x = np.hstack([rows[k : k + AT_ONCE], np.ones((len(rows[k : k + AT_ONCE]), 1))])
                wrong = sign * (x @ w) < 1
                support.append(wrong)
                x = x[wrong]
                weighted = x * share[k : k + AT_ONCE][wrong][:, None]
                left += weighted.T @ x
                right += sign * weighted.sum(0)
        support = np.concatenate(support)
        if before is not None and (support == before).all():
            break
        before = support
        w = w + (np.linalg.solve(left, right) - w) * (1.0 if step < 8 else 0.6)
    return w


class Model:
    """A weight per subsequence, what margins are worth, and the calibration; ``constant`` where nothing could be learnt."""

    def __init__(self, constant: float | None = None) -> None:
        self.constant = constant
        self.known, self.weight, self.bias, self.harmless = np.zeros(0, np.int64), np.zeros(0), 0.0, 0.0
        self.worth = np.zeros(round((MOST_MARGIN - LEAST_MARGIN) / BIN) + 1)
        self.landmarks: list[str] = []
        #: The same of pairs of words; all zero where no pair tells anything.
        self.pair_worth, self.harmless_pair = self.worth.copy(), 0.0
        self.calibrate = L.Isotonic(np.zeros(0), np.zeros(0))

    @property
    def digest(self) -> tuple[int, int]:
        """Tells models apart."""
        return crc32(self.known.tobytes() + self.weight.tobytes()), crc32(self.worth.tobytes() + self.pair_worth.tobytes() + np.array([self.harmless, self.harmless_pair]).tobytes())

    def margins(self, found: list[str], least: float = -np.inf, split=windows) -> np.ndarray:
        """The largest margin over each word's windows; words that do not reach ``least`` have a value below it. Pairs are ``split`` by :func:`parts_of`."""
        out = np.full(len(found), LEAST_MARGIN)
        owner: list[int] = []
        parts: list[str] = []

        def flush() -> None:
            if parts:
                np.maximum.at(out, np.array(owner), self._window_margins(parts, least))
                owner.clear()
                parts.clear()

        for k, word in enumerate(found):
            for part in split(word):
                owner.append(k)
                parts.append(part)
                if len(parts) == AT_ONCE:
                    flush()
        flush()
        return out

    def _window_margins(self, parts: list[str], least: float) -> np.ndarray:
        out = np.full(len(parts), LEAST_MARGIN)
        for at in _by_length(parts) if len(self.known) else ():
            key, span = _keys([parts[k] for k in at])
            place = np.minimum(np.searchsorted(self.known, key.ravel()), len(self.known) - 1).reshape(key.shape)
            dot = np.where(self.known[place] == key, self.weight[place], 0.0) @ span
            # A string's own kernel is at least that of a string without repeated subsequences.
            most = np.where(dot > 0, dot, 0.0) / np.sqrt((span**2).sum()) + self.bias
            likely = np.flatnonzero(most >= least)
            out[at] = np.minimum(most, least - BIN)
            if len(likely):
                out[at[likely]] = dot[likely] / _summed(key[likely], span)[3] + self.bias
        return out

    def bins(self, margin: np.ndarray) -> np.ndarray:
        """The bin of each margin."""
        return np.rint((np.clip(margin, LEAST_MARGIN, MOST_MARGIN) - LEAST_MARGIN) / BIN).astype(int)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        """Calibrated score of documents by their evidence."""
        return np.full(len(evidence), self.constant) if self.constant is not None else self.calibrate(evidence)


class Evidence(dict):
    """Word -> its evidence; filled in bulk."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model
        self.least, self.least_pair = (LEAST_MARGIN + BIN * at[0] - BIN / 2 if len(at) else np.inf for at in (np.flatnonzero(model.worth > 0), np.flatnonzero(model.pair_worth > 0)))
        #: What pairs are worth.
        self.pairs: dict[str, float] = {}

    def of_pairs(self, text: str, found: Counter[str]) -> float:
        """The evidence of the pairs of a text, but for those with a word that is evidence itself."""
        own = pairs(text)
        new = sorted(p for p in own if p not in self.pairs)
        if len(self.pairs) + len(new) > CACHE_WORDS:
            self.pairs.clear()
            new = sorted(own)
        worth = self.model.pair_worth[self.model.bins(self.model.margins(new, self.least_pair, parts_of))]
        known = dict(zip(new, worth.tolist(), strict=True))
        self.pairs.update((p, x) for p, x in known.items() if len(p) <= CACHED_CHARS)
        told = [min(n, MOST_TIMES) * x for p, n in own.items() if (x := known[p] if p in known else self.pairs[p]) and not any(self.get(w) for w in p.split(" "))]
        return sum(told) - self.model.harmless_pair * (len(own) - len(told))

    def of(self, texts: list[str]) -> np.ndarray:
        """The evidence of each text."""
        out = np.zeros(len(texts))
        for begin, end in C.pieces(texts, 1_000_000):
            some = [words(t) for t in texts[begin:end]]
            new = sorted({w for found in some for w in found if w not in self})
            if len(self) + len(new) > CACHE_WORDS:
                self.clear()
                new = sorted(set().union(*some))
            worth = self.model.worth[self.model.bins(self.model.margins(new, self.least))]
            long = {}
            for w, x in zip(new, worth.tolist(), strict=True):
                (self if len(w) <= CACHED_CHARS else long)[w] = x
            for k, found in enumerate(some, begin):
                told = [min(n, MOST_TIMES) * x for w, n in found.items() if (x := self[w] if w in self else long[w])]
                out[k] = sum(told) - self.model.harmless * (len(found) - len(told))
                if self.least_pair < np.inf:
                    out[k] += self.of_pairs(texts[k], found)
        return out


_LOADED: dict[tuple[int, int], Evidence] = {}


def _evidence(model: Model) -> Evidence:
    """The cache of a model, once per Python worker; those of other models go."""
    if model.digest not in _LOADED:
        _LOADED.clear()
        _LOADED[model.digest] = Evidence(model)
    return _LOADED[model.digest]


def _counted(rows: DataFrame, of, keys: str) -> DataFrame:
    """Sum (toxic, other) per key: ``of`` yields (key, toxic, other) of a pandas batch; tasks add up before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both: dict[str, list[int]] = {}
        for batch in batches:
            for key, toxic, other in of(batch):
                at = both.get(key)
                if at is None:
                    both[key] = [toxic, other]
                    if len(both) >= SUMMED_KEYS:
                        yield from told(both)
                        both = {}
                else:
                    at[0] += toxic
                    at[1] += other
        yield from told(both)

    def told(both: dict[str, list[int]]) -> Iterator[pd.DataFrame]:
        names = list(both)
        for at in range(0, len(names), 20_000):
            some = names[at : at + 20_000]
            counts = np.array([both[k] for k in some], dtype=np.int64).reshape(-1, 2)
            yield pd.DataFrame({keys: pd.Series(some, dtype=object), "toxic": counts[:, 0], "other": counts[:, 1]})

    return rows.mapInPandas(run, f"{keys} string, toxic long, other long").groupBy(keys).agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def instances(found: Counter[str]) -> set[str]:
    """What of a sentence the machine is shown: the windows of its words as they stand."""
    return {part for w in found for part in parts_of(w)}


def chosen_words(fit: DataFrame, toxic: int, other: int) -> tuple[dict[str, tuple[int, int, int]], list[str]]:
    """Windows of words that the machine is fitted on -> documents of either kind that have the word, and toxic ones that chose it as a witness.

    At most MAX_WORDS of toxic documents, those with the most worth, and as many others, by a hash. Also the
    common words, at most PAIR_WORDS, of which none tells toxic documents from others.
    """
    counted = C.spill(_counted(fit, lambda b: ((w, y, 1 - y) for t, y in zip(b["text"], b["y"], strict=True) for w in instances(words(t))), "word"), "toxicity-words")
    t, o = F.col("toxic"), F.col("other")
    worth = t / (t + 20.0 * toxic / other * o + 2) * F.log1p(t)
    told = (t - 1.5 * F.sqrt(t)) / toxic > 2 * (o + 1.5 * F.sqrt(o) + 1) / other
    first = counted.where("toxic > 0").select("word", "toxic", "other", worth.alias("worth"), told.alias("told")).orderBy(F.desc("worth"), "word").limit(MAX_WORDS).collect()
    rest = counted.where("toxic = 0").orderBy(F.xxhash64("word"), "word").limit(MAX_WORDS).collect()
    shared = fit.sparkSession.sparkContext.broadcast({r["word"]: r["worth"] for r in first if r["told"]})

    def witnesses(batch: pd.DataFrame) -> Iterator[tuple[str, int, int]]:
        known = shared.value
        for text in batch["text"]:
            own = sorted((w for w in instances(words(text)) if w in known), key=lambda w: (-known[w], w))
            yield from ((w, 1, 0) for w in own[:WITNESSES])

    votes = {r["word"]: r["toxic"] for r in _counted(fit.where("y = 1"), witnesses, "word").collect()}
    whole = F.col("word").startswith("^") & F.col("word").endswith("$") & (F.length("word") > 2)
    plain = counted.where(whole & (t > 0) & (o > 0) & ~told).orderBy(F.desc(t + o), "word").limit(PAIR_WORDS).select("word").collect()
    return {r["word"]: (r["toxic"], r["other"], votes.get(r["word"], 0)) for r in [*first, *rest]}, [r["word"][1:-1] for r in plain]


def chosen_pairs(fit: DataFrame, toxic: int, other: int, common: list[str]) -> dict[str, tuple[int, int, int]]:
    """Pairs of common words, marked, with documents of either kind that have them, and again the toxic ones where the pair tells something; none if no pair does.

    A pair tells something if it is PAIR_RATIO times as common in toxic documents and this is no chance: by the
    bound on a binomial's tail, over all pairs, PAIR_CHANCE at most. Both must hold even if all toxic documents in
    which it stands between the same words count as one, so that copies of one document do not make a pair.
    """
    shared = fit.sparkSession.sparkContext.broadcast(frozenset(common))

    def found(batch: pd.DataFrame) -> Iterator[tuple[str, int, int]]:
        known = shared.value
        for text, y in zip(batch["text"], batch["y"], strict=True):
            yield from ((p, y, 1 - y) for p in pairs(text) if all(w in known for w in p.split(" ")))

    # At most PAIR_WORDS squared rows.
    counts = {f"^{r['pair']}$": (r["toxic"], r["other"]) for r in _counted(fit, found, "pair").where(F.col("toxic") + F.col("other") >= PAIR_TIMES).collect()}
    base = toxic / (toxic + other)

    def tells(t: int, o: int) -> bool:
        share = t / (t + o)
        apart = share * np.log(share / base) + ((1 - share) * np.log((1 - share) / (1 - base)) if o else 0.0) if t else 0.0
        return t >= PAIR_TIMES and t / toxic >= PAIR_RATIO * o / other and (t + o) * apart > np.log(max(1, len(counts)) / PAIR_CHANCE)

    likely = fit.sparkSession.sparkContext.broadcast(frozenset(p[1:-1] for p, (t, o) in counts.items() if len(p) <= WINDOW and tells(t, o)))
    told: set[str] = set()
    if likely.value:
        around = _counted(fit.where("y = 1"), lambda b: ((c, 1, 0) for text in b["text"] for c in contexts(text, likely.value)), "context")
        apart = {f"^{r['pair']}$": r["count"] for r in around.groupBy(F.substring_index("context", "\0", 1).alias("pair")).count().collect()}
        told = {p for p, n in apart.items() if tells(min(n, counts[p][0]), counts[p][1])}
    plain = sorted((p for p, (_, o) in counts.items() if o and p not in told and len(p) <= WINDOW), key=lambda p: (-counts[p][1], p))[:MAX_WORDS]
    return {p: (*counts[p], counts[p][0] if p in told else 0) for p in [*sorted(told), *plain]} if told else {}


def _unlike(candidates: list[str], most: int) -> list[str]:
    """The first of the strings that are unlike one another by the kernel: each is compared with those that are taken."""
    out: list[str] = []
    for begin in range(0, len(candidates), LANDMARKS):
        some = candidates[begin : begin + LANDMARKS]
        both = Kernel(out + some)
        own = both.values(some)
        taken = own[:, : len(out)].max(1, initial=0.0)
        own = own[:, len(out) :]
        for k, word in enumerate(some):
            if len(out) < most and taken[k] < ALIKE:
                out.append(word)
                taken = np.maximum(taken, own[:, k])
        if len(out) >= most:
            break
    return out


def _with_a_letter(word: str, letters: list[str]) -> list[str]:
    """The window with a letter put in at each place between two of its letters, another at each."""
    first, last = word.startswith("^"), word.endswith("$")
    return [word[:k] + letters[crc32(f"{word}{k}".encode()) % len(letters)] + word[k:] for k in range(1 + first, len(word) - last)]


def fitted(found: dict[str, tuple[int, int, int]]) -> Model | None:
    """The machine on words and their counts, or None without witnesses or without other words."""
    names = sorted(found)
    toxic, other, votes = np.array([found[w] for w in names], np.float64).reshape(-1, 3).T
    sure = (votes >= CHOSEN) & (votes >= CHOSEN_SHARE * toxic)
    if not sure.any() or not (other > 0).any():
        return None
    by_votes = sorted(np.flatnonzero(sure), key=lambda k: (-votes[k], names[k]))
    common = sorted(np.flatnonzero(~sure & (other > 0)), key=lambda k: (-other[k], names[k]))
    kernel = Kernel(_unlike([names[k] for k in by_votes], LANDMARKS) + [names[k] for k in common[:OTHERS]])
    if not kernel.landmarks:
        return None
    root = kernel.root()
    letters = sorted({c for k in by_votes for c in names[k] if c.isalpha()}) or ["x"]
    virtual = [(k, v) for k in by_votes for v in _with_a_letter(names[k], letters) if len(v) <= LONGEST_SHOWN]
    own, made = kernel.coordinates(names, root), kernel.coordinates([v for _, v in virtual], root)
    source = np.array([k for k, _ in virtual], int)
    against = np.sqrt(other) * np.where(sure, 0.3, 1.0)
    shown = np.sqrt(votes[source]) / np.bincount(source, minlength=len(names))[source] * VIRTUAL
    more = (toxic >= CHOSEN) & (toxic / max(1.0, toxic.sum()) > other / max(1.0, other.sum()))
    positive, w = np.where(sure, np.sqrt(votes), 0.0), None
    for _ in range(2):
        if w is not None:
            positive = np.where(sure, np.sqrt(votes), ((own @ w[:-1] + w[-1] > 0) & more).astype(float))
        for_, against_ = positive > 0, against > 0
        all_of = 2 * positive.sum()
        w = machine([(own[for_], 1.0, positive[for_] / all_of), (made, 1.0, shown / all_of), (own[against_], -1.0, against[against_] / (2 * against.sum()))], w)
    model = Model()
    model.landmarks = kernel.landmarks
    model.known, model.weight, model.bias = kernel.known, kernel.columns @ (root @ w[:-1]), float(w[-1])
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", mod: int = 3, rest: int = 1, max_rows: int = MAX_ROWS) -> Model:
    """Fit on labelled documents outside the held-out remainder; at most about ``max_rows`` of them, equal texts once."""
    spark = docs.sparkSession
    drawn = L.labelled_sample(docs, labels, label, mod, rest, max_rows).groupBy("text").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    sample = C.spill(drawn.withColumn("aside", F.pmod(F.xxhash64("text", F.lit(3)), F.lit(CALIBRATE)) == 0), "toxicity-sample")
    counts = {(r["aside"], r["y"]): r["n"] for r in sample.groupBy("aside", "y").agg(F.count("*").alias("n")).collect()}
    number, ones = sum(counts.values()), sum(n for (_, y), n in counts.items() if y)
    if not 0 < ones < number:
        return Model(float(ones / number) if number else 0.0)
    # Where either part lacks a label, all rows serve for both.
    split = len(counts) == 4
    fit, aside = (sample.where("not aside"), sample.where("aside")) if split else (sample, sample)
    toxic, other = (counts[False, 1], counts[False, 0]) if split else (ones, number - ones)
    found, common = chosen_words(fit, toxic, other)
    told_pairs = chosen_pairs(fit, toxic, other, common)
    model = fitted(found | told_pairs)
    if model is None:
        return Model(float(ones / number))
    shared = spark.sparkContext.broadcast(model)
    size = len(model.worth)

    def histogram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, total = shared.value, np.zeros((4, size))
        for batch in batches:
            for begin, end in C.pieces(list(batch["text"]), 1_000_000):
                some = [list(words(t)) for t in batch["text"].iloc[begin:end]]
                names = sorted({w for found in some for w in found})
                at = dict(zip(names, own.bins(own.margins(names)).tolist(), strict=True))
                for y, found in zip(batch["y"].iloc[begin:end], some, strict=True):
                    total[1 - y] += np.bincount([at[w] for w in found], minlength=size)
                for y, text in zip(batch["y"].iloc[begin:end], batch["text"].iloc[begin:end], strict=True) if told_pairs else ():
                    total[3 - y] += np.bincount(own.bins(own.margins(sorted(pairs(text)), split=parts_of)), minlength=size)
        yield pd.DataFrame({"sums": list(total), "n": range(4)})

    sums = np.zeros((4, size))
    for r in aside.mapInPandas(histogram, "sums array<double>, n int").collect():  # four rows a task
        sums[r["n"]] += np.array(r["sums"])
    model.worth, model.pair_worth = word_worth(sums[:2]), word_worth(sums[2:])
    model.harmless, model.harmless_pair = harmless_worth(sums[:2], model.worth), harmless_worth(sums[2:], model.pair_worth)
    got = aside.select("y", _evidence_column(spark, model)(F.col("text")).alias("e")).toPandas()
    model.calibrate = L.Isotonic(got["e"].to_numpy(np.float64), got["y"].to_numpy(np.float64))
    return model


def word_worth(sums: np.ndarray) -> np.ndarray:
    """Evidence of words by the bin of their margin, from how many words of toxic and of other documents each bin has."""
    every = sums.sum(0)
    if not sums[0].sum() or not sums[1].sum():
        return np.zeros(len(every))
    some = np.flatnonzero(every)
    share = L.Isotonic(some.astype(np.float64), sums[0][some] / every[some], every[some]).share_at(np.arange(len(every)))
    base = sums[0].sum() / every.sum()
    odds = lambda p: np.log(p / (1 - p))
    return np.where(share > 2 * base, np.maximum(0.0, odds(np.clip(share, 1e-6, 0.98)) - odds(base)), 0.0)


def harmless_worth(sums: np.ndarray, worth: np.ndarray) -> float:
    """What a word without evidence takes from a document's: the log of how much rarer such words are in toxic documents."""
    if not (worth > 0).any():
        return 0.0
    share = (sums[:, worth == 0].sum(1) + 1) / (sums.sum(1) + 2)
    return float(max(0.0, np.log(share[1] / share[0])))


def _evidence_column(spark, model: Model):
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _evidence(shared.value)
        for batch in batches:
            yield pd.Series(known.of(list(batch)))

    return run


def score_column(docs: DataFrame, model: Model, text: Column | None = None) -> Column:
    """The score of a text column as an expression."""
    text = C.whole_text() if text is None else text
    if model.constant is not None:
        return F.lit(float(model.constant))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _evidence(shared.value)
        for batch in batches:
            yield pd.Series(shared.value.score(known.of(list(batch))))

    return run(text)


def add_score(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """Add score (0 to 1) and predicted (1 if the score reaches the cut)."""
    return docs.withColumn("score", score_column(docs, model)).withColumn("predicted", (F.col("score") >= cut).cast("int"))


def keep_clean(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """The rows whose text is not predicted to be toxic, with the columns they had; all of them if the model has learnt nothing."""
    return docs if model.constant is not None else docs.where(score_column(docs, model) < cut)
