"""Near-duplicate documents by ProbMinHash over weighted five-word shingles.

Each shingle of a document sends arrivals of a Poisson process, whose rate is
the shingle's weight, to random registers; a register keeps the shingle that
came first. Arrivals are drawn in rounds and stop for a shingle once it is later
than the document's latest register. Two documents agree in a register with the
probability Jaccard similarity of their weighted shingles. Registers are grouped
into bands; documents that share a band are candidates and are verified on all
their shingles.

Equal texts are one class before banding. Within a bucket of a band, members are
first compared with one centre, the member that shares most buckets. Buckets
that this leaves in several components are dealt out in pairs of blocks; there,
members of different components are compared, first by their registers and then
on all their shingles, until they are one. So a group of copies costs as many
comparisons as it has members, no link between different components is left
untried, and pairs are never rows.

A word is a run of ASCII letters, digits and underscores or of any other
non-ASCII characters, in lower case. A shingle's weight is 1 + ln(times it
occurs). A document of one to four words has one shingle, all its words.

Defined cases: a null text is the empty text; texts without words are linked
only with equal texts; rows without an id are linked with nothing and have a
null component; repeated rows share their component; two texts under one id are
two documents, each in its own component; very long texts are hashed in blocks
and compared in tasks of bounded bytes, one text at least; extra columns are left
out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.llm import _common as C
from quarrylake.llm._components import components

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 21, 6
#: Bytes of text worked on at once.
CHUNK = 2_000_000
#: Comparisons with one centre that one task does at most, about.
MEMBERS_PER_GROUP = 128
#: Members of a bucket that one task compares with as many others, and bytes of their texts, about.
BLOCK, BLOCK_BYTES = 1024, 16_000_000
#: Share of equal registers below which a pair is not compared further: five standard deviations below the least similarity.
REGISTERS_AGREE = 0.62
SALTS = 8

_WORD_BYTE = np.zeros(256, bool)
for _b in range(256):
    _WORD_BYTE[_b] = _b >= 128 or chr(_b).isalnum() or chr(_b) == "_"
_BYTE_VALUE = np.random.default_rng(17).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_STEP = [np.uint64(x | 1) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers without visible order."""
    x = (x ^ (x >> np.uint64(30))) * _STEP[0]
    x = (x ^ (x >> np.uint64(27))) * _STEP[1]
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if 0 not in _POWERS or len(_POWERS[0][0]) <= n:
        _POWERS[0] = _powers(_BASE, n), _powers(_INVERSE, n)
    return _POWERS[0]


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts, and its hash; worked out in blocks that end between words, so one long text costs no more memory."""
    starts, hashes, begin = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while begin < len(data):
        end = min(len(data), begin + CHUNK)
        raw = np.frombuffer(data, np.uint8, end - begin, begin)
        word = _WORD_BYTE[raw]
        if end < len(data) and word[-1]:
            gaps = np.flatnonzero(~word)
            if len(gaps):
                raw, word = raw[: gaps[-1] + 1], word[: gaps[-1] + 1]
            else:  # one word longer than a block
                end = next(k for k in range(end, len(data)) if not _WORD_BYTE[data[k]])
                raw = np.frombuffer(data, np.uint8, end - begin, begin)
                word = _WORD_BYTE[raw]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
        start, stop = edge[::2], edge[1::2]
        power, inverse = _tables(len(raw) + 1)
        total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE_VALUE[raw] * power[: len(raw)], dtype=np.uint64)])
        starts.append(start + begin)
        hashes.append(mix((total[stop] - total[start]) * inverse[start] + (stop - start).astype(np.uint64)))
        begin += len(raw)
    return np.concatenate(starts), np.concatenate(hashes)


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, weight) of several texts, sorted by document and shingle."""
    data = [t.lower().encode("utf-8", "replace") + b"\n" for t in texts]
    ends = np.cumsum([len(d) for d in data])
    start, hashed = _word_hashes(b"".join(data))
    if not len(start):
        none = np.zeros(0, np.uint64)
        return none.astype(np.int64), none, none.astype(np.float64)
    doc = np.searchsorted(ends, start, side="right")
    count = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(count) - count
    whole = np.zeros(0, np.int64)
    n = len(hashed)
    if n >= WORDS:
        at = np.flatnonzero(doc[: n - WORDS + 1] == doc[WORDS - 1 :])
        made = sum((hashed[at + k] * _STEP[k] for k in range(1, WORDS)), hashed[at] * _STEP[0])
    else:
        at, made = whole, np.zeros(0, np.uint64)
    short = np.flatnonzero((count > 0) & (count < WORDS))
    few = np.array([np.bitwise_xor.reduce(mix(hashed[first[d] : first[d] + count[d]] + np.arange(count[d], dtype=np.uint64))) for d in short], np.uint64)
    doc = np.concatenate([doc[at], short])
    made = mix(np.concatenate([made, few]))
    order = np.lexsort((made, doc))
    doc, made = doc[order], made[order]
    fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | (made[1:] != made[:-1])])
    at = np.flatnonzero(fresh)
    times = np.diff(np.append(at, len(doc)))
    return doc[at], made[at], 1 + np.log(times)


def signatures(docs: int, doc: np.ndarray, element: np.ndarray, weight: np.ndarray, registers: int) -> np.ndarray:
    """ProbMinHash registers (documents x registers) of weighted elements."""
    earliest = np.full(docs * registers, np.inf)
    keeps = np.zeros(docs * registers, np.uint64)
    time = np.zeros(len(doc))
    shift = np.zeros(1, np.uint64)
    while len(doc):
        shift += _STEP[2]
        draw = mix(element + shift)
        time = time - np.log1p(-((draw >> np.uint64(11)) * 2.0**-53)) / weight
        cell = doc * registers + (mix(draw + _STEP[3]) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(earliest, cell, time)
        won = time == earliest[cell]
        keeps[cell[won]] = element[won]
        latest = earliest.reshape(docs, registers).max(1)
        on = time < latest[doc]
        doc, element, weight, time = doc[on], element[on], weight[on], time[on]
    return keeps.reshape(docs, registers)


def bands(kept: np.ndarray, number: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band of a signature."""
    part = kept.reshape(len(kept), number, rows)
    key = np.broadcast_to(np.arange(number, dtype=np.uint64), (len(kept), number)).copy()
    for k in range(rows):
        key = mix(key * _STEP[4] + part[:, :, k])
    return key.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity of two weighted sets (sorted elements, weights)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    place = np.minimum(a[0].searchsorted(b[0]), len(a[0]) - 1)
    j = np.flatnonzero(a[0][place] == b[0])
    i = place[j]
    if not len(i):
        return 0.0
    x, y = a[1][i], b[1][j]
    if (a[1] == 1).all() and (b[1] == 1).all():
        return len(i) / (len(a[0]) + len(b[0]) - len(i))
    # The sum over shared d of 1 / sum over all e of max(x_e / x_d, y_e / y_d): by the order of y / x both parts are prefix sums.
    ratio = y / x
    order = np.argsort(ratio)
    sx, sy = np.cumsum(x[order]), np.cumsum(y[order])
    low = np.searchsorted(ratio[order], ratio[order], side="right") - 1
    only_x, only_y = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    total = (sx[low] + only_x) / x[order] + (sy[-1] - sy[low] + only_y) / y[order]
    return float((1 / total).sum())


def _pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK characters each."""
    begin, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size > CHUNK or k == len(texts) - 1:
            yield begin, k + 1
            begin, size = k + 1, 0


def signed(docs: DataFrame, number: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, the MD5 digest of the text (two numbers) and its band keys (empty for a text without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in _pieces(texts):
                some = texts[begin:end]
                doc, element, weight = shingles(some)
                has = np.zeros(len(some), bool)
                has[doc] = True
                near = np.flatnonzero(has)
                place = np.cumsum(has) - 1
                keys = bands(signatures(len(near), place[doc], element, weight, number * rows), number, rows) if len(near) else np.zeros((0, number), np.int64)
                digest = np.frombuffer(b"".join(hashlib.md5(t.encode("utf-8", "replace")).digest() for t in some), ">i8").astype(np.int64).reshape(-1, 2)
                offsets = np.concatenate([[0], np.cumsum(has * number)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))], ["doc_id", "k1", "k2", "bands"])

    return docs.select(F.col("doc_id").cast("long"), C.whole_text().alias("text")).mapInArrow(run, "doc_id long, k1 long, k2 long, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs (centre, member) whose texts are similar enough, as edges (u, v).

    Members stream past their centre: a centre with many members is repeated in
    as many groups as it needs, so no task holds more than one group's centre.
    """
    sizes = pairs.groupBy("centre").agg(F.ceil(F.count("*") / MEMBERS_PER_GROUP).cast("long").alias("groups"))
    members = pairs.join(texts.withColumnRenamed("doc_id", "member").hint("merge"), "member").select("centre", F.pmod(F.xxhash64("member"), F.lit(1 << 20)).alias("deal"), "member", "text")
    heads = sizes.join(texts.withColumnRenamed("doc_id", "centre").hint("merge"), "centre").withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
    rows = _salted(members, sizes, "centre", "member").select("centre", F.pmod("deal", "groups").alias("group"), F.lit(1).alias("role"), "member", "text").unionByName(heads.select("centre", "group", F.lit(0).alias("role"), F.col("centre").alias("member"), "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, head = None, (np.zeros(0, np.uint64), np.zeros(0))
        for batch in batches:
            data = batch.to_pydict()
            u: list[int] = []
            v: list[int] = []
            for begin, end in _pieces(data["text"]):
                doc, element, weight = shingles(data["text"][begin:end])
                cut = np.searchsorted(doc, np.arange(end - begin + 1))
                for k in range(begin, end):
                    a, b = cut[k - begin], cut[k - begin + 1]
                    this = element[a:b], weight[a:b]
                    if data["role"][k] == 0:
                        own, head = (data["centre"][k], data["group"][k]), this
                    elif own == (data["centre"][k], data["group"][k]) and similarity(head, this) >= least:
                        u.append(data["centre"][k])
                        v.append(data["member"][k])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "centre", "group").sortWithinPartitions("centre", "group", "role").mapInArrow(run, "u long, v long")


def across(mixed: DataFrame, texts: DataFrame, least: float = SIMILARITY, number: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Edges (u, v) between members (band, rep, own) of a bucket that are in different components ``own`` but similar enough."""
    lengths = texts.select(F.col("doc_id").alias("rep"), F.octet_length("text").alias("bytes"))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES))
    sizes = mixed.join(lengths, "rep").groupBy("band").agg(blocks.cast("long").alias("blocks"))
    placed = _salted(mixed, sizes, "band", "rep").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))
    others = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    dealt = placed.withColumn("other", F.explode(others)).select("band", "rep", "own", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).alias("side"))
    full = dealt.join(texts.withColumnRenamed("doc_id", "rep").hint("merge"), "rep")

    def compare(group: list[tuple]) -> tuple[list[int], list[int]]:
        rep, own, side, words = zip(*group, strict=True)
        doc, element, weight = shingles(list(words))
        cut = np.searchsorted(doc, np.arange(len(rep) + 1))
        kept = signatures(len(rep), doc, element, weight, number * rows)
        one_block = not any(side)
        parent = {x: x for x in own}

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        u, v = [], []
        apart = np.array(side)
        for a in range(len(rep) - 1):
            near = np.flatnonzero((kept[a + 1 :] == kept[a]).mean(1) >= REGISTERS_AGREE) + a + 1
            for b in near if one_block else near[apart[near] != apart[a]]:
                x, y = find(own[a]), find(own[b])
                if x != y and similarity((element[cut[a] : cut[a + 1]], weight[cut[a] : cut[a + 1]]), (element[cut[b] : cut[b + 1]], weight[cut[b] : cut[b + 1]])) >= least:
                    parent[x] = y
                    u.append(rep[a])
                    v.append(rep[b])
        return u, v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        for batch in batches:
            d = batch.to_pydict()
            u: list[int] = []
            v: list[int] = []
            for now, row in zip(zip(d["band"], d["i"], d["j"], strict=True), zip(d["rep"], d["own"], d["side"], d["text"], strict=True), strict=True):
                if now != key:
                    if len(group) > 1:
                        a, b = compare(group)
                        u, v = u + a, v + b
                    key, group = now, []
                group.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
        if len(group) > 1:
            u, v = compare(group)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    n = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return full.repartition(n, "band", "i", "j").sortWithinPartitions("band", "i", "j", "side").mapInArrow(run, "u long, v long")


def _salted(many: DataFrame, few: DataFrame, key: str, by: str) -> DataFrame:
    """Inner join of ``many`` rows of a key, told apart by ``by``, with the ``few`` rows that have each key once, dealt to SALTS places."""
    salts = F.explode(F.array(*(F.lit(k).cast("long") for k in range(SALTS)))).alias("__salt")
    return many.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS))).join(few.select("*", salts).hint("merge"), [key, "__salt"]).drop("__salt")


def _digest(k1: str = "k1", k2: str = "k2"):
    """The digest as MD5 writes it, from its two numbers."""
    return F.lower(F.concat(F.lpad(F.hex(k1), 16, "0"), F.lpad(F.hex(k2), 16, "0")))


def _grouped(docs: DataFrame, least: float) -> DataFrame:
    """doc_id, digest (of the text), component_id and kept of every row.

    A class of equal texts has a number of its own, so that two texts under one
    id are two documents. Of a component, the class with the smallest doc_id
    (among equals: the smallest number) is the one kept.
    """
    rows = C.spill(signed(docs), "minhash-signed")
    grouped = rows.where("doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.max("bands").alias("bands"))
    classes = C.spill(grouped.withColumn("rep", F.monotonically_increasing_id()), "minhash-classes")
    every = classes.select("rep", F.explode("bands").alias("band"))
    shared = every.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    inside = C.spill(_salted(every, shared, "band", "rep").select("band", "rep", "n"), "minhash-buckets")
    degree = inside.groupBy("rep").agg(F.sum("n").alias("degree"))
    ranked = C.spill(inside.select("band", "rep").join(degree, "rep"), "minhash-ranked")
    centres = ranked.groupBy("band").agg(F.max(F.struct("degree", (-F.col("rep")).alias("rep"))).alias("top")).select("band", (-F.col("top.rep")).alias("centre"))
    around = _salted(ranked, centres, "band", "rep")
    pairs = C.spill(around.where("rep <> centre").select("centre", F.col("rep").alias("member")).distinct(), "minhash-pairs")
    wanted = ranked.select("rep").distinct().join(classes.select("rep", F.col("first").alias("doc_id"), _digest().alias("digest")), "rep")
    own_text = docs.select(F.col("doc_id").cast("long"), C.whole_text().alias("text")).join(wanted.hint("merge"), "doc_id").where(F.md5(F.col("text").cast("binary")) == F.col("digest"))
    texts = C.spill(own_text.select(F.col("rep").alias("doc_id"), "text").dropDuplicates(["doc_id"]), "minhash-texts")
    first = C.spill(verified(pairs, texts, least), "minhash-edges")
    label = C.spill(components(first), "minhash-labels")
    placed = C.spill(ranked.join(label.withColumnRenamed("id", "rep"), "rep", "left").select("band", "rep", F.coalesce("component_id", "rep").alias("own")), "minhash-placed")
    mixed = placed.groupBy("band").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo <> hi").select("band")
    left = C.spill(_salted(placed, mixed, "band", "rep"), "minhash-mixed")
    second = C.spill(across(left, texts, least), "minhash-edges")
    label = components(first.unionByName(second))
    named = C.spill(classes.select("k1", "k2", "rep", "first").join(label.withColumnRenamed("id", "rep"), "rep", "left").withColumn("own", F.coalesce("component_id", "rep")).drop("component_id"), "minhash-named")
    top = named.groupBy("own").agg(F.min(F.struct("first", "rep")).alias("top"))
    found = C.spill(named.join(top, "own").select("k1", "k2", F.col("top.first").alias("component_id"), (F.col("rep") == F.col("top.rep")).alias("chosen")), "minhash-found")
    C.drop(inside, ranked, pairs, texts, first, placed, left, second, classes, named)
    out = rows.select("doc_id", "k1", "k2").join(found, ["k1", "k2"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", _digest().alias("digest"), own.alias("component_id"), F.coalesce((F.col("doc_id") == own) & F.col("chosen"), F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, component_id (smallest doc_id of its group of near-duplicates) and kept (it is the one of its group that stays)."""
    return _grouped(docs, least).select("doc_id", "component_id", "kept")


def one_of_each(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of one document of each group, the smallest doc_id's, with all their columns; repeated rows once.

    Rows without an id are no copies of any other and stay.
    """
    stay = _grouped(docs.select("doc_id", "text"), least).where("kept and doc_id is not null").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).distinct()
    same = (docs["doc_id"].cast("long") == F.col("__id")) & (F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary")) == F.col("__digest"))
    return docs.join(stay, same, "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id is null"))
