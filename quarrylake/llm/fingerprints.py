"""Document fingerprints: I-Match over several randomised lexicons, in DataFrame functions only.

A lexicon keeps the terms whose inverse document frequency lies in a band. The
band's lower end on the document frequency is a share of the documents, so the
number of its terms has a bound that does not grow with the corpus (the mean
number of distinct terms of a document over that share). Membership is a bitmap
over hashed terms, with SPARE places for each kept term, sent to the tasks as one
value; a term that hashes to the place of a kept one (one in SPARE at most) joins
the lexicon, in every document alike.

Each of LEXICONS subsets keeps a term by bits of its hash, with several shares
of the lexicon between a quarter and a two-thousandth, so that for a text of any
length some subsets meet a few of its terms. A text's distinct terms in the
lexicon are sorted and each subset of them is hashed; the fingerprint is the
list of these hashes. A text without a term in the lexicon takes all its terms,
and one without terms its characters.

The likeness of two fingerprints is the share of subsets that agree among those
that meet a term of either text.

Defined cases: a null text is the empty text; texts are in the order of
descending document id, then text; rows without an id come last; repeated rows
have each their own place there; very long texts are read whole; extra columns are
left out; an empty table gives an empty result.
"""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.llm import _common as C

#: Kept terms are in at least and at most these shares of the documents.
LEAST_SHARE, MOST_SHARE = 0.0005, 0.2
#: Least places of the bitmap, as a power of two, and places for each kept term.
PLACES, SPARE = 20, 16
#: Bits of a term's hash that must be zero for a subset to keep it, and the subsets of each such density.
DENSITIES = (2, 4, 5, 6, 7, 8, 9, 11)
SUBSETS = 6
NOTHING = "00000000"
#: Most ranges of ids.
MOST_RANGES = 32_768
TERM = r"[^\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    """The distinct terms of a text: runs of letters and digits in lower case."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), TERM)), "")


def lexicon(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> tuple[Column, int]:
    """The bitmap (an array of longs) of hashed terms whose document frequency is in the band, as a constant, and its places as a power of two.

    Counts are over all documents and summed within tasks before they are
    exchanged; only the bitmap, whose size follows from the bound on the kept
    terms, reaches the driver. In a
    corpus so small that the band would end below two documents, terms of a
    single document are still left out.
    """
    number = docs.count()
    low, high = max(2, ceil(least * number)), max(2, int(most * number))
    counted = docs.select(F.explode(terms(C.whole_text())).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    kept = C.spill(counted.where(F.col("n").between(low, high)).select(F.xxhash64("term").alias("h")), "lexicon")
    places = max(PLACES, (SPARE * kept.count() - 1).bit_length())
    place = kept.select(F.shiftrightunsigned("h", 64 - places).alias("place"))
    bits = place.select(F.shiftright("place", 5).alias("word"), F.expr("shiftleft(1L, cast(place & 31 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    words = [0] * (1 << (places - 5))
    for r in bits.collect():
        words[r["word"]] = r["bits"]
    return F.from_json(F.lit(str(words)), "array<bigint>"), places


def _let(value: Column, of) -> Column:
    """``of(value)`` with the value computed once per row."""
    return F.element_at(F.transform(F.array(value), of), 1)


def fingerprint(text: Column, terms_kept: tuple[Column, int]) -> Column:
    """The fingerprint of a text: a hash of eight hexadecimal digits per subset, zeros for a subset without terms."""

    bitmap, places = terms_kept

    def in_lexicon(h: Column) -> Column:
        word = F.get(bitmap, F.shiftrightunsigned(h, 64 - places + 5).cast("int"))
        bit = F.shiftrightunsigned(h, 64 - places).bitwiseAND(F.lit(31).cast("long"))
        return F.call_function("getbit", word, bit.cast("int")) == 1

    def subset(h: Column, k: int) -> Column:
        def step(done: Column, mask: Column) -> Column:
            kept = F.filter(done["h"], lambda x: F.shiftright(x, 9 * k).bitwiseAND(mask) == 0)
            told = lambda h: F.when(F.size(h) > 0, F.lpad(F.lower(F.hex(F.xxhash64(h).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))), 8, "0")).otherwise(F.lit(NOTHING))
            return _let(kept, lambda h: F.struct(h.alias("h"), F.concat(done["s"], told(h)).alias("s")))

        return F.aggregate(F.array(*(F.lit((1 << b) - 1).cast("long") for b in DENSITIES)), F.struct(h.alias("h"), F.lit("").alias("s")), step, lambda done: done["s"])

    hashes = F.transform(F.array_sort(terms(text)), lambda t: F.xxhash64(t))
    chosen = _let(hashes, lambda h: _let(F.filter(h, in_lexicon), lambda inside: F.when(F.size(inside) > 0, inside).when(F.size(h) > 0, h).otherwise(F.array(F.xxhash64(text)))))
    return _let(chosen, lambda h: F.concat(*(subset(h, k) for k in range(SUBSETS))))


def likeness(a: Column, b: Column) -> Column:
    """Between 0 and 1: the share of subsets that agree among those that meet a term of either text."""
    def step(done: Column, p: Column) -> Column:
        x, y = F.substr(a, p, F.lit(8)), F.substr(b, p, F.lit(8))
        same = done["same"] + ((x == y) & (x != NOTHING)).cast("int")
        return F.struct(same.alias("same"), (done["met"] + ((x != NOTHING) | (y != NOTHING)).cast("int")).alias("met"))

    none = F.struct(F.lit(0).alias("same"), F.lit(0).alias("met"))
    share = F.aggregate(F.sequence(F.lit(1), F.length(a), F.lit(8)), none, step, lambda done: F.when(done["met"] > 0, done["same"] / done["met"]).otherwise(F.lit(0.0)))
    return F.when(a == b, F.lit(1.0)).otherwise(share)


def ranges(rows: DataFrame, number: int) -> Column:
    """The range of doc_id that a row is in, from 0; ranges hold about equally many rows, however ids are spread. Nulls have -1.

    The bounds are quantiles, as many as the root of the rows (MOST_RANGES at
    most), sent to the tasks as one value; a row finds its range by bisection.
    """
    most = min(MOST_RANGES, max(1, ceil(sqrt(number))))
    shares = F.array(*(F.lit(k / most) for k in range(1, most)))
    found = rows.agg(F.approx_percentile("doc_id", shares, F.lit(10 * most)).alias("q")).first()["q"] if most > 1 else None
    bounds = sorted(set(found or []))
    if not bounds:
        return F.when(F.col("doc_id").isNotNull(), F.lit(0)).otherwise(F.lit(-1)).cast("long")
    known, steps = F.from_json(F.lit(str(bounds)), "array<bigint>"), F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        over = (s["low"] < s["high"]) & (F.get(known, middle) < F.col("doc_id"))
        return F.struct(F.when(over, middle + 1).otherwise(s["low"]).alias("low"), F.when(over, s["high"]).otherwise(F.least(middle, s["high"])).alias("high"))

    place = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high")), halve, lambda s: s["low"])
    return F.when(F.col("doc_id").isNotNull(), place).otherwise(F.lit(-1)).cast("long")


def with_next(docs: DataFrame, bitmap: tuple[Column, int]) -> DataFrame:
    """doc_id, text, its fingerprint, and next: text and fingerprint of the document that follows.

    The order is that of descending doc_id, and the first follows the last. Rows
    are dealt to ranges of ids. Each text is exchanged once; a small join ties
    the end of one range to the head of the next.
    """
    rows = docs.select("doc_id", C.whole_text().alias("text"))
    dealt = rows.withColumn("range", ranges(docs.select("doc_id"), docs.count()))
    signed = F.struct("text", "fingerprint")
    inside = Window.partitionBy("range").orderBy(F.col("doc_id").desc_nulls_last(), "text")
    led = dealt.withColumn("fingerprint", fingerprint(F.col("text"), bitmap)).withColumn("next", F.lead(signed).over(inside))
    tops = dealt.groupBy("range").agg(F.max("doc_id").alias("top"))
    ring = Window.orderBy(F.col("range").desc())
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = tops.select(F.coalesce(F.lead("range").over(ring), F.first("range").over(whole)).alias("range"), F.col("range").alias("owner"))
    # One row per range: at most the root of the number of documents.
    first = dealt.join(F.broadcast(tops), "range").where(F.col("doc_id").eqNullSafe(F.col("top"))).groupBy("range").agg(F.min("text").alias("text"))
    heads = first.withColumn("fingerprint", fingerprint(F.col("text"), bitmap)).join(follows, "range").select(F.col("owner").alias("range"), signed.alias("head"))
    return led.join(heads, "range").select("doc_id", "text", "fingerprint", F.coalesce("next", "head").alias("next"))


def compared(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next document's.

    The edited text has its last third (rounded down to code points) replaced by
    as many of the first code points of the next document, or all it has.
    """
    bitmap = lexicon(docs)
    third = F.floor(F.char_length("text") / 3).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), F.char_length("text") - third), F.col("next.text").substr(F.lit(1), third))
    rows = with_next(docs, bitmap).select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "fingerprint", F.col("next.fingerprint").alias("after"), edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "after", fingerprint(F.col("edited"), bitmap).alias("edited_fingerprint"))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("after")).alias("near_next"))
