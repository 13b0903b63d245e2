"""An inverted index in blocks, and exact ranked retrieval that skips blocks by bounds on their scores.

Units (files, chunks, symbols) are dealt to blocks of BLOCK as they are scanned.
The index has one row for each term of a block: the units that have it, by their
place in the block, how often each has it and where (as differences), and for
the bound the highest count and the least length among them. These lists are
bytes, as Spark moves, sorts and writes lists number by number. Rows with the empty
term hold a block's unit ids and lengths. A block is made inside one task, so a
common term costs one row per block that has it, never a row per occurrence, and
nothing is exchanged but finished rows, which Spark balances by size.

A phrase of one term is a posting as it stands; one of several is found by
differences of positions. A query asks for units that have all its phrases. Its
frequencies come from the rows' counts alone. A block that lacks a phrase is out;
what another block's units can score at most follows from its highest counts and
least lengths. The best few blocks by that bound are read first; then only those
that may still hold one of the k best. Ties go to the smaller unit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylake.functions import text
from quarrylake.functions.batches import slices
from quarrylake.plans import scratch

# Fixed values of the ranking rules.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Units of a block, and bytes of their terms, beyond which it has fewer units; blocks that a query reads before it knows what the others must reach.
BLOCK, BLOCK_BYTES, FIRST_BLOCKS = 1024, 8 << 20, 4
#: Packed lists are too many for a dictionary of them.
PLAIN = {f"parquet.enable.dictionary#{c}": "false" for c in ("places", "steps")}
#: Scores are told to so many digits; a bound this little below the k-th score is still looked into.
DIGITS = 6


def write_index(units: DataFrame, unit_id: str, columns: list[str], path: str, phrases: bool = True) -> None:
    """Write the index of some text columns of units; texts are split once, as they are scanned.

    A null text has no terms. A phrase lies inside one column, so a gap is left between them.
    Without ``phrases`` no positions are kept: such an index has all units and counts, and refuses phrases of several terms.
    """
    parts = [text.terms(F.coalesce(F.col(c), F.lit(""))) for c in columns]
    joined = parts[0]
    for p in parts[1:]:
        joined = F.concat(joined, F.array(F.lit("")), p)
    given = units.select(F.col(unit_id).alias("unit_id"), joined.alias("terms"))
    kind = given.schema["unit_id"].dataType.simpleString()
    size = BLOCK
    rows = given.mapInArrow(lambda batches: _blocks(batches, size, len(columns) - 1, phrases), f"term string, block long, n int, occurrences int, most int, least int, places binary, counts binary, steps binary, units array<{kind}>, lengths array<int>")
    rows.hint("rebalance", "term").sortWithinPartitions("term", "block").write.options(**PLAIN).parquet(path)


def _blocks(batches: Iterator[pa.RecordBatch], size: int, gaps: int, phrases: bool = True) -> Iterator[pa.RecordBatch]:
    """The rows of each block of units."""
    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 32
    for some in slices(batches, size, BLOCK_BYTES):
        yield _block(some.column(0), some.column(1), number, gaps, phrases)
        number += 1


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


#: The numbers of a packed list: as narrow as the largest of its block allows. Its width is told by its bytes and how many numbers it has.
WIDTHS = {1: np.dtype("<u1"), 2: np.dtype("<u2"), 4: np.dtype("<i4")}


def _packed(values: np.ndarray, offsets: np.ndarray) -> pa.BinaryArray:
    """Lists of numbers from zero up as bytes."""
    kind = next(t for t in WIDTHS.values() if values.max(initial=0) <= np.iinfo(t).max)
    ends = (np.asarray(offsets, np.int64) * kind.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values, kind))])


def _block(ids: pa.Array, terms: pa.ListArray, number: int, gaps: int, phrases: bool) -> pa.RecordBatch:
    """One block's rows: sorted by term, without a loop over terms or occurrences."""
    bounds = terms.offsets.to_numpy()
    flat, bounds = terms.flatten(), bounds - bounds[0]
    length = np.diff(bounds)
    coded = flat.dictionary_encode()
    names = coded.dictionary
    code = coded.indices.to_numpy(zero_copy_only=False)
    unit = np.repeat(np.arange(len(ids), dtype=np.int32), length)
    at = np.arange(len(flat), dtype=np.int32) - np.repeat(bounds[:-1].astype(np.int32), length)
    # A stable sort keeps units and positions in order within a term.
    order = np.argsort(code, kind="stable")
    code, unit, at = code[order], unit[order], at[order]
    new_term = np.concatenate([[True], code[1:] != code[:-1]]) if len(code) else np.zeros(0, bool)
    new_unit = new_term | np.concatenate([[True], unit[1:] != unit[:-1]]) if len(code) else new_term
    first, start = np.flatnonzero(new_unit), np.flatnonzero(new_term)
    steps = np.where(new_unit, at, at - np.concatenate([[0], at[:-1]])) if len(code) else at
    counts, places = np.diff(np.append(first, len(code))), unit[first]
    own = np.searchsorted(first, start)  # where each term's units begin
    dl = length - gaps
    n = np.diff(np.append(own, len(first)))
    most = np.maximum.reduceat(counts, own) if len(own) else own
    least = np.minimum.reduceat(dl[places], own) if len(own) else own
    occurrences = np.add.reduceat(counts, own) if len(own) else own
    term = names.take(pa.array(code[start])) if len(start) else pa.array([], pa.string())
    real = pa.compute.not_equal(term, "")
    columns = [
        term, pa.array(np.full(len(start), number), pa.int64()), pa.array(n, pa.int32()), pa.array(occurrences, pa.int32()), pa.array(most, pa.int32()), pa.array(least, pa.int32()),
        _packed(places, np.append(own, len(first))), _packed(counts, np.append(own, len(first))), _packed(steps, np.append(start, len(code))) if phrases else pa.nulls(len(start), pa.binary()),
        pa.nulls(len(start), pa.list_(ids.type)), pa.nulls(len(start), pa.list_(pa.int32())),
    ]
    names_ = ["term", "block", "n", "occurrences", "most", "least", "places", "counts", "steps", "units", "lengths"]
    rows = pa.RecordBatch.from_arrays(columns, names_).filter(real)
    whole = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    none = pa.nulls(1, pa.binary())
    head = pa.RecordBatch.from_arrays(
        [pa.array([""]), pa.array([number], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.array([0], pa.int32()), none, none, none, whole, _lists(dl, np.array([0, len(ids)]))], names_
    )
    return pa.concat_batches([head, rows]) if rows.num_rows else head


class Index:
    """A written index, and the questions it answers.

    ``queries`` are rows (query_id, phrase_no, phrase array<string>), a row for each phrase.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.rows = spark, spark.read.parquet(path)
        heads = self.rows.where("term = ''")
        total = heads.agg(F.sum("n").alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("terms")).first()
        self.units = total["n"] or 0
        self.mean = (total["terms"] or 0) / self.units if self.units else 1.0
        self.heads = heads.select("block", "units", "lengths")

    def terms(self) -> DataFrame:
        """(term, units, occurrences) over all units."""
        return self.rows.where("term <> ''").groupBy("term").agg(F.sum("n").alias("units"), F.sum("occurrences").alias("occurrences"))

    def all(self, queries: DataFrame, words: list[str] | None = None) -> DataFrame:
        """(query_id, unit_id, dl, score) of every unit that has all phrases of a query.

        ``words``: all terms of the queries, if they are few; then no other row groups are read.
        """
        found = self._phrases(queries, words)
        return self._scores(found, self._weights(found, queries), None)

    def parts(self, queries: DataFrame, words: list[str] | None = None) -> DataFrame:
        """(query_id, phrase_no, unit_id, dl, part): what each phrase adds to each unit that has it, whether the unit has the others or not.

        Units that share an id keep their own rows, so that a caller can put them together by it.
        """
        found = scratch.written(self._phrases(queries, words), "phrases-met")
        weights = self._each_weight(found)
        kinds = {f.name: f.dataType.simpleString() for f in found.schema}
        lists = found.select("query_id", "phrase_no", "block", "n", "places", "counts").mapInArrow(_unpacked, f"query_id {kinds['query_id']}, phrase_no {kinds['phrase_no']}, block long, places array<int>, counts array<int>")
        each = lists.join(self.heads, "block").select("query_id", "phrase_no", "units", "lengths", F.explode(F.arrays_zip("places", "counts")).alias("u"))
        units = each.select("query_id", "phrase_no", F.get("units", F.col("u.places")).alias("unit_id"), F.get("lengths", F.col("u.places")).alias("dl"), F.col("u.counts").alias("tf"))
        return units.join(weights, ["query_id", "phrase_no"]).select("query_id", "phrase_no", "unit_id", "dl", self._part(F.col("w"), F.col("tf"), F.col("dl")).alias("part"))

    def top(self, queries: DataFrame, k: int, words: list[str] | None = None) -> DataFrame:
        """(query_id, unit_id, dl, score, rank): the k best units of each query, scores to six digits."""
        found = self._phrases(queries, words)
        weights = self._weights(found, queries)
        blocks = scratch.written(self.bounded(found, weights), "blocks")
        first = self._scores(found, weights, blocks.where(F.col("place") <= FIRST_BLOCKS))
        first = scratch.written(ranked(first, k), "first")
        reached = first.where(F.col("rank") == k - 1).select("query_id", F.col("score").alias("reached"))
        rest = blocks.where(F.col("place") > FIRST_BLOCKS).join(reached, "query_id", "left").where(F.col("reached").isNull() | (F.col("bound") + 10.0**-DIGITS >= F.col("reached")))
        more = self._scores(found, weights, rest.select("query_id", "block"))
        return ranked(first.drop("rank").unionByName(more), k)

    def bounded(self, found: DataFrame, weights: DataFrame) -> DataFrame:
        """(query_id, block, bound, place): blocks that have all phrases, by what their units can score at most."""
        whole = found.groupBy("query_id", "block").agg(F.array_sort(F.collect_list(F.struct("phrase_no", "most", "least"))).alias("p")).join(weights, "query_id").where(F.size("p") == F.size("idf"))
        bound = F.aggregate(F.zip_with("p", "idf", lambda p, w: self._part(w, p["most"], p["least"])), F.lit(0.0), lambda a, x: a + x)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block"))
        return whole.select("query_id", "block", bound.alias("bound")).withColumn("place", place)

    def _part(self, idf: Column, tf: Column, dl: Column) -> Column:
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(self.mean or 1.0)))

    def _phrases(self, queries: DataFrame, words: list[str] | None) -> DataFrame:
        """(query_id, phrase_no, block, n, most, least, places, counts): where each phrase is; those of several terms are written."""
        rows = self.rows.where("term <> ''").select("term", "block", "n", "most", "least", "places", "counts", "steps")
        if words is not None:
            rows = rows.where(F.col("term").isin(sorted(set(words))))
        single = queries.where(F.size("phrase") == 1).select("query_id", "phrase_no", F.col("phrase")[0].alias("term"))
        out = rows.drop("steps").join(single, "term").select("query_id", "phrase_no", "block", "n", "most", "least", "places", "counts")
        several = queries.where(F.size("phrase") > 1)
        if several.isEmpty():
            return out
        if not rows.where("steps is not null").limit(1).count() and not rows.isEmpty():
            raise ValueError("this index has no positions: write it with phrases to ask for several terms side by side")
        # A phrase that more queries have is looked for once.
        phrases = several.select("phrase").distinct()
        asked = phrases.select("phrase", F.posexplode("phrase").alias("at", "term"))
        met = rows.join(asked, "term").groupBy("phrase", "block").agg(F.array_sort(F.collect_list(F.struct("at", "n", "places", "counts", "steps", "least"))).alias("parts")).where(F.size("parts") == F.size("phrase"))
        made = met.mapInArrow(_joined, "phrase array<string>, block long, n int, most int, least int, places binary, counts binary")
        made = scratch.written(made, "phrases")
        return out.unionByName(made.join(several, "phrase").select(*out.columns))

    def _weights(self, found: DataFrame, queries: DataFrame) -> DataFrame:
        """(query_id, idf): the weights of each query's phrases in order; a phrase that is nowhere has none, so its query has no result."""
        each = self._each_weight(found)
        whole = queries.groupBy("query_id").agg(F.count("*").alias("phrases"))
        known = each.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("phrase_no", "w"))).alias("p")).join(whole, "query_id").where(F.size("p") == F.col("phrases"))
        return scratch.written(known.select("query_id", F.transform("p", lambda x: x["w"]).alias("idf")), "weights")

    def _each_weight(self, found: DataFrame) -> DataFrame:
        """(query_id, phrase_no, w): the weight of each phrase that is somewhere."""
        n = F.lit(self.units)
        idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weight = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(F.greatest(idf, F.lit(LEAST_IDF)))
        return found.groupBy("query_id", "phrase_no").agg(F.sum("n").alias("df")).select("query_id", "phrase_no", weight.alias("w"))

    def _scores(self, found: DataFrame, weights: DataFrame, blocks: DataFrame | None) -> DataFrame:
        """(query_id, unit_id, dl, score) of the units in some blocks, or in all."""
        if blocks is not None:
            found = found.join(blocks.select("query_id", "block"), ["query_id", "block"], "left_semi")
        parts = found.groupBy("query_id", "block").agg(F.array_sort(F.collect_list(F.struct("phrase_no", "n", "places", "counts"))).alias("parts"))
        whole = parts.join(weights, "query_id").where(F.size("parts") == F.size("idf"))
        kind = whole.schema["query_id"].dataType.simpleString()
        both = whole.select("query_id", "block", "parts").mapInArrow(_met, f"query_id {kind}, block long, places array<int>, counts array<array<int>>")
        each = both.join(self.heads, "block").select("query_id", "units", "lengths", F.explode(F.arrays_zip("places", "counts")).alias("u"))
        units = each.select("query_id", F.get("units", F.col("u.places")).alias("unit_id"), F.get("lengths", F.col("u.places")).alias("dl"), F.col("u.counts").alias("tf")).join(weights, "query_id")
        score = F.aggregate(F.zip_with("tf", "idf", lambda t, w: self._part(w, t, F.col("dl"))), F.lit(0.0), lambda a, x: a + x)
        return units.select("query_id", "unit_id", "dl", score.alias("score"))


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query by score to six digits, with rank from 0."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "unit_id"))
    # The bare row number is compared, so that Spark keeps k rows of a query in each task before it exchanges them.
    return scored.withColumn("score", F.round("score", DIGITS)).withColumn("rank", place).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def _positions(places: np.ndarray, counts: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """(place, position) of each occurrence as one number."""
    count = counts.astype(np.int64)
    first = np.cumsum(count) - count
    steps = steps.astype(np.int64)
    at = np.cumsum(steps)
    at -= np.repeat(at[first] - steps[first], count)
    return (np.repeat(places.astype(np.int64), count) << 32) | at


def _each(parts: pa.StructArray, name: str) -> Callable[[int], np.ndarray]:
    """The list of each part in a field, as a view of Arrow's values: no number becomes an object."""
    lists = parts.field(name)
    if not pa.types.is_nested(lists.type):
        return _bytes(lists)
    bounds, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    return lambda k: values[bounds[k] : bounds[k + 1]]


def _bytes(lists: pa.BinaryArray) -> Callable[[int, int], np.ndarray]:
    """The packed list of each row, as a view, by the row and how many numbers it has."""
    _, ends, data = lists.cast(pa.binary()).buffers()
    bounds = np.frombuffer(ends, np.int32)[lists.offset : lists.offset + len(lists) + 1] if len(lists) else np.zeros(1, np.int32)
    values = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return lambda k, n: values[bounds[k] : bounds[k + 1]].view(WIDTHS[(bounds[k + 1] - bounds[k]) // n])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed places and counts as lists; the rest as it is, but for their number."""
    for batch in slices(batches):
        sizes = batch.column("n").to_numpy()
        flat = [_flat([get(k, n) for k, n in enumerate(sizes)]) for get in (_bytes(batch.column("places")), _bytes(batch.column("counts")))]
        kept = [c for c in batch.schema.names if c not in ("n", "places", "counts")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(_lists(v, _bounds(sizes)) for v in flat)], [*kept, "places", "counts"])


def _bounds(sizes: list[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]) if len(sizes) else np.zeros(1, np.int64)


def _flat(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, np.int64)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of phrases: positions of the first term at which all terms follow one another."""
    for batch in slices(batches):
        bounds, parts = batch.column(2).offsets.to_numpy(), batch.column(2).values
        at, least, n = (parts.field(c).to_numpy() for c in ("at", "least", "n"))
        places, counts, steps = (_each(parts, c) for c in ("places", "counts", "steps"))
        keep, where, often, shortest = [], [], [], []
        for row in range(batch.num_rows):
            start = None
            for k in range(bounds[row], bounds[row + 1]):
                often_k = counts(k, n[k])
                own = _positions(places(k, n[k]), often_k, steps(k, int(often_k.sum()))) - at[k]
                start = own if start is None else np.intersect1d(start, own, assume_unique=True)
                if not len(start):
                    break
            if len(start):
                found, times = np.unique(start >> 32, return_counts=True)
                keep.append(row)
                where.append(found)
                often.append(times)
                shortest.append(least[bounds[row] : bounds[row + 1]].max())
        some, ends = pa.array(keep, pa.int64()), _bounds([len(w) for w in where])
        columns = [
            batch.column(0).take(some), batch.column(1).take(some), pa.array(np.diff(ends), pa.int32()), pa.array([int(n.max()) for n in often], pa.int32()), pa.array([int(n) for n in shortest], pa.int32()),
            _packed(_flat(where), ends), _packed(_flat(often), ends),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["phrase", "block", "n", "most", "least", "places", "counts"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places that have all parts of a query, and how often each part is there."""
    for batch in slices(batches):
        bounds, parts = batch.column(2).offsets.to_numpy(), batch.column(2).values
        # Lists of parts are packed, and then their number is told, or are Arrow's own.
        told = [parts.field("n").to_numpy()] if "n" in {f.name for f in parts.type} else []
        places, counts = ((lambda k, get=_each(parts, c): get(k, *(n[k] for n in told))) for c in ("places", "counts"))
        keep, where, often, width = [], [], [], []
        for row in range(batch.num_rows):
            own = range(bounds[row], bounds[row + 1])
            both = places(own[0])
            for k in own[1:]:
                both = np.intersect1d(both, places(k), assume_unique=True)
            if len(both):
                keep.append(row)
                where.append(both)
                often.append(np.stack([counts(k)[np.searchsorted(places(k), both)] for k in own], 1).ravel())
                width.append(np.full(len(both), len(own)))
        some, ends = pa.array(keep, pa.int64()), _bounds([len(w) for w in where])
        each = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _lists(_flat(often), _bounds(_flat(width))))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some), _lists(_flat(where), ends), each], ["query_id", "block", "places", "counts"])
