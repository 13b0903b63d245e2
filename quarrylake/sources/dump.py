"""Packed dumps: text files that hold a tree's listing and its files in fences.

A dump is read by byte ranges, by as many tasks as it has ranges. What a line of
a range means depends on what came before: it may lie outside of files, after a
header, or in a fence of some number of marks. So each range first tells, for
each of these beginnings, how it would end; that is a few small rows. Joined up
in order they give each range its true beginning, and the ranges are read once
more, each giving its parts of files.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the format.
FILE_HEADER = "## File: "
TREE_HEADER = "# Directory Structure"
LEAST_MARKS = 3
HEAD_CHARS, PEEK_CHARS = 4096, 200_000
MARKS = ("Repomix", "packed representation")
TRANSFORMS = {"line numbers have been added": "line_numbers", "comments have been removed": "comments_removed", "empty lines have been removed": "empty_lines_removed", "content has been compressed": "compressed"}
#: Characters of a file that are given out as one part.
PART_CHARS = 1_000_000


def _head(path: str, most: int) -> str:
    with open(path, encoding="utf-8", errors="replace") as f:
        return f.read(most)


def looks_like_dump(path: str) -> bool:
    """True if a file's beginning tells that it is a packed dump and a file header follows soon."""
    try:
        head = _head(path, PEEK_CHARS)
    except OSError:
        return False
    return any(m in head[:HEAD_CHARS] for m in MARKS) and FILE_HEADER in head


def declared_transforms(path: str) -> list[str]:
    """What a dump says was done to its files."""
    low = _head(path, HEAD_CHARS).lower()
    return [tag for needle, tag in TRANSFORMS.items() if needle in low]


class Place(NamedTuple):
    """Where a line lies: outside of files (no name, no marks), after a header (name), or in a fence (marks); a file is told by where its fence opened."""

    name: str | None = None
    marks: int = 0
    opened: int = -1
    number: int = -1


OUTSIDE = Place()
#: Stands for the name that a range does not know yet.
UNKNOWN = "\0"


def marks_of(line: str) -> int:
    """Marks of a line that may open a fence: nothing but marks and a word of letters, digits, dots, plus and minus signs; 0 for others."""
    bare = line.strip()
    word = bare.lstrip("`")
    marks = len(bare) - len(word)
    return marks if marks >= LEAST_MARKS and all(c.isalnum() or c in "_.+-" for c in word.strip()) else 0


def closes(line: str) -> int:
    """Marks of a line that is nothing else; 0 for others."""
    return len(line) if len(line) >= LEAST_MARKS and not line.strip("`") else 0


def after(place: Place, line: str, block: int, number: int) -> Place:
    """The place of the line after this one.

    A header counts only if a fence opens next, blank lines apart. A fence goes on
    to the line that is just its marks, or to the end.
    """
    if place.marks:
        return OUTSIDE if closes(line) == place.marks else place
    if line.startswith(FILE_HEADER):
        return Place(line[len(FILE_HEADER) :].strip())
    if place.name is None or not line.strip():
        return place
    marks = marks_of(line)
    return Place(place.name, marks, block, number) if marks else OUTSIDE


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Lines by range: ((dump, block), lines); a range's lines come one after another."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    return groupby(rows, key=lambda r: r[:2])


SUMMARY = "dump string, block long, begins int, name string, marks int, opened long, number long"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How a range ends for each beginning: -1 outside, 0 after a header, or the marks of a fence that it closes; others go on through it."""
    for (dump, block), lines in _ranges(batches):
        ends = {-1: OUTSIDE, 0: Place(UNKNOWN)}
        for number, row in enumerate(lines):
            line = row[2]
            ends = {k: after(p, line, block, number) for k, p in ends.items()}
            marks = closes(line)
            if marks:
                ends.setdefault(marks, OUTSIDE)
        columns = list(zip(*((dump, block, k, *p) for k, p in ends.items()), strict=True))
        kinds = pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [f.split()[0] for f in SUMMARY.split(", ")])


BEGIN = "dump string, block long, name string, marks int, opened long, number long"


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each range of a dump begins, from all its summaries in order."""
    for batch in batches:
        for dump, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            place, out = OUTSIDE, []
            for block, own in groupby(ends, key=lambda e: e["block"]):
                out.append((dump, block, *place))
                known = {e["begins"]: Place(e["name"], e["marks"], e["opened"], e["number"]) for e in own}
                end = known.get(place.marks or (-1 if place.name is None else 0), place)
                place = end._replace(name=place.name) if end.name == UNKNOWN else end
            kinds = pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [f.split()[0] for f in BEGIN.split(", ")])


PART = "dump string, opened long, number long, path string, block long, part int, lines int, text string"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of files: (lines joined) of each file in a range, in pieces of bounded size; the first part of a file may be empty."""
    kinds = pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string()
    out: list[tuple] = []
    held = 0
    for (dump, block), lines in _ranges(batches):
        place, body, chars, part = None, [], 0, 0
        for number, row in enumerate(lines):
            if place is None:
                place = Place(*row[3:7])
            line = row[2]
            then = after(place, line, block, number)
            if place.marks and then.marks:
                body.append(line)
                chars += len(line) + 1
            elif then.marks:
                out.append((dump, block, number, then.name, block, -1, 0, ""))
            if place.marks and body and (not then.marks or chars > PART_CHARS):
                out.append((dump, place.opened, place.number, place.name, block, part, len(body), "\n".join(body)))
                held, part, body, chars = held + chars, part + 1, [], 0
            if held > PART_CHARS or len(out) > 5000:
                yield _batch(out, kinds)
                out, held = [], 0
            place = then
        if place is not None and body:
            out.append((dump, place.opened, place.number, place.name, block, part, len(body), "\n".join(body)))
    if out:
        yield _batch(out, kinds)


def _batch(rows: list[tuple], kinds: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in PART.split(", ")])


def lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """(dump, block, value) of every line, by byte ranges; lines end with line feeds alone."""
    read = spark.read.option("lineSep", "\n").text(files)
    return read.select(F.col("_metadata.file_path").alias("dump"), F.col("_metadata.file_block_start").alias("block"), F.make_valid_utf8("value").alias("value"))


def read_dumps(spark: SparkSession, files: list[str]) -> DataFrame:
    """(dump, path, text) of every file in packed dumps."""
    given = lines(spark, files)
    ends = given.mapInArrow(_summaries, SUMMARY)
    begins = ends.groupBy("dump").agg(F.array_sort(F.collect_list(F.struct("block", "begins", "name", "marks", "opened", "number"))).alias("ends")).mapInArrow(_beginnings, BEGIN)
    # As many rows as ranges, of which the driver plans each; a broadcast keeps the lines in their order.
    met = given.join(F.broadcast(begins.withColumnsRenamed({"dump": "d", "block": "b"})), (F.col("dump") == F.col("d")) & (F.col("block") == F.col("b")))
    parts = met.select("dump", "block", "value", "name", "marks", "opened", "number").mapInArrow(_parts, PART)
    own = F.array_sort(F.collect_list(F.when(F.col("lines") > 0, F.struct("block", "part", "text"))))
    whole = parts.groupBy("dump", "opened", "number").agg(F.max("path").alias("path"), own.alias("own"))
    return whole.select("dump", "path", F.array_join(F.transform("own", lambda p: p["text"]), "\n").alias("text"))


def read_listings(spark: SparkSession, files: list[str]) -> DataFrame:
    """(dump, path) of every path that the dumps list: two spaces a level, a slash after directories.

    The listing lies in the first fence after its header. An entry belongs to the
    last entry above it of each lower level, where that is a directory.
    """
    at = F.struct("block", "id").alias("at")
    fenced = F.ltrim(F.col("value")).startswith("`" * LEAST_MARKS)
    given = lines(spark, files).withColumn("id", F.monotonically_increasing_id()).select("dump", at, "value")
    header = given.where(F.trim(F.col("value")) == TREE_HEADER).groupBy("dump").agg(F.min("at").alias("begin"))
    fences = given.where(fenced).select("dump", "at")
    first = fences.join(header, "dump").where(F.col("at") > F.col("begin")).groupBy("dump").agg(F.min("at").alias("begin"))
    last = fences.join(first, "dump").where(F.col("at") > F.col("begin")).groupBy("dump").agg(F.min("at").alias("end"))
    inside = given.join(first, "dump").join(last, "dump", "left").where((F.col("at") > F.col("begin")) & (F.col("end").isNull() | (F.col("at") < F.col("end"))) & (F.trim(F.col("value")) != ""))
    level = F.floor((F.length("value") - F.length(F.ltrim(F.col("value")))) / 2).cast("int")
    entries = inside.select("dump", "at", level.alias("level"), F.trim(F.col("value")).alias("name"))
    deepest = entries.agg(F.max("level")).first()[0] or 0
    above = Window.partitionBy("dump").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    on = [F.last(F.when(F.col("level") <= k, F.struct("level", "name")), ignorenulls=True).over(above).alias(f"__{k}") for k in range(deepest)]
    chain = [F.when((F.col("level") > k) & (F.col(f"__{k}.level") == k) & F.col(f"__{k}.name").endswith("/"), F.rtrim(F.col(f"__{k}.name"), F.lit("/"))) for k in range(deepest)]
    return entries.select("*", *on).where(~F.col("name").endswith("/")).select("dump", F.concat_ws("/", *chain, "name").alias("path"))


def facts(spark: SparkSession, files: list[str]) -> DataFrame:
    """(dump, is_dump, transforms, entries): whether each file is a packed dump, what its head says was done to its files, and its file headers."""
    given = lines(spark, files).withColumn("id", F.monotonically_increasing_id())
    size = F.char_length("value") + 1
    above = Window.partitionBy("dump").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    # A head lies in a file's first range; lines that begin beyond the looked-at characters by their number alone are left out first.
    early = given.where((F.col("block") == 0)).withColumn("place", F.row_number().over(Window.partitionBy("dump").orderBy("id"))).where(F.col("place") <= PEEK_CHARS)
    early = early.withColumn("begins", F.coalesce(F.sum(size).over(above), F.lit(0)))
    head = early.where(F.col("begins") < HEAD_CHARS).groupBy("dump").agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "value"))), lambda x: x["value"]), "\n"), 1, HEAD_CHARS).alias("head"))
    header = F.col("value").startswith(FILE_HEADER)
    soon = early.where((F.col("begins") < PEEK_CHARS) & header).select("dump").distinct().withColumn("soon", F.lit(True))
    entries = given.groupBy("dump").agg(F.count_if(header).alias("entries"))
    marked = F.lit(False)
    for m in MARKS:
        marked = marked | F.contains("head", F.lit(m))
    told = [F.when(F.contains(F.lower("head"), F.lit(needle)), F.lit(tag)) for needle, tag in TRANSFORMS.items()]
    rows = entries.join(head, "dump", "left").join(soon, "dump", "left")
    return rows.select("dump", (F.coalesce(marked, F.lit(False)) & F.coalesce("soon", F.lit(False))).alias("is_dump"), F.array_compact(F.array(*told)).alias("transforms"), "entries")


def count_entries(spark: SparkSession, path: str) -> int:
    """File headers of a dump, counted without the parser."""
    return spark.read.text(path).where(F.col("value").startswith(FILE_HEADER)).count()
