"""Conversation structure repair by a forward Viterbi pass over a small grammar.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``.
Its grammar has four states: nothing yet, after system, after user, after
assistant. Rows are read in order of turn (nulls first), role and text. Each
state carries the least (cost, audit), where an audit spells the edits: K keeps
a row, R gives it the other role, D deletes it, I inserts a turn without text.
Each row's layer is closed by at most two inserts, as a third one only repeats a
state. Equal costs are settled by the audit that is least in ASCII; as the
letters and the rows fix the cost, no audit of equal cost starts with another,
so the choice may be made state by state. The audit and the first kept row fix
the roles, so the repaired conversation is unique.

Conversations of at most LONG_ROWS rows and LONG_BYTES bytes are sorted within
tasks and mended in one pass. Longer ones, of which one may hold a third of all
rows, are dealt out by ranges of their order and cut into blocks of rows: a block
gives the least (cost, audit) between any two states, the blocks' tables are
joined up in order, and every row takes its letters back. What one task then
holds of a whole conversation is up to four bytes of audit per row; its texts are
hashed as they stream by, since SHA-256 has to read them in order. Both ways give
the same rows.

Defined cases: a null in any column is one space, so that a null id is a
conversation of its own (and stays null in the result); a null turn comes first
and counts for no gap; rows of equal turn are taken by role and text; repeated
rows are duplicates; an empty text is blank; a very long text only makes its
conversation a long one; a conversation without rows left has zeros, an empty
audit and the hash of the empty string; extra columns are left out; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quarrylake.llm import _common as C

DELETE, REROLE, INSERT, CUT = 2, 1, 5, 5
#: Rows and bytes of text up to which a conversation is mended in one pass.
LONG_ROWS, LONG_BYTES = 2048, 16_000_000
#: Bytes of text that one task reads, about.
TASK_BYTES = 64_000_000
#: Rows of a block of a long conversation; a power of two.
BLOCK = 2048
#: Conversations that a task gives out at once.
BATCH_ROWS = 2_000
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
START, SYSTEM, USER, ASSISTANT = range(4)
#: From which states a role's initial may follow, and the state it leads to.
GRAMMAR = {"s": ((START,), SYSTEM), "u": ((START, SYSTEM, ASSISTANT), USER), "a": ((USER,), ASSISTANT)}
LEGAL = {"su", "ua", "au"}
Layer = list  # of four (cost, audit), or None where a state cannot be reached

RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after damage that their ids decide: conv_id, turn, role, text, copies.

    A dropped row stays with no copies, so that its conversation is not lost.
    """
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    text = F.when(harm.isin(0, 1), "").when(harm == 2, F.regexp_replace(known("text"), "[.!?]", "")).otherwise(known("text"))
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(harm == 4, "user").otherwise(known("role")).alias("role"),
        text.alias("text"),
        F.when(harm == 0, 0).when(harm == 3, 2).otherwise(1).alias("copies"),
    )


def repair(rows: DataFrame) -> DataFrame:
    """One row per conv_id: what is wrong with it, its cheapest repair, and the hash of what is repaired.

    ``rows`` has conv_id, turn (long), role and text, and may have ``copies``
    (int): how often a row stands there, 0 for one that only names its
    conversation.
    """
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), copies.cast("int").alias("copies"))
    seen = Observation()
    sizes = rows.groupBy("conv_id").agg(F.sum("copies").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    sizes = sizes.observe(seen, F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    long = C.spill(sizes.where((F.col("n") > LONG_ROWS) | (F.col("bytes") > LONG_BYTES)).select(F.col("conv_id").alias("long_id")), "conversations-long")
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    parts = C.partitions_for(rows.sparkSession, seen.get["bytes"], TASK_BYTES)
    if long.isEmpty():
        return in_one_pass(rows, parts)
    return in_one_pass(rows.join(long, same, "left_anti"), parts).unionByName(in_blocks(rows.join(long, same, "left_semi"), parts))


# The grammar


def closed(layer: Layer) -> Layer:
    """The layer with inserted turns allowed after it: two at most, as a third only comes back to a state."""
    for _ in range(2):
        given = list(layer)
        for source, target in ((START, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT)):
            if given[source] is not None:
                better = (given[source][0] + INSERT, given[source][1] + "I")
                if layer[target] is None or better < layer[target]:
                    layer[target] = better
    return layer


def after_row(layer: Layer, initial: str, broken: bool, cut: bool, times: int = 1) -> Layer:
    """The closed layer after a row: ``broken`` ones (blank or duplicate) are deleted, ``times`` at once; ``cut`` ones cost more unless they are."""
    new: Layer = [(p[0] + DELETE * times, p[1] + "D" * times) if p is not None else None for p in layer]
    if not broken:
        extra = CUT if cut else 0
        for kind, (sources, target) in GRAMMAR.items():
            if kind == initial:
                letter, cost = "K", extra
            elif kind != "s":
                letter, cost = "R", REROLE + extra
            else:
                continue
            for s in sources:
                if layer[s] is not None:
                    better = (layer[s][0] + cost, layer[s][1] + letter)
                    if new[target] is None or better < new[target]:
                        new[target] = better
    return closed(new)


def best(layer: Layer) -> tuple[int, str]:
    """The cheapest way to end: with nothing at all, or after an assistant."""
    return min(p for p in (layer[START], layer[ASSISTANT]) if p is not None)


def entered(state: int) -> Layer:
    """A layer that is in one state, at no cost."""
    return [(0, "") if s == state else None for s in range(4)]


# Conversations that fit a task


def in_one_pass(rows: DataFrame, parts: int) -> DataFrame:
    """Conversations of bounded length: sorted within tasks and mended one after another."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    given = rows.repartition(parts, "conv_id").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for conv, own in groupby(_tuples(batches), key=lambda r: r[0]):
            out.append((conv, *mended([r[1:4] for r in own for _ in range(r[4])])))
            if len(out) == BATCH_ROWS:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return given.mapInArrow(run, RESULT)


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    names = [c.split()[0] for c in RESULT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def mended(rows: list[tuple[int | None, str, str]]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit and hash of ordered rows (turn, role, text)."""
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    count, seen, layer = {"blank": 0, "duplicate": 0, "cut": 0}, set(), closed(entered(START))
    for _, role, text in rows:
        bare = text.rstrip(WHITE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "cut" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            count[fault] += 1
        layer = after_row(layer, role[:1], fault in ("blank", "duplicate"), fault == "cut")
    illegal = sum(a[1][:1] + b[1][:1] not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
    cost, audit = best(layer)
    digest = hashlib.sha256("\n".join(f"{role}:{text}" for role, text in repaired([(r, t) for _, r, t in rows], audit)).encode()).hexdigest()
    return gaps, count["blank"], count["duplicate"], count["cut"], illegal, cost, audit, digest


def repaired(rows: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The turns (role, text) that an audit leaves of the rows it was made for."""
    out: list[tuple[str, str]] = []
    given = iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(given)
        if edit == "D":
            continue
        if edit != "K":
            role = "user" if not out or out[-1][0][:1] != "u" else "assistant"
        out.append((role, text))
    return out


# Longer conversations


def in_blocks(rows: DataFrame, parts: int) -> DataFrame:
    """The same for conversations of any length, without any task that holds one's rows."""
    whole = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).where("copies > 0")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    # Ranges follow the order, so the place of a row in its part also orders all rows.
    dealt = whole.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(
        "conv_id", "turn", "role", "text", "copies",
        F.monotonically_increasing_id().alias("at"),
        F.sha2("text", 256).alias("same"),
        (F.length(bare) == 0).alias("blank"),
        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("open"),
    )
    placed = C.spill(dealt, "conversations-placed")
    facts = placed.drop("text")
    first = facts.where("not blank").groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("same").alias("h")).agg(F.min("at").alias("first"))
    marked = facts.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("same") == F.col("h")), "left")
    # Of the copies of one row, the first may be sound; the others are blank or duplicates like it.
    marked = marked.select(
        "conv_id", "turn", "at", "copies", "blank", F.shiftright("at", BLOCK.bit_length() - 1).alias("block"), F.substring("role", 1, 1).alias("initial"),
        (~F.col("blank") & (F.col("at") != F.col("first"))).alias("again"), "open",
    )
    marked = C.spill(marked, "conversations-marked")
    counts = _counts(marked)
    tables = C.spill(marked.groupBy("conv_id", "block").applyInArrow(_block_tables, "conv_id long, block long, head string, tail string, illegal long, costs array<long>, audits array<string>"), "conversations-tables")
    chosen = C.spill(_chosen(tables), "conversations-chosen")
    done = chosen.where("last").select("conv_id", "cost", "illegal")
    ways = chosen.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "audit", "before", "system")
    blocks = marked.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("at", "copies"))).alias("rows"))
    edited = blocks.join(ways, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).select("rows", "audit", "before", "system")
    letters = edited.mapInArrow(_row_edits, "at long, edits string, before long, system boolean")
    pieces = placed.join(letters, "at").select("conv_id", "at", "edits", _piece().alias("piece"))
    hashed = pieces.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "at").mapInArrow(_hashed, "conv_id long, audit string, repaired_sha256 string")
    keyed = lambda df, name: df.withColumnRenamed("conv_id", name)
    out = counts.join(keyed(done, "c1"), F.col("conv_id").eqNullSafe(F.col("c1"))).join(keyed(hashed, "c2"), F.col("conv_id").eqNullSafe(F.col("c2")))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _counts(marked: DataFrame) -> DataFrame:
    count = lambda c: F.sum(c).cast("long")
    sums = marked.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        count(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        count(F.when(F.col("again"), F.col("copies")).when(~F.col("blank"), F.col("copies") - 1).otherwise(0)).alias("duplicate"),
        count((~F.col("blank") & ~F.col("again") & F.col("open")).cast("int")).alias("truncated"),
    )
    return sums


def _block_tables(block: pa.Table) -> pa.Table:
    """For each two states the least (cost, audit) from one to the other through a block; and what its neighbours must know."""
    rows = sorted(zip(*(block[c].to_pylist() for c in ("at", "initial", "copies", "blank", "again", "open")), strict=True))
    costs, audits = [], []
    for state in range(4):
        layer = entered(state)
        for _, initial, copies, blank, again, is_open in rows:
            broken = blank or again
            layer = after_row(layer, initial, broken, is_open, copies if broken else 1)
            if not broken and copies > 1:
                layer = after_row(layer, initial, True, False, copies - 1)
        costs += [p[0] if p else None for p in layer]
        audits += [p[1] if p else None for p in layer]
    illegal = sum(a[1] + b[1] not in LEGAL for a, b in zip(rows, rows[1:], strict=False)) + sum((r[1] * 2 not in LEGAL) * (r[2] - 1) for r in rows)
    first = [block["conv_id"][0].as_py()], [block["block"][0].as_py()], [rows[0][1]], [rows[-1][1]], [illegal], [costs], [audits]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(first, kinds, strict=True)], ["conv_id", "block", "head", "tail", "illegal", "costs", "audits"])


def _chosen(tables: DataFrame) -> DataFrame:
    """The audit of each block on the cheapest way through its conversation; turns left before it, and whether the first is a system's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, own in groupby(_tuples(batches), key=lambda r: r[0]):
            # A way is (cost, (way before, letters)); only ways that can still be chosen are referred to.
            layer = [(p[0], (None, p[1])) if p else None for p in closed(entered(START))]
            blocks, illegal, tail = [], 0, None
            for _, block, head, end, inner, costs, audits in own:
                blocks.append(block)
                illegal += inner + (tail is not None and tail + head not in LEGAL)
                tail = end
                new: Layer = [None] * 4
                for s, t in ((s, t) for s in range(4) for t in range(4)):
                    if layer[s] is not None and costs[4 * s + t] is not None:
                        found = layer[s][0] + costs[4 * s + t], (layer[s][1], audits[4 * s + t])
                        if new[t] is None or found[0] < new[t][0] or (found[0] == new[t][0] and _less(found[1], new[t][1])):
                            new[t] = found
                layer = new
            ends = [p for p in (layer[START], layer[ASSISTANT]) if p is not None]
            cost, way = ends[0] if len(ends) == 1 or ends[0][0] < ends[1][0] or (ends[0][0] == ends[1][0] and _less(ends[0][1], ends[1][1])) else ends[1]
            parts = []
            while way is not None:
                parts.append(way[1])
                way = way[0]
            parts.reverse()  # what is inserted before the first block, then one per block
            parts = [parts[0] + parts[1], *parts[2:]]
            before, system = 0, sum(len(p) - p.count("D") for p in parts) % 2 == 1  # users and assistants come in pairs
            for k, (block, audit) in enumerate(zip(blocks, parts, strict=True)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], t) for v, t in ((conv, pa.int64()), (block, pa.int64()), (audit, pa.string()), (before, pa.int64()), (cost, pa.int64()), (illegal, pa.int64()), (system, pa.bool_()), (k == len(blocks) - 1, pa.bool_()))],
                    ["conv_id", "block", "audit", "before", "cost", "illegal", "system", "last"],
                )
                before += sum(e != "D" for e in audit)

    ordered = tables.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "block")
    return ordered.mapInArrow(run, "conv_id long, block long, audit string, before long, cost long, illegal long, system boolean, last boolean")


def _less(one: tuple, other: tuple) -> bool:
    """Whether one way's letters come before another's: compared from where the two part."""
    a, b = [], []
    while one is not other:  # ways of equally many blocks
        a.append(one[1])
        b.append(other[1])
        one, other = one[0], other[0]
    return "".join(reversed(a)) < "".join(reversed(b))


def _row_edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The letters of each row of a block; an inserted turn goes with the row after it, or the last one."""
    for rows, audit, before, system in _tuples(batches):
        edits, at = [], 0
        for row in rows:
            begin, left = at, row["copies"]
            while left:
                left -= audit[at] != "I"
                at += 1
            edits.append(audit[begin:at])
        edits[-1] += audit[at:]
        befores = [before]
        for e in edits[:-1]:
            befores.append(befores[-1] + len(e) - e.count("D"))
        columns = pa.array([r["at"] for r in rows], pa.int64()), pa.array(edits, pa.string()), pa.array(befores, pa.int64()), pa.array([system] * len(rows))
        yield pa.RecordBatch.from_arrays(list(columns), ["at", "edits", "before", "system"])


def _piece() -> Column:
    """The repaired turns that a row gives, or null; the places of users and assistants alternate."""
    left = F.split(F.translate("edits", "D", ""), "")
    turn = lambda i: F.when((F.col("before") + i - F.col("system").cast("int")) % 2 == 0, "user").otherwise("assistant")
    made = F.transform(left, lambda e, i: F.when(e == "K", F.concat("role", F.lit(":"), "text")).when(e == "R", F.concat(turn(i), F.lit(":"), "text")).when(e == "I", F.concat(turn(i), F.lit(":"))))
    return F.when(F.length(F.translate("edits", "D", "")) > 0, F.array_join(made, "\n"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit and the hash of each conversation, from its rows in order."""
    for conv, own in groupby(_tuples(batches), key=lambda r: r[0]):
        letters, digest, begun = [], hashlib.sha256(), False
        for _, _, edits, piece in own:
            letters.append(edits)
            if piece is not None:
                digest.update(f"\n{piece}".encode() if begun else piece.encode())
                begun = True
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array(["".join(letters)]), pa.array([digest.hexdigest()])], ["conv_id", "audit", "repaired_sha256"])
