"""Fingerprints against a plain version of the method; edited texts and the order of documents."""

import hashlib
from collections import Counter
import struct

import regex
import xxhash

from quarrylake.llm import fingerprints as P


def terms(text):
    return sorted({t for t in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if t})


def of_text(t):
    return xxhash.xxh64_intdigest(t.encode(), 42)


def of_longs(values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<Q", v), seed)
    return seed


def plain(texts, least=P.LEAST_SHARE, most=P.MOST_SHARE):
    n, df = len(texts), {}
    for t in texts:
        for w in terms(t):
            df[w] = df.get(w, 0) + 1
    low, high = max(2, -int(-least * n // 1)), max(2, int(most * n))
    places = {of_text(w) >> (64 - P.PLACES) for w, c in df.items() if low <= c <= high}

    def fingerprint(t):
        h = [of_text(w) for w in terms(t)]
        h = [x for x in h if x >> (64 - P.PLACES) in places] or h or [of_text(t)]
        out = ""
        for k in range(P.SUBSETS):
            for b in P.DENSITIES:
                kept = [x for x in h if (x >> (9 * k)) & ((1 << b) - 1) == 0]
                out += f"{of_longs(kept) & 0xFFFFFFFF:08x}" if kept else P.NOTHING
        return out

    return fingerprint


def like(a, b):
    parts = [(a[k : k + 8], b[k : k + 8]) for k in range(0, len(a), 8)]
    met = [p for p in parts if p != (P.NOTHING, P.NOTHING)]
    return 1.0 if a == b else sum(x == y for x, y in met) / max(1, len(met))


def check(got, rows):
    rows = sorted([(i, t or "") for i, t in rows], key=lambda r: ((r[0] is None), -(r[0] or 0), r[1]))
    fingerprint = plain([t for _, t in rows])
    want = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        f, e, g = fingerprint(t), fingerprint(edited), fingerprint(after)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), f, e, like(f, e), like(f, g)))
    def key(r):
        return tuple((x is None, x or 0) for x in r[:1]) + tuple(r[1:5])
    have = [tuple(r) for r in got]
    assert sorted(have, key=key) == sorted(want, key=key)
    return want


def test_cases(spark):
    rows = [(1, "alpha beta gamma"), (7, None), (9, ""), (12, "!!! ---"), (40, "Beta alpha."), (41, "beta gamma delta epsilon"), (41, "beta gamma delta epsilon"), (None, "zeta eta"), (10**12, "Ünï 日本語 x9 😀😀😀😀")]
    docs = spark.createDataFrame([(i, t, "own") for i, t in rows], "doc_id long, text string, fingerprint string")
    check(P.compared(docs).collect(), rows)
    assert P.compared(docs.limit(0)).count() == 0
    check(P.compared(docs.limit(1)).collect(), rows[:1])


def test_query(spark, small):
    from quarrylake.llm.queries import op2_fingerprints

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = check(op2_fingerprints(spark, small).collect(), rows)
    assert sum(r[5] > r[6] for r in want) > 0.85 * len(want)


def test_ranges_are_even_whatever_the_ids(spark):
    """An outlying id, ids in clumps, repeated ids and nulls: ranges keep the order and hold about equally many rows."""
    ids = [*range(2000), 10**15, -(10**12), *([77] * 30), None]
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    got = rows.withColumn("r", P.ranges(rows, len(ids))).collect()
    known = sorted((r["doc_id"], r["r"]) for r in got if r["doc_id"] is not None)
    assert [r for _, r in known] == sorted(r for _, r in known) and all(r["r"] == -1 for r in got if r["doc_id"] is None)
    assert max(Counter(r for _, r in known).values()) < 120 and len({r for i, r in known if i == 77}) == 1


def test_very_long_text(spark):
    rows = [(1, "alpha beta " * 60_000), (2, "gamma delta"), (3, "x" * 300_000)]
    got = P.compared(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_chars"] for r in got} == {i: len(t) for i, t in rows}
