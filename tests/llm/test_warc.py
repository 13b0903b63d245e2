"""WARC files: byte for byte, revisits, streaming of long payloads."""

import base64
import gzip
import hashlib
from collections import Counter, defaultdict
from pathlib import Path

from quarrylake.llm import _common as C
from quarrylake.llm import warc as W

PAGES = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, None), (4, "u\r\nX: y", ""), (5, "http://a/5", "é" * 200_000), (6, "http://a/6", "WARC/1.1\r\n\r\nhello\r\n\r\n"), (7, "http://a/7", "<p>x</p>"), (None, "http://a/8", "<p>x</p>"), (8, "h", "WARC/1.1\r\n\r\n" * 9000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "own") for i, u, h in rows], "page_id long, url string, html string, record_type string")


def expect(rows, least=0):
    by = defaultdict(list)
    for i, _, h in rows:
        if i is not None:
            by[h or ""].append(i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        top = max(by[h or ""], default=None) if len(data) >= least and i is not None else i
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), digest, "response" if top == i else "revisit", None if top == i else top))
    return Counter(out)


def test_round_trip(spark):
    for least in (0, 1):
        assert Counter(map(tuple, W.round_trip(frame(spark, PAGES), least).collect())) == expect(PAGES, least)
    assert W.round_trip(frame(spark, PAGES).limit(0)).count() == 0
    twice = [PAGES[4], PAGES[4]]
    assert [r["record_type"] for r in W.round_trip(frame(spark, twice)).collect()] == ["response"] * 2


def test_files_and_chunks(spark):
    folder = C.scratch_path(spark, "warc-test")
    manifest = W.write(frame(spark, PAGES), folder, size=1000)
    files = list(Path(folder.removeprefix("file://")).glob("*.warc.gz"))
    assert {str(f) for f in files} == {r["path"] for r in manifest.collect()} and sum(r["records"] for r in manifest.collect()) == len(PAGES)
    assert sum(gzip.decompress(f.read_bytes()).count(b"WARC-Type: ") for f in files) == len(PAGES)
    rows = W.read(manifest, folder, size=1000).collect()
    assert max(len(r["chunk"]) for r in rows) == 1000
    for i, _, h in PAGES:
        own = sorted((r for r in rows if r["page_id"] == i), key=lambda r: r["chunk_no"])
        data = b"".join(r["chunk"] for r in own)
        assert data == ((h or "").encode() if own[0]["record_type"] == "response" else b"")
        assert own[-1]["sha1_so_far"] == hashlib.sha1(data).hexdigest() and [r["last"] for r in own] == [False] * (len(own) - 1) + [True]


def test_query(spark, small):
    from quarrylake.llm.queries import op4_warc

    rows = [tuple(r) for r in spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url", "html").collect()]
    assert Counter(map(tuple, op4_warc(spark, small).collect())) == expect(rows)


def test_archives_are_rolled_and_sizes_counted(spark):
    rows = [(k, f"http://a/{k}", f"page {k} " * 400) for k in range(40)] + [(7, "http://a/again", "another text"), (7, "http://b", "another text")]
    folder = C.scratch_path(spark, "warc-roll")
    pages = frame(spark, rows).coalesce(1)
    manifest = W.write(pages, folder, roll=2000)
    assert manifest.count() > 3 and sum(r["records"] for r in manifest.collect()) == len(rows)
    table = W.read(manifest, folder)
    assert Counter(map(tuple, W.summary(table).collect())) == expect(rows)
    # A wrong length in a header does not reach the summary of a response.
    wrong = table.withColumn("payload_bytes", table["payload_bytes"] + 5)
    assert {r["payload_bytes"] for r in W.summary(wrong).where("page_id = 3").collect()} == {len(rows[3][2])}
    ids = [line for f in Path(folder.removeprefix("file://")).glob("*.warc.gz") for line in gzip.decompress(f.read_bytes()).split(b"\r\n") if line.startswith(b"WARC-Record-ID")]
    assert len(set(ids)) == len(rows) - 1  # but for the row that repeats its id and payload
