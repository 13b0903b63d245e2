"""WARC archives through a chunked record table.

Writing: each payload is cut into chunks by DataFrame functions, so a task sees
rows of (record, chunk number, chunk) and never holds a payload as a whole; it
streams them into a WARC/1.1 file of gzip members, one member per record. A
task writes files of its own names, a new one when one has ROLL bytes, and tells
them in a manifest; only files that the manifest names count, so a task that ran
twice does no harm. Records of one page_id are told apart by their digest.

Reading: archives are streamed back as rows of (record, chunk number, offset,
chunk, digest so far, last), with the SHA-1 carried from chunk to chunk.

Records with equal payloads of at least ``least`` bytes are written once: the
record with the largest page_id is the response, the others are revisit records
that name it and carry its digest and size but no payload.

Defined cases: a null html is an empty payload; a null url an empty target; a
row without a page_id is a response of its own; a row that repeats with its
page_id and payload is a response each time; extra columns are left out; an
empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.llm import _common as C

CHUNK = 64 * 1024
READ = 256 * 1024
SALTS = 16
#: Bytes after which an archive is closed and another begun.
ROLL = 1_000_000_000
#: WARC files written by a session hold a fixed date, so equal tables give equal records.
DATE = "2024-01-01T00:00:00Z"
RECORD = "urn:x-page:"


def planned(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload (binary), bytes, sha1, and refers_to for revisits."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    some = rows.where((F.col("bytes") >= least) & F.col("page_id").isNotNull())
    owners = some.groupBy("sha1", "bytes").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1").select("sha1", "bytes", "owner", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    refers = F.when((F.col("bytes") >= least) & (F.col("owner") != F.col("page_id")), F.col("owner"))
    return rows.withColumn("salt", salt).join(owners, ["sha1", "bytes", "salt"], "left").select("page_id", "url", "payload", "bytes", "sha1", refers.alias("refers_to"))


def chunks(records: DataFrame, size: int = CHUNK) -> DataFrame:
    """One row per chunk of each record's payload, in order; a record without payload has one empty chunk."""
    carried = F.when(F.col("refers_to").isNull(), F.col("bytes")).otherwise(F.lit(0))
    last = F.greatest(F.lit(0), F.ceil(carried / size).cast("int") - 1)
    part = F.when(F.col("refers_to").isNull(), F.substring("payload", F.col("chunk_no") * size + 1, F.lit(size))).otherwise(F.lit("").cast("binary"))
    return records.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last))).select("page_id", "url", "bytes", "sha1", "refers_to", "chunk_no", part.alias("chunk"))


def _filesystem(folder: str):
    """The file system and path of a folder named by a URI or a local path."""
    from pyarrow import fs

    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder)


def _head(row: dict) -> bytes:
    """The header of a record, with the HTTP part's absence told by its content type."""
    digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
    page = "" if row["page_id"] is None else f"{row['page_id']}:{row['sha1']}"
    kind = "response" if row["refers_to"] is None else "revisit"
    url = "".join(c for c in row["url"] if c not in "\r\n")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{RECORD}{page}>", f"WARC-Target-URI: {url}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {row['bytes']}"]
    if row["refers_to"] is not None:
        lines += [f"WARC-Refers-To: <{RECORD}{row['refers_to']}:{row['sha1']}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: text/html", f"Content-Length: {row['bytes'] if row['refers_to'] is None else 0}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "replace")


def write(pages: DataFrame, folder: str, least: int = 0, size: int = CHUNK, roll: int = ROLL) -> DataFrame:
    """Write the archives of a table of pages into a folder; gives the manifest (path, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _filesystem(folder)
        path, out, packer, records = "", None, None, 0

        def closed() -> pa.RecordBatch:
            out.write(packer.compress(b"\r\n\r\n") + packer.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64())], ["path", "records"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["chunk_no"] == 0:
                    if out is not None and out.tell() >= roll:
                        yield closed()
                        out = None
                    if out is None:
                        system.create_dir(base, recursive=True)
                        path, records = f"{base}/{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(path, compression=None)
                    else:
                        out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    records += 1
                    out.write(packer.compress(_head(row)))
                out.write(packer.compress(row["chunk"]))
        if out is not None:
            yield closed()

    return C.spill(chunks(planned(pages, least), size).mapInArrow(run, "path string, records long"), "warc-manifest")


class _Members:
    """The bytes of a file of gzip members, decompressed as they are asked for."""

    def __init__(self, stream) -> None:
        self.stream, self.unpack, self.waiting, self.buffer, self.ended = stream, zlib.decompressobj(31), b"", bytearray(), False

    def fill(self) -> bool:
        """Decompress a little more; false at the end."""
        while not self.ended:
            data = self.waiting or self.stream.read(READ)
            if not data:
                self.ended = True
                return False
            if self.unpack.eof:
                self.unpack = zlib.decompressobj(31)
            more = self.unpack.decompress(data, READ)
            self.waiting = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
            if more:
                self.buffer += more
                return True
        return False

    def line(self) -> bytes | None:
        """The next line without its end, or None."""
        while (at := self.buffer.find(b"\r\n")) < 0:
            if not self.fill():
                return None
        found = bytes(self.buffer[:at])
        del self.buffer[: at + 2]
        return found

    def take(self, most: int) -> bytes:
        """At least one and at most so many bytes."""
        while not self.buffer and self.fill():
            pass
        found = bytes(self.buffer[:most])
        del self.buffer[:most]
        return found

    def exactly(self, number: int) -> bytes:
        """So many bytes."""
        while len(self.buffer) < number:
            if not self.fill():
                raise ValueError("an archive ends inside a record")
        found = bytes(self.buffer[:number])
        del self.buffer[:number]
        return found


def _records(stream, size: int) -> Iterator[tuple[dict[str, str], int, int, bytes, str, bool]]:
    """(header, chunk number, offset, chunk, digest so far, last) of every chunk in an archive."""
    source = _Members(stream)
    while (line := source.line()) is not None:
        if line != b"WARC/1.1":
            raise ValueError(f"not the start of a record: {line[:80]!r}")
        header = {}
        while line := source.line():
            name, _, value = line.decode("utf-8", "replace").partition(": ")
            header[name] = value
        left, number, offset, digest = int(header["Content-Length"]), 0, 0, hashlib.sha1()
        while True:
            chunk = source.exactly(min(size, left))
            digest.update(chunk)
            left -= len(chunk)
            yield header, number, offset, chunk, digest.hexdigest(), not left
            number, offset = number + 1, offset + len(chunk)
            if not left:
                break
        if source.exactly(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its header says")


def read(manifest: DataFrame, folder: str, payloads: bool = True, size: int = CHUNK) -> DataFrame:
    """The chunk table of the archives that a manifest names.

    Columns: page_id, record_type, refers_to, payload_digest (of the header),
    payload_bytes (of the full payload, as the header has it), url, chunk_no,
    chunk_offset, chunk_bytes, chunk (null unless payloads are asked for),
    sha1_so_far and last.
    """
    fields = [("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("url", pa.string()), ("chunk_no", pa.int32()), ("chunk_offset", pa.int64()), ("chunk_bytes", pa.int32()), ("chunk", pa.binary()), ("sha1_so_far", pa.string()), ("last", pa.bool_())]

    def number(value: str | None) -> int | None:
        found = (value or "").strip("<>").removeprefix(RECORD).partition(":")[0]
        return int(found) if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _filesystem(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with system.open_input_stream(path, compression=None) as stream:
                    for h, k, offset, chunk, digest, last in _records(stream, size):
                        rows.append((number(h["WARC-Record-ID"]), h["WARC-Type"], number(h.get("WARC-Refers-To")), h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"]), h["WARC-Target-URI"], k, offset, len(chunk), chunk if payloads else None, digest, last))
                        held += len(chunk) * payloads + 300
                        if held > 8_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])

    schema = "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, url string, chunk_no int, chunk_offset long, chunk_bytes int, chunk binary, sha1_so_far string, last boolean"
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(parts, "path").mapInArrow(run, schema)


def summary(chunk_table: DataFrame) -> DataFrame:
    """One row per record from its last chunk; a response's size and digest are those of the bytes read, a revisit's its header's."""
    carried = F.col("record_type") == "response"
    digest = F.when(carried, to_base32(F.col("sha1_so_far"))).otherwise(F.col("payload_digest"))
    size = F.when(carried, F.col("chunk_offset") + F.col("chunk_bytes")).otherwise(F.col("payload_bytes"))
    return chunk_table.where("last").select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


def to_base32(digest):
    """Upper-case base 32 of a hexadecimal SHA-1: eight digits of five bits for each ten hexadecimal digits."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = []
    for at in range(1, 41, 10):
        value = F.conv(F.substring(digest, at, 10), 16, 10).cast("long")
        parts += [F.substr(F.lit(alphabet), (F.shiftright(value, shift).bitwiseAND(F.lit(31).cast("long")) + 1).cast("int"), F.lit(1)) for shift in range(35, -1, -5)]
    return F.concat(*parts)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write a table of pages and read it back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = C.scratch_path(pages.sparkSession, "warc")
    return summary(read(write(pages, folder, least), folder, payloads=False))
