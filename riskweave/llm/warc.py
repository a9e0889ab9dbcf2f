"""WARC archives: writing, normalising and reading back.

Spark's text writer makes the monolithic form: a gzip stream per file, with the records one after the other. The
normaliser inflates each file once, as a stream, writes every record as a gzip member of its own and lists the members'
places in a sidecar file. Readers then go straight to a record. All files lie in a folder that driver and executors
share; tasks reach it through Arrow's file systems. A file appears under its final name only when it is complete, so a
repeated task replaces it by the same bytes.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach_groups

LEAST_REVISIT = 100  # bytes of payload from which equal payloads are stored once
FILE_RECORDS = 20_000  # records per archive at most
CHUNK = 1 << 20
END = "\r\n\r\n"
EPOCH = "1970-01-01T00:00:00Z"
# Fixed value: the profile of revisit records in the WARC 1.1 standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _lines(*parts: Column | str) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def with_revisits(pages: DataFrame, key: str, payload: str) -> DataFrame:
    """Adds payload_bytes, payload_digest and refers_to; the payload's null becomes empty.

    Of rows with equal payloads of at least LEAST_REVISIT bytes, those with the smallest key refer to nothing and the
    others to that key. Rows with a null key refer to nothing, and neither do repeated rows of the smallest key.
    """
    rows = pages.withColumn(payload, F.coalesce(payload, F.lit("")))
    rows = rows.withColumns({"payload_bytes": F.octet_length(payload).cast("long"), "payload_digest": F.sha2(payload, 256)})
    groups = rows.where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("payload_digest").agg(
        F.count("*").alias("_size"), F.min(key).alias("_first")).where("_size > 1")
    rows = attach_groups(rows, groups, "payload_digest", "_size", pages.count(), key)
    return rows.withColumn("refers_to", F.when(F.col(key) > F.col("_first"), F.col("_first"))).drop("_size", "_first")


def record_text(key: str, url: str, payload: str) -> Column:
    """A WARC 1.1 record without its final empty lines, from columns as ``with_revisits`` adds them."""
    urn = lambda c: _lines("<urn:page:", F.coalesce(F.col(c).cast("string"), F.lit("null")), ">")
    revisit = F.col("refers_to").isNotNull()
    # Line breaks in an address would end the header.
    target = F.when(F.col(url).isNotNull(), _lines("WARC-Target-URI: ", F.regexp_replace(url, r"[\r\n]+", "%0A"), "\r\n")).otherwise("")
    http = _lines("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ", F.col("payload_bytes").cast("string"), END)
    body = F.when(revisit, http).otherwise(F.concat(http, payload))
    return _lines(
        "WARC/1.1\r\nWARC-Type: ", F.when(revisit, "revisit").otherwise("response"), "\r\nWARC-Record-ID: ", urn(key), "\r\n", target,
        f"WARC-Date: {EPOCH}\r\nWARC-Payload-Digest: sha256:", F.col("payload_digest"), "\r\n",
        F.when(revisit, _lines("WARC-Refers-To: ", urn("refers_to"), f"\r\nWARC-Profile: {PROFILE}\r\n")).otherwise(""),
        "Content-Type: application/http; msgtype=response\r\nContent-Length: ", F.octet_length(body).cast("string"), END, body)


def write_monolithic(pages: DataFrame, key: str, url: str, payload: str, folder: str) -> None:
    """Writes the pages into gzip files of many records each."""
    rows = with_revisits(pages, key, payload)
    rows.select(record_text(key, url, payload).alias("value")).write.option("lineSep", END).option("compression", "gzip").option(
        "maxRecordsPerFile", FILE_RECORDS).text(folder)


# ---------------------------------------------------------------- normaliser

def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a path as Spark prints it."""
    if re.match(r"file:/(?!/)", uri):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def inflate(stream: BinaryIO) -> Iterator[bytes]:
    """The contents of a gzip file of one or many members, piece by piece."""
    z, fed = zlib.decompressobj(31), False
    while data := stream.read(CHUNK):
        while data:
            fed = True
            out = z.decompress(data, CHUNK)
            if out:
                yield out
            data = z.unconsumed_tail
            if z.eof:
                data, z, fed = z.unused_data, zlib.decompressobj(31), False
    if fed:
        raise ValueError("the archive ends within a gzip member")


def records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and whole bytes of the records of a stream, one in memory at a time."""
    held = bytearray()
    pieces = iter(pieces)

    def fill(wanted: int) -> bool:
        while len(held) < wanted:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while True:
        at = 0
        while (head := held.find(END.encode(), at)) < 0:
            at = max(0, len(held) - 3)
            if not fill(len(held) + 1):
                if held.strip():
                    raise ValueError("the archive ends within a header")
                return
        headers = header_fields(bytes(held[:head]))
        total = head + 4 + int(headers["content-length"]) + 4
        if not fill(total) or held[total - 4 : total] != END.encode():
            raise ValueError("the archive ends within a record")
        yield headers, bytes(held[:total])
        del held[:total]


def header_fields(head: bytes) -> dict[str, str]:
    first, *lines = head.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError(f"no WARC record: {first[:40]}")
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


def normalise_file(source: str, target: str) -> tuple[int, int]:
    """Rewrites one archive and its sidecar; returns the numbers of records and bytes."""
    store, path = open_fs(source)
    out_store, out = open_fs(target)
    part, count, offset = f"{out}.{uuid.uuid4().hex}", 0, 0
    with store.open_input_stream(path, compression=None) as raw, out_store.open_output_stream(f"{part}.gz", compression=None) as archive, \
            out_store.open_output_stream(f"{part}.idx", compression=None) as index:
        for headers, record in records(inflate(raw)):
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = z.compress(record) + z.flush()
            archive.write(member)
            entry = {"record_id": headers.get("warc-record-id"), "type": headers.get("warc-type"), "url": headers.get("warc-target-uri"),
                     "archive": target, "offset": offset, "length": len(member)}
            index.write((json.dumps(entry) + "\n").encode())
            offset += len(member)
            count += 1
    out_store.move(f"{part}.gz", out)
    out_store.move(f"{part}.idx", f"{out}.idx")
    return count, offset


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrites every gzip archive of the folder ``source`` into ``target``, next to sidecars ``*.warc.gz.idx``, and
    returns the manifest (archive, records, bytes), written there too. Reading it again does no work twice."""
    store, path = open_fs(target)
    store.create_dir(path, recursive=True)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")

    def rewrite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for name in batch.column(0).to_pylist():
                archive = f"{target}/{name.rsplit('/', 1)[1].removesuffix('.gz').removesuffix('.txt')}.warc.gz"
                done.append((archive, *normalise_file(name, archive)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["archive", "records", "bytes"])

    files.mapInArrow(rewrite, "archive string, records bigint, bytes bigint").write.parquet(f"{target}/manifest")
    return spark.read.parquet(f"{target}/manifest")


# ---------------------------------------------------------------- reader

INDEX = "record_id string, type string, url string, archive string, offset bigint, length bigint"
RECORD = ("record_id string, record_type string, url string, refers_to string, payload_bytes bigint, payload_digest string, "
          "payload binary")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).option("pathGlobFilter", "*.idx").json(folder)


def parse(record: bytes) -> tuple:
    """Fields of a record; a response's payload must have the length and the digest that its headers name."""
    head, _, body = record.partition(END.encode())
    fields = header_fields(head)
    http, _, payload = body[: int(fields["content-length"])].partition(END.encode())
    size = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    stored = fields["warc-type"] == "response"
    if stored and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload of {fields['warc-record-id']}")
    return (fields["warc-record-id"], fields["warc-type"], fields.get("warc-target-uri"), fields.get("warc-refers-to"), size, digest,
            payload if stored else None)


def read_records(index: DataFrame) -> DataFrame:
    """The records that the index lists, each read from its own place. Lines of one sidecar are read by few tasks and
    in order, so an archive is opened once for a run of them."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, archive = None, None
        for batch in batches:
            rows, held = [], 0
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if path != name:
                    if archive is not None:
                        archive.close()
                    store, at = open_fs(path)
                    name, archive = path, store.open_input_file(at)
                rows.append(parse(zlib.decompress(archive.read_at(length, offset), 31)))
                held += len(rows[-1][-1] or b"")
                if held > 8 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    return index.select("archive", "offset", "length").mapInArrow(read, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]
    names = ["record_id", "record_type", "url", "refers_to", "payload_bytes", "payload_digest", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def key_of(urn: str) -> Column:
    """The page's key in a record id."""
    key = F.regexp_extract(urn, r"^<urn:page:(.*)>$", 1)
    return F.when(~key.isin("", "null"), key).cast("long")
