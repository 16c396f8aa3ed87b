"""WARC records in seekable Zstandard bundles (operator 7).

A bundle is one byte string in the seekable format: independent frames, each of
whole records, and a skippable frame with the seek table at the end. A table
holds one bundle a row, so that Spark's committer writes it and any store can
keep it, together with an index: for each record its id, frame, and offset and
length inside the uncompressed frame.

Of records with equal payloads the one with the largest page_id is a response
and the others are revisits of it, which keep its HTTP head (with the full
length) but no body. Which payloads repeat is decided over (digest, page_id)
pairs, never over whole pages.

Defined cases: null html is the empty payload; a null url leaves out the target;
rows that repeat the largest page_id of a payload are responses all; a null
page_id counts as the smallest; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import stored, table, text_or_empty

# Fixed values of the seekable Zstandard format and of WARC 1.1.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Uncompressed bytes after which a frame and a bundle are closed.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 22
LEVEL = 3


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"urn:x-page:{'' if page_id is None else page_id}"


def page_of(uri: str) -> int | None:
    tail = uri.strip("<>").rpartition(":")[2]
    return int(tail) if tail else None


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id(page_id)}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Refers-To: <{record_id(refers_to)}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of the record, headers of the HTTP message, and the body that is there."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    return headers, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), body


class BundleWriter:
    def __init__(self, level: int = LEVEL):
        import zstandard

        self.compressor = zstandard.ZstdCompressor(level=level)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.index: list[tuple[str, int, int, int]] = []
        self.open: list[bytes] = []
        self.open_bytes = self.bytes = 0

    def add(self, rid: str, record: bytes) -> None:
        self.index.append((rid, len(self.frames), self.open_bytes, len(record)))
        self.open.append(record)
        self.open_bytes += len(record)
        self.bytes += len(record)
        if self.open_bytes >= FRAME_BYTES:
            self._close_frame()

    def _close_frame(self) -> None:
        if self.open:
            frame = self.compressor.compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.open_bytes))
            self.open, self.open_bytes = [], 0

    def finish(self) -> bytes:
        self._close_frame()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join([*self.frames, struct.pack("<II", SKIPPABLE, len(entries) + len(footer)), entries, footer])


class BundleReader:
    """Random access: the seek table from the end, then one frame at a time."""

    def __init__(self, data: bytes):
        import zstandard

        n, _, magic = struct.unpack_from("<IBI", data, len(data) - 9)
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        sizes = list(struct.iter_unpack("<II", data[len(data) - 9 - 8 * n : len(data) - 9]))
        self.data, self.at, self.last = data, [], (-1, b"")
        start = 0
        for packed, size in sizes:
            self.at.append((start, packed, size))
            start += packed
        self.decompressor = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            start, packed, size = self.at[k]
            self.last = (k, self.decompressor.decompress(self.data[start : start + packed], max_output_size=size))
        return self.last[1]

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]


INDEX = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))
BUNDLES = "data binary, index array<struct<record_id:string,frame:int,offset:bigint,length:bigint>>"


def repeated_payloads(pages: DataFrame, least: int = 0) -> DataFrame:
    """digest and keeper (largest page_id) of payloads that more than one row has; one small row each, stored."""
    body = text_or_empty("html")
    narrow = pages.select(F.unhex(F.sha1(body.cast("binary"))).alias("digest"), F.octet_length(body).alias("n"), F.col("page_id").cast("long").alias("page_id"))
    groups = narrow.where(F.col("n") >= least).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("rows"))
    return stored(groups.where("rows > 1").select("digest", "keeper"), "repeated-payloads")


def write_bundles(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes a record for each of ``pages(page_id, url, html)``; returns the stored table of bundles and their index."""
    body = text_or_empty("html")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    # the stored groups have a known size: the planner broadcasts them only if they are small
    rows = rows.join(repeated_payloads(pages, least), "digest", "left").select("page_id", "url", "payload", "digest", "keeper")

    def write(batches):
        def close(w):
            index = [dict(zip(("record_id", "frame", "offset", "length"), x)) for x in w.index]
            return pa.RecordBatch.from_arrays([pa.array([w.finish()], pa.binary()), pa.array([index], INDEX)], names=["data", "index"])

        w = BundleWriter()
        for batch in batches:
            for page_id, url, payload, digest, keeper in zip(*(c.to_pylist() for c in batch.columns)):
                revisit = len(payload) >= least and keeper is not None and page_id != keeper
                w.add(record_id(page_id), make_record(page_id, url, payload, base64.b32encode(digest).decode(), keeper, revisit))
                if w.bytes >= BUNDLE_BYTES:
                    yield close(w)
                    w = BundleWriter()
        if w.index:
            yield close(w)

    out = rows.mapInArrow(write, BUNDLES)
    return stored(out.withColumn("bundle", F.monotonically_increasing_id()), "warc-bundles")


def record_index(bundles: DataFrame) -> DataFrame:
    """record_id, bundle, frame, offset, length."""
    return bundles.select("bundle", F.explode("index").alias("i")).select("i.record_id", "bundle", "i.frame", "i.offset", "i.length")


def read_records(bundles: DataFrame) -> DataFrame:
    """Every record, opened through the index: page_id, url, payload facts, type, what it refers to, and its place."""

    def read(batches):
        for batch in batches:
            for bundle, data, index in zip(batch.column("bundle").to_pylist(), batch.column("data").to_pylist(), batch.column("index").to_pylist()):
                r, out = BundleReader(data), []
                for i in index:
                    headers, http, body = parse_record(r.record(i["frame"], i["offset"], i["length"]))
                    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and base32_sha1(body) != digest:
                        raise ValueError(f"bundle {bundle}: {i['record_id']} is damaged")
                    refers = headers.get("WARC-Refers-To")
                    out.append((page_of(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), int(http["Content-Length"]), digest, kind, None if refers is None else page_of(refers), bundle, i["frame"], i["offset"]))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "bundle", "frame", "offset"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, bundle long, frame int, offset long"
    return bundles.select("bundle", "data", "index").mapInArrow(read, schema)


def op7_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_records(write_bundles(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
