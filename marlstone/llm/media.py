"""Media columns: texts stored as lossless WebP and read back (operator 2).

The payload of a text is its UTF-8 with zeros up to a positive multiple of 64.
Its bytes are the 8-bit samples of an image of ``WIDTH`` columns (of a multiple
of it where the rows would pass the format's limit), written by the encoder,
stored as a table, and decoded from the stored bytes.

Defined cases: null text is the empty string, whose payload is 64 zeros; equal
texts give equal bytes and features; rows that repeat are stored each; an empty table gives an
empty result; a text over the format's 2**28 pixels is an error; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import webp
from ._common import slices, stored, table, text_or_empty

WIDTH, UNIT = 64, 64


def samples_of(raw: bytes) -> np.ndarray:
    """The payload as an image; rows beyond the payload are zeros."""
    size = max(1, -(-len(raw) // UNIT)) * UNIT
    width = WIDTH * -(-size // (WIDTH * webp.MAX_SIDE))
    height = -(-size // width)
    out = np.zeros(width * height, dtype=np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(height, width)


def feature(samples: np.ndarray) -> str:
    """Mean, deviation, entropy of the samples, and means of an 8 by 8 grid."""
    counts = np.bincount(samples.reshape(-1), minlength=256)
    p = counts[counts > 0] / counts.sum()
    values = np.arange(256)
    mean = float((counts * values).sum() / counts.sum())
    spread = float(((counts * (values - mean) ** 2).sum() / counts.sum()) ** 0.5)
    height, width = samples.shape
    rows = np.arange(8) * height // 8
    heights = np.maximum(1, np.diff(np.append(rows, height)))
    grid = np.add.reduceat(samples.reshape(height, 8, width // 8).sum(axis=2, dtype=np.int64), rows, axis=0)
    grid = grid // (heights[:, None] * (width // 8))
    return f"mean={mean:.4f};deviation={spread:.4f};entropy={float(-(p * np.log2(p)).sum()) + 0.0:.4f};grid={grid.astype(np.uint8).tobytes().hex()}"


def write_media(docs: DataFrame) -> DataFrame:
    """Stores doc_id, n_bytes and media (a WebP file) of ``docs(doc_id, text)``; returns the table."""

    def write(batches):
        for batch in slices(batches):
            raws = [t.encode() for t in batch.column(1).to_pylist()]
            media = [webp.encode_samples(samples_of(raw)) for raw in raws]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in raws], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return stored(rows.mapInArrow(write, "doc_id long, n_bytes long, media binary"), "media")


def pixels(media: DataFrame) -> DataFrame:
    """Pixel arrays of any table with a column ``media`` of lossless WebP: its columns but that, width, height, argb (array of long)."""
    kept = [n for n in media.columns if n != "media"]

    def read(batches):
        for batch in slices(batches):
            images = [webp.decode(m) for m in batch.column("media").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), pa.array([i.shape[1] for i in images], pa.int32()), pa.array([i.shape[0] for i in images], pa.int32()), pa.array([i.reshape(-1).astype(np.int64) for i in images], pa.list_(pa.int64()))],
                names=[*kept, "width", "height", "argb"],
            )

    schema = "".join(f"`{n}` {t}, " for n, t in media.dtypes if n != "media") + "width int, height int, argb array<bigint>"
    return media.mapInArrow(read, schema)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_media(media: DataFrame) -> DataFrame:
    """Decodes the stored files and describes what they hold."""

    def read(batches):
        for batch in slices(batches):
            out = []
            for doc_id, n, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media"))):
                samples = webp.decode_samples(data)
                payload = samples.tobytes()[: max(1, -(-n // UNIT)) * UNIT]
                out.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples)))
            kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [c.split()[0] for c in FEATURES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(8)], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, FEATURES)


def op2_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_media(write_media(table(spark, sf_dir, "documents")))
