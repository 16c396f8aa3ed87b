"""Token-id shards with a minimal perfect hash index (operator 4).

File format
-----------
A shard is one self-contained byte string; a table holds one shard a row, so
that Spark's committer writes it and any store can keep it::

    header   '<4sBxxxIIQI'  magic b'MPS1', bytes of an id (2 or 4), documents n,
             buckets m, ids in the payload, seed
    disp     m x int32      displacement of each bucket; below 0: slot -d-1
    slots    n x (uint32 fingerprint, uint32 length, uint64 offset in ids)
    payload  raw ids, little-endian, documents in ascending key order

``n`` keys map onto ``n`` slots (hash and displace), so a lookup is two hashes,
one compare of the fingerprint and one slice. Shards follow each other in
ascending doc_id; the table's ``lo``/``hi`` columns route a key to its shard.

Defined cases: null text is the empty string, which has the end id alone. Rows
that repeat a doc_id are all kept, in the order of a hash of their text, and are told
apart by their occurrence number inside the shard. A null doc_id sorts first and is a key of its own. A very long
text is encoded whole and its shard grows with it. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import stored, table, text_or_empty
from .tokenizing import default_file, encoder, with_end

HEADER = struct.Struct("<4sBxxxIIQI")
SLOT = np.dtype([("fp", "<u4"), ("length", "<u4"), ("offset", "<u8")])
MAGIC = b"MPS1"
#: A shard is closed at this many ids or documents.
SHARD_IDS, SHARD_DOCS = 1 << 19, 1 << 14
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over uint64 arrays."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def key_hash(doc_id: np.ndarray, null: np.ndarray, occurrence: np.ndarray, seed: int) -> np.ndarray:
    h = mix64(doc_id.astype(np.int64).view(np.uint64) + _U(0x9E3779B97F4A7C15) * _U(seed + 1))
    h = mix64(h ^ mix64(occurrence.astype(np.uint64) * _U(2) + null.astype(np.uint64) + _U(0x5851F42D4C957F2D)))
    return h


def _place(h: np.ndarray, d, n: int) -> np.ndarray:
    return mix64(h ^ (np.asarray(d, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))) % _U(n)


def fingerprint(h: np.ndarray) -> np.ndarray:
    return (mix64(h ^ _U(0xA0761D6478BD642F)) >> _U(32)).astype(np.uint32)


def build_mph(h: np.ndarray) -> np.ndarray | None:
    """Displacements of a minimal perfect hash over distinct ``h``; None if this seed fails."""
    n = len(h)
    m = max(1, -(-n // 4))
    bucket = (h % _U(m)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=m)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    disp, taken = np.zeros(m, dtype=np.int32), np.zeros(n, dtype=bool)
    tries = np.arange(1, 65, dtype=np.uint64)[:, None]
    for b in np.argsort(-sizes, kind="stable"):
        keys = h[order[starts[b] : starts[b + 1]]]
        if len(keys) < 2:
            break
        for base in range(0, 1 << 16, 64):
            at = _place(keys[None, :], tries + _U(base), n).astype(np.int64)
            ranked = np.sort(at, axis=1)
            fits = ~taken[at].any(axis=1) & (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
            if fits.any():
                first = int(fits.argmax())
                disp[b] = base + first + 1
                taken[at[first]] = True
                break
        else:
            return None
    free = iter(np.flatnonzero(~taken).tolist())
    for b in np.flatnonzero(sizes == 1).tolist():
        disp[b] = -next(free) - 1
    return disp


def lookup_slots(h: np.ndarray, disp: np.ndarray, n: int) -> np.ndarray:
    d = disp[(h % _U(len(disp))).astype(np.int64)].astype(np.int64)
    return np.where(d < 0, -d - 1, _place(h, np.maximum(d, 0), n).astype(np.int64))


def occurrences(doc_id: np.ndarray, null: np.ndarray) -> np.ndarray:
    """0, 1, ... within runs of equal neighbours."""
    n = len(doc_id)
    new = np.ones(n, dtype=bool)
    new[1:] = (doc_id[1:] != doc_id[:-1]) | (null[1:] != null[:-1])
    at = np.arange(n)
    return at - np.maximum.accumulate(np.where(new, at, 0))


def pack_shard(doc_id: np.ndarray, null: np.ndarray, lengths: np.ndarray, payload: bytes, id_bytes: int) -> bytes:
    n = len(doc_id)
    occurrence = occurrences(doc_id, null)
    for seed in range(64):
        h = key_hash(doc_id, null, occurrence, seed)
        disp = build_mph(h)
        if disp is not None:
            break
    else:
        raise ValueError("no perfect hash found")
    slots = np.zeros(n, dtype=SLOT)
    at = lookup_slots(h, disp, n)
    slots["fp"][at], slots["length"][at] = fingerprint(h), lengths
    slots["offset"][at] = np.cumsum(lengths) - lengths
    head = HEADER.pack(MAGIC, id_bytes, n, len(disp), int(lengths.sum()), seed)
    return b"".join((head, disp.astype("<i4").tobytes(), slots.tobytes(), payload))


class Shard:
    """Keyed access to the bytes of one shard."""

    def __init__(self, data: bytes):
        magic, self.id_bytes, self.n, m, self.n_ids, self.seed = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = HEADER.size
        self.disp = np.frombuffer(data, "<i4", m, at)
        self.slots = np.frombuffer(data, SLOT, self.n, at + 4 * m)
        self.ids = np.frombuffer(data, f"<u{self.id_bytes}", self.n_ids, at + 4 * m + SLOT.itemsize * self.n)

    def locate(self, doc_id: np.ndarray, null: np.ndarray, occurrence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Found, offset and length of each key; a foreign key has a wrong fingerprint."""
        if not self.n:
            none = np.zeros(len(doc_id), dtype=np.int64)
            return none.astype(bool), none, none
        h = key_hash(doc_id, null, occurrence, self.seed)
        slots = self.slots[lookup_slots(h, self.disp, self.n)]
        return slots["fp"] == fingerprint(h), slots["offset"].astype(np.int64), slots["length"].astype(np.int64)

    def get(self, doc_id: int | None, occurrence: int = 0) -> np.ndarray | None:
        found, offset, length = self.locate(np.array([doc_id or 0]), np.array([doc_id is None]), np.array([occurrence]))
        return self.ids[offset[0] : offset[0] + length[0]] if found[0] else None


SHARDS = "shard long, lo long, hi long, n_docs long, n_ids long, keys binary, nulls binary, data binary"


def write_shards(docs: DataFrame, file: str, end_id: int = 0, keeps_space: bool = True, id_bytes: int = 2) -> DataFrame:
    """Encodes ``docs(doc_id, text)`` and writes shards in ascending doc_id; returns the stored table.

    The range exchange is on doc_id, then the text's hash, so that a doc_id
    repeated over a third of all rows still spreads.
    """

    def shards(batches):
        part, block = TaskContext.get().partitionId(), 0
        keys, nulls, lengths, payload, docs_held, ids_held = [], [], [], [], 0, 0

        def close():
            doc_id, null, n = np.concatenate(keys), np.concatenate(nulls), np.concatenate(lengths)
            data = pack_shard(doc_id, null, n, b"".join(payload), id_bytes)
            row = [(part << 32) | block, None if null[0] else int(doc_id[0]), None if null[-1] else int(doc_id[-1]), len(n), int(n.sum()), doc_id.tobytes(), null.tobytes(), data]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int64()] * 5 + [pa.binary()] * 3)], names=[c.split()[0] for c in SHARDS.split(", ")])

        for batch in batches:
            ids, counts = with_end(*encoder(file, keeps_space, f"<u{id_bytes}").encode(batch.column(1)), end_id)
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            doc_id = batch.column(0).fill_null(0).to_numpy()
            ends, at = np.cumsum(counts), 0
            while at < len(counts):
                before = int(ends[at - 1]) if at else 0
                # up to the document that reaches the limit of ids, and no further than that of documents
                end = min(int(np.searchsorted(ends, before + SHARD_IDS - ids_held)) + 1, at + SHARD_DOCS - docs_held, len(counts))
                keys.append(doc_id[at:end])
                nulls.append(null[at:end])
                lengths.append(counts[at:end])
                payload.append(ids[before : int(ends[end - 1])].tobytes())
                docs_held, ids_held, at = docs_held + end - at, ids_held + int(ends[end - 1]) - before, end
                if ids_held >= SHARD_IDS or docs_held >= SHARD_DOCS:
                    yield close()
                    keys, nulls, lengths, payload, docs_held, ids_held, block = [], [], [], [], 0, 0, block + 1
        if keys:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    tie = F.xxhash64("text")
    rows = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    return stored(rows.mapInArrow(shards, SHARDS), "token-shards")


def read_documents(shards: DataFrame) -> DataFrame:
    """One row a document, found through its shard's index: shard, doc_id, offset, n_tokens, ids_crc32."""

    def read(batches):
        for batch in batches:
            cols = batch.to_pydict()
            for shard, keys, nulls, data in zip(cols["shard"], cols["keys"], cols["nulls"], cols["data"]):
                s = Shard(data)
                doc_id, null = np.frombuffer(keys, np.int64), np.frombuffer(nulls, bool)
                found, offset, length = s.locate(doc_id, null, occurrences(doc_id, null))
                if not found.all():
                    raise ValueError(f"shard {shard}: a key is not in its index")
                wide = s.ids.astype("<u4")
                crc = [zlib.crc32(wide[a : a + n]) for a, n in zip(offset.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(doc_id), shard)), pa.array(doc_id, mask=null), pa.array(offset), pa.array(length), pa.array(crc, pa.int64())],
                    names=["shard", "doc_id", "offset", "n_tokens", "ids_crc32"],
                )

    return shards.select("shard", "keys", "nulls", "data").mapInArrow(read, "shard long, doc_id long, offset long, n_tokens long, ids_crc32 long")


def lookup(shards: DataFrame, keys: DataFrame) -> DataFrame:
    """Ids of the documents named in ``keys(doc_id)``: doc_id, ids (array of long).

    Keys are routed twice: to the write's partitions, whose ranges are one small row each, and
    by an equi-join on the partition to its shards; only shards with a key are opened. A key
    that is in no shard has no row.
    """
    least = F.coalesce("lo", F.lit(-(2**63)))
    directory = shards.select("shard", F.shiftright("shard", 32).alias("part"), least.alias("lo"), F.coalesce("hi", F.lit(-(2**63))).alias("hi"))
    ranges = directory.groupBy("part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()  # at most one row a shuffle partition
    wanted = keys.select(F.col("doc_id").cast("long").alias("key")).where("key is not null").distinct()
    known = F.array(*[F.struct(F.lit(r["part"]).alias("part"), F.lit(r["lo"]).alias("lo"), F.lit(r["hi"]).alias("hi")) for r in ranges])
    inside = F.filter(known, lambda r: (r["lo"] <= F.col("key")) & (F.col("key") <= r["hi"])) if ranges else F.array().cast("array<struct<part:bigint,lo:bigint,hi:bigint>>")
    routed = wanted.withColumn("part", F.explode(F.transform(inside, lambda r: r["part"]))).join(directory, "part").where("lo <= key and key <= hi")
    by_shard = routed.groupBy("shard").agg(F.collect_list("key").alias("wanted"))

    def get(batches):
        for batch in batches:
            for keys_of, data in zip(batch.column("wanted").to_pylist(), batch.column("data").to_pylist()):
                s = Shard(data)
                out = []
                for k in keys_of:
                    at = 0
                    while (found := s.get(k, at)) is not None:
                        out.append((k, found.astype(np.int64).tolist()))
                        at += 1
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([v for _, v in out], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return shards.select("shard", "data").join(by_shard, "shard").select("wanted", "data").mapInArrow(get, "doc_id long, ids array<long>")


def with_starts(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """Adds ``start``, the ids of all documents before. Shards are added up within their partition, and partitions (as many as the shuffle had) among each other."""
    sums = shards.select("shard", "n_ids", F.shiftright("shard", 32).alias("part"))
    earlier = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sums.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", earlier(Window.orderBy("part")).alias("part_base"))
    base = sums.select("part", "shard", earlier(Window.partitionBy("part").orderBy("shard")).alias("shard_base")).join(parts, "part")
    base = base.select("shard", (F.col("part_base") + F.col("shard_base")).alias("base"))
    return rows.join(base, "shard").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", "shard")


def op4_mph_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = write_shards(table(spark, sf_dir, "documents"), default_file("byte_bpe_50k.json"))
    return with_starts(read_documents(shards), shards)
