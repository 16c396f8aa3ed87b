"""Document fingerprints from closed syncmers, in DataFrame functions alone (operator 3).

The alphabet is that of bytes of UTF-8. A k-mer of ``K`` bytes is kept where the smallest hash of
its ``W`` inner substrings of ``S`` bytes, the leftmost of equal ones, is that of the
first or the last. This looks at nothing outside the k-mer, so the same passage
keeps the same anchors in any document. Before its first byte a text has K - 1 zero bytes, so that
each byte ends one k-mer and short texts have anchors too. A fingerprint is all distinct anchor
hashes, ascending; with the first position of each it is matched, and the
likeness of two texts is the share of matches in their union.

The hash of an inner substring carries its place in the low bits, so that the
minimum of a window says where it is; minima of windows come by doubling. Bytes are worked on in
blocks that overlap by K - 1, so that a very long text never needs arrays of its
own length for each step.

An edited text keeps the anchors of the text before the cut and has those of the next
document's beginning; only the k-mers over the cut are hashed anew.

The next document comes from one range exchange: bucket borders and each
bucket's top doc_id are at most one number a shuffle partition, each
bucket also gets the top row of the bucket below it, which its own last row is
followed by, and is a partition of its own.

Defined cases: null text is the empty string, with the empty fingerprint; two
empty fingerprints have likeness 1, an empty and another one 0; a text without
a syncmer has the hash of the whole text as its anchor; rows
with equal doc_id follow each other by a hash of their text; null doc_id comes
last; a single document follows itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import table, text_or_empty

#: Bytes of an inner substring, inner substrings of a k-mer (a power of two), and bytes of a k-mer.
S, W = 8, 16
K = S + W - 1
#: k-mers of a block, and the low bits of a hash that hold a place in one.
BLOCK, PLACES = 16_384, (1 << 15) - 1
_ALL = 1 << 30


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _ahead(x: Column, n: int) -> Column:
    return F.slice(x, n + 1, _ALL)


def _hash32(x: Column) -> Column:
    return F.xxhash64(x).bitwiseAND(0xFFFFFFFF)


def _packed(hash: Column, pos: Column) -> Column:
    return F.shiftleft(hash, 31) + pos


def hash_of(x: Column) -> Column:
    return F.shiftrightunsigned(x, 31)


def pos_of(x: Column) -> Column:
    return x.bitwiseAND(2**31 - 1)


def _least_of_two(n: int):
    """Each entry or the one ``n`` places ahead, whichever is less."""
    return lambda x: F.zip_with(x, _ahead(x, n), lambda p, q: F.least(p, q))


def _block_anchors(b: Column, base: Column) -> Column:
    """Anchors among the k-mers of bytes (at least K of them), the first of which ends at byte ``base + 1`` of its text."""

    def places(b: Column) -> Column:
        code = lambda i: F.xxhash64(F.substring(b, i, F.lit(S))).bitwiseAND(~PLACES).bitwiseOR(i)
        least = F.transform(F.sequence(F.lit(1), F.octet_length(b) - (S - 1)), code)
        step = 1
        while step < W:
            least = let(least, _least_of_two(step))
            step *= 2
        whole = let(least, lambda x: F.slice(x, 1, F.size(x) - (W - 1)))
        ends = F.transform(whole, lambda x, i: let(x.bitwiseAND(PLACES) - i, lambda at: F.when((at == 1) | (at == W), i + 1)))
        return F.transform(F.filter(ends, lambda i: i.isNotNull()), lambda i: _packed(_hash32(F.substring(b, i, F.lit(K))), i + base))

    return let(b, places)


def _anchors_of(padded: Column) -> Column:
    """Anchors of bytes that begin with K - 1 that end no k-mer."""

    def blocks(b: Column) -> Column:
        n = F.octet_length(b) - (K - 1)
        starts = F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))
        some = F.flatten(F.transform(starts, lambda k: _block_anchors(F.substring(b, k * BLOCK + 1, F.lit(BLOCK + K - 1)), k * BLOCK)))
        return F.when(n > 0, some).otherwise(F.array().cast("array<bigint>"))

    return let(padded, blocks)


def _padded(text: Column) -> Column:
    return F.concat(F.lit(bytes(K - 1)), text.cast("binary"))


def anchors(text: Column) -> Column:
    """Closed syncmers of a text in the order of their places: hash * 2**31 + the byte, from 1, at which the k-mer ends."""
    return _anchors_of(_padded(text))


def edited_anchors(text: Column, own: Column, cut: Column, following: Column, after: Column, part: Column) -> Column:
    """Anchors of the first ``cut`` bytes of a text and the first ``part`` of the following one, from those of both."""
    behind = F.substring(_padded(text), cut + 1, F.lit(K - 1))  # the K - 1 bytes before the cut
    over = F.concat(behind, F.substring(following.cast("binary"), F.lit(1), F.least(part, F.lit(K - 1))))
    kept = F.filter(own, lambda x: pos_of(x) <= cut)
    moved = F.filter(after, lambda x: (pos_of(x) >= K) & (pos_of(x) <= part))
    shifted = lambda xs: F.transform(xs, lambda x: x + cut)
    return F.concat(kept, shifted(_anchors_of(over)), shifted(moved))


def firsts(found: Column, text: Column) -> Column:
    """Each distinct anchor hash with its first place, ascending; the hash of the whole text where there are no anchors."""
    some = let(F.sort_array(found), lambda s: F.filter(s, lambda x, i: (i == 0) | (hash_of(F.get(s, i - 1)) != hash_of(x))))
    return let(some, lambda x: F.when((F.size(x) > 0) | (F.octet_length(text) == 0), x).otherwise(F.array(_packed(_hash32(text), F.lit(0)))))


def hashes(x: Column) -> Column:
    return F.transform(x, hash_of)


def matches(a: Column, b: Column) -> Column:
    """Positional matching: (a_pos, b_pos) of the hashes that two results of :func:`firsts` share."""
    side = lambda x, k: F.transform(x, lambda v: F.struct(hash_of(v).alias("hash"), F.lit(k).alias("side"), pos_of(v).alias("pos")))
    pair = lambda x, y: F.when((x["side"] == 0) & (y["hash"] == x["hash"]), F.struct(x["pos"].alias("a_pos"), y["pos"].alias("b_pos")))
    both = F.sort_array(F.concat(side(a, 0), side(b, 1)))
    return let(both, lambda s: F.filter(F.transform(s, lambda x, i: pair(x, F.get(s, i + 1))), lambda x: x.isNotNull()))


def matched(a: Column, b: Column) -> Column:
    """How many pairs :func:`matches` gives: hashes are distinct on either side, so equal neighbours are a pair."""
    both = F.sort_array(F.concat(a, b))
    return let(both, lambda s: F.size(F.filter(s, lambda x, i: hash_of(x) == hash_of(F.get(s, i + 1)))))


def likeness(a: Column, b: Column) -> Column:
    """Matches of two results of :func:`firsts` in proportion to their union, 0 to 1."""
    share = let(matched(a, b), lambda m: m / F.greatest(F.size(a) + F.size(b) - m, F.lit(1)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(share)


def as_string(x: Column) -> Column:
    return F.array_join(F.transform(x, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, anchors and fingerprint (array) of ``docs(doc_id, text)``."""
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("found", anchors(F.col("text")))
    as_pairs = F.transform("found", lambda x: F.struct(pos_of(x).alias("pos"), hash_of(x).alias("hash")))
    return rows.select("doc_id", F.char_length("text").alias("n_chars"), as_pairs.alias("anchors"), hashes(firsts(F.col("found"), F.col("text"))).alias("fingerprint"))


def in_order():
    """Descending doc_id within a bucket, then the guest of the bucket below."""
    return Window.partitionBy("bucket").orderBy("guest", F.desc("key"), "tie")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows ``doc_id, text, bucket, guest, key, tie, next_text`` in descending doc_id within buckets, guests included."""
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("tie", F.xxhash64("text"))
    keys = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key"))
    quantiles = F.percentile_approx("key", [k / n for k in range(1, n)] or [0.5], 100 * n)
    cuts, low = keys.agg(quantiles, F.min("key")).first()
    cuts = sorted({c for c in cuts or [] if c != low})  # fewer than n numbers, each the key of a row
    borders = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    bucket = F.size(F.filter(borders, lambda c: c <= F.col("key")))
    tops = {r["bucket"]: r["top"] for r in keys.groupBy(bucket.alias("bucket")).agg(F.max("key").alias("top")).collect()}  # one row a bucket
    last = max(tops, default=0)
    guests = F.array(*[F.lit(t).cast("long") for t in tops.values()]) if tops else F.array().cast("array<bigint>")
    above = F.when(F.col("bucket") == last, F.lit(0)).otherwise(F.col("bucket") + 1)
    places = F.when(F.array_contains(guests, F.col("key")), F.array(F.struct("bucket", F.lit(0).alias("guest")), F.struct(above.alias("bucket"), F.lit(1).alias("guest")))).otherwise(
        F.array(F.struct("bucket", F.lit(0).alias("guest")))
    )
    rows = rows.withColumn("bucket", bucket).select("doc_id", "text", "key", "tie", F.explode(places).alias("place"))
    rows = rows.select("doc_id", "text", "key", "tie", "place.bucket", "place.guest")
    rows = rows.repartitionById(n, F.col("bucket").cast("int"))
    return rows.withColumn("next_text", F.lead("text").over(in_order()))


def op3_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(table(spark, sf_dir, "documents")).withColumn("next_text", F.coalesce("next_text", F.lit("")))
    n = F.char_length("text")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("moved", F.floor(n / 3).cast("int"))
    rows = rows.withColumns({"kept": F.substring("text", F.lit(1), n - F.col("moved")), "part": F.substring("next_text", F.lit(1), F.col("moved"))})
    rows = rows.withColumns({"cut": F.octet_length("kept"), "more": F.octet_length("part"), "found": anchors(F.col("text"))})
    rows = rows.withColumn("own", firsts(F.col("found"), F.col("text")))
    none = F.array().cast("array<bigint>")
    after = {c: F.coalesce(F.lead(x).over(in_order()), none) for c, x in (("found_next", "found"), ("own_next", "own"))}
    rows = rows.withColumns(after).where("guest = 0").withColumn("edited", F.concat("kept", "part"))
    edited = edited_anchors(F.col("text"), F.col("found"), F.col("cut"), F.col("next_text"), F.col("found_next"), F.col("more"))
    rows = rows.withColumn("own_edited", firsts(edited, F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_string(hashes(F.col("own"))).alias("fingerprint"), as_string(hashes(F.col("own_edited"))).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("own_edited")).alias("near_edited"), likeness(F.col("own"), F.col("own_next")).alias("near_next"),
    )
