"""Vector similarity and bit distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine in double; 0 for different lengths or a zero vector."""
    below = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when((F.size(a) != F.size(b)) | (below == 0), 0.0).otherwise(dot(a, b) / below)


def similarity_score(c: Column) -> Column:
    """A cosine from -1 to 1 as a score from 0 to 100 of two decimals, rounded as SQL rounds doubles; ``round`` would make a decimal of each."""
    return F.floor((F.greatest(F.least(c, F.lit(1.0)), F.lit(-1.0)) + 1) * 50 * 100 + 0.5) / 100


def sign_bits(v: Column, n: int = 64) -> Column:
    """The signs of the first ``n`` values as a bigint, first value lowest."""
    return F.aggregate(F.transform(F.slice(v, 1, n), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(x))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hex_hamming(a: Column, b: Column) -> Column:
    """Hamming distance of 64-bit hex hashes; 64 where one is missing, all zeros or of another length."""
    bad = a.isNull() | b.isNull() | (F.length(a) != F.length(b)) | (a == "") | a.rlike("^0+$") | b.rlike("^0+$")
    bits = lambda h: F.conv(h, 16, -10).cast("bigint")
    return F.when(bad, 64).otherwise(hamming(bits(a), bits(b)))
