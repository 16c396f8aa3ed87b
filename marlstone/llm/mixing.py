"""Mixing sources to target weights by Pareto order sampling (operator 8).

A source's target is a share of all words, by weight, but at most
``most_copies`` times its own words (water filling). Of target / source size copies
the whole part is certain for each document; the rest of the target is sampled.

Inclusion odds grow with the root of a document's size: a document of n words has odds
theta sqrt(n), and theta is such that the expected words are the rest of the target.
A source is drawn in strata of like size (half octaves). The number that a stratum gives is
fixed: the sum of its inclusion probabilities, rounded down along the strata from long to short, so that
what one stratum lacks the next, of shorter documents, gives. Inside a stratum the
documents with the smallest Pareto keys are taken,

    (u / (1 - u)) / (theta sqrt(n)),   u uniform from a hash of the row.

Words that rounding leaves missing are filled by documents that fit, in the order of their keys, in passes until little
is missing; one more document, the one whose size is closest to the words
then missing, is taken, or one is left out, where this brings the sum nearer to the target.

No source and no stratum is ever sorted in one task: keys fall into fixed bins whose sums
find the bin in which the number is reached, and only this bin is ranked. Prefix sums over all
sources go by range partitions.

Defined cases: null text has size 0 and takes 0 words; null is a source of its
own, last in the order; identical rows tie and either may be taken; very long texts count whole; an empty
table gives an empty result; other columns are ignored, or kept in one struct. If a size is 0
everywhere, every target is 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import broadcast_if_small, stored, table, text_or_empty

#: Bins of the Pareto key; a bin of a hot group has about this fraction of its rows.
BINS = 4096
#: Share of a target that may be missing before documents past one that did not fit are tried, and how often they are.
SMALL_GAP, MOST_PASSES = 0.001, 20


def word_count(text):
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _running(df: DataFrame, order: list, sums: dict[str, str], name: str) -> DataFrame:
    """``df`` with running sums of columns (new name: column) in an order of all rows; partitions of the order are added up by themselves."""
    placed = stored(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), name)
    here = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    parts = placed.groupBy("__part").agg(*[F.sum(c).alias(f"__{new}") for new, c in sums.items()])
    parts = parts.select("__part", *[F.coalesce(F.sum(f"__{new}").over(before), F.lit(0)).alias(f"__{new}") for new in sums])
    out = placed.withColumns({new: F.sum(c).over(here) for new, c in sums.items()}).join(F.broadcast(parts), "__part")
    return out.withColumns({new: F.col(new) + F.col(f"__{new}") for new in sums}).drop("__part", *[f"__{new}" for new in sums])


def source_targets(sizes: DataFrame, most_copies: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Targets by source key from ``sizes(skey, source, source_size)``, one row a source.

    With sources in the order of cap / weight, the capped ones are a prefix;
    the first source that its share of the rest does not cap fixes the level.
    """
    # null last, then code points: UTF-8 bytes sort alike
    out = _running(sizes.withColumn("one", F.lit(1)), [F.col("source").isNull(), F.col("source")], {"nth": "one"}, "mix-names")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("nth") - 1) % len(weights) + 1).cast("int"))
    out = out.withColumn("weight", weight).withColumn("cap", F.lit(float(most_copies)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    out = _running(out, [F.col("ratio"), F.col("skey")], {"place": "one", "cap_to": "cap", "weight_to": "weight"}, "mix-ratios")
    out = stored(out, "mix-levels")
    totals = out.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    level = (F.lit(totals["words"] or 0) - (F.col("cap_to") - F.col("cap"))) / (F.lit(totals["weight"] or 0.0) - (F.col("weight_to") - F.col("weight")))
    out = out.withColumn("level", level)
    first = out.agg(F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).alias("first")).first()["first"]
    place, level = (first["place"], first["level"]) if first else (0, 0.0)
    free = F.col("place") >= place
    return out.select("skey", "source_size", F.when(free, F.col("weight") * F.lit(float(level))).otherwise(F.col("cap")).alias("target"))


def draws(strata: DataFrame) -> DataFrame:
    """theta of each source and the number that each stratum gives, from ``strata(skey, rest, stratum, n, words)``.

    A stratum counts with its mean size here; a source has at most two strata for each doubling of the size.
    """
    parts = F.collect_list(F.struct(F.col("stratum"), F.col("n").cast("double").alias("n"), F.col("words").cast("double").alias("words")))
    out = strata.groupBy("skey", "rest").agg(parts.alias("parts"))
    odds = lambda x, log: F.exp(log) * F.sqrt(x["words"] / x["n"])
    expected = lambda log: F.aggregate("parts", F.lit(0.0), lambda acc, x: acc + x["words"] * odds(x, log) / (1 + odds(x, log)))
    halved = lambda at, i: F.when(expected(at) < F.col("rest"), at + F.pow(F.lit(0.5), i - 6)).otherwise(at - F.pow(F.lit(0.5), i - 6))
    out = out.withColumn("theta", F.exp(F.aggregate(F.sequence(F.lit(1), F.lit(50)), F.lit(0.0), lambda at, i: halved(at, i))))
    out = out.select("skey", "theta", F.explode("parts").alias("part")).select("skey", "theta", "part.*")
    share = F.col("theta") * F.sqrt(F.col("words") / F.col("n"))
    upto = F.sum(F.col("n") * share / (1 + share)).over(Window.partitionBy("skey").orderBy(F.desc("stratum")))
    out = out.withColumn("upto", F.floor(upto + 1e-9))
    give = F.col("upto") - F.coalesce(F.lag("upto").over(Window.partitionBy("skey").orderBy(F.desc("stratum"))), F.lit(0))
    return out.select("skey", "stratum", "theta", F.least(give, F.col("n")).cast("double").alias("give"))


def _taken_in_order(ranked: DataFrame, by: list[str], amount: str) -> DataFrame:
    """row, skey, size of those of ``ranked(row, skey, doc_id, size, u, odds, rest)`` that come, by key, before the sum of ``amount`` passes ``rest`` of their group."""
    ranked = ranked.withColumn("key", F.col("u") / (1 - F.col("u")) / F.col("odds")).withColumn("amount", F.expr(amount))
    ranked = ranked.withColumn("bin", F.floor(F.col("key") / (1 + F.col("key")) * BINS))
    sums = ranked.groupBy(*by, "rest", "bin").agg(F.sum("amount").alias("sum"))
    sums = sums.withColumn("upto", F.sum("sum").over(Window.partitionBy(*by).orderBy("bin"))).where("upto > rest")
    edge = sums.groupBy(*by).agg(F.min_by(F.struct("bin", (F.col("upto") - F.col("sum")).alias("before")), "bin").alias("edge"))
    edge = edge.select(*by, F.col("edge.bin").alias("edge_bin"), F.col("edge.before").alias("before"))
    edge = broadcast_if_small(stored(edge, "mix-edges"))

    ranked = ranked.join(edge, by, "left").withColumn("edge_bin", F.coalesce("edge_bin", F.lit(BINS + 1)))
    inside = ranked.where("bin < edge_bin").select("row", "skey", "size")
    upto = F.sum("amount").over(Window.partitionBy(*by).orderBy("key", "doc_id", "row").rowsBetween(Window.unboundedPreceding, 0))
    at_edge = ranked.where("bin = edge_bin").withColumn("upto", upto + F.col("before")).where("upto <= rest").select("row", "skey", "size")
    return inside.unionByName(at_edge)


def pareto_mix(docs: DataFrame, most_copies: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: int = 20240501, keep: bool = False) -> DataFrame:
    """Per row of ``docs(doc_id, text, source)``: doc_id, size, source, source_size, target, copies, taken, and, to ``keep``, the row itself as ``doc``."""
    doc = [F.struct(*docs.columns).alias("doc")] if keep else []
    skey = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source"))
    u = (F.xxhash64(F.lit(seed), "doc_id", "text", "source").bitwiseAND((1 << 52) - 1) + F.lit(0.5)) / F.lit(float(1 << 52))
    rows = docs.select("doc_id", "source", *doc, skey.alias("skey"), word_count(text_or_empty()).alias("size"), u.alias("u"))
    whole = stored(rows.withColumn("row", F.monotonically_increasing_id()), "mix-rows")
    rows = whole.drop("doc")

    targets = source_targets(rows.groupBy("skey", "source").agg(F.sum("size").alias("source_size")), most_copies, weights)
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.withColumn("whole", F.floor(copies + F.lit(1e-12)))
    targets = stored(targets.withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))), "mix-targets")
    targets = broadcast_if_small(targets)  # one row a source; a hot source's rows then stay where they are

    rows = rows.where("size > 0").withColumn("stratum", F.floor(2 * F.log2("size")).cast("int"))
    strata = rows.groupBy("skey", "stratum").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    strata = strata.join(targets.select("skey", "rest"), "skey").where("rest > 0")
    given = broadcast_if_small(stored(draws(strata), "mix-draws"))
    drawn = rows.join(given, ["skey", "stratum"])
    odds = F.col("theta") * F.sqrt("size")
    ranked = drawn.withColumn("odds", odds).withColumn("rest", F.col("give"))
    taken = stored(_taken_in_order(ranked, ["skey", "stratum"], "1"), "mix-taken")

    def missing(taken: DataFrame) -> DataFrame:
        got = taken.groupBy("skey").agg(F.sum("size").alias("got"))
        gaps = targets.where("rest > 0").join(got, "skey", "left").select("skey", "target", (F.col("rest") - F.coalesce("got", F.lit(0))).alias("gap"))
        return broadcast_if_small(stored(gaps, "mix-gaps"))

    gaps = missing(taken)
    for _ in range(MOST_PASSES):
        wide = gaps.where(F.col("gap") > SMALL_GAP * F.col("target")).select("skey", F.col("gap").alias("rest"))
        if wide.isEmpty():
            break
        fit = rows.join(broadcast_if_small(wide), "skey").where(F.col("size") <= F.col("rest")).join(taken.select("row"), "row", "left_anti")
        more = stored(_taken_in_order(fit.withColumn("odds", F.sqrt("size")), ["skey"], "size"), "mix-more")
        if more.isEmpty():
            break
        taken = stored(taken.unionByName(more), "mix-taken")
        gaps = missing(taken)
    closest = lambda gap: F.struct(F.abs(F.col("size") - gap), "u", "doc_id", "row")
    short, over = gaps.where("gap > 0").select("skey", "gap"), gaps.where("gap < 0").select("skey", (-F.col("gap")).alias("gap"))
    left = rows.join(short, "skey").where(F.col("size") < 2 * F.col("gap")).join(taken.select("row"), "row", "left_anti")
    last = left.groupBy("skey").agg(F.min(closest(F.col("gap"))).alias("best")).select(F.col("best.row").alias("row"), F.lit(1).alias("extra"))
    much = rows.join(over, "skey").where(F.col("size") < 2 * F.col("gap")).join(taken.select("row"), "row", "left_semi")
    less = much.groupBy("skey").agg(F.min(closest(F.col("gap"))).alias("best")).select(F.col("best.row").alias("row"), F.lit(-1).alias("extra"))

    extra = taken.select("row", F.lit(1).alias("extra")).unionByName(last).unionByName(less).groupBy("row").agg(F.sum("extra").alias("extra"))
    out = whole.join(extra, "row", "left").join(targets, "skey")
    out = out.withColumn("copies", F.col("whole") + F.coalesce("extra", F.lit(0)))
    return out.select("doc_id", "size", "source", "source_size", "target", F.col("copies").cast("int").alias("copies"), (F.col("copies") * F.col("size")).alias("taken"), *(["doc"] if keep else []))


def op8_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pareto_mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")
