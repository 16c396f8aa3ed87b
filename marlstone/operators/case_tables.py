"""Tables of cases and their logs: inserting, activating, scans, timelines and numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_cases(cases: DataFrame, new: DataFrame, key: str = "case_id") -> DataFrame:
    """``cases`` and the new ones; of new rows with one key, the first by name. A key that exists is an error, as a unique key would raise it."""
    clash = new.join(cases, key, "left_semi").limit(1).collect()
    if clash:
        raise ValueError(f"case exists already: {clash[0][key]}")
    first = new.withColumn("__nth", F.row_number().over(Window.partitionBy(key).orderBy(*[c for c in new.columns if c != key]))).where("__nth = 1").drop("__nth")
    return cases.unionByName(first)


def set_active(cases: DataFrame, case_id, key: str = "case_id") -> DataFrame:
    """One case is active and no other; no case is where the id is unknown."""
    return cases.withColumn("is_active", F.coalesce(F.col(key) == F.lit(case_id), F.lit(False)))


def rename(cases: DataFrame, case_id, name: str, key: str = "case_id") -> DataFrame:
    return cases.withColumn("case_name", F.when(F.col(key) == F.lit(case_id), F.lit(name)).otherwise(F.col("case_name")))


def active_case(cases: DataFrame, counts: DataFrame, key: str = "case_id") -> DataFrame:
    """The active case with its number of records; the limit is that of one row."""
    return cases.where("is_active").orderBy(key).limit(1).join(counts, key, "left").fillna(0, ["records"])


def log_of(log: DataFrame, case: str, case_id=None, evidence: str | None = None, evidence_id=None) -> DataFrame:
    """The log of a case, or of one record in it, newest first by id."""
    out = log if case_id is None else log.where(F.col(case) == F.lit(case_id))
    if evidence is not None:
        out = out.where(F.col(evidence) == F.lit(evidence_id))
    return out.orderBy(F.desc("id"))


def latest_hash(log: DataFrame, case: str, order: str = "id", first: str = "GENESIS") -> DataFrame:
    """(case, last_hash): what the next event of each case continues."""
    return log.groupBy(case).agg(F.coalesce(F.max_by("event_hash", order), F.lit(first)).alias("last_hash"))


def timeline(records: DataFrame, case: str, time: str, key: str) -> DataFrame:
    """Records of each case in order, unknown times last: place, and how many records of the case have a time."""
    w = Window.partitionBy(case).orderBy(F.col(time).isNull(), time, key)
    known = records.groupBy(case).agg(F.count(time).alias("dated"))
    return records.withColumn("place", F.row_number().over(w)).join(known, case)


def evidence_numbers(records: DataFrame, case: str, order: str, prefix: str = "IMG-") -> DataFrame:
    """A number of three digits or more for each record of a case, in the order of import."""
    nth = F.row_number().over(Window.partitionBy(case).orderBy(order))
    return records.withColumn("number", F.concat(F.lit(prefix), F.lpad(nth.cast("string"), F.greatest(F.lit(3), F.length(nth.cast("string"))), F.lit("0"))))


def best_peers(relations: DataFrame) -> DataFrame:
    """The best duplicate peer of each record from ``relations(left_id, right_id, relation, score, distance)``: by score, distance and id."""
    both = relations.select(F.col("left_id").alias("id"), F.col("right_id").alias("peer"), "relation", "score", "distance")
    both = both.unionByName(relations.select(F.col("right_id").alias("id"), F.col("left_id").alias("peer"), "relation", "score", "distance"))
    best = F.min_by(F.struct("peer", "relation", "score", "distance"), F.struct(-F.col("score"), "distance", "peer")).alias("b")
    return both.groupBy("id").agg(best, F.count(F.lit(1)).alias("peers")).select("id", "b.*", "peers")


def histogram(values: DataFrame, column: str, bins: int = 8) -> DataFrame:
    """(bin, low, high, n) of equal bins from the least to the largest value; empty bins are kept."""
    ends = values.agg(F.min(column).cast("double").alias("least"), F.max(column).cast("double").alias("most")).first()
    least, width = ends["least"], (ends["most"] - ends["least"]) / bins if ends["least"] is not None else 0.0
    at = F.least(F.floor((F.col(column) - F.lit(least)) / F.lit(width)), F.lit(bins - 1)).cast("int") if width else F.lit(0)
    counts = values.where(F.col(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = values.sparkSession.range(bins if least is not None else 0).select(F.col("id").cast("int").alias("bin"))
    low = lambda k: F.lit(least or 0.0) + k * F.lit(width)
    return grid.join(counts, "bin", "left").select("bin", low(F.col("bin")).alias("low"), low(F.col("bin") + 1).alias("high"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def top_values(records: DataFrame, case: str, column: str, most: int = 2) -> DataFrame:
    """The most frequent values of each case with their counts; of equals the first by name."""
    counts = records.groupBy(case, column).agg(F.count(F.lit(1)).alias("n"))
    nth = F.row_number().over(Window.partitionBy(case).orderBy(F.desc("n"), column))
    return counts.withColumn("nth", nth).where(F.col("nth") <= most)


def privacy_issues(c=F.col, strict: bool = True) -> Column:
    """array<struct<issue, severity>> of what an export of a record would give away."""
    one = lambda issue, severity: F.struct(F.lit(issue).alias("issue"), F.lit(severity).alias("severity"))
    if not strict:
        return F.array(one("internal_export", "Medium"))
    return F.array_compact(F.array(
        one("raw_filename", "Low"),
        F.when(c("gps_latitude").isNotNull() | c("derived_latitude").isNotNull() | c("derived_longitude").isNotNull(), one("coordinates", "High")),
        F.when(c("visible_text") | (c("visible_urls") > 0), one("ocr_text", "High")),
        F.when((c("map_labels") > 0) | (c("visible_urls") > 0), one("entities", "Medium")),
    ))


def relationships(records: DataFrame, case: str, key: str, day: Column, most: int | None = None) -> DataFrame:
    """(case, source, target, reason): records of one case that share a duplicate group, else a device, else a day.

    Each record is tied to the first of its group, device and day, so that what hangs together is a star, not all pairs.
    """
    out = None
    for rank, (reason, column) in enumerate((("duplicate", F.nullif("duplicate_group", F.lit(""))), ("device", F.when(~F.col("device_model").isin("Unknown", "N/A", ""), F.col("device_model"))), ("day", day))):
        rows = records.select(case, F.col(key).alias("target"), column.alias("value")).where("value is not null")
        first = rows.groupBy(case, "value").agg(F.min("target").alias("source"))
        star = rows.join(first, [case, "value"]).where("source <> target").select(case, "source", "target", F.lit(rank).alias("rank"), F.lit(reason).alias("reason"))
        out = star if out is None else out.unionByName(star)
    best = out.groupBy(case, "source", "target").agg(F.min_by("reason", "rank").alias("reason"))
    if most is None:
        return best
    nth = F.row_number().over(Window.partitionBy(case).orderBy("source", "target"))
    return best.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")
