"""Case tables: statistics, readiness, ranking, search, upsert, validation."""

from __future__ import annotations

import shlex

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import place_in_group


def percent(x: Column) -> Column:
    """Rounded half to even, as the scores are."""
    return F.bround(x, 0).cast("int")


def case_stats(evidence: DataFrame, case: str = "case_id") -> DataFrame:
    device = F.when(~F.col("device_model").isin("", "Unknown"), F.col("device_model"))
    return evidence.groupBy(case).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("gps_latitude").isNotNull()).alias("gps_enabled"),
        F.count_if(F.col("risk_level") != "Low").alias("anomalies"),
        F.count_distinct(device).alias("devices"),
        F.count_if(F.col("integrity_status") != "Pending Review").alias("checked"),
        F.count_if(F.col("source_type").rlike("Screenshot|Messaging")).alias("screenshots"),
        percent(F.avg("suspicion_score")).alias("avg_score"),
        F.count_if((F.col("parser_status") != "Valid") | (F.col("signature_status") == "Mismatch")).alias("parser_issues"),
        F.count_if("bookmarked").alias("bookmarked"),
    )


def readiness(evidence: DataFrame, case: str = "case_id") -> DataFrame:
    """Five means of a case and their weighted sum. Needs courtroom_strength as ``court``."""
    location = F.when(F.col("gps_latitude").isNotNull(), F.greatest("gps_confidence", F.lit(70))).when(F.col("derived_geo_confidence") > 0, F.least("derived_geo_confidence", F.lit(70)))
    location = location.when(F.col("map_confidence") > 0, F.least("map_confidence", F.lit(55))).otherwise(0)
    sound = (F.col("parser_status") == "Valid") & (F.col("signature_status") != "Mismatch")
    integrity = F.when(F.col("integrity_status") == "Verified", 95).when(F.col("integrity_status") == "Partial", 70).when(sound, 55).otherwise(25)
    out = evidence.groupBy(case).agg(
        percent(F.avg(F.least("timestamp_confidence", F.lit(100)))).alias("timeline"),
        percent(F.avg(location)).alias("location"),
        percent(F.avg(integrity)).alias("integrity"),
        F.greatest(F.lit(45), 100 - 5 * F.count_if(F.col("visible_text") | (F.col("visible_urls") > 0))).cast("int").alias("privacy"),
        percent(F.avg("court")).alias("courtroom"),
    )
    return out.withColumn("overall", percent(0.20 * F.col("timeline") + 0.18 * F.col("location") + 0.24 * F.col("integrity") + 0.13 * F.col("privacy") + 0.25 * F.col("courtroom")))


def dominant(evidence: DataFrame, case: str, column: str, order: str) -> DataFrame:
    """The most frequent value of each case; of equals the one seen first."""
    counts = evidence.where(~F.col(column).isin("", "Unknown", "N/A")).groupBy(case, column).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return counts.groupBy(case).agg(F.max_by(F.struct(column, "n"), F.struct("n", -F.col("first"))).alias("top")).select(case, F.col(f"top.{column}").alias(column), F.col("top.n").alias("n"))


def risk_histogram(evidence: DataFrame, case: str = "case_id") -> DataFrame:
    return evidence.groupBy(case).agg(*(F.count_if(F.col("risk_level") == x).alias(x.lower()) for x in ("High", "Medium", "Low")))


def priority_rank(evidence: DataFrame, case: str = "case_id") -> DataFrame:
    """Adds priority_rank, 1 for the weightiest record of a case; a case may hold any share of all records."""
    return place_in_group(evidence, case, [F.desc("weight"), F.desc("suspicion_score"), F.desc("ocr_confidence"), F.desc("evidence_id")], "priority_rank")


def haystack(columns: list[str]) -> Column:
    return F.lower(F.concat_ws(" ", *(F.nullif(F.col(c).cast("string"), F.lit("")) for c in columns)))


def _yes(v: str) -> Column:
    return F.lit(v in ("yes", "true", "1"))


#: key of the search grammar -> predicate of its value
KEYS = {
    "gps": lambda v: F.col("gps_latitude").isNotNull() == _yes(v),
    "geo": lambda v: (F.col("gps_latitude").isNotNull() | F.col("derived_latitude").isNotNull()) == _yes(v),
    "hidden": lambda v: ((F.col("hidden_codes") > 0) | (F.col("hidden_embeds") > 0)) == _yes(v),
    "code": lambda v: (F.col("hidden_codes") > 0) == _yes(v),
    "url": lambda v: (F.col("visible_urls") > 0) == _yes(v),
    "risk": lambda v: F.lower("risk_level") == v,
    "parser": lambda v: F.lower("parser_status") == v,
    "source": lambda v: F.lower("source_type").contains(v),
    "score": lambda v: F.col("suspicion_score") >= int(v),
}


def search(query: str, columns: list[str]) -> Column:
    """All tokens must hold: ``key:value`` by its meaning, any other as part of the record's text."""
    out, text = F.lit(True), haystack(columns)
    for token in shlex.split(query.lower()):
        key, _, value = token.partition(":")
        out = out & (KEYS[key](value) if value and key in KEYS else text.contains(token))
    return out


MODES = {
    "All": lambda: F.lit(True),
    "Has GPS": lambda: F.col("gps_latitude").isNotNull(),
    "High Risk": lambda: F.col("risk_level") == "High",
    "Medium Risk": lambda: F.col("risk_level") == "Medium",
    "Low Risk": lambda: F.col("risk_level") == "Low",
    "Screenshots": lambda: F.col("source_type").contains("Screenshot"),
    "Camera": lambda: F.col("source_type") == "Camera Photo",
    "Edited": lambda: F.col("source_type") == "Edited / Exported",
    "Duplicates": lambda: F.coalesce(F.col("duplicate_group"), F.lit("")) != "",
    "Geo Anchors": lambda: F.col("gps_latitude").isNotNull() | F.col("derived_latitude").isNotNull(),
    "Hidden Content": lambda: (F.col("hidden_codes") > 0) | (F.col("hidden_embeds") > 0),
    "Parser Issues": lambda: (F.col("parser_status") != "Valid") | (F.col("signature_status") == "Mismatch"),
    "Bookmarked": lambda: F.col("bookmarked"),
}
SORTS = {"Score ↓": ("suspicion_score", False), "Score ↑": ("suspicion_score", True), "Time ↓": ("ts", False), "Time ↑": ("ts", True), "ID ↑": ("evidence_id", True), "ID ↓": ("evidence_id", False), "Source": ("source_type", True)}


def inventory(evidence: DataFrame, mode: str, query: str, sort: str, columns: list[str]) -> DataFrame:
    """Filter by mode and search, then sort; a missing time sorts as the latest one."""
    name, up = SORTS[sort]
    key = F.col(name)
    order = [key.asc_nulls_last(), F.asc("evidence_id")] if up else [key.desc_nulls_first(), F.desc("evidence_id")]
    return evidence.where(MODES[mode]() & search(query, columns)).orderBy(*order)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of equal keys; ``new`` has each key once."""
    return existing.join(new, keys, "left_anti").unionByName(new)


def rollback(existing: DataFrame, imported: DataFrame, keys: list[str]) -> DataFrame:
    return existing.join(imported, keys, "left_anti")


def list_cases(cases: DataFrame, evidence: DataFrame, key: str, newest: str) -> DataFrame:
    """Every case with its number of records, newest first."""
    counts = evidence.groupBy(key).agg(F.count(F.lit(1)).alias("records"))
    return cases.join(counts, key, "left").withColumn("records", F.coalesce("records", F.lit(0))).orderBy(F.desc_nulls_last(newest), key)


def validation(checks: DataFrame) -> DataFrame:
    """Assertions, passes, failures and pass rate from ``checks(name, passed)``."""
    out = checks.agg(F.count("passed").alias("checks"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.count_if(F.col("passed").isNull()).alias("skipped"))
    return out.withColumn("pass_rate", F.when(F.col("checks") > 0, F.round(100 * F.col("passed") / F.col("checks"), 2)).otherwise(0.0))


def weight_of(delta: Column, flags: Column, hidden: Column, parser: Column) -> Column:
    return delta + 10 * flags + 8 * hidden + 6 * parser


def label_clusters(labels: DataFrame, most: int = 8) -> DataFrame:
    """Labels by their first three tokens of three letters or more: members, first label, confidence; the largest ``most``."""
    words = F.filter(F.split(F.lower("label"), r"[^\p{L}\p{N}]+"), lambda x: F.length(x) >= 3)
    keyed = labels.withColumn("key", F.array_join(F.slice(words, 1, 3), " ")).where("key <> ''")
    out = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min_by("label", "ord").alias("first_label"), F.max_by(F.length("label"), F.col("ord")).alias("last_length"))
    confidence = F.least(F.lit(92), 48 + 12 * F.col("members") + F.least(F.lit(20), F.floor(F.col("last_length") / 3))).cast("int")
    return out.withColumn("confidence", confidence).drop("last_length").orderBy(F.desc("members"), "key").limit(most)
