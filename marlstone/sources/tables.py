"""Driver tables and the evidence view that stands on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as located points: id, ts, subject, source, lat, lon. Coordinates are a function of user and event."""
    e = table(spark, sf_dir, "events")
    lat = F.lit(30.0) + (7 * F.col("user_id") + 13 * F.col("event_id")) % 400 / 100
    lon = F.lit(31.0) + (11 * F.col("user_id") + 17 * F.col("event_id")) % 500 / 100
    return e.select(F.col("event_id").alias("id"), "ts", F.col("user_id").alias("subject"), F.col("event_type").alias("source"), lat.alias("lat"), lon.alias("lon"))


#: The SQL of :func:`points` for the oracle.
POINTS_SQL = """points as (select event_id id, ts, user_id subject, event_type source,
  30.0 + ((7 * user_id + 13 * event_id) % 400) / 100.0 lat, 31.0 + ((11 * user_id + 17 * event_id) % 500) / 100.0 lon from events)"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as evidence records: every column of the scoring rules is a function of an order's columns."""
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    sources = F.array(*(F.lit(x) for x in ("Camera Photo", "Screenshot", "Messaging Export", "Edited / Exported", "Unknown")))
    out = o.select(
        k.alias("evidence_id"), F.col("o_orderpriority").alias("case_id"), F.col("o_orderdate").alias("ts"),
        (F.floor("o_totalprice") % 101).cast("int").alias("suspicion_score"),
        F.when(F.col("o_orderstatus") == "P", "Failed").otherwise("Valid").alias("parser_status"),
        F.when(c % 4 == 0, "Mismatch").otherwise("Matched").alias("signature_status"),
        F.when(c % 3 == 0, "Verified").when(c % 3 == 1, "Partial").otherwise("Pending Review").alias("integrity_status"),
        F.get(sources, (k % 5).cast("int")).alias("source_type"),
        F.when(c % 6 == 0, "Unknown").otherwise(F.concat(F.lit("D"), (c % 6).cast("string"))).alias("device_model"),
        (k % 101).cast("int").alias("timestamp_confidence"),
        F.when(k % 3 == 0, 30 + (k % 400) / 100).alias("gps_latitude"), F.when(k % 3 == 0, 31 + (k % 500) / 100).alias("gps_longitude"),
        (c * 7 % 101).cast("int").alias("gps_confidence"), (k * 11 % 101).cast("int").alias("derived_geo_confidence"),
        (c * 5 % 101).cast("int").alias("ocr_confidence"), (k % 7).cast("int").alias("map_confidence"), (k % 10 == 0).alias("bookmarked"),
    )
    return out.withColumn("risk_level", F.when(F.col("suspicion_score") >= 70, "High").when(F.col("suspicion_score") >= 35, "Medium").otherwise("Low"))


#: The SQL of :func:`evidence` for the oracle.
EVIDENCE_SQL = """base as (select o_orderkey evidence_id, o_orderpriority case_id, o_orderdate ts, cast(cast(floor(o_totalprice) as bigint) % 101 as int) suspicion_score,
  case when o_orderstatus = 'P' then 'Failed' else 'Valid' end parser_status, case when o_custkey % 4 = 0 then 'Mismatch' else 'Matched' end signature_status,
  case o_custkey % 3 when 0 then 'Verified' when 1 then 'Partial' else 'Pending Review' end integrity_status,
  case o_orderkey % 5 when 0 then 'Camera Photo' when 1 then 'Screenshot' when 2 then 'Messaging Export' when 3 then 'Edited / Exported' else 'Unknown' end source_type,
  case when o_custkey % 6 = 0 then 'Unknown' else 'D' || cast(o_custkey % 6 as varchar) end device_model, cast(o_orderkey % 101 as int) timestamp_confidence,
  case when o_orderkey % 3 = 0 then 30 + (o_orderkey % 400) / 100.0 end gps_latitude, case when o_orderkey % 3 = 0 then 31 + (o_orderkey % 500) / 100.0 end gps_longitude,
  cast(o_custkey * 7 % 101 as int) gps_confidence, cast(o_orderkey * 11 % 101 as int) derived_geo_confidence, cast(o_custkey * 5 % 101 as int) ocr_confidence,
  cast(o_orderkey % 7 as int) map_confidence, o_orderkey % 10 = 0 bookmarked from orders),
evidence as (select *, case when suspicion_score >= 70 then 'High' when suspicion_score >= 35 then 'Medium' else 'Low' end risk_level from base)"""
