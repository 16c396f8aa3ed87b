"""Exports of cases by privacy level, and package manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.text import STRICT_LEVELS, redact, sensitive_hits
from .sources.files import suffix

SENTINELS = ("", "Unknown", "Unavailable", "N/A")


def masked(df: DataFrame, level: str) -> DataFrame:
    """Paths, names, places, devices and texts as the level allows; sentinels stay."""
    if level == "full":
        return df
    out: dict[str, Column] = {}
    if "file_path" in df.columns:
        out["file_path"] = F.concat(F.lit("[REDACTED]/[REDACTED_FILE]."), suffix(F.col("file_path")))
    if level in STRICT_LEVELS:
        if "file_name" in df.columns:
            out["file_name"] = F.concat_ws(".", F.col("evidence_id").cast("string"), suffix(F.col("file_name")))
        for name, mark in (("gps_display", "[REDACTED_LOCATION]"), ("device_model", "[REDACTED_DEVICE]"), ("software", "[REDACTED_DEVICE]")):
            if name in df.columns:
                out[name] = F.when(F.col(name).isin(*SENTINELS) | F.col(name).isNull(), F.col(name)).otherwise(mark)
        for name in ("note", "ocr_text", "summary"):
            if name in df.columns:
                out[name] = redact(F.col(name))
    return df.withColumns(out) if out else df


def export_csv(df: DataFrame, path: str, level: str = "redacted_text") -> None:
    masked(df, level).write.mode("overwrite").csv(path, header=True)


def export_json(df: DataFrame, path: str, level: str = "redacted_text") -> None:
    masked(df, level).write.mode("overwrite").json(path)


#: Columns of the flat export, in order.
EXPORT = (
    "case_id", "evidence_id", "file_name", "file_path", "source_type", "ts", "timestamp_source", "timestamp_confidence", "gps_latitude", "gps_longitude", "derived_latitude", "derived_longitude", "gps_confidence",
    "device_model", "software", "suspicion_score", "risk_level", "integrity_status", "parser_status", "signature_status", "duplicate_group",
)


def flat(df: DataFrame, level: str = "redacted_text") -> DataFrame:
    """The export's columns, missing ones null, masked by level; strict levels give no coordinates."""
    out = masked(df, level)
    strict = level in STRICT_LEVELS
    hide = lambda c: strict and c.endswith(("latitude", "longitude"))
    return out.select(*((F.lit(None).cast("double") if hide(c) else F.col(c) if c in out.columns else F.lit(None).cast("string")).alias(c) for c in EXPORT))


def nested(df: DataFrame, level: str = "redacted_text") -> DataFrame:
    """One row a case: its records as an array of structs, for JSON."""
    rows = flat(df, level)
    return rows.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("evidence_id", *(c for c in EXPORT if c not in ("case_id", "evidence_id"))))).alias("records"))


def sidecar(files: DataFrame) -> DataFrame:
    """The line '<sha256>  <path>' of each file of a manifest."""
    return files.select(F.concat_ws("  ", "sha256", "relative_path").alias("value"))


def leaks(artifacts: DataFrame) -> DataFrame:
    """(relative_path, kind, hits) of sensitive text in ``artifacts(relative_path, text)`` that a strict package must not have."""
    rows = artifacts.select("relative_path", F.explode(sensitive_hits(F.col("text"))).alias("h"))
    return rows.select("relative_path", "h.kind", F.col("h.hits").cast("long").alias("hits"))


#: Artifacts that a package may have, by suffix.
ALLOWED_ASSETS = ("csv", "json", "html", "pdf", "txt", "png", "jpg", "jpeg", "webp", "sha256", "jsonl")


def allowed(files: DataFrame) -> DataFrame:
    """Files of a package that are on the list, and none that leaves its folder."""
    path = F.col("relative_path")
    return files.where(suffix(path).isin(*ALLOWED_ASSETS) & ~path.startswith("/") & ~path.rlike(r"(^|[/\\])\.\.([/\\]|$)"))


def append_failures(df: DataFrame, path: str) -> None:
    """Failures as JSON lines, added to those that are there."""
    df.select("time", "context", "message", "evidence_id", "operation").write.mode("append").json(path)


def truth_template(df: DataFrame) -> DataFrame:
    """One row for each record with the checks that a person may fill in, all open."""
    checks = ("native_gps", "derived_geo", "hidden_payload", "parser_failure", "metadata_stripped", "duplicate_expected", "time_conflict", "source_type_contains", "ocr_confidence_min")
    return df.select(F.coalesce("file_name", F.col("evidence_id").cast("string")).alias("file_name"), *(F.lit(None).cast("string").alias(c) for c in checks))


def manifest(spark, folder: str) -> DataFrame:
    """relative_path and sha256 of every file of a package."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    tail = F.element_at(F.split("path", folder.rstrip("/").rsplit("/", 1)[-1] + "/"), -1)
    return files.select(tail.alias("relative_path"), F.sha2("content", 256).alias("sha256"))


def write_snapshot(df: DataFrame, path: str) -> None:
    """One row of JSON at ``path``; what was there becomes '.bak', which the reader of snapshots falls back to."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    new, old, backup = make(f"{path}.new"), make(path), make(f"{path}.bak")
    df.limit(1).coalesce(1).write.mode("overwrite").json(f"{path}.new")
    fs = old.getFileSystem(hadoop)
    if fs.exists(old):
        fs.delete(backup, True)
        fs.rename(old, backup)
    fs.rename(new, old)


def html_table(df: DataFrame, level: str = "redacted_text") -> DataFrame:
    """Rows of an HTML table of the flat export, escaped, one text a record."""
    rows = flat(df, level)
    escape = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return rows.select(F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *(escape(c) for c in EXPORT)), F.lit("</td></tr>")).alias("value"))


def map_features(df: DataFrame) -> DataFrame:
    """One GeoJSON point for each record of ``df(evidence_id, lat, lon)`` that has one."""
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct("evidence_id").alias("properties"))
    return df.where("lat is not null and lon is not null").select(F.to_json(feature).alias("value"))


def export_claims(claims: DataFrame, path: str) -> None:
    claims.write.mode("overwrite").csv(path, header=True)


def write_cache(df: DataFrame, path: str, version: int) -> None:
    """Results by record and content hash, with the version of their form, added to what is cached."""
    df.withColumn("schema_version", F.lit(version)).write.mode("append").parquet(path)


def read_cache(spark, path: str, wanted: DataFrame, version: int) -> DataFrame:
    """Cached results of ``wanted(evidence_id, sha256)``, of this version alone; other content is no hit."""
    return spark.read.parquet(path).where(F.col("schema_version") == version).join(wanted, ["evidence_id", "sha256"], "left_semi")
