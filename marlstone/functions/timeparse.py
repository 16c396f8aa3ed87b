"""Timestamps as the evidence carries them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_timestamp(text: Column) -> Column:
    """'yyyy:MM:dd HH:mm:ss' or 'yyyy-MM-dd HH:mm:ss', else null."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))


# Patterns of times in file names, in the order in which they are tried, and in visible text.
FILE_NAME = (
    r"(?i)(20\d{2})-(\d{2})-(\d{2})\s+at\s+(\d{1,2})\.(\d{2})\.(\d{2})\s*([AP]M)?",
    r"(?i)(20\d{2})-(\d{2})-(\d{2})[ _-](\d{2})(\d{2})(\d{2})",
    r"(?i)(20\d{2})(\d{2})(\d{2})[ _-]?(\d{2})(\d{2})(\d{2})",
    r"(?i)(20\d{2})[._-](\d{2})[._-](\d{2})[ T_-](\d{2})[.:_-](\d{2})[.:_-](\d{2})",
    r"(?i)(20\d{2})[-_](\d{2})[-_](\d{2})[-_](\d{1,2})[-_](\d{2})[-_](\d{2})\s*([AP]M)?",
)
IN_TEXT = (
    r"(20\d{2})[-/:.](\d{2})[-/:.](\d{2})[ T](\d{1,2})[:.](\d{2})(?::(\d{2}))?",
    r"(20\d{2})[-_](\d{2})[-_](\d{2})[ _-](\d{2})(\d{2})(\d{2})",
)
#: Hours that two times of a record may differ before they conflict.
CONFLICT_HOURS = 12


def _stamp(text: Column, pattern: str) -> Column:
    part = lambda i: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text, pattern, i), F.lit("")), F.lit("9999")).cast("int"), F.lit(0))
    hour = part(4)
    if "[AP]M" in pattern:
        half = F.upper(F.regexp_extract(text, pattern, 7))
        hour = F.when((half == "PM") & (hour != 12), hour + 12).when((half == "AM") & (hour == 12), 0).otherwise(hour)
    made = F.try_make_timestamp(part(1), part(2), part(3), hour, part(5), part(6).cast("decimal(8,6)"))
    # seconds of 60 are no time here
    return F.when(text.rlike(pattern) & (part(6) < 60), F.date_format(made, "yyyy:MM:dd HH:mm:ss"))


def from_file_name(name: Column) -> Column:
    """The time in names such as IMG_20260306_203406.png, as 'yyyy:MM:dd HH:mm:ss': the first pattern that gives one, else null."""
    return F.coalesce(*(_stamp(name, p) for p in FILE_NAME))


def from_text(text: Column) -> Column:
    """The first time in visible text, in the form of :func:`from_file_name`."""
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.coalesce(*(_stamp(clean, p) for p in IN_TEXT))


def time_candidates(original: Column, embedded: Column, digitized: Column, name: Column, visible: Column, modified: Column, created: Column) -> Column:
    """array<struct<score, source, value>> of a record's times, the most trusted first; ``visible`` is an array of texts."""
    shown = F.get(F.filter(F.transform(visible, lambda x: F.coalesce(from_text(x), from_file_name(x))), lambda x: x.isNotNull()), F.lit(0))
    rows = (
        (original, "Native EXIF Original", 94), (embedded, "Embedded EXIF", 84), (digitized, "Embedded EXIF Digitized", 82), (from_file_name(name), "Filename Pattern", 58), (shown, "Visible On-Screen Time", 52),
        (modified, "Filesystem Modified Time", 42), (created, "Filesystem Birth / Creation Time", 38),
    )
    return F.array_compact(F.array(*(F.when(value.isNotNull(), F.struct(F.lit(score).alias("score"), F.lit(source).alias("source"), value.alias("value"))) for value, source, score in rows)))


def time_assessment(candidates: Column) -> Column:
    """struct<timestamp, source, confidence, conflicts>: the best candidate, and the sources of others that are over twelve hours away."""
    best = F.get(candidates, F.lit(0))
    at = lambda x: F.unix_seconds(parse_timestamp(x["value"]))
    away = F.filter(F.slice(candidates, 2, 1 << 10), lambda x: F.abs(at(x) - at(best)) > CONFLICT_HOURS * 3600)
    sure = F.when(best["source"] == "Native EXIF Original", 94).when(best["source"].startswith("Embedded EXIF"), 84).when(best["source"] == "Filename Pattern", 58).when(best["source"].startswith("Filesystem"), 42).otherwise(30)
    return F.struct(
        F.coalesce(best["value"], F.lit("Unknown")).alias("timestamp"), F.coalesce(best["source"], F.lit("Unavailable")).alias("source"), F.when(F.size(candidates) == 0, 0).otherwise(sure).alias("confidence"),
        F.transform(away, lambda x: x["source"]).alias("conflicts"),
    )


def timeline_confidence(confidence: Column, source: Column, visible: Column, conflicts: Column) -> Column:
    """0 to 100 from the anchor's confidence, its source, visible time strings and conflicts."""
    low = F.lower(F.coalesce(source, F.lit("Unavailable")))
    base = F.least(F.greatest(F.coalesce(confidence, F.lit(0)), F.lit(0)), F.lit(100))
    score = F.when(low.rlike("exif|metadata|native"), F.greatest(base, F.least(F.lit(95), base + 8))).otherwise(base)
    score = F.when(low.contains("filename"), F.least(F.when(score == 0, 58).otherwise(score), F.lit(65))).otherwise(score)
    score = F.when(low.rlike("filesystem|modified"), F.least(F.greatest(score, F.lit(42)), F.lit(70))).otherwise(score)
    score = F.when(visible, F.greatest(score, F.least(F.lit(88), base + 10))).otherwise(score)
    return F.when(conflicts, F.least(score, F.lit(55))).otherwise(score)


def timeline_label(score: Column) -> Column:
    return F.when(score >= 85, "strong timeline anchor").when(score >= 65, "usable timeline lead").when(score >= 35, "weak timeline lead").otherwise("no reliable timeline anchor")
