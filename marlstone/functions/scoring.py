"""Rule scores over one record: additive buckets, caps and labels.

A rule table is data: (bucket, condition, points, confidence). The columns that
conditions name are those of the evidence schema.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXPORT_LIKE = ("Screenshot", "Messaging Export", "Screenshot / Export", "Graphic Asset")


def clamp(x: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


# The rules of the anomaly score with their points and what they add to the confidence.
#: First match within a group counts; groups add up. (group, bucket, SQL condition, points, confidence)
ANOMALY_RULES = (
    ("structure", "technical", "parser_status = 'Failed'", 46, 8),
    ("structure", "technical", "structure_status = 'Animated'", 6, 0),
    ("structure", "technical", "structure_status = 'Suspicious'", 18, 0),
    ("signature", "technical", "signature_status = 'Mismatch'", 24, 6),
    ("signature", "technical", "format_trust in ('Weak', 'Header-only')", 8, 0),
    ("exif", "metadata", "not has_exif and source_type in ('Screenshot', 'Messaging Export', 'Screenshot / Export', 'Graphic Asset')", 10, 10),
    ("exif", "metadata", "not has_exif", 24, 0),
    ("time", "authenticity", "timestamp_source = 'Unavailable'", 16, -12),
    ("time", "authenticity", "timestamp_source = 'Filename Pattern'", 4, 4),
    ("time", "authenticity", "timestamp_source like 'Filesystem%'", 8, 0),
    ("gps", "authenticity", "gps_latitude is null and source_type in ('Camera Photo', 'Unknown', 'Edited / Exported')", 7, 0),
    ("gps", "authenticity", "gps_latitude is not null", 0, 10),
    ("software", "authenticity", "lower(software) rlike 'photoshop|lightroom|snapseed|canva|gimp'", 18, 0),
    ("software", "authenticity", "coalesce(software, '') not in ('', 'N/A', 'Unknown')", 4, 0),
    ("hidden", "technical", "hidden_codes > 0", 26, 6),
    ("hidden", "technical", "hidden_embeds > 0", 14, 0),
    ("conflict", "authenticity", "time_conflicts > 0", 9, 0),
    ("urls", "authenticity", "visible_urls > 0 and source_type = 'Camera Photo'", 12, 0),
    ("screen", "authenticity", "source_type in ('Map Screenshot', 'Browser Screenshot')", 0, 5),
    ("portrait", "authenticity", "environment like 'Desktop%' and width > 0 and height > 0 and width < height and source_type like '%Screenshot%'", 5, 0),
    ("stego", "technical", "stego <> '' and stego not like '%No strong%'", 11, 0),
    ("pixels", "technical", "pixel_score >= 70", 18, 4),
    ("pixels", "technical", "pixel_score >= 40 or lsb_strings > 0", 10, 4),
    ("quality", "technical", "lower(quality_flag) rlike 'alpha|hidden|very dark'", 0, 2),
    ("device", "authenticity", "device_model <> 'Unknown' and device_model <> dominant_device", 10, 0),
    ("duplicate", "authenticity", "duplicate_group <> ''", 6, 8),
    ("size", "authenticity", "width > 0 and height > 0 and least(width, height) < 720 and source_type = 'Camera Photo'", 6, 0),
    ("size", "authenticity", "width > 0 and height > 0 and source_type in ('Screenshot', 'Messaging Export', 'Screenshot / Export')", 0, 5),
    ("size", "technical", "coalesce(width, 0) <= 0 or coalesce(height, 0) <= 0", 10, 0),
    ("clock", "authenticity", "timestamp_source <> 'Unavailable' and mtime_gap_days > 365", 8, 0),
    ("workflow", "authenticity", "source_type = 'Edited / Exported'", 10, 0),
    ("workflow", "technical", "source_type = 'Malformed / Unsupported Asset'", 18, 0),
)


def _sum_of(rules, column: int, bucket: str | None = None) -> Column:
    """Adds the groups; in each the first rule that holds counts, in its own bucket."""
    total = F.lit(0)
    for group in dict.fromkeys(r[0] for r in rules):
        chain = None
        for _, in_bucket, condition, *values in (r for r in rules if r[0] == group):
            value = F.lit(values[column] if bucket in (None, in_bucket) else 0)
            holds = F.coalesce(F.expr(condition), F.lit(False))
            chain = F.when(holds, value) if chain is None else chain.when(holds, value)
        total = total + chain.otherwise(0)
    return total


def anomaly_columns(rules=ANOMALY_RULES) -> dict[str, Column]:
    """Columns authenticity, metadata, technical, score, confidence and level by the rule table."""
    parts = {b: _sum_of(rules, 0, b) for b in ("authenticity", "metadata", "technical")}
    score = clamp(F.bround(0.45 * parts["authenticity"] + 0.25 * parts["metadata"] + 0.65 * parts["technical"], 0).cast("int"), 0, 100)
    level = F.when((parts["technical"] >= 44) | (score >= 70), "High").when(score >= 35, "Medium").otherwise("Low")
    return parts | {"score": score, "confidence": clamp(64 + _sum_of(rules, 1), 15, 98), "level": level}


def evidence_strength(c=F.col) -> tuple[Column, Column]:
    """Score and label of a record: integrity, parser, time, location and OCR."""
    gps = c("gps_latitude").isNotNull() & c("gps_longitude").isNotNull()
    verified = c("integrity_status") == "Verified"
    sound = (c("parser_status") == "Valid") & (c("signature_status") != "Mismatch")
    strong_time, strong_gps = c("timestamp_confidence") >= 80, gps & (c("gps_confidence") >= 80)
    score = F.when(verified, 24).otherwise(0) + F.when(sound, 14).otherwise(0)
    score = score + F.when(strong_time, 20).when(c("timestamp_confidence") > 0, 8).otherwise(0)
    score = score + F.when(strong_gps, 24).when(gps, 16).when(c("derived_geo_confidence") > 0, 8).when(c("map_confidence") > 0, 5).otherwise(0)
    score = clamp(score + F.when(c("ocr_confidence") >= 70, 6).otherwise(0), 0, 100)
    limited = ~verified | ~sound | ~strong_time | (gps & ~strong_gps) | (~gps & ((c("derived_geo_confidence") > 0) | (c("map_confidence") > 0)))
    proof = (score >= 78) & verified & (gps | strong_time)
    label = F.when(proof & ~limited, "PROOF").when(proof | (score >= 55), "STRONG_INDICATOR").when(score >= 20, "LEAD").when(score > 0, "WEAK_SIGNAL").otherwise("NO_SIGNAL")
    return score, label


def weighted_confidence(signals: Column, base: int = 0) -> Column:
    """Sum of an array of signal weights on a base, 0 to 100; nulls add nothing."""
    return clamp(F.aggregate(F.filter(signals, lambda x: x.isNotNull()), F.lit(base), lambda s, x: s + x), 0, 100)


def bounded_claim_confidence(base: Column, evidence: Column, contradictions: Column, limitations: Column) -> Column:
    return clamp(base + F.least(F.lit(20), 5 * evidence) - F.least(F.lit(25), 12 * contradictions) - F.least(F.lit(18), 4 * limitations), 0, 100)


def risk_call(risk: Column, confidence: Column) -> Column:
    return F.when((risk >= 72) & (confidence >= 62), "ISOLATE").when(risk >= 45, "REVIEW").when(risk >= 18, "WATCH").otherwise("CLEAR")


# Signals of the digital risk with what they add to score and confidence; first match within a group counts.
DIGITAL_RULES = (
    ("code", "signal", "dangerous and codes > 0", 42, 22),
    ("code", "signal", "dangerous", 26, 12),
    ("container", "signal", "embeds > 0 or payloads > 0", 30, 18),
    ("planes", "signal", "lsb > 0", 34, 18),
    ("marked planes", "signal", "lsb > 0 and marked_lsb", 18, 8),
    ("alpha", "signal", "alpha", 16, 10),
    ("statistics", "signal", "pixel_score >= 40 and lsb <= 0", 14, 6),
    ("entropy", "signal", "entropy_channels >= 2", 8, 4),
)


def digital_risk() -> tuple[Column, Column, Column]:
    """Score, confidence and call from the columns dangerous, visible_code, codes, embeds, payloads, lsb, marked_lsb, alpha, pixel_score, entropy_channels, jpeg.

    Code that is only visible on the screen is no hidden payload: its score is at most 24.
    """
    visible_only = F.expr("visible_code and not dangerous and codes <= 0 and embeds <= 0 and payloads <= 0 and lsb <= 0")
    score, sure = _sum_of(DIGITAL_RULES, 0), 35 + _sum_of(DIGITAL_RULES, 1)
    score = F.when(visible_only, F.least(score, F.lit(24))).otherwise(score)
    sure = F.when(visible_only, F.greatest(sure, F.lit(55))).otherwise(sure)
    sure = F.when(F.expr("jpeg and pixel_score >= 40 and lsb <= 0"), F.greatest(F.lit(20), sure - 6)).otherwise(sure)
    score, sure = clamp(score, 0, 100), clamp(sure, 0, 100)
    return score, sure, risk_call(score, sure)
