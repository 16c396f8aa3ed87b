"""Decisions over one record: ordered rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import clamp
from ..functions.text import all_matches


def courtroom_strength(c=F.col) -> Column:
    """Time, location, integrity, container, device and visible text add points; conflicts, hidden code and parser trouble take some."""
    gps = c("gps_latitude").isNotNull()
    time = F.when(c("timestamp_confidence") >= 90, 28).when(c("timestamp_confidence") >= 70, 18).when(c("timestamp_confidence") > 0, 8).otherwise(0)
    place = F.when(c("gps_confidence") >= 80, 22).when(gps, 14).when(c("derived_geo_confidence") >= 60, 10).when(c("derived_geo_confidence") > 0, 5).otherwise(0)
    integrity = F.when(c("integrity_status") == "Verified", 20).when(c("integrity_status") == "Partial", 12).otherwise(0)
    more = F.when(c("signature_status").isin("Matched", "Compatible"), 8).otherwise(0) + F.when(c("parser_status") == "Valid", 6).otherwise(0)
    more = more + F.when(~c("device_model").isin("Unknown", "N/A", ""), 5).otherwise(0) + F.when(c("visible_text"), 4).otherwise(0)
    less = F.when((c("parser_status") != "Valid") | (c("signature_status") == "Mismatch"), 14).otherwise(0)
    less = less + F.when(c("time_conflicts") > 0, 10).otherwise(0) + F.when(c("hidden_codes") > 0, 8).otherwise(0)
    return clamp(time + place + integrity + more - less, 0, 100)


def court_reasons(c=F.col) -> Column:
    """Codes of what stands against use in court, in order."""
    gps = c("gps_latitude").isNotNull()
    rules = (
        (c("parser_status") != "Valid", "parser"),
        (c("signature_status") == "Mismatch", "signature"),
        (~c("integrity_status").isin("Verified", "Partial"), "integrity"),
        (c("timestamp_confidence") < 70, "time"),
        (~gps & (c("derived_geo_confidence") > 0), "derived location"),
        (~gps & (c("derived_geo_confidence") == 0), "no location"),
        ((c("ocr_confidence") > 0) & (c("ocr_confidence") < 55), "weak ocr"),
        (c("time_conflicts") > 0, "time conflict"),
        (c("ai_flags") > 0, "batch review"),
    )
    return F.array_compact(F.array(*(F.when(holds, F.lit(code)) for holds, code in rules)))


def court_ready(c=F.col) -> Column:
    sound = (c("parser_status") == "Valid") & (c("signature_status") != "Mismatch")
    return (courtroom_strength(c) >= 68) & (F.size(court_reasons(c)) <= 2) & sound


def next_action(c=F.col) -> Column:
    """Code of the first step that a record asks for."""
    return (
        F.when((c("parser_status") != "Valid") | (c("signature_status") == "Mismatch"), "second parser")
        .when((c("time_conflicts") > 0) | (c("timestamp_confidence") < 70), "verify time")
        .when(c("gps_latitude").isNotNull(), "verify coordinate")
        .when(c("route"), "confirm route")
        .when((c("derived_geo_confidence") > 0) | (c("map_labels") > 0) | (c("map_intelligence") > 0), "corroborate location")
        .when(c("duplicate_group") != "", "compare duplicates")
        .otherwise("analyst note")
    )


def integrity_status(source_sha: Column, working_sha: Column, copied: Column, parser: Column, signature: Column, trust: Column, warned: Column) -> Column:
    both = source_sha.isNotNull() & working_sha.isNotNull()
    return (
        F.when(both & ~copied, "Review Required")
        .when((parser != "Valid") | (signature == "Mismatch"), "Review Required")
        .when((trust == "Verified") & ~warned, "Verified")
        .when(trust.isin("Verified", "Header-only", "Weak"), "Partial")
        .otherwise("Pending Review")
    )


def timestamp_confidence(timestamp: Column, source: Column) -> Column:
    return (
        F.when(timestamp.isNull() | (source == "Unavailable"), 0)
        .when(source == "Native EXIF Original", 94)
        .when(source.startswith("Embedded EXIF"), 84)
        .when(source == "Filename Pattern", 58)
        .when(source.startswith("Filesystem"), 42)
        .otherwise(30)
    )


def anchor_kind(source: Column, native: Column, coordinates: Column) -> Column:
    """What a location stands on; coordinates of a place table alone are never a fix."""
    text = F.lower(F.coalesce(source, F.lit("")))
    return (
        F.when(native | (text.contains("native") & text.contains("gps")), "native_gps")
        .when(text.rlike("geocoder|centroid|approximate|place candidate|place lead"), "approximate_place")
        .when(text.rlike("coordinate|map url|map-url|derived|context menu|right click|lat|lon"), F.when(coordinates, "derived_coordinate").otherwise("place_search"))
        .when(text.rlike("ocr|place label|landmark|search|provider link"), "place_search")
        .when(coordinates, "derived_coordinate")
        .otherwise("visual_context")
    )


def anchor_radius(kind: Column, confidence: Column, source: Column) -> Column:
    """Metres around an anchor that its kind and confidence allow."""
    text, sure = F.lower(F.coalesce(source, F.lit(""))), clamp(confidence, 0, 100)
    return (
        F.when(kind == "native_gps", F.greatest(F.lit(25), 130 - sure))
        .when(kind == "derived_coordinate", F.greatest(F.lit(80), 900 - sure * 6))
        .when(text.rlike("landmark|poi"), F.when(text.rlike("approximate|centroid"), 3500).otherwise(300))
        .when(text.contains("area"), 4500)
        .when(text.contains("city"), 25000)
        .when(text.rlike("linear feature|river"), 12000)
        .when(kind == "place_search", 8000)
        .when(kind == "approximate_place", 15000)
        .otherwise(0)
    )


def evidence_radius(native: Column, coordinates: Column, map_url: Column, level: Column, confidence: Column) -> Column:
    step = lambda limit, small, large: F.when(confidence >= limit, small).otherwise(large)
    return (
        F.when(native, step(90, 25, 75)).when(coordinates, step(85, 50, 150)).when(map_url, step(75, 250, 750))
        .when(level == "poi", step(80, 350, 900)).when(level == "area", step(70, 1500, 3000)).when(level == "city", step(65, 10000, 25000)).otherwise(50000)
    )


def region_scores(text: Column, profiles: dict[str, tuple[int, int, int, tuple[str, ...]]]) -> Column:
    """array<struct<region, score, hits>> best first: base + step for each word that occurs, at most a cap; regions without words are left out."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def one(region: str, base: int, step: int, cap: int, words: tuple[str, ...]) -> Column:
        hits = F.aggregate(F.array(*(low.contains(w).cast("int") for w in words)), F.lit(0), lambda s, x: s + x)
        return F.struct((-F.when(hits > 0, F.least(F.lit(cap), base + step * hits)).otherwise(0)).alias("order"), F.lit(region).alias("region"), hits.alias("hits"))

    ranked = F.filter(F.array_sort(F.array(*(one(r, *p) for r, p in profiles.items()))), lambda x: x["order"] < 0)
    return F.transform(ranked, lambda x: F.struct(x["region"].alias("region"), (-x["order"]).alias("score"), x["hits"].alias("hits")))


def classify_region(text: Column, profiles: dict[str, tuple], least: int = 30) -> Column:
    """struct<region, score>: the profile with the most points, of equals the first; under ``least`` only the script is told.

    A profile is (cap, (base, step, word cap, words), ((pattern, points), ...)): words give base + step for each that
    occurs, patterns (script, telephone, domain, coordinates) their points, all together at most cap.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    rows = []
    for nth, (region, (cap, (base, step, most, words), patterns)) in enumerate(profiles.items()):
        hits = F.aggregate(F.array(*(low.contains(w).cast("int") for w in words)), F.lit(0), lambda s, x: s + x)
        points = F.when(hits > 0, F.least(F.lit(most), base + step * hits)).otherwise(0)
        for pattern, more in patterns:
            points = points + F.when(low.rlike(pattern), more).otherwise(0)
        rows.append(F.struct((-F.least(F.lit(cap), points)).alias("order"), F.lit(nth).alias("nth"), F.lit(region).alias("region")))
    best = F.get(F.array_sort(F.array(*rows)), F.lit(0))
    found = lambda region, score: F.struct(region.alias("region"), score.cast("int").alias("score"))
    return (
        F.when(-best["order"] >= least, found(best["region"], -best["order"]))
        .when(low.rlike("[\u0600-\u06ff]"), found(F.lit("Arabic script"), F.lit(28)))
        .when(low.rlike("[a-z]"), found(F.lit("Latin script"), F.lit(24)))
        .otherwise(found(F.lit("Unknown"), F.lit(0)))
    )


def urls(text: Column) -> Column:
    return all_matches(text, r"(?i)(?:https?://|www\.)[^\s<>'\"()]+")


def narrator(evidence: DataFrame, case: str = "case_id") -> DataFrame:
    """Per case: records, high risks, strong ones, leads, and the strongest record. Needs columns strength and label."""
    return evidence.groupBy(case).agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("risk_level").isin("High", "Critical")).alias("high"),
        F.count_if(F.col("label").isin("PROOF", "STRONG_INDICATOR")).alias("strong"),
        F.count_if(F.col("label") == "LEAD").alias("leads"),
        F.max_by("evidence_id", F.struct("strength", "suspicion_score", "map_confidence", "ocr_confidence", "evidence_id")).alias("strongest"),
    )


def map_summary(points: DataFrame, case: str) -> DataFrame:
    """Per case: anchors, native and derived ones, centroid and bounding box, to six places."""
    six = lambda x: F.round(x, 6)
    return points.groupBy(case).agg(
        F.count(F.lit(1)).alias("anchors"), F.count_if("native").alias("native"), F.count_if(~F.col("native")).alias("derived"),
        six(F.avg("lat")).alias("mean_lat"), six(F.avg("lon")).alias("mean_lon"), six(F.min("lat")).alias("min_lat"), six(F.max("lat")).alias("max_lat"), six(F.min("lon")).alias("min_lon"), six(F.max("lon")).alias("max_lon"),
    )


def launch_gate(evidence: DataFrame, case: str = "case_id", redacted: bool = True, ground_truth: bool = False) -> DataFrame:
    """Weighted readiness of each case for handoff, its blockers and warnings; a blocker caps the score at 69. Needs court, the courtroom strength."""
    c = F.col
    count = lambda holds, name: F.count_if(F.coalesce(holds, F.lit(False))).alias(name)
    secret = (c("pixel_score") >= 40) | (c("hidden_codes") > 0) | (c("hidden_embeds") > 0)
    out = evidence.groupBy(case).agg(
        F.count(F.lit(1)).alias("total"), count(c("parser_status") == "Valid", "parser"), count(c("integrity_status") == "Verified", "integrity"), count(c("gps_confidence") >= 80, "gps"),
        count(c("derived_latitude").isNotNull() | (c("map_labels") > 0), "derived"), count(c("timestamp_confidence") >= 80, "time"), count(c("court") >= 60, "court_ready"),
        count(c("claims") > 0, "claims"), count(secret, "hidden"), count(c("route"), "routes"),
    )
    share = lambda name: F.bround(100 * c(name) / c("total"), 0)
    score = 0.14 * share("parser") + 0.18 * share("integrity") + (14 if redacted else 0) + 0.12 * (100 if ground_truth else 35)
    score = score + 0.12 * F.greatest(share("gps"), F.least(share("derived"), F.lit(85.0))) + 0.10 * share("time") + 0.10 * share("court_ready") + 0.07 * share("claims") + 0.03 * F.when(c("hidden") == 0, 100).otherwise(55)
    blockers = (c("parser") < c("total")).cast("int") + (c("integrity") < c("total")).cast("int") + int(not redacted)
    warnings = int(not ground_truth) + (c("gps") == 0).cast("int") + (c("time") == 0).cast("int") + (c("court_ready") == 0).cast("int") + (c("hidden") > 0).cast("int") + (c("routes") == 0).cast("int") + (c("claims") == 0).cast("int")
    out = out.withColumns({"blockers": blockers, "warnings": warnings, "raw": clamp(F.bround(score, 0).cast("int"), 0, 100)})
    out = out.withColumn("score", F.when(c("blockers") > 0, F.least(c("raw"), F.lit(69))).otherwise(c("raw")))
    label = F.when(c("blockers") > 0, "blocked").when((c("score") >= 82) & (c("warnings") == 0), "ready").when(c("score") >= 55, "review").otherwise("needs_work")
    return out.withColumn("status", label).select(case, "total", "hidden", "blockers", "warnings", "score", "status")


def closest_peers(evidence: DataFrame, base_id, most: int = 10) -> DataFrame:
    """Other records by distance of their score from a base record's; the base is one row, its score a literal."""
    base = evidence.where(F.col("evidence_id") == base_id).select("suspicion_score").first()
    if base is None:
        return evidence.where("false").select("evidence_id", F.lit(0).alias("distance"))
    others = evidence.where(F.col("evidence_id") != base_id)
    return others.select("evidence_id", F.abs(F.col("suspicion_score") - base[0]).alias("distance")).orderBy("distance", "evidence_id").limit(most)


def first_rows(rows: DataFrame, group: str, order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each group, with their place nth."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("nth") <= most)


def guardian_cards(evidence: DataFrame, case: str = "case_id") -> DataFrame:
    """Seven figures of each case: best strength in court, risks, hidden content, duplicate groups, located records, routes, share of verified copies. Needs court."""
    c = F.col
    return evidence.groupBy(case).agg(
        F.max("court").alias("best_court"), F.count_if(c("risk_level") != "Low").alias("risks"), F.count_if((c("hidden_codes") > 0) | (c("hidden_embeds") > 0) | (c("pixel_score") >= 40)).alias("hidden"),
        F.count_distinct(F.nullif("duplicate_group", F.lit(""))).alias("duplicate_groups"), F.count_if(c("gps_latitude").isNotNull()).alias("located"), F.count_if("route").alias("routes"),
        F.bround(100 * F.avg(c("copy_verified").cast("int")), 0).cast("int").alias("verified"),
    )
