"""Assessment of records: findings, strength of maps and signals, claims, plans and what explains a score.

All rules are Column expressions over the record schema. Texts of the results are codes; a report words them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import EXPORT_LIKE, bounded_claim_confidence, clamp
from ..functions.text import EDITORS

LABELS = (("PROOF", "STRONG_INDICATOR", 55), ("LEAD", "LEAD", 20))
PHOTO_LIKE = ("Camera Photo", "Edited / Exported", "Unknown")


def native(c=F.col) -> Column:
    return c("gps_latitude").isNotNull() & c("gps_longitude").isNotNull()


def derived(c=F.col) -> Column:
    return c("derived_latitude").isNotNull() & c("derived_longitude").isNotNull()


def sound(c=F.col) -> Column:
    return (c("parser_status") == "Valid") & (c("signature_status") != "Mismatch")


def hidden(c=F.col) -> Column:
    return (c("hidden_codes") > 0) | (c("hidden_embeds") > 0)


def edited(c=F.col) -> Column:
    return c("software").rlike(EDITORS)


def known_time(c=F.col) -> Column:
    return c("timestamp_source") != "Unavailable"


def usable_point(c=F.col) -> Column:
    """A native fix, or derived coordinates of a confidence of at least 45."""
    return native(c) | (derived(c) & (F.least(c("derived_geo_confidence"), F.lit(70)) >= 45))


def reliable_time(c=F.col) -> Column:
    """A time that no weak source gave, with a confidence of 45 or more where one is known."""
    weak = c("timestamp_source").rlike("(?i)file ?name|filesystem")
    return known_time(c) & ~weak & ((c("timestamp_confidence") <= 0) | (c("timestamp_confidence") >= 45))


def displayed_place(c=F.col) -> Column:
    return ~native(c) & (((c("derived_geo_confidence") > 0) & derived(c)) | (c("map_labels") > 0) | (c("place_candidates") > 0))


def codes(*rules: tuple[Column, str]) -> Column:
    """Codes of the rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(holds, F.lit(code)) for holds, code in rules)))


def first_of(rules, otherwise: str) -> Column:
    out = None
    for holds, code in rules:
        out = F.when(holds, code) if out is None else out.when(holds, code)
    return out.otherwise(otherwise)


def points_of(*rules: tuple[Column, int]) -> Column:
    return reduce(lambda a, b: a + b, (F.when(holds, n).otherwise(0) for holds, n in rules))


# ------------------------------------------------------------------ findings


def authenticity_cues(c=F.col) -> Column:
    return codes(
        (~sound(c), "container"),
        (edited(c), "editor"),
        (c("time_conflicts") > 0, "time conflict"),
        (~c("has_exif") & c("source_type").isin(*PHOTO_LIKE), "missing exif"),
        (hidden(c), "hidden content"),
        (derived(c) & ~native(c) & (c("source_type") == "Camera Photo"), "derived location only"),
    )


def record_findings(records: DataFrame, key: str = "evidence_id") -> DataFrame:
    """(key, flag, delta, confidence_delta) of the findings that need one record alone."""
    c = F.col
    cues = F.size(authenticity_cues())
    place = native() | displayed_place()
    sure = (c("gps_confidence") >= 70) | (c("derived_geo_confidence") >= 60)
    rules = (
        ((c("source_type") == "Screenshot") & native(), "source_geo_contradiction", F.lit(8), 2),
        ((c("source_type") == "Camera Photo") & ~native() & (c("derived_geo_confidence") >= 60), "camera_without_native_gps_but_map_lead", F.lit(6), 2),
        (usable_point() & ~known_time() & sure, "location_without_time_anchor", F.lit(5), 1),
        (displayed_place(), "displayed_location_not_device_proof", F.lit(5), 1),
        (place & ~reliable_time(), "location_context_without_time_anchor", F.lit(5), 1),
        (cues >= 3, "metadata_authenticity_cluster", F.when(cues == 3, 10).otherwise(14), 3),
    )
    rows = F.array_compact(F.array(*(F.when(holds, F.struct(F.lit(flag).alias("flag"), delta.alias("delta"), F.lit(sure).alias("confidence_delta"))) for holds, flag, delta, sure in rules)))
    return records.select(key, F.explode(rows).alias("f")).select(key, "f.*")


def duplicate_findings(records: DataFrame, key: str = "evidence_id", group: str = "duplicate_group") -> DataFrame:
    """Findings of duplicate groups whose members disagree in time, place or source; counts come from one aggregate a group."""
    c = F.col
    place = F.when(native(), F.format_string("%.4f,%.4f", c("gps_latitude"), c("gps_longitude")))
    shown = F.when(derived(), F.format_string("%.4f,%.4f", c("derived_latitude"), c("derived_longitude")))
    signature = F.coalesce(F.concat(F.lit("gps:"), place), F.when(displayed_place(), F.concat(F.lit("shown:"), F.coalesce(shown, F.lit("label")))))
    rows = records.where(F.col(group) != "").select(
        key, group, F.when(known_time(), c("ts")).alias("time"), place.alias("place"), shown.alias("shown"), F.when(c("source_type") != "Unknown", c("source_type")).alias("source"), signature.alias("signature")
    )
    facts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("members"), *(F.count_distinct(x).alias(f"n_{x}") for x in ("time", "place", "shown", "source", "signature")))
    reasons = (F.col("n_time") > 1).cast("int") + ((F.col("n_place") > 1) | (F.col("n_shown") > 1)).cast("int") + (F.col("n_source") > 1).cast("int")
    met = rows.join(facts.where("members > 1"), group).withColumn("reasons", reasons)
    context = met.where("reasons > 0").select(key, F.lit("duplicate_context_conflict").alias("flag"), F.when(F.col("reasons") == 1, 8).otherwise(12).alias("delta"), F.lit(3).alias("confidence_delta"))
    mismatch = met.where("n_signature > 1 and signature is not null").select(key, F.lit("duplicate_location_context_mismatch").alias("flag"), F.lit(8).alias("delta"), F.lit(2).alias("confidence_delta"))
    return context.unionByName(mismatch)


def fold_findings(findings: DataFrame, key: str = "evidence_id") -> DataFrame:
    """Per record: its distinct flags, and the sums of deltas that are not negative."""
    return findings.groupBy(key).agg(
        F.sort_array(F.collect_set("flag")).alias("flags"), F.sum(F.greatest(F.col("delta"), F.lit(0))).cast("int").alias("score_delta"), F.sum(F.greatest(F.col("confidence_delta"), F.lit(0))).cast("int").alias("confidence_delta")
    )


def uplift(score: Column, level: Column, confidence: Column, delta: Column, more: Column) -> tuple[Column, Column, Column]:
    """Score, level and confidence after findings: the score is capped at 100, the confidence at 98, and a level only rises."""
    total = F.least(F.lit(100), score + delta)
    rank = lambda x: F.when(x == "High", 2).when(x == "Medium", 1).otherwise(0)
    by_score = F.when(total >= 70, 2).when(total >= 35, 1).otherwise(0)
    best = F.greatest(rank(level), F.when(delta > 0, by_score).otherwise(0))
    return total, F.when(best == 2, "High").when(best == 1, "Medium").otherwise("Low"), F.least(F.lit(98), confidence + more)


# ------------------------------------------------------------------ strength and confidence


def map_strength(c=F.col) -> tuple[Column, Column]:
    proof = native(c) & (c("gps_confidence") >= 80)
    best = F.greatest(
        F.when(c("derived_geo_confidence") >= 65, 52).otherwise(0), F.when(c("map_intelligence") >= 70, 45).otherwise(0), F.when((c("map_labels") > 0) | (c("place_candidates") > 0), 32).otherwise(0)
    )
    score = F.when(proof, 86).otherwise(F.when(c("basis") == "filename", F.least(best, F.lit(38))).otherwise(best))
    return score, F.when(proof, "PROOF").when(score >= 70, "STRONG_INDICATOR").when(score >= 30, "LEAD").when(score > 0, "WEAK_SIGNAL").otherwise("NO_SIGNAL")


def confidence_signals(c=F.col) -> Column:
    """array<struct<name, weight>> of what supports a record."""
    one = lambda name, weight: F.struct(F.lit(name).alias("name"), F.lit(weight).alias("weight"))
    rules = (
        F.when(c("integrity_status") == "Verified", one("integrity_verified", 22)).when(c("integrity_status") == "Partial", one("integrity_partial", 12)),
        F.when(sound(c), one("parser_valid", 14)),
        F.when(c("timestamp_confidence") >= 80, one("strong_time_anchor", 18)).when(c("timestamp_confidence") > 0, one("weak_time_anchor", 8)),
        F.when(native(c) & (c("gps_confidence") >= 80), one("native_gps", 18)).when(c("derived_geo_confidence") > 0, one("derived_geo", 8)),
        F.when(c("map_intelligence") >= 70, one("map_intelligence", 10)),
        F.when(c("ocr_confidence") >= 70, one("ocr_context", 8)),
        F.when(c("scene_confidence") >= 70, one("scene_classifier", 6)),
    )
    return F.array_compact(F.array(*rules))


def evidentiary_value(c=F.col) -> Column:
    value = F.when(c("timestamp_confidence") >= 90, 28).when(c("timestamp_confidence") >= 70, 20).when(c("timestamp_confidence") > 0, 12).otherwise(0)
    value = value + F.when(c("gps_confidence") >= 80, 26).when(native(c), 18).when(c("derived_geo_confidence") >= 60, 14).when(c("derived_geo_confidence") > 0, 8).otherwise(0)
    value = value + F.when(c("integrity_status") == "Verified", 16).when(c("integrity_status") == "Partial", 10).otherwise(0)
    value = value + points_of((~c("device_model").isin("Unknown", "N/A", ""), 6), (c("visible_text"), 6), (c("duplicate_group") != "", 5), (hidden(c), 7))
    return clamp(F.when(~sound(c), F.greatest(F.lit(8), value - 10)).otherwise(value), 0, 100)


def location_strength(c=F.col) -> Column:
    lead = (c("derived_geo_confidence") >= 70) & (c("map_url") | (c("basis") == "map-url"))
    read = (c("map_intelligence") >= 80) & (c("map_url") | (c("place_candidates") > 0) | (c("basis") == "ocr/text"))
    return F.when(native(c) & (c("gps_confidence") >= 80), "proof").when(lead | read, "lead").when((c("map_intelligence") > 0) | (c("derived_geo_confidence") > 0), "weak_signal").otherwise("no_signal")


def claim_policy(kind: Column) -> Column:
    """struct<label, proof_level, privacy> of what may be said of an anchor of a kind."""
    policy = lambda *x: F.struct(*(F.lit(v).alias(n) for n, v in zip(("label", "proof_level", "privacy"), x)))
    return (
        F.when(kind == "native_gps", policy("Native GPS", "primary_metadata", "high"))
        .when(kind == "derived_coordinate", policy("Derived Geo Anchor", "derived_coordinate_lead", "high"))
        .when(kind.isin("approximate_place", "place_search"), policy("Map Search Lead", "approximate_review_required", "medium"))
        .otherwise(policy("Map Screenshot Mode", "visual_context_only", "low"))
    )


def geo_ladder(c=F.col) -> tuple[Column, Column]:
    """Classification of a record's location and the highest score that one of its tiers gives."""
    place, visual = c("place_candidates") > 0, (c("map_intelligence") > 0) | c("route")
    given = lambda x, otherwise: F.when(x > 0, x).otherwise(otherwise)
    score = F.greatest(
        F.when(native(c), given(c("gps_confidence"), 94)).otherwise(0), F.when(derived(c), given(c("derived_geo_confidence"), 82)).otherwise(0), F.when(c("map_url"), 74).otherwise(0),
        F.when(place, clamp(c("map_intelligence"), 52, 78)).otherwise(0), F.when(visual, clamp(c("map_intelligence"), 28, 48)).otherwise(0),
    )
    kind = F.when(native(c), "Native GPS").when(derived(c), "Derived Geo Anchor").when(place, "Map Search Lead").when(visual, "Map Screenshot Mode").otherwise("No Geo Anchor")
    return kind, clamp(score, 0, 100)


def map_answer_readiness(c=F.col) -> tuple[Column, Column]:
    place, visual = c("place_candidates") > 0, c("map_intelligence") > 0
    score = F.greatest(
        F.when(native(c), 92).otherwise(0), F.when(derived(c), 86).otherwise(0), F.when(c("map_url"), 74).otherwise(0),
        F.when(place, clamp(c("map_intelligence"), 58, 82)).otherwise(0), F.when(visual, clamp(c("map_intelligence"), 25, 42)).otherwise(0),
    )
    anchored = derived(c) | c("map_url") | place
    score = F.when(c("route") & anchored, F.least(F.lit(100), score + 6)).when(c("route"), F.greatest(score, F.lit(45))).otherwise(score)
    return score, F.when(score >= 85, "anchor").when(score >= 70, "after verification").when(score >= 50, "place lead").when(score >= 30, "visual only").otherwise("not ready")


def location_estimate(c=F.col) -> Column:
    """struct<tier, confidence, scope>: native, displayed, ranked candidate, region, context only."""
    tier = lambda name, confidence, scope: F.struct(F.lit(name).alias("tier"), confidence.cast("int").alias("confidence"), F.lit(scope).alias("scope"))
    support = F.least(F.lit(12), 4 * (c("map_labels") + c("visible_urls")))
    return F.coalesce(
        F.when(native(c), tier("native_gps", F.greatest(F.lit(92), c("gps_confidence")), "exact_coordinates")),
        F.when(derived(c), tier("displayed_coordinate", F.greatest(F.lit(76), c("derived_geo_confidence")), "exact_coordinates")),
        F.when(c("place_candidates") > 0, tier("ranked_candidate", clamp(c("map_intelligence") + support, 18, 95), "poi")),
        F.when(c("scene_confidence") >= 90, tier("regional_hint", clamp(c("scene_confidence"), 40, 78), "country")),
        F.when((c("map_intelligence") >= 35) | c("route"), tier("visual_context", clamp(c("map_intelligence"), 18, 58), "context_only")),
        tier("no_signal", F.lit(0), "no_signal"),
    )


# ------------------------------------------------------------------ claims, plans, explanations


def fused_claims(c=F.col) -> Column:
    """array<struct<claim, status, confidence>> of integrity, location, map, image and hidden content."""
    one = lambda claim, status, confidence: F.struct(F.lit(claim).alias("claim"), status.alias("status"), clamp(confidence, 0, 100).cast("int").alias("confidence"))
    valid = c("parser_status") == "Valid"
    integrity = bounded_claim_confidence(F.when(valid, 55).otherwise(35), F.lit(3), F.when(valid, 0).otherwise(1), F.when(c("copy_verified"), 0).otherwise(1))
    given = lambda x, otherwise: F.when(x > 0, x).otherwise(otherwise)
    native_claim = one("gps", F.when(c("gps_confidence") >= 80, "proof").otherwise("strong_lead"), given(c("gps_confidence"), 75))
    derived_claim = one("derived location", F.when(c("derived_geo_confidence") < 65, "lead").otherwise("strong_lead"), clamp(given(c("derived_geo_confidence"), 45), 35, 78))
    mapped = F.when(c("map_intelligence") > 0, c("map_intelligence")).otherwise(c("map_confidence"))
    map_claim = one("map", F.when(mapped >= 70, "strong_lead").when(mapped >= 40, "lead").otherwise("weak_signal"), clamp(F.when(mapped > 0, mapped).otherwise(given(c("ocr_confidence"), 35)), 30, 86))
    image_claim = one("image", F.when(c("image_confidence") < 75, "lead").otherwise("strong_lead"), c("image_confidence"))
    hidden_claim = one("hidden", F.when(c("pixel_score") < 70, "lead").otherwise("strong_lead"), clamp(given(c("pixel_score"), 55), 45, 88))
    return F.array_compact(F.array(
        one("integrity", F.when(valid, "lead").otherwise("weak_signal"), integrity),
        F.when(native(c), native_claim).when(derived(c), derived_claim),
        F.when((mapped > 0) | (c("map_labels") > 0) | (c("basis") != ""), map_claim),
        F.when(c("image_confidence") > 0, image_claim),
        F.when(hidden(c) | (c("pixel_score") > 0), hidden_claim),
    ))


def claim_rows(c=F.col) -> Column:
    """array<struct<family, confidence, strength, status>>: what each source family claims of a record."""
    one = lambda family, confidence, strength, status: F.struct(F.lit(family).alias("family"), confidence.cast("int").alias("confidence"), strength.alias("strength"), status.alias("status"))
    by = lambda x, anchored=F.lit(False): F.when((x >= 85) & ~anchored, "proof").when(x >= 70, "strong_lead").when(x >= 45, "lead").otherwise("weak_signal")
    proven = F.when(c("copy_verified"), "proof")
    time, places = c("timestamp_confidence"), F.greatest(c("gps_confidence"), c("derived_geo_confidence"), c("map_intelligence"))
    ocr, secret = c("ocr_confidence"), F.greatest(c("pixel_score"), F.when(c("hidden_codes") > 0, 55).otherwise(0))
    sure = native(c) & (places >= 85)
    return F.array_compact(F.array(
        one("custody/hash", F.when(c("copy_verified"), 95).otherwise(F.greatest(F.lit(45), c("scene_confidence"))), proven.otherwise("lead"), proven.otherwise("needs_review")),
        F.when(known_time(c) | (time > 0), one("timeline", time, by(time, time < 80), F.when(time >= 85, "proof").otherwise("needs_corroboration"))),
        F.when(places > 0, one("geo/map", places, F.when(sure, "proof").otherwise(by(places, ~native(c))), F.when(sure, "proof").otherwise("lead_only"))),
        F.when((ocr > 0) | c("visible_text") | (c("map_labels") > 0), one("ocr/visible-text", ocr, by(ocr), F.when(ocr >= 65, "evidence").otherwise("needs_review"))),
        F.when((secret > 0) | (c("hidden_embeds") > 0) | (c("lsb_strings") > 0), one("hidden-content/pixel", secret, by(secret), F.when(secret < 80, "needs_review").otherwise("evidence"))),
    ))


def corroboration_plan(c=F.col) -> Column:
    """Codes of the steps that would corroborate a record, at most six."""
    time = F.when(c("timestamp_confidence") >= 80, "check time").when(c("timestamp_confidence") > 0, "confirm time").otherwise("recover time")
    lead = (c("map_labels") > 0) | (c("place_candidates") > 0)
    place = F.when(native(c), "check gps").when(c("derived_geo_confidence") >= 45, "confirm derived").when(lead, "read labels").otherwise("no location claim")
    rest = codes((~sound(c), "second parser"), (c("duplicate_group") != "", "compare duplicates"), (hidden(c), "review hidden"), (c("visible_text"), "keep text"))
    return F.slice(F.concat(F.array(time, place), rest), 1, 6)


def metadata_issues(c=F.col) -> Column:
    """Codes of what weakens a record's metadata, in order, at most eight."""
    camera = c("device_model").isin("Unknown", "N/A", "")
    photo = c("source_type").isin(*PHOTO_LIKE)
    return F.slice(codes(
        (~c("has_exif") & c("source_type").isin(*EXPORT_LIKE), "thin metadata"),
        (~c("has_exif") & ~c("source_type").isin(*EXPORT_LIKE), "no metadata"),
        (camera & photo, "no device"),
        (edited(c), "edited"),
        (c("timestamp_source") == "Filename Pattern", "filename time"),
        (c("timestamp_source").startswith("Filesystem"), "filesystem time"),
        (c("time_conflicts") > 0, "time conflict"),
        (c("signature_status") == "Mismatch", "signature"),
        ((c("signature_status") != "Mismatch") & (c("parser_status") != "Valid"), "parser"),
        (~native(c) & derived(c), "derived location"),
        (~native(c) & ~derived(c) & photo, "no location"),
        (c("hidden_codes") > 0, "hidden code"),
        ((c("hidden_codes") == 0) & (c("hidden_embeds") > 0), "hidden embeds"),
    ), 1, 8)


def primary_issue(c=F.col) -> Column:
    """The first of eleven issues that a record has."""
    return first_of(
        (
            (c("parser_status") == "Failed", "parser"), (c("signature_status") == "Mismatch", "signature"), (c("hidden_codes") > 0, "payload"), (c("hidden_embeds") > 0, "structure"),
            (c("time_conflicts") > 0, "time conflict"), (c("duplicate_group") != "", "duplicate"), (~c("has_exif") & ~c("source_type").isin(*EXPORT_LIKE), "missing metadata"),
            (~native(c) & derived(c), "derived location"), (edited(c), "edited"), (c("risk_level") == "Low", "low risk"),
        ),
        "none",
    )


def image_threat_label(score: Column) -> Column:
    return F.when(score >= 85, "CRITICAL").when(score >= 65, "HIGH").when(score >= 38, "REVIEW").when(score >= 15, "LOW").otherwise("SAFE")


# ------------------------------------------------------------------ scenes, sources, maps

CHAT_APPS = ("WhatsApp", "Telegram", "Signal", "Discord", "Facebook", "Instagram", "X / Twitter")
BROWSERS = ("Chrome", "Safari", "Firefox", "Edge")
MAP_APPS = ("Google Maps", "Google Earth", "Map Application")


def scene(c=F.col) -> tuple[Column, Column]:
    """What a record shows, and how surely; the first kind that fits."""
    map_app, labels = c("app").isin(*MAP_APPS), (c("map_labels") > 0) | (c("place_candidates") > 0)
    mapped = map_app | labels | native(c) | derived(c) | (c("map_intelligence") >= 50)
    sure = F.greatest(c("derived_geo_confidence"), c("gps_confidence"), c("map_intelligence"), F.lit(58), F.when(map_app, 84).otherwise(0), F.when(derived(c), 78).otherwise(0))
    rules = (
        (mapped & c("route"), "route map", sure), (mapped, "map", sure), (c("app").isin(*CHAT_APPS), "messaging", F.lit(82)), (c("app").isin(*BROWSERS) | (c("visible_urls") > 0), "browser", F.lit(74)),
        (c("source_type") == "Camera Photo", "camera", F.when(~c("device_model").isin("Unknown", "N/A", ""), 80).otherwise(68)),
    )
    label, score = None, None
    for holds, name, points in rules:
        label = F.when(holds, name) if label is None else label.when(holds, name)
        score = F.when(holds, points) if score is None else score.when(holds, points)
    return label.otherwise("screen"), score.otherwise(54)


def source_profile(c=F.col) -> Column:
    """struct<kind, confidence> of how a file came about; the first rule that holds counts."""
    row = lambda kind, confidence: F.struct(F.lit(kind).alias("kind"), F.lit(confidence).cast("int").alias("confidence") if isinstance(confidence, int) else confidence.cast("int").alias("confidence"))
    screen = c("source_type").isin("Screenshot", "Screenshot / Export", "Messaging Export")
    map_app = c("app").isin("Google Maps", "Google Earth")
    wide = c("width") >= c("height")
    return (
        F.when((c("width") <= 0) | (c("height") <= 0), row("malformed", 74))
        .when(map_app | ((c("map_labels") > 0) & screen), row("map screen", F.when(map_app, 84).otherwise(74)))
        .when(c("app").isin(*BROWSERS) & (c("visible_urls") > 0), row("browser screen", 78))
        .when(c("app").isin(*CHAT_APPS), row("chat screen", 80))
        .when(c("source_type") == "Camera Photo", row("camera original", F.when(c("has_exif"), 86).otherwise(62)))
        .when(c("source_type") == "Edited / Exported", row("edited export", 76))
        .when(c("source_type").isin("Screenshot", "Screenshot / Export"), F.when(wide, row("desktop capture", 72)).otherwise(row("mobile screen", 72)))
        .when(c("source_type") == "Messaging Export", row("chat export", 78))
        .when(c("source_type") == "Graphic Asset", row("graphic", 70))
        .otherwise(row("unknown", 48))
    )


#: Zones of a map image that a reader should look at, by priority.
ZONES = (("search bar", 92), ("pin bubble", 90), ("route card", 86), ("labels", 78), ("corners", 72))


def map_zones(c=F.col, limit: int = 8) -> Column:
    """array<struct<zone, priority>> of a record with map context, first the most telling."""
    fixed = F.array(*(F.struct(F.lit(zone).alias("zone"), F.lit(priority).alias("priority")) for zone, priority in ZONES))
    route = F.array(F.struct(F.lit("waypoints").alias("zone"), F.lit(95).alias("priority")))
    return F.when((c("map_intelligence") > 0) | c("route"), F.slice(F.when(c("route"), F.concat(route, fixed)).otherwise(fixed), 1, limit)).otherwise(F.array().cast("array<struct<zone:string,priority:int>>"))


def provider_links(lat: Column, lon: Column) -> Column:
    """array<struct<provider, url>> that show a point; null coordinates give none. Nothing is fetched."""
    point = F.format_string("%.6f,%.6f", lat, lon)
    marker = F.format_string("https://www.openstreetmap.org/?mlat=%.6f&mlon=%.6f#map=16/%.6f/%.6f", lat, lon, lat, lon)
    links = (("Google Maps", F.concat(F.lit("https://www.google.com/maps/search/?api=1&query="), point)), ("OpenStreetMap", marker), ("Apple Maps", F.concat(F.lit("https://maps.apple.com/?ll="), point)))
    some = F.array(*(F.struct(F.lit(name).alias("provider"), url.alias("url")) for name, url in links))
    return F.when(lat.isNotNull() & lon.isNotNull(), some).otherwise(F.array().cast("array<struct<provider:string,url:string>>"))


def best_anchor(c=F.col) -> Column:
    """struct<kind, lat, lon> of the point that a map of a record shows: the native one, else the derived one."""
    point = lambda kind, p: F.struct(F.lit(kind).alias("kind"), c(f"{p}_latitude").cast("double").alias("lat"), c(f"{p}_longitude").cast("double").alias("lon"))
    return F.coalesce(F.when(native(c), point("native", "gps")), F.when(derived(c), point("derived", "derived")))


# Points of a place by its kind.
PLACE_POINTS = {"city": 52, "area": 58, "landmark": 66}


def place_score(kind: Column, in_text: Column, in_url: Column, in_picture: Column, native_gps: Column, ocr: Column) -> Column:
    """How well a place is supported, 0 to 100, by its kind and by where it was seen."""
    base = F.lit(44)
    for name, points in PLACE_POINTS.items():
        base = F.when(kind == name, points).otherwise(base)
    more = points_of((in_text, 10), (in_url, 16), (in_picture, 7), (native_gps, 10))
    return clamp(base + more + F.least(F.lit(10), F.greatest(F.lit(0), F.floor(ocr / 10))).cast("int"), 0, 100)


# ------------------------------------------------------------------ checks against ground truth

CHECKS = {
    "native_gps": lambda c: native(c), "derived_geo": lambda c: derived(c) | (c("map_labels") > 0), "hidden_payload": lambda c: hidden(c), "parser_failure": lambda c: c("parser_status") != "Valid",
    "metadata_stripped": lambda c: ~c("has_exif"), "duplicate_expected": lambda c: c("duplicate_group") != "", "time_conflict": lambda c: c("time_conflicts") > 0,
    "image_detail_generated": lambda c: c("image_confidence") > 0, "map_route_detected": lambda c: c("route"),
}


def truth_checks(truth: Column, c=F.col) -> Column:
    """array<struct<key, passed>> of the expectations in a map that the record can be held against; others are skipped."""
    rows = [F.when(truth[key].isin("true", "false"), F.struct(F.lit(key).alias("key"), (is_so(c) == (truth[key] == "true")).alias("passed"))) for key, is_so in CHECKS.items()]
    contains, least, software = truth["source_type_contains"], truth["ocr_confidence_min"].try_cast("int"), truth["software_contains"]
    rows += [
        F.when(contains.isNotNull(), F.struct(F.lit("source_type_contains").alias("key"), F.lower(c("source_type")).contains(F.lower(contains)).alias("passed"))),
        F.when(least.isNotNull(), F.struct(F.lit("ocr_confidence_min").alias("key"), (c("ocr_confidence") >= least).alias("passed"))),
        F.when(software.isNotNull(), F.struct(F.lit("software_contains").alias("key"), F.lower(c("software")).contains(F.lower(software)).alias("passed"))),
    ]
    return F.array_compact(F.array(*rows))


# ------------------------------------------------------------------ map intelligence, content, posture


def map_intelligence(c=F.col) -> Column:
    """How surely a record shows a map, from the columns detected, basis, visual_score, interface_text, signal_confidence, route, route_confidence, city, area, landmark, their file-name forms, strong_region, offline_hit, endpoints."""
    floor = lambda holds, x: F.when(holds, x).otherwise(0)
    named = c("basis") == "filename"
    score = F.greatest(
        floor(c("detected"), F.when(named | (c("basis") == ""), 38).otherwise(F.greatest(c("visual_score"), F.lit(55)))), floor(c("interface_text"), 86), floor(c("signal_confidence") > 0, c("signal_confidence")),
        floor(c("route"), F.least(F.lit(92), c("route_confidence") + 8)), F.when(c("city"), 78).when(c("named_city"), 44).otherwise(0), F.when(c("area"), 80).when(c("named_area"), 46).otherwise(0),
        F.when(c("landmark"), 82).when(c("named_landmark"), 48).otherwise(0), floor(c("strong_region"), 84), floor(c("offline_hit") > 0, F.least(F.lit(88), c("offline_hit"))), floor(c("endpoints"), 76),
    )
    return F.when(named, F.least(score, F.lit(35))).otherwise(score).cast("int")


def content_label(c=F.col) -> tuple[Column, Column]:
    """What kind of content a record is, and how surely."""
    base = clamp(36 + F.floor(c("image_confidence") / 2) + F.least(F.lit(24), 5 * (c("map_labels") + c("visible_urls"))), 38, 74)
    mapped, chat, web = (c("map_intelligence") >= 50) | c("route"), c("app").isin(*CHAT_APPS), (c("visible_urls") > 0) | c("app").isin(*BROWSERS)
    camera, screen = c("source_type") == "Camera Photo", F.lower(c("source_type")).contains("screenshot")
    label = F.when(mapped, "map").when(chat, "messaging").when(web, "web").when(camera, "camera").when(screen, "screen").otherwise("general")
    floor = (
        F.when(mapped, F.greatest(c("map_intelligence"), F.when(c("route"), 76).otherwise(68))).when(chat, 76).when(web, 70)
        .when(camera, F.when(c("device_model").isin("Unknown", "N/A", ""), 68).otherwise(80)).when(screen, 58).otherwise(0)
    )
    pixel = F.when(c("pixel_score") >= 40, F.least(F.lit(92), 62 + F.floor(c("pixel_score") / 2))).otherwise(0)
    return label, F.greatest(base, floor, pixel).cast("int")


def existence(c=F.col) -> Column:
    """struct<exact, near>: whether a record has a twin in its case; any duplicate group counts as either."""
    group = ~F.coalesce(c("duplicate_group"), F.lit("")).isin("", "unique")
    note = F.lower(F.coalesce(c("note"), F.lit("")))
    said = note.rlike("near[ -]duplicate detected|similar image detected|similar peer|duplicate peer") & ~note.rlike("no near[ -]duplicate|no duplicate|no similar|not identified|none identified")
    return F.struct(group.alias("exact"), (group | said).alias("near"))


def search_gate(c=F.col) -> Column:
    """struct<coordinates, sensitive>: what stands against searching for a record's clues outside."""
    kinds = F.array_compact(F.array(F.when(native(c), F.lit("metadata")), F.when(c("map_url") | derived(c), F.lit("map")), F.when(c("scene_confidence") >= 30, F.lit("country")), F.when(c("visible_text"), F.lit("text"))))
    return F.struct((native(c) | derived(c)).alias("coordinates"), F.array_sort(kinds).alias("sensitive"))


def support_count(name: Column, *buckets: Column) -> Column:
    """How many buckets (arrays of texts) name a candidate."""
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    hits = [F.coalesce(F.lower(F.array_join(b, " | ")).contains(low), F.lit(False)).cast("int") for b in buckets]
    return F.when(low == "", 0).otherwise(reduce(lambda a, b: a + b, hits))


def audit_summary(records: DataFrame, case: str = "case_id", level: str = "redacted_text", verified: bool = False) -> DataFrame:
    """Per case: records, high risks, records without a firm place, and the number of blockers of a handoff."""
    ready, _ = map_answer_readiness()
    out = records.groupBy(case).agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("risk_level") == "High").alias("high"), F.count_if((ready < 50) & ~native()).alias("weak"))
    return out.withColumn("blockers", F.lit(int(level == "full") + int(not verified)) + (F.col("weak") > 0).cast("int"))


def privacy_posture(records: DataFrame, case: str = "case_id", level: str = "redacted_text") -> DataFrame:
    """Per case and level: records whose coordinates, texts or names an export must mask, and the status of the export."""
    strict = level in ("redacted_text", "courtroom_redacted")
    place, read = native() | derived(), F.col("visible_text") | (F.col("visible_urls") > 0)
    out = records.groupBy(case).agg(F.count_if(place & F.lit(strict)).alias("coordinates"), F.count_if(read & F.lit(strict)).alias("texts"), F.count(F.lit(1)).alias("records"))
    return out.withColumn("status", F.lit("Safe" if strict else "Needs review"))
