"""Candidates and hypotheses of where a record was made: generation, merging, ranking, solvability, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import clamp
from .assessment import derived, native

# Orders of strength and of level.
STRENGTH = {"proof": 0, "lead": 1, "weak_signal": 2, "no_signal": 3}
LEVEL = {"coordinates": 0, "poi": 1, "area": 2, "city": 3, "country": 4, "place": 5, "visual_context": 8, "filename_hint": 9}
STABLE = ("coordinates", "poi", "area", "city", "country", "place")


def rank_of(column: Column, order: dict[str, int], otherwise: int) -> Column:
    out = None
    for value, rank in order.items():
        out = F.when(column == value, rank) if out is None else out.when(column == value, rank)
    return out.otherwise(otherwise)


def geo_candidates(c=F.col) -> Column:
    """array<struct<name, level, confidence, strength>> that a record's own signals give."""
    one = lambda name, level, confidence, strength: F.struct(name.cast("string").alias("name"), F.lit(level).alias("level"), confidence.cast("int").alias("confidence"), strength.alias("strength"))
    given = lambda x, otherwise: F.when(x > 0, x).otherwise(otherwise)
    point = lambda lat, lon: F.concat_ws(", ", F.round(c(lat), 4).cast("string"), F.round(c(lon), 4).cast("string"))
    sure = c("scene_confidence")
    return F.array_compact(F.array(
        F.when(native(c), one(point("gps_latitude", "gps_longitude"), "coordinates", F.greatest(F.lit(85), c("gps_confidence")), F.lit("proof"))),
        F.when(derived(c), one(point("derived_latitude", "derived_longitude"), "coordinates", clamp(given(c("derived_geo_confidence"), 80), 70, 92), F.lit("lead"))),
        F.when(c("map_url"), one(F.lit("map address"), "poi", F.greatest(F.lit(72), c("map_intelligence")), F.lit("lead"))),
        F.when(c("place_candidates") > 0, one(F.lit("place label"), "place", c("map_intelligence"), F.when(c("map_intelligence") >= 55, "lead").otherwise("weak_signal"))),
        F.when(c("image_confidence") > 0, one(F.lit("visual context"), "visual_context", clamp(c("image_confidence"), 28, 38), F.lit("weak_signal"))),
        F.when(c("basis") == "filename", one(F.lit("file name"), "filename_hint", F.lit(35), F.lit("weak_signal"))),
        F.when(sure >= 30, one(F.lit("region"), "country", sure, F.when(sure >= 55, "lead").otherwise("weak_signal"))),
    ))


def merge_candidates(candidates: DataFrame, key: str) -> DataFrame:
    """One row for each name (in any case) and level of a record: that of the highest confidence, of equals the strongest."""
    name = F.lower(F.trim(F.regexp_replace("name", r"\s+", " ")))
    rows = candidates.withColumn("same", name).where("same <> ''")
    best = rows.groupBy(key, "level", "same").agg(F.max_by(F.struct("name", "confidence", "strength"), F.struct("confidence", -rank_of(F.col("strength"), STRENGTH, 5), "name")).alias("b"), F.count(F.lit(1)).alias("merged"))
    return best.select(key, "b.name", "level", F.least(F.greatest("b.confidence", F.lit(0)), F.lit(100)).alias("confidence"), "b.strength", "merged")


def rank_candidates(candidates: DataFrame, key: str) -> DataFrame:
    """Adds place, 1 for the best candidate: by strength, then level and confidence, then name."""
    order = [rank_of(F.col("strength"), STRENGTH, 5), rank_of(F.col("level"), LEVEL, 5) * 100 - F.col("confidence"), F.lower("name")]
    return candidates.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def solvability(candidates: DataFrame, key: str) -> DataFrame:
    """Per record, how far its candidates go: 0 to 100, with floors for proof and coordinates and caps for file names and visual context alone."""
    c = F.col
    stable = c("level").isin(*STABLE) & c("strength").isin("proof", "lead") & (c("confidence") >= 45)
    out = candidates.groupBy(key).agg(
        F.max("confidence").alias("best"), F.bool_or(c("strength") == "proof").alias("proof"), F.bool_or((c("level") == "coordinates") & (c("strength") == "lead")).alias("coordinate"),
        F.bool_or(c("level").isin("poi", "area") & (c("confidence") >= 65)).alias("place"), F.bool_and(c("level") == "filename_hint").alias("named"), F.bool_or(stable).alias("stable"),
        F.bool_or(c("level") == "visual_context").alias("visual"), F.bool_and(c("level").isin("visual_context", "filename_hint")).alias("context"),
    )
    score = F.greatest(c("best"), F.when(c("proof"), 92).otherwise(0), F.when(c("coordinate"), 82).otherwise(0), F.when(c("place"), 68).otherwise(0))
    score = F.when(c("named"), F.least(score, F.lit(35))).otherwise(score)
    context = (~c("stable") & c("context")) | (~c("stable") & c("visual"))
    score = clamp(F.when(context, F.least(score, F.lit(38))).otherwise(score), 0, 100)
    label = F.when(~c("stable") & c("context"), "context only").when(score >= 90, "exact").when(score >= 75, "strong").when(score >= 55, "likely").when(score >= 30, "regional").otherwise("none")
    return out.select(key, score.alias("score"), label.alias("label"))


def methodology_score(solved: Column, ready: Column, located: Column, mapped: Column, best: Column, families: Column, pixel: Column, context_only: Column) -> Column:
    """Operational readiness: the best of three scores with floors, what independent sources add, and a cap for context alone."""
    score = F.greatest(solved, ready, best, F.when(located, 90).when(mapped, 78).otherwise(0))
    score = F.when((families >= 2) & (best >= 50), F.least(F.lit(100), score + 8)).otherwise(score)
    score = F.when(pixel >= 70, F.least(F.lit(100), score + 5)).otherwise(score)
    return F.when(context_only, F.least(score, F.lit(38))).otherwise(score)


def hypotheses(c=F.col) -> Column:
    """array<struct<title, strength, confidence>>: what may be said of a record's place, the first of equal titles, at most ten."""
    one = lambda title, strength, confidence: F.struct(F.lit(title).alias("title"), strength.alias("strength"), clamp(confidence, 0, 100).cast("int").alias("confidence"))
    places, mapped = c("place_candidates") > 0, F.when(c("map_intelligence") > 0, c("map_intelligence")).otherwise(c("map_confidence"))
    seen = c("basis") != ""
    return F.slice(F.array_compact(F.array(
        F.when(native(c), one("native gps", F.when(c("gps_confidence") >= 80, "proof").otherwise("lead"), c("gps_confidence"))),
        F.when(derived(c), one("derived coordinate", F.lit("lead"), c("derived_geo_confidence"))),
        F.when(c("map_url"), one("map address", F.lit("lead"), F.lit(82))),
        F.when(places, one("visible place", F.when(mapped >= 65, "lead").otherwise("weak_signal"), mapped)),
        F.when(~places & seen & (mapped >= 50), one("map context", F.lit("weak_signal"), clamp(mapped, 35, 88))),
        F.when((c("basis") == "filename") & ~places & ~c("map_url") & ~native(c), one("file name", F.lit("weak_signal"), F.lit(35))),
        F.when(c("place_candidates") > 1, one("ranked places", F.when(mapped >= 65, "lead").otherwise("weak_signal"), clamp(mapped, 35, 92))),
    )), 1, 10)


def missing_bases(c=F.col) -> Column:
    """Codes of what a location hypothesis of a record still lacks."""
    held = F.array_compact(F.array(
        F.when(native(c), F.lit("native-gps")), F.when(c("visible_urls") > 0, F.lit("source-url")), F.when(c("visible_text"), F.lit("stable-label")),
        F.when(c("copy_verified") | (c("integrity_status") == "Verified"), F.lit("verified-copy")),
    ))
    return F.array_except(F.array(*(F.lit(x) for x in ("native-gps", "source-url", "stable-label", "verified-copy"))), held)


def corroboration_status(strength: Column, missing: Column) -> Column:
    return F.when((strength == "proof") & (F.size(missing) == 0), "corroborated").when((strength == "lead") & (F.size(missing) <= 2), "strong_lead").otherwise("needs_corroboration")


def default_decision(strength: Column, confidence: Column) -> Column:
    return F.when((strength == "proof") & (confidence >= 80), "auto_generated").otherwise("needs_review")


def attach_decisions(claims: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """``claims`` with the decision on each; where there is none, the default one. ``decisions(keys, decision, at)``: the last counts."""
    last = decisions.groupBy(*keys).agg(F.max_by("decision", "at").alias("given"))
    return claims.join(last, keys, "left").withColumn("decision", F.coalesce("given", default_decision(F.col("strength"), F.col("confidence")))).drop("given")


def place_centroids(records: DataFrame, centroids: DataFrame, place: str = "place") -> DataFrame:
    """Adds lat and lon of a place's centroid by its name in any case; null where the table has none. ``centroids(name, lat, lon)`` has a name once."""
    c = centroids.select(F.lower(F.trim("name")).alias("__name"), "lat", "lon")
    return records.withColumn("__name", F.lower(F.trim(place))).join(c, "__name", "left").drop("__name")
