"""Registered queries of the record rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import rules
from ..sources.tables import EVIDENCE_SQL, POINTS_SQL, evidence, points, table
from .queries import _STRENGTH, query

@query(
    f"""with {EVIDENCE_SQL} select evidence_id, case when evidence_id % 7 = 0 then 'Review Required' when parser_status <> 'Valid' or signature_status = 'Mismatch' then 'Review Required'
  when evidence_id % 3 = 0 and not bookmarked then 'Verified' when evidence_id % 3 in (0, 1) then 'Partial' else 'Pending Review' end status from evidence"""
)
def integrity_status(spark, sf_dir):
    k = F.col("evidence_id")
    trust = F.when(k % 3 == 0, "Verified").when(k % 3 == 1, "Weak").otherwise("Unknown")
    status = rules.integrity_status(F.lit("a"), F.lit("a"), k % 7 != 0, F.col("parser_status"), F.col("signature_status"), trust, F.col("bookmarked"))
    return evidence(spark, sf_dir).select("evidence_id", status.alias("status"))


@query(
    f"""with {EVIDENCE_SQL}, s as (select evidence_id, gps_latitude is not null native, derived_geo_confidence c, case evidence_id % 4 when 0 then 'offline geocoder city' when 1 then 'map url' when 2 then 'ocr landmark' else '' end src from evidence),
k as (select *, case when native then 'native_gps' when src like '%geocoder%' then 'approximate_place' when src = 'map url' then case when c > 40 then 'derived_coordinate' else 'place_search' end when src like '%ocr%' then 'place_search'
  when c > 40 then 'derived_coordinate' else 'visual_context' end kind from s)
select evidence_id, kind, case when kind = 'native_gps' then greatest(25, 130 - c) when kind = 'derived_coordinate' then greatest(80, 900 - c * 6) when src like '%landmark%' then 300 when src like '%city%' then 25000
  when kind = 'place_search' then 8000 when kind = 'approximate_place' then 15000 else 0 end radius from k"""
)
def location_anchor(spark, sf_dir):
    names = F.array(*(F.lit(x) for x in ("offline geocoder city", "map url", "ocr landmark", "")))
    e = evidence(spark, sf_dir).withColumn("src", F.get(names, (F.col("evidence_id") % 4).cast("int")))
    kind = rules.anchor_kind(F.col("src"), F.col("gps_latitude").isNotNull(), F.col("derived_geo_confidence") > 40)
    return e.withColumn("kind", kind).select("evidence_id", "kind", rules.anchor_radius(F.col("kind"), F.col("derived_geo_confidence"), F.col("src")).alias("radius"))


#: Words of a region, as (base, step, cap, words); the words of a deployment are data of its own.
REGIONS = {"english": (16, 7, 50, ("the ", " and ", " of ")), "german": (16, 7, 50, (" der ", " und ", " die ")), "french": (18, 8, 46, (" les ", " de ", " et ")), "spanish": (18, 8, 46, (" el ", " que ", " los "))}


def _region_sql() -> str:
    parts = []
    for region, (base, step, cap, words) in REGIONS.items():
        hits = " + ".join(f"cast(contains(lower(text), '{w}') as int)" for w in words)
        parts.append(f"select doc_id, '{region}' region, {hits} hits, case when {hits} > 0 then least({cap}, {base} + {step} * ({hits})) else 0 end score from documents")
    return f"with s as ({' union all '.join(parts)}) select doc_id, region, score, hits from s where score > 0 qualify row_number() over (partition by doc_id order by score desc, region) = 1"


@query(_region_sql())
def region_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.get(rules.region_scores(F.col("text"), REGIONS), 0).alias("r")).where("r is not null")
    return docs.select("doc_id", "r.region", "r.score", "r.hits")


#: Profiles with evidence besides words; those of a deployment are data of its own.
PROFILES = {
    "german": (90, (16, 3, 40, (" der ", " und ", " die ", " mit ", " ist ")), (("[\u00e4\u00f6\u00fc\u00df]", 14), ("\\.de\\b", 30))),
    "french": (88, (12, 3, 36, (" les ", " de ", " et ", " la ")), (("[\u00e8\u00ea\u00e7]", 16), ("\\+33", 34))),
    "spanish": (78, (14, 3, 36, (" el ", " que ", " los ", " de ")), (("[\u00f1\u00f3]", 14),)),
    "english": (72, (14, 4, 45, ("the ", " and ", " of ", " was ")), (("[0-9]{3}-[0-9]{4}", 18),)),
}


def _profile_sql() -> str:
    scores = []
    for cap, (base, step, most, words), patterns in PROFILES.values():
        hits = " + ".join(f"cast(contains(low, '{w}') as int)" for w in words)
        more = "".join(f" + case when regexp_matches(low, '{p}') then {n} else 0 end" for p, n in patterns)
        scores.append(f"least({cap}, case when {hits} > 0 then least({most}, {base} + {step} * ({hits})) else 0 end{more})")
    names = "', '".join(PROFILES)
    return f"""with d as (select doc_id, lower(coalesce(text, '')) low from documents), s as (select doc_id, low, [{', '.join(scores)}] s from d), b as (select *, list_max(s) m from s)
select doc_id, case when m >= 30 then ['{names}'][list_position(s, m)] when regexp_matches(low, '[\u0600-\u06ff]') then 'Arabic script' when regexp_matches(low, '[a-z]') then 'Latin script' else 'Unknown' end region,
  cast(case when m >= 30 then m when regexp_matches(low, '[\u0600-\u06ff]') then 28 when regexp_matches(low, '[a-z]') then 24 else 0 end as int) score from b"""


@query(_profile_sql())
def region_profiles(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", rules.classify_region(F.col("text"), PROFILES).alias("r")).select("doc_id", "r.*")


@query(
    f"""with {EVIDENCE_SQL}, s as (select *, {_STRENGTH} strength from evidence), t as (select *, strength >= 78 and integrity_status = 'Verified' and (gps_latitude is not null or timestamp_confidence >= 80) proof from s)
select case_id, count(*) records, count(*) filter (risk_level = 'High') high, count(*) filter (proof or strength >= 55) strong, count(*) filter (not (proof or strength >= 55) and strength >= 20) leads,
  arg_max(evidence_id, row(strength, suspicion_score, map_confidence, ocr_confidence, evidence_id)) strongest from t group by case_id"""
)
def case_narrator(spark, sf_dir):
    score, label = scoring.evidence_strength()
    return rules.narrator(evidence(spark, sf_dir).withColumns({"strength": score, "label": label}))


@query(
    f"""with {POINTS_SQL} select source, count(*) anchors, count(*) filter (id % 3 = 0) native, count(*) filter (id % 3 <> 0) derived, round(avg(lat), 6) mean_lat, round(avg(lon), 6) mean_lon,
  round(min(lat), 6) min_lat, round(max(lat), 6) max_lat, round(min(lon), 6) min_lon, round(max(lon), 6) max_lon from points group by source"""
)
def map_reconstruction(spark, sf_dir):
    return rules.map_summary(points(spark, sf_dir).withColumn("native", F.col("id") % 3 == 0), "source")


@query(f"""with {EVIDENCE_SQL}, b as (select suspicion_score s from evidence where evidence_id = 7) select evidence_id, abs(suspicion_score - s) distance from evidence, b where evidence_id <> 7 order by distance, evidence_id limit 10""")
def closest_peers(spark, sf_dir):
    return rules.closest_peers(evidence(spark, sf_dir), 7)


@query(f"""with {EVIDENCE_SQL} select evidence_id, case when gps_latitude is not null then case when gps_confidence >= 90 then 25 else 75 end when derived_geo_confidence > 90 then 50 when bookmarked then case when derived_geo_confidence >= 75 then 250 else 750 end
  when evidence_id % 4 = 0 then case when derived_geo_confidence >= 80 then 350 else 900 end when evidence_id % 4 = 1 then case when derived_geo_confidence >= 70 then 1500 else 3000 end when evidence_id % 4 = 2 then case when derived_geo_confidence >= 65 then 10000 else 25000 end else 50000 end radius from evidence""")
def evidence_radius(spark, sf_dir):
    level = F.get(F.array(*(F.lit(x) for x in ("poi", "area", "city", "country"))), (F.col("evidence_id") % 4).cast("int"))
    native = F.col("gps_latitude").isNotNull()
    sure = F.when(native, F.col("gps_confidence")).otherwise(F.col("derived_geo_confidence"))
    return evidence(spark, sf_dir).select("evidence_id", rules.evidence_radius(native, F.col("derived_geo_confidence") > 90, F.col("bookmarked"), level, sure).alias("radius"))
