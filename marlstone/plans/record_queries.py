"""Registered queries of the rules over whole records, with SQL written from the rules themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import assessment, casework, relations, rules
from ..sources.records import RECORDS_SQL, records
from .queries import _km, query

_GPS = "(gps_latitude is not null and gps_longitude is not null)"
_DERIVED = "(derived_latitude is not null and derived_longitude is not null)"
_SOUND = "(parser_status = 'Valid' and signature_status <> 'Mismatch')"
_HIDDEN = "(hidden_codes > 0 or hidden_embeds > 0)"
_EDITOR = "regexp_matches(lower(software), 'photoshop|lightroom|snapseed|gimp|canva|pixlr')"
_EXPORT = "source_type in ('Screenshot', 'Messaging Export', 'Screenshot / Export', 'Graphic Asset')"
_PHOTO = "source_type in ('Camera Photo', 'Edited / Exported', 'Unknown')"
_SHOWN = f"(not {_GPS} and ((derived_geo_confidence > 0 and {_DERIVED}) or map_labels > 0 or place_candidates > 0))"
_COURT = """least(100, greatest(0, (case when timestamp_confidence >= 90 then 28 when timestamp_confidence >= 70 then 18 when timestamp_confidence > 0 then 8 else 0 end
  + case when gps_confidence >= 80 then 22 when gps_latitude is not null then 14 when derived_geo_confidence >= 60 then 10 when derived_geo_confidence > 0 then 5 else 0 end
  + case integrity_status when 'Verified' then 20 when 'Partial' then 12 else 0 end + case when signature_status = 'Matched' then 8 else 0 end + case when parser_status = 'Valid' then 6 else 0 end
  + case when device_model <> 'Unknown' then 5 else 0 end + case when visible_text then 4 else 0 end - case when time_conflicts > 0 then 10 else 0 end - case when hidden_codes > 0 then 8 else 0 end
  - case when parser_status <> 'Valid' or signature_status = 'Mismatch' then 14 else 0 end)))"""


def _listed(*rules: tuple[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"case when {holds} then '{code}' end" for holds, code in rules) + "], lambda x: x is not null), '; ')"


_REASONS = _listed(
    ("parser_status <> 'Valid'", "parser"), ("signature_status = 'Mismatch'", "signature"), ("integrity_status not in ('Verified', 'Partial')", "integrity"), ("timestamp_confidence < 70", "time"),
    ("gps_latitude is null and derived_geo_confidence > 0", "derived location"), ("gps_latitude is null and derived_geo_confidence = 0", "no location"),
    ("ocr_confidence > 0 and ocr_confidence < 55", "weak ocr"), ("time_conflicts > 0", "time conflict"), ("ai_flags > 0", "batch review"),
)


@query(f"with {RECORDS_SQL}, s as (select *, {_COURT} strength, {_REASONS} reasons from records) select evidence_id, strength, reasons, strength >= 68 and len(string_split(reasons, '; ')) <= 2 and {_SOUND} ready from s")
def court_readiness(spark, sf_dir):
    return records(spark, sf_dir).select("evidence_id", rules.courtroom_strength().alias("strength"), F.array_join(rules.court_reasons(), "; ").alias("reasons"), rules.court_ready().alias("ready"))


@query(
    f"""with {RECORDS_SQL} select evidence_id, case when not {_SOUND} then 'second parser' when time_conflicts > 0 or timestamp_confidence < 70 then 'verify time' when {_GPS} then 'verify coordinate' when route then 'confirm route'
  when derived_geo_confidence > 0 or map_labels > 0 or map_intelligence > 0 then 'corroborate location' when duplicate_group <> '' then 'compare duplicates' else 'analyst note' end action from records"""
)
def next_action(spark, sf_dir):
    return records(spark, sf_dir).select("evidence_id", rules.next_action().alias("action"))


@query(
    f"""with {RECORDS_SQL}, r as (select *, {_COURT} court from records), a as (select case_id, cast(round_even(avg(least(timestamp_confidence, 100)), 0) as int) timeline,
  cast(round_even(avg(case when gps_latitude is not null then greatest(gps_confidence, 70) when derived_geo_confidence > 0 then least(derived_geo_confidence, 70) when map_confidence > 0 then least(55, map_confidence) else 0 end), 0) as int) location,
  cast(round_even(avg(case when integrity_status = 'Verified' then 95 when integrity_status = 'Partial' then 70 when {_SOUND} then 55 else 25 end), 0) as int) integrity,
  cast(greatest(45, 100 - 5 * count(*) filter (visible_text or visible_urls > 0)) as int) privacy, cast(round_even(avg(court), 0) as int) courtroom from r group by case_id)
select *, cast(round_even(0.20 * timeline + 0.18 * location + 0.24 * integrity + 0.13 * privacy + 0.25 * courtroom, 0) as int) overall from a"""
)
def case_readiness(spark, sf_dir):
    return casework.readiness(records(spark, sf_dir).withColumn("court", rules.courtroom_strength()))


_CLAIMS = "1 + cast(timestamp_source <> 'Unavailable' or timestamp_confidence > 0 as int)"


@query(
    f"""with {RECORDS_SQL}, r as (select *, {_COURT} court, {_CLAIMS} claims from records), n as (select case_id, count(*) total, count(*) filter (parser_status = 'Valid') parser, count(*) filter (integrity_status = 'Verified') integrity,
  count(*) filter (gps_confidence >= 80) gps, count(*) filter ({_DERIVED} or map_labels > 0) derived, count(*) filter (timestamp_confidence >= 80) timed, count(*) filter (court >= 60) court_ready, count(*) filter (claims > 0) claimed,
  count(*) filter (pixel_score >= 40 or {_HIDDEN}) hidden, count(*) filter (route) routes from r group by case_id),
s as (select *, cast(parser < total as int) + cast(integrity < total as int) blockers, 1 + cast(gps = 0 as int) + cast(timed = 0 as int) + cast(court_ready = 0 as int) + cast(hidden > 0 as int) + cast(routes = 0 as int) + cast(claimed = 0 as int) warnings,
  least(100, greatest(0, cast(round_even(0.14 * round_even(100 * parser / total, 0) + 0.18 * round_even(100 * integrity / total, 0) + 14 + 0.12 * 35 + 0.12 * greatest(round_even(100 * gps / total, 0), least(round_even(100 * derived / total, 0), 85))
    + 0.10 * round_even(100 * timed / total, 0) + 0.10 * round_even(100 * court_ready / total, 0) + 0.07 * round_even(100 * claimed / total, 0) + 0.03 * case when hidden = 0 then 100 else 55 end, 0) as int))) raw from n),
f as (select *, case when blockers > 0 then least(raw, 69) else raw end score from s)
select case_id, total, hidden, cast(blockers as int) blockers, cast(warnings as int) warnings, cast(score as int) score, case when blockers > 0 then 'blocked' when score >= 82 and warnings = 0 then 'ready' when score >= 55 then 'review' else 'needs_work' end status from f"""
)
def launch_gate(spark, sf_dir):
    claims = F.size(assessment.claim_rows())
    return rules.launch_gate(records(spark, sf_dir).withColumns({"court": rules.courtroom_strength(), "claims": claims}))


_DOMINANT = "d as (select case_id, device_model dominant from (select case_id, device_model, count(*) n, min(evidence_id) f from records where device_model <> 'Unknown' group by all) qualify row_number() over (partition by case_id order by n desc, f) = 1)"
_BUCKETS = f"""(case when parser_status = 'Failed' then 46 when structure_status = 'Animated' then 6 when structure_status = 'Suspicious' then 18 else 0 end + case when signature_status = 'Mismatch' then 24 when format_trust in ('Weak', 'Header-only') then 8 else 0 end
    + case when hidden_codes > 0 then 26 when hidden_embeds > 0 then 14 else 0 end + case when stego <> '' and not contains(stego, 'No strong') then 11 else 0 end + case when pixel_score >= 70 then 18 when pixel_score >= 40 or lsb_strings > 0 then 10 else 0 end
    + case when width = 0 or height = 0 then 10 else 0 end + case when source_type = 'Malformed / Unsupported Asset' then 18 else 0 end) technical,
  case when has_exif then 0 when {_EXPORT} then 10 else 24 end metadata,
  (case when timestamp_source = 'Unavailable' then 16 when timestamp_source = 'Filename Pattern' then 4 when starts_with(timestamp_source, 'Filesystem') then 8 else 0 end + case when not {_GPS} and {_PHOTO} then 7 else 0 end
    + case when software in ('N/A', 'Unknown', '') then 0 when regexp_matches(lower(software), 'photoshop|lightroom|snapseed|gimp|canva') then 18 else 4 end + case when time_conflicts > 0 then 9 else 0 end
    + case when visible_urls > 0 and source_type = 'Camera Photo' then 12 else 0 end + case when starts_with(environment, 'Desktop') and width > 0 and height > 0 and width < height and contains(source_type, 'Screenshot') then 5 else 0 end
    + case when device_model not in ('Unknown', dominant) then 10 else 0 end + case when duplicate_group <> '' then 6 else 0 end + case when width > 0 and height > 0 and least(width, height) < 720 and source_type = 'Camera Photo' then 6 else 0 end
    + case when timestamp_source <> 'Unavailable' and mtime_gap_days > 365 then 8 else 0 end + case when source_type = 'Edited / Exported' then 10 else 0 end) authenticity,
  64 + case when parser_status = 'Failed' then 8 else 0 end + case when signature_status = 'Mismatch' then 6 else 0 end + case when not has_exif and {_EXPORT} then 10 else 0 end
    + case when timestamp_source = 'Unavailable' then -12 when timestamp_source = 'Filename Pattern' then 4 else 0 end + case when {_GPS} then 10 else 0 end + case when hidden_codes > 0 then 6 else 0 end
    + case when source_type in ('Map Screenshot', 'Browser Screenshot') then 5 else 0 end + case when pixel_score >= 40 or lsb_strings > 0 then 4 else 0 end + case when regexp_matches(lower(quality_flag), 'alpha|hidden|very dark') then 2 else 0 end
    + case when duplicate_group <> '' then 8 else 0 end + case when width > 0 and height > 0 and source_type in ('Screenshot', 'Messaging Export', 'Screenshot / Export') then 5 else 0 end trust"""
_ANOMALY = f"""with {RECORDS_SQL}, {_DOMINANT}, b as (select r.*, {_BUCKETS} from records r left join d using (case_id)),
anomaly as (select *, cast(least(greatest(round_even(authenticity * 0.45::double + metadata * 0.25::double + technical * 0.65::double, 0), 0), 100) as int) score, least(98, greatest(15, trust)) confidence from b),
levelled as (select *, case when technical >= 44 or score >= 70 then 'High' when score >= 35 then 'Medium' else 'Low' end level from anomaly)"""


def _scored(spark, sf_dir):
    e = records(spark, sf_dir)
    dominant = casework.dominant(e, "case_id", "device_model", "evidence_id").select("case_id", F.col("device_model").alias("dominant_device"))
    e = e.join(dominant, "case_id", "left")
    return e.withColumns(scoring.anomaly_columns())


@query(_ANOMALY + " select evidence_id, authenticity, metadata, technical, score, confidence, level from levelled")
def anomaly_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("evidence_id", "authenticity", "metadata", "technical", "score", "confidence", "level")


_CUES = f"""(cast(not {_SOUND} as int) + cast({_EDITOR} as int) + cast(time_conflicts > 0 as int) + cast(not has_exif and {_PHOTO} as int) + cast({_HIDDEN} as int) + cast({_DERIVED} and not {_GPS} and source_type = 'Camera Photo' as int))"""
_TIMED = "(timestamp_source <> 'Unavailable' and not regexp_matches(lower(timestamp_source), 'file ?name|filesystem') and (timestamp_confidence <= 0 or timestamp_confidence >= 45))"
_FINDINGS = f"""own as (
  select evidence_id, 'source_geo_contradiction' flag, 8 delta, 2 sure from records where source_type = 'Screenshot' and {_GPS}
  union all select evidence_id, 'camera_without_native_gps_but_map_lead', 6, 2 from records where source_type = 'Camera Photo' and not {_GPS} and derived_geo_confidence >= 60
  union all select evidence_id, 'location_without_time_anchor', 5, 1 from records where ({_GPS} or ({_DERIVED} and least(derived_geo_confidence, 70) >= 45)) and timestamp_source = 'Unavailable' and (gps_confidence >= 70 or derived_geo_confidence >= 60)
  union all select evidence_id, 'displayed_location_not_device_proof', 5, 1 from records where {_SHOWN}
  union all select evidence_id, 'location_context_without_time_anchor', 5, 1 from records where ({_GPS} or {_SHOWN}) and not {_TIMED}
  union all select evidence_id, 'metadata_authenticity_cluster', case when {_CUES} = 3 then 10 else 14 end, 3 from records where {_CUES} >= 3),
facts as (select evidence_id, duplicate_group grp, case when timestamp_source <> 'Unavailable' then ts end t, case when {_GPS} then round(gps_latitude, 4) || ',' || round(gps_longitude, 4) end p, case when {_DERIVED} then round(derived_latitude, 4) || ',' || round(derived_longitude, 4) end q,
  case when source_type <> 'Unknown' then source_type end s, case when {_GPS} then 'g' || round(gps_latitude, 4) || ',' || round(gps_longitude, 4) when {_SHOWN} then 's' || coalesce(round(derived_latitude, 4) || ',' || round(derived_longitude, 4), '') end sig from records where duplicate_group <> ''),
grouped as (select grp, cast(count(distinct t) > 1 as int) + cast(count(distinct p) > 1 or count(distinct q) > 1 as int) + cast(count(distinct s) > 1 as int) reasons, count(distinct sig) sigs from facts group by grp having count(*) > 1),
found as (select * from own union all select evidence_id, 'duplicate_context_conflict', case when reasons = 1 then 8 else 12 end, 3 from facts join grouped using (grp) where reasons > 0
  union all select evidence_id, 'duplicate_location_context_mismatch', 8, 2 from facts join grouped using (grp) where sigs > 1 and sig is not null)"""


def _found(e):
    return assessment.record_findings(e).unionByName(assessment.duplicate_findings(e))


@query(f"with {RECORDS_SQL}, {_FINDINGS} select evidence_id, flag, delta, sure confidence_delta from found")
def batch_findings(spark, sf_dir):
    return _found(records(spark, sf_dir))


@query(
    f"""{_ANOMALY}, {_FINDINGS}, folded as (select evidence_id, array_to_string(list_sort(list(distinct flag)), '; ') flags, sum(delta) score_delta, sum(sure) more from found group by evidence_id),
u as (select l.evidence_id, l.level was, coalesce(f.flags, '') flags, coalesce(score_delta, 0) d, least(100, score + coalesce(score_delta, 0)) score, least(98, confidence + coalesce(more, 0)) confidence from levelled l left join folded f using (evidence_id))
select evidence_id, flags, cast(score as int) score, cast(confidence as int) confidence, case when was = 'High' or (d > 0 and score >= 70) then 'High' when was = 'Medium' or (d > 0 and score >= 35) then 'Medium' else 'Low' end level from u"""
)
def batch_assessment(spark, sf_dir):
    e = _scored(spark, sf_dir)
    out = e.join(assessment.fold_findings(_found(e)).withColumnRenamed("confidence_delta", "more"), "evidence_id", "left").fillna(0, ["score_delta", "more"])
    score, level, confidence = assessment.uplift(F.col("score"), F.col("level"), F.col("confidence"), F.col("score_delta"), F.col("more"))
    return out.select("evidence_id", F.coalesce(F.array_join("flags", "; "), F.lit("")).alias("flags"), score.alias("score"), confidence.alias("confidence"), level.alias("level"))


@query(
    f"""with {RECORDS_SQL}, s as (select evidence_id, {_GPS} and gps_confidence >= 80 proof, greatest(case when derived_geo_confidence >= 65 then 52 else 0 end, case when map_intelligence >= 70 then 45 else 0 end, case when map_labels > 0 or place_candidates > 0 then 32 else 0 end) best, basis from records),
t as (select evidence_id, proof, case when proof then 86 when basis = 'filename' then least(best, 38) else best end score from s)
select evidence_id, score, case when proof then 'PROOF' when score >= 70 then 'STRONG_INDICATOR' when score >= 30 then 'LEAD' when score > 0 then 'WEAK_SIGNAL' else 'NO_SIGNAL' end label from t"""
)
def map_strength(spark, sf_dir):
    score, label = assessment.map_strength()
    return records(spark, sf_dir).select("evidence_id", score.alias("score"), label.alias("label"))


@query(
    f"""with {RECORDS_SQL} select evidence_id, cast(least(100, 8 + case integrity_status when 'Verified' then 22 when 'Partial' then 12 else 0 end + case when {_SOUND} then 14 else 0 end + case when timestamp_confidence >= 80 then 18 when timestamp_confidence > 0 then 8 else 0 end
  + case when {_GPS} and gps_confidence >= 80 then 18 when derived_geo_confidence > 0 then 8 else 0 end + case when map_intelligence >= 70 then 10 else 0 end + case when ocr_confidence >= 70 then 8 else 0 end + case when scene_confidence >= 70 then 6 else 0 end) as int) confidence,
  {_listed(("integrity_status = 'Verified'", "integrity_verified"), ("integrity_status = 'Partial'", "integrity_partial"), (_SOUND, "parser_valid"), ("timestamp_confidence >= 80", "strong_time_anchor"), ("timestamp_confidence between 1 and 79", "weak_time_anchor"), (_GPS + " and gps_confidence >= 80", "native_gps"), ("not (" + _GPS + " and gps_confidence >= 80) and derived_geo_confidence > 0", "derived_geo"), ("map_intelligence >= 70", "map_intelligence"), ("ocr_confidence >= 70", "ocr_context"), ("scene_confidence >= 70", "scene_classifier"))} basis from records"""
)
def confidence_profile(spark, sf_dir):
    signals = assessment.confidence_signals()
    weights = F.transform(signals, lambda s: s["weight"])
    return records(spark, sf_dir).select("evidence_id", scoring.weighted_confidence(weights, 8).alias("confidence"), F.array_join(F.transform(signals, lambda s: s["name"]), "; ").alias("basis"))


@query(
    f"""with {RECORDS_SQL}, v as (select *, case when timestamp_confidence >= 90 then 28 when timestamp_confidence >= 70 then 20 when timestamp_confidence > 0 then 12 else 0 end + case when gps_confidence >= 80 then 26 when {_GPS} then 18 when derived_geo_confidence >= 60 then 14 when derived_geo_confidence > 0 then 8 else 0 end
  + case integrity_status when 'Verified' then 16 when 'Partial' then 10 else 0 end + case when device_model <> 'Unknown' then 6 else 0 end + case when visible_text then 6 else 0 end + case when duplicate_group <> '' then 5 else 0 end + case when {_HIDDEN} then 7 else 0 end a from records),
w as (select evidence_id, least(100, greatest(0, case when {_SOUND} then a else greatest(8, a - 10) end)) value from v)
select evidence_id, value, case when value >= 72 then 'High' when value >= 45 then 'Medium' else 'Low' end label from w"""
)
def evidentiary_value(spark, sf_dir):
    value = assessment.evidentiary_value()
    return records(spark, sf_dir).select("evidence_id", value.alias("value"), F.when(value >= 72, "High").when(value >= 45, "Medium").otherwise("Low").alias("label"))


@query(
    f"""with {RECORDS_SQL} select evidence_id, case when {_GPS} and gps_confidence >= 80 then 'proof' when derived_geo_confidence >= 70 and (map_url or basis = 'map-url') then 'lead' when map_intelligence >= 80 and (map_url or place_candidates > 0 or basis = 'ocr/text') then 'lead'
  when map_intelligence > 0 or derived_geo_confidence > 0 then 'weak_signal' else 'no_signal' end strength from records"""
)
def location_strength(spark, sf_dir):
    return records(spark, sf_dir).select("evidence_id", assessment.location_strength().alias("strength"))


_SOURCE = "case evidence_id % 5 when 0 then 'offline geocoder city' when 1 then 'map url' when 2 then 'ocr landmark' when 3 then 'native gps tag' else '' end"


@query(
    f"""with {RECORDS_SQL}, s as (select evidence_id, {_GPS} native, {_DERIVED} placed, {_SOURCE} src from records), k as (select *, case when native or src = 'native gps tag' then 'n' when src = 'offline geocoder city' then 'a' when src = 'map url' and placed then 'd' when src in ('map url', 'ocr landmark') then 'a' when placed then 'd' else 'v' end k from s)
select evidence_id, case k when 'n' then 'Native GPS' when 'd' then 'Derived Geo Anchor' when 'a' then 'Map Search Lead' else 'Map Screenshot Mode' end label, case k when 'n' then 'primary_metadata' when 'd' then 'derived_coordinate_lead' when 'a' then 'approximate_review_required' else 'visual_context_only' end proof_level,
  case k when 'a' then 'medium' when 'v' then 'low' else 'high' end privacy from k"""
)
def claim_policies(spark, sf_dir):
    kind = rules.anchor_kind(F.expr(_SOURCE), assessment.native(), assessment.derived())
    return records(spark, sf_dir).select("evidence_id", assessment.claim_policy(kind).alias("p")).select("evidence_id", "p.*")


_VISUAL = "(map_intelligence > 0 or route)"


@query(
    f"""with {RECORDS_SQL} select evidence_id, case when {_GPS} then 'Native GPS' when {_DERIVED} then 'Derived Geo Anchor' when place_candidates > 0 then 'Map Search Lead' when {_VISUAL} then 'Map Screenshot Mode' else 'No Geo Anchor' end kind,
  least(100, greatest(case when {_GPS} then case when gps_confidence > 0 then gps_confidence else 94 end else 0 end, case when {_DERIVED} then case when derived_geo_confidence > 0 then derived_geo_confidence else 82 end else 0 end, case when map_url then 74 else 0 end,
  case when place_candidates > 0 then least(78, greatest(52, map_intelligence)) else 0 end, case when {_VISUAL} then least(48, greatest(28, map_intelligence)) else 0 end)) score from records"""
)
def geo_ladder(spark, sf_dir):
    kind, score = assessment.geo_ladder()
    return records(spark, sf_dir).select("evidence_id", kind.alias("kind"), score.alias("score"))


@query(
    f"""with {RECORDS_SQL}, s as (select evidence_id, route, {_DERIVED} or map_url or place_candidates > 0 anchored, greatest(case when {_GPS} then 92 else 0 end, case when {_DERIVED} then 86 else 0 end, case when map_url then 74 else 0 end,
  case when place_candidates > 0 then least(82, greatest(58, map_intelligence)) else 0 end, case when map_intelligence > 0 then least(42, greatest(25, map_intelligence)) else 0 end) base from records),
t as (select evidence_id, case when route and anchored then least(100, base + 6) when route then greatest(base, 45) else base end score from s)
select evidence_id, score, case when score >= 85 then 'anchor' when score >= 70 then 'after verification' when score >= 50 then 'place lead' when score >= 30 then 'visual only' else 'not ready' end label from t"""
)
def map_answer_readiness(spark, sf_dir):
    score, label = assessment.map_answer_readiness()
    return records(spark, sf_dir).select("evidence_id", score.alias("score"), label.alias("label"))


@query(
    f"""with {RECORDS_SQL} select evidence_id, case when {_GPS} then 'native_gps' when {_DERIVED} then 'displayed_coordinate' when place_candidates > 0 then 'ranked_candidate' when scene_confidence >= 90 then 'regional_hint' when map_intelligence >= 35 or route then 'visual_context' else 'no_signal' end tier,
  cast(case when {_GPS} then greatest(92, gps_confidence) when {_DERIVED} then greatest(76, derived_geo_confidence) when place_candidates > 0 then least(95, greatest(18, map_intelligence + least(12, 4 * (map_labels + visible_urls)))) when scene_confidence >= 90 then least(78, scene_confidence)
  when map_intelligence >= 35 or route then least(58, greatest(18, map_intelligence)) else 0 end as int) confidence,
  case when {_GPS} or {_DERIVED} then 'exact_coordinates' when place_candidates > 0 then 'poi' when scene_confidence >= 90 then 'country' when map_intelligence >= 35 or route then 'context_only' else 'no_signal' end "scope" from records"""
)
def location_estimate(spark, sf_dir):
    return records(spark, sf_dir).select("evidence_id", assessment.location_estimate().alias("e")).select("evidence_id", "e.*")


_MAPPED = "case when map_intelligence > 0 then map_intelligence else map_confidence end"


@query(
    f"""with {RECORDS_SQL}, r as (select *, {_MAPPED} mapped from records)
select evidence_id, 'integrity' claim, case when parser_status = 'Valid' then 'lead' else 'weak_signal' end status, cast(case when parser_status = 'Valid' then 55 else 35 end + 15 - case when parser_status = 'Valid' then 0 else 12 end - case when copy_verified then 0 else 4 end as int) confidence from r
union all select evidence_id, 'gps', case when gps_confidence >= 80 then 'proof' else 'strong_lead' end, case when gps_confidence > 0 then gps_confidence else 75 end from r where {_GPS}
union all select evidence_id, 'derived location', case when derived_geo_confidence < 65 then 'lead' else 'strong_lead' end, least(78, greatest(35, case when derived_geo_confidence > 0 then derived_geo_confidence else 45 end)) from r where not {_GPS} and {_DERIVED}
union all select evidence_id, 'map', case when mapped >= 70 then 'strong_lead' when mapped >= 40 then 'lead' else 'weak_signal' end, least(86, greatest(30, case when mapped > 0 then mapped when ocr_confidence > 0 then ocr_confidence else 35 end)) from r where mapped > 0 or map_labels > 0 or basis <> ''
union all select evidence_id, 'image', case when image_confidence < 75 then 'lead' else 'strong_lead' end, image_confidence from r where image_confidence > 0
union all select evidence_id, 'hidden', case when pixel_score < 70 then 'lead' else 'strong_lead' end, least(88, greatest(45, case when pixel_score > 0 then pixel_score else 55 end)) from r where {_HIDDEN} or pixel_score > 0"""
)
def fused_claims(spark, sf_dir):
    return records(spark, sf_dir).select("evidence_id", F.explode(assessment.fused_claims()).alias("c")).select("evidence_id", "c.*")


def _by(x: str, anchored: str = "false") -> str:
    return f"case when {x} >= 85 and not ({anchored}) then 'proof' when {x} >= 70 then 'strong_lead' when {x} >= 45 then 'lead' else 'weak_signal' end"


@query(
    f"""with {RECORDS_SQL}, r as (select *, greatest(gps_confidence, derived_geo_confidence, map_intelligence) placed, greatest(pixel_score, case when hidden_codes > 0 then 55 else 0 end) secret from records)
select evidence_id, 'custody/hash' family, cast(case when copy_verified then 95 else greatest(45, scene_confidence) end as int) confidence, case when copy_verified then 'proof' else 'lead' end strength, case when copy_verified then 'proof' else 'needs_review' end status from r
union all select evidence_id, 'timeline', timestamp_confidence, {_by("timestamp_confidence", "timestamp_confidence < 80")}, case when timestamp_confidence >= 85 then 'proof' else 'needs_corroboration' end from r where timestamp_source <> 'Unavailable' or timestamp_confidence > 0
union all select evidence_id, 'geo/map', placed, case when {_GPS} and placed >= 85 then 'proof' else {_by("placed", "not " + _GPS)} end, case when {_GPS} and placed >= 85 then 'proof' else 'lead_only' end from r where placed > 0
union all select evidence_id, 'ocr/visible-text', ocr_confidence, {_by("ocr_confidence")}, case when ocr_confidence >= 65 then 'evidence' else 'needs_review' end from r where ocr_confidence > 0 or visible_text or map_labels > 0
union all select evidence_id, 'hidden-content/pixel', secret, {_by("secret")}, case when secret < 80 then 'needs_review' else 'evidence' end from r where secret > 0 or hidden_embeds > 0 or lsb_strings > 0"""
)
def claim_rows(spark, sf_dir):
    return records(spark, sf_dir).select("evidence_id", F.explode(assessment.claim_rows()).alias("c")).select("evidence_id", "c.*")


@query(
    f"""with {RECORDS_SQL} select evidence_id, {_listed(("timestamp_confidence >= 80", "check time"), ("timestamp_confidence between 1 and 79", "confirm time"), ("timestamp_confidence <= 0", "recover time"), (_GPS, "check gps"), ("not " + _GPS + " and derived_geo_confidence >= 45", "confirm derived"), ("not " + _GPS + " and derived_geo_confidence < 45 and (map_labels > 0 or place_candidates > 0)", "read labels"), ("not " + _GPS + " and derived_geo_confidence < 45 and not (map_labels > 0 or place_candidates > 0)", "no location claim"), ("not " + _SOUND, "second parser"), ("duplicate_group <> ''", "compare duplicates"), (_HIDDEN, "review hidden"), ("visible_text", "keep text"))} plan from records"""
)
def corroboration_plan(spark, sf_dir):
    return records(spark, sf_dir).select("evidence_id", F.array_join(assessment.corroboration_plan(), "; ").alias("plan"))


_ISSUES = (
    (f"not has_exif and {_EXPORT}", "thin metadata"), (f"not has_exif and not {_EXPORT}", "no metadata"), (f"device_model = 'Unknown' and {_PHOTO}", "no device"), (_EDITOR, "edited"), ("timestamp_source = 'Filename Pattern'", "filename time"),
    ("starts_with(timestamp_source, 'Filesystem')", "filesystem time"), ("time_conflicts > 0", "time conflict"), ("signature_status = 'Mismatch'", "signature"), ("signature_status <> 'Mismatch' and parser_status <> 'Valid'", "parser"),
    (f"not {_GPS} and {_DERIVED}", "derived location"), (f"not {_GPS} and not {_DERIVED} and {_PHOTO}", "no location"), ("hidden_codes > 0", "hidden code"), ("hidden_codes = 0 and hidden_embeds > 0", "hidden embeds"),
)


@query(f"with {RECORDS_SQL}, i as (select evidence_id, {_listed(*_ISSUES)} all_issues from records) select evidence_id, array_to_string(string_split(all_issues, '; ')[1:8], '; ') issues from i")
def metadata_issues(spark, sf_dir):
    return records(spark, sf_dir).select("evidence_id", F.array_join(assessment.metadata_issues(), "; ").alias("issues"))


@query(
    f"""with {RECORDS_SQL} select evidence_id, case when parser_status = 'Failed' then 'parser' when signature_status = 'Mismatch' then 'signature' when hidden_codes > 0 then 'payload' when hidden_embeds > 0 then 'structure' when time_conflicts > 0 then 'time conflict'
  when duplicate_group <> '' then 'duplicate' when not has_exif and not {_EXPORT} then 'missing metadata' when not {_GPS} and {_DERIVED} then 'derived location' when {_EDITOR} then 'edited' when risk_level = 'Low' then 'low risk' else 'none' end issue from records"""
)
def primary_issue(spark, sf_dir):
    return records(spark, sf_dir).select("evidence_id", assessment.primary_issue().alias("issue"))


_POINT = f"case when {_GPS} then gps_latitude when {_DERIVED} and least(derived_geo_confidence, 70) >= 45 then derived_latitude end lat, case when {_GPS} then gps_longitude when {_DERIVED} and least(derived_geo_confidence, 70) >= 45 then derived_longitude end lon"


@query(
    f"""with {RECORDS_SQL}, r as (select case_id, evidence_id id, duplicate_group, device_model, link_text, {_POINT} from records), dev as (select case_id, device_model, id, row_number() over (partition by case_id, device_model order by id) nth from r where device_model <> 'Unknown'),
near as (select a.case_id, a.id s, b.id t, {_km("a.lat", "a.lon", "b.lat", "b.lon")} km from r a join r b on a.case_id = b.case_id and a.id < b.id and abs(a.lat - b.lat) < 0.03 and abs(a.lon - b.lon) < 0.05),
e as (select a.case_id, a.id source_id, b.id target_id, 'duplicate_group' relation, 96 weight from r a join r b on a.case_id = b.case_id and a.duplicate_group = b.duplicate_group and a.duplicate_group <> '' and a.id < b.id
  union select a.case_id, a.id, b.id, 'same_device', 58 from dev a join dev b on a.case_id = b.case_id and a.device_model = b.device_model and a.id < b.id and a.nth <= 8 and b.nth <= 8
  union select case_id, s, t, case when km <= 0.25 then 'same_location' else 'nearby_location' end, case when km <= 0.25 then 74 else 52 end from near where km <= 3
  union select a.case_id, least(a.id, b.id), greatest(a.id, b.id), 'case_link', 65 from r a join r b on a.case_id = b.case_id and a.id <> b.id and list_contains(regexp_extract_all(a.link_text, '[0-9]+'), cast(b.id as varchar)))
select case_id, source_id, target_id, relation, weight from e qualify row_number() over (partition by case_id order by weight desc, relation, source_id, target_id) <= 120"""
)
def evidence_graph(spark, sf_dir):
    """The 120 heaviest edges of each case; the limit is the feature."""
    e = records(spark, sf_dir).select("case_id", F.col("evidence_id").alias("id"), "duplicate_group", "device_model", "link_text", *(F.when(assessment.native(), F.col(f"gps_{x}")).when(assessment.usable_point(), F.col(f"derived_{x}")).alias(y) for x, y in (("latitude", "lat"), ("longitude", "lon"))))
    return relations.evidence_graph(e)
