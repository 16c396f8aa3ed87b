"""Registered queries of visible text, colours, map intelligence, content and posture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ocr_text
from ..operators import assessment, pixels
from ..sources.records import RECORDS_SQL, records
from ..sources.tables import table
from .queries import query
from .record_queries import _DERIVED, _GPS
from .signal_queries import _BYTES, _CHAT

_LINES = "list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')))"


@query(
    f"""with l as (select doc_id, unnest({_LINES}) t from documents), c as (select doc_id, t, length(t) n, length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) a, length(regexp_replace(t, '[^\\p{{Nd}}]', '', 'g')) d, length(regexp_replace(t, '[^ ]', '', 'g')) s from l),
r as (select *, n >= 3 and a + d + s >= greatest(3, floor(n * 0.35::double)) and regexp_matches(t, '[\\p{{L}}\\p{{N}}]') and not (n <= 4 and a <= 1 and d = 0) ok from c)
select doc_id, count(*) lines, count(*) filter (ok) readable, cast(least(95, least(92, 28 + 4 * count(*) filter (ok)) + least(18, 3 * count(*) filter (contains(t, '@')))) as int) score from r group by doc_id"""
)
def readable_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("t"))
    out = lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(ocr_text.readable(F.col("t"))).alias("readable"), F.count_if(F.col("t").contains("@")).alias("signals"))
    return out.select("doc_id", "lines", "readable", ocr_text.ocr_score(F.col("readable"), F.lit(0), F.col("signals")).alias("score"))


_ROUTE = """case o_orderkey % 5 when 0 then 'from Old Town ' || o_custkey % 7 || ' to City Park, now' when 1 then 'Harbour Street -> North Gate' when 2 then 'directions -> Cairo Tower' when 3 then o_orderpriority else 'from Central Hall to central hall' end"""


@query(
    f"""with t as (select o_orderkey, {_ROUTE} t from orders) select o_orderkey, case o_orderkey % 5 when 0 then regexp_extract(t, 'from (.+) to', 1) else 'Harbour Street' end start, case o_orderkey % 5 when 0 then 'City Park' else 'North Gate' end finish from t where o_orderkey % 5 in (0, 1)"""
)
def route_endpoints(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.array(F.expr(_ROUTE), F.lit("a very long line that says nothing about where anything goes at all")).alias("lines"))
    return o.select("o_orderkey", ocr_text.route(F.col("lines")).alias("r")).where("r is not null").select("o_orderkey", "r.*")


_QUESTION = """case o_orderkey % 6 when 0 then 'Identify this temple. Flag format: byuctf{City-State}' when 1 then 'What are the exact coordinates?' when 2 then 'Which country is it? ctf{x}' when 3 then 'When was it published' when 4 then 'Name the bridge' else 'Hm?' end"""
_FLAG = """case o_orderkey % 6 when 0 then 'byuctf{City-State}' when 2 then 'ctf{x}' else '' end"""


@query(
    f"""with t as (select o_orderkey, o_orderpriority || ', A B' a, {_FLAG} f from orders)
select o_orderkey, case o_orderkey % 6 when 0 then 'city_state' when 1 then 'coordinates' when 2 then 'country' when 3 then 'date' when 4 then 'landmark' else 'generic' end kind,
  case when f = '' then a else split_part(f, '{{', 1) || '{{' || replace(replace(replace(a, ', ', '-'), ',', '-'), ' ', '-') || '}}' end answer from t"""
)
def question_answers(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_QUESTION).alias("q"), F.concat("o_orderpriority", F.lit(", A B")).alias("a"))
    return o.select("o_orderkey", ocr_text.question_kind(F.col("q")).alias("kind"), ocr_text.flag_answer(F.col("a"), ocr_text.flag_format(F.col("q"))).alias("answer"))


@query(
    f"""with b as (select vec_id, {_BYTES} b from embeddings), p as (select vec_id, unnest(range(16)) i, b from b), c as (select vec_id, b[4 * i + 1] r, b[4 * i + 2] g, b[4 * i + 3] bl, b[4 * i + 4] a from p), m as (select *, (r + g + bl) / 3 mean, greatest(r, g, bl) - least(r, g, bl) spread from c)
select vec_id, round(count(*) filter (mean >= 190) / 16, 4) light, round(count(*) filter (mean <= 45) / 16, 4) dark, round(count(*) filter (spread >= 60) / 16, 4) saturated, round(count(*) filter (g >= 105 and g >= r + 8 and g >= bl - 10) / 16, 4) green,
  round(count(*) filter (bl >= 95 and g >= 70 and r <= 105 and bl >= r + 25) / 16, 4) water, round(count(*) filter (mean between 82 and 205 and spread <= 22) / 16, 4) road_grey, round(count(*) filter (r > 95 and g > 55 and bl > 35 and r > g and g > bl and r - bl >= 35) / 16, 4) skin from m group by vec_id"""
)
def colour_ratios(spark, sf_dir):
    byte = F.transform("embedding", lambda x: (F.floor(F.abs(x.cast("double")) * 1000) % 256).cast("int"))
    raw = F.unhex(F.array_join(F.transform(byte, lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    images = table(spark, sf_dir, "embeddings").select("vec_id", raw.alias("rgba"), F.lit(4).alias("width"))
    return pixels.colours(images).select("vec_id", "light", "dark", "saturated", "green", "water", "road_grey", "skin")


_MAP = {
    "detected": "map_intelligence > 20", "visual_score": "image_confidence", "interface_text": "evidence_id % 9 = 0", "signal_confidence": "case when map_url then 88 else 0 end", "route_confidence": "scene_confidence", "city": "evidence_id % 7 = 0", "named_city": "evidence_id % 7 = 1",
    "area": "evidence_id % 11 = 0", "named_area": "evidence_id % 11 = 1", "landmark": "evidence_id % 13 = 0", "named_landmark": "evidence_id % 13 = 1", "strong_region": "evidence_id % 17 = 0", "offline_hit": "case when place_candidates > 0 then 60 + place_candidates * 10 else 0 end", "endpoints": "evidence_id % 19 = 0",
}


@query(
    f"""with {RECORDS_SQL}, m as (select evidence_id, basis, route, {", ".join(f"{e} {c}" for c, e in _MAP.items())} from records), s as (select evidence_id, basis, greatest(case when not detected then 0 when basis in ('filename', '') then 38 else greatest(visual_score, 55) end, case when interface_text then 86 else 0 end, signal_confidence,
  case when route then least(92, route_confidence + 8) else 0 end, case when city then 78 when named_city then 44 else 0 end, case when area then 80 when named_area then 46 else 0 end, case when landmark then 82 when named_landmark then 48 else 0 end, case when strong_region then 84 else 0 end,
  case when offline_hit > 0 then least(88, offline_hit) else 0 end, case when endpoints then 76 else 0 end) score from m)
select evidence_id, cast(case when basis = 'filename' then least(score, 35) else score end as int) confidence from s"""
)
def map_confidence(spark, sf_dir):
    e = records(spark, sf_dir).withColumns({c: F.expr(x) for c, x in _MAP.items()})
    return e.select("evidence_id", assessment.map_intelligence().alias("confidence"))


@query(
    f"""with {RECORDS_SQL}, k as (select *, case when map_intelligence >= 50 or route then 'map' when {_CHAT} then 'messaging' when visible_urls > 0 then 'web' when source_type = 'Camera Photo' then 'camera' when contains(lower(source_type), 'screenshot') then 'screen' else 'general' end label from records)
select evidence_id, label, cast(greatest(least(74, greatest(38, 36 + image_confidence // 2 + least(24, 5 * (map_labels + visible_urls)))), case label when 'map' then greatest(map_intelligence, case when route then 76 else 68 end) when 'messaging' then 76 when 'web' then 70
  when 'camera' then case when device_model = 'Unknown' then 68 else 80 end when 'screen' then 58 else 0 end, case when pixel_score >= 40 then least(92, 62 + pixel_score // 2) else 0 end) as int) confidence from k"""
)
def content_labels(spark, sf_dir):
    label, confidence = assessment.content_label()
    return records(spark, sf_dir).select("evidence_id", label.alias("label"), confidence.alias("confidence"))


_NOTE = "case evidence_id % 5 when 0 then 'Near-duplicate detected' when 1 then 'No near-duplicate peer; similar peer unlikely' when 2 then 'similar peer' else '' end"


@query(
    f"""with {RECORDS_SQL} select evidence_id, duplicate_group <> '' "exact", duplicate_group <> '' or evidence_id % 5 in (0, 2) near, {_GPS} or {_DERIVED} coordinates,
  array_to_string(list_filter([case when scene_confidence >= 30 then 'country' end, case when map_url or {_DERIVED} then 'map' end, case when {_GPS} then 'metadata' end, case when visible_text then 'text' end], lambda x: x is not null), '; ') sensitive from records"""
)
def existence_and_gate(spark, sf_dir):
    e = records(spark, sf_dir).withColumn("note", F.expr(_NOTE))
    out = e.select("evidence_id", assessment.existence().alias("x"), assessment.search_gate().alias("g"))
    return out.select("evidence_id", "x.exact", "x.near", "g.coordinates", F.array_join("g.sensitive", "; ").alias("sensitive"))


@query(
    f"""with {RECORDS_SQL}, s as (select *, {_DERIVED} or map_url or place_candidates > 0 anchored, greatest(case when {_GPS} then 92 else 0 end, case when {_DERIVED} then 86 else 0 end, case when map_url then 74 else 0 end, case when place_candidates > 0 then least(82, greatest(58, map_intelligence)) else 0 end,
  case when map_intelligence > 0 then least(42, greatest(25, map_intelligence)) else 0 end) base from records), t as (select *, case when route and anchored then least(100, base + 6) when route then greatest(base, 45) else base end ready from s)
select case_id, count(*) records, count(*) filter (risk_level = 'High') high, count(*) filter (ready < 50 and not {_GPS}) weak, cast(1 + cast(count(*) filter (ready < 50 and not {_GPS}) > 0 as int) as int) blockers from t group by case_id"""
)
def audit_summary(spark, sf_dir):
    return assessment.audit_summary(records(spark, sf_dir))


@query(f"""with {RECORDS_SQL} select case_id, count(*) filter ({_GPS} or {_DERIVED}) coordinates, count(*) filter (visible_text or visible_urls > 0) texts, count(*) records, 'Safe' status from records group by case_id""")
def privacy_posture(spark, sf_dir):
    return assessment.privacy_posture(records(spark, sf_dir))
