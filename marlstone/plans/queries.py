"""Registered queries over the driver tables, each with SQL that an independent engine can run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, scoring, text, timeparse, vectors
from ..operators import casework, custody, gazetteer, relations, travel
from ..sources.tables import EVIDENCE_SQL, POINTS_SQL, evidence, points, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


_HAVERSINE = "2 * 6371.0088 * atan2(sqrt({a}), sqrt(1 - {a}))"
_A = "(pow(sin(radians({la2} - {la1}) / 2), 2) + cos(radians({la1})) * cos(radians({la2})) * pow(sin(radians({lo2} - {lo1}) / 2), 2))"


def _km(la1, lo1, la2, lo2) -> str:
    return _HAVERSINE.format(a=_A.format(la1=la1, lo1=lo1, la2=la2, lo2=lo2))


_PAIRS = f"""with {POINTS_SQL}, lagged as (select *, lag(id) over w prev_id, lag(ts) over w prev_ts, lag(lat) over w prev_lat, lag(lon) over w prev_lon from points window w as (partition by subject order by ts, id)),
pairs as (select *, (epoch_us(ts) - epoch_us(prev_ts)) / 1e6 / 3600 as hours, {_km("prev_lat", "prev_lon", "lat", "lon")} km from lagged where prev_id is not null)"""


@query(
    _PAIRS
    + """, flagged as (select *, case when hours <= 0 then 'time_geo_conflict' when km / hours >= 900 and km >= 50 then 'impossible_travel' when km / hours >= 220 and km >= 40 and hours <= 6 then 'rapid_travel' end flag from pairs where km >= 25)
select id, prev_id, subject, flag, case flag when 'time_geo_conflict' then 20 when 'impossible_travel' then 22 else 12 end delta,
  case flag when 'time_geo_conflict' then 6 when 'impossible_travel' then 7 else 4 end peer_delta, round(km, 3) km, round(hours, 4) as hours from flagged where flag is not null"""
)
def impossible_travel(spark, sf_dir):
    out = travel.impossible_travel(points(spark, sf_dir), "subject")
    return out.select("id", "prev_id", "subject", "flag", "delta", "peer_delta", F.round("km", 3).alias("km"), F.round("hours", 4).alias("hours"))


@query(
    _PAIRS
    + """, ranked as (select *, row_number() over (partition by subject order by ts, id) nth from pairs where hours <= 0 or km / hours >= 220)
select subject, id, prev_id, nth, round(km, 3) km from ranked where nth <= 20"""
)
def contradictions(spark, sf_dir):
    return travel.contradictions(points(spark, sf_dir), "subject").select("subject", "id", "prev_id", F.col("nth").cast("long").alias("nth"), F.round("km", 3).alias("km"))


@query(
    f"""with {POINTS_SQL}, centre as (select subject, count(*) points, median(lat) c_lat, median(lon) c_lon from points group by subject having count(*) >= 3),
far as (select p.*, {_km("c_lat", "c_lon", "lat", "lon")} km from points p join centre using (subject)),
middle as (select subject, median(km) m from far group by subject)
select id, subject, round(km, 3) km, round(greatest(35, 3.5 * m + 15), 3) limit_km from far join middle using (subject) where km > greatest(35, 3.5 * m + 15) and km >= 45"""
)
def geo_outliers(spark, sf_dir):
    out = travel.geo_outliers(points(spark, sf_dir), "subject")
    return out.select("id", "subject", F.round("km", 3).alias("km"), F.round("limit_km", 3).alias("limit_km"))


@query(
    f"""with {POINTS_SQL}, lagged as (select *, lag(id) over w prev_id, lag(lat) over w p_lat, lag(lon) over w p_lon from points window w as (partition by subject order by id)),
d as (select *, 2 * 6371.0 * asin(sqrt({_A.format(la1="p_lat", lo1="p_lon", la2="lat", lo2="lon")})) km from lagged where prev_id is not null)
select id, prev_id, subject, round(km, 3) km from d where km >= 400"""
)
def spatial_jumps(spark, sf_dir):
    return travel.spatial_jumps(points(spark, sf_dir), "subject", "id", 400).select("id", "prev_id", "subject", F.round("km", 3).alias("km"))


@query(
    f"""with {POINTS_SQL}, lagged as (select *, lag(id) over w prev_id, lag(ts) over w prev_ts from points window w as (partition by subject order by ts, id))
select id, prev_id, subject, round((epoch_us(ts) - epoch_us(prev_ts)) / 1e6 / 3600, 4) as hours from lagged where (epoch_us(ts) - epoch_us(prev_ts)) / 1e6 / 3600 >= 4"""
)
def timeline_gaps(spark, sf_dir):
    return travel.timeline_gaps(points(spark, sf_dir), "subject").select("id", "prev_id", "subject", F.round("hours", 4).alias("hours"))


@query(f"with {POINTS_SQL} select subject, count(*) points, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / 3600, 1) as hours from points group by subject")
def timeline_span(spark, sf_dir):
    return travel.timeline_span(points(spark, sf_dir), "subject").select("subject", "points", "hours")


_NEAR = f"""with {POINTS_SQL}, met as (select a.id source_id, b.id target_id, {_km("a.lat", "a.lon", "b.lat", "b.lon")} km from points a join points b on a.id < b.id and abs(a.lat - b.lat) < 0.03 and abs(a.lon - b.lon) < 0.04)"""


@query(_NEAR + " select source_id, target_id, case when km <= 0.25 then 74 else 52 end weight, round(km, 3) km from met where km <= 3")
def nearby_edges(spark, sf_dir):
    return relations.nearby_edges(points(spark, sf_dir)).withColumn("km", F.round("km", 3))


_DEVICES = f"""with {EVIDENCE_SQL}, ranked as (select case_id || '/' || device_model device, evidence_id, row_number() over (partition by case_id, device_model order by evidence_id) nth from evidence where device_model <> 'Unknown')"""


def _by_device(spark, sf_dir):
    e = evidence(spark, sf_dir).where("device_model <> 'Unknown'")
    return e.select(F.col("evidence_id").alias("id"), F.concat_ws("/", "case_id", "device_model").alias("device"))


@query(_DEVICES + " select a.device, a.evidence_id source_id, b.evidence_id target_id, 58 weight from ranked a join ranked b on a.device = b.device and a.evidence_id < b.evidence_id where a.nth <= 8 and b.nth <= 8")
def same_device_edges(spark, sf_dir):
    return relations.device_edges(_by_device(spark, sf_dir), "device")


#: Patterns without looks behind or ahead, which the other engine lacks: what stands around a hit is a group of its own.
_PLAIN = {
    "unix_path": (r"(^|[^0-9A-Za-z_])(/(?:Users|home|mnt|var|tmp|private|Volumes)/[^\s\n\r\t]+)()", 2),
    "username": (r"(^|[^0-9A-Za-z_.])(@[A-Za-z0-9_.-]{2,}\b)()", 2),
    "coordinates": (r"(^|[^0-9A-Za-z_.])(-?\d{1,3}\.\d{4,}\s*,\s*-?\d{1,3}\.\d{4,})($|[^0-9A-Za-z_.])", 2),
    "phone": (r"(^|[^0-9A-Za-z_])((?:\+?\d{1,3}[\s.-]?)?(?:\(?\d{2,4}\)?[\s.-]?)?\d{3,4}[\s.-]?\d{4})($|[^0-9A-Za-z_])", 2),
}


def _sql_redact(column: str) -> str:
    out = column
    for kind, (pattern, mark) in text.SENSITIVE.items():
        pattern, mark = (_PLAIN[kind][0], f"\\1{mark}\\3") if kind in _PLAIN else (pattern, mark)
        quoted = pattern.replace("'", "''")
        out = f"regexp_replace({out}, '{quoted}', '{mark}', 'g')"
        if kind in _PLAIN:  # a sign between two hits is taken by the first
            out = f"regexp_replace({out}, '{quoted}', '{mark}', 'g')"
    return out


@query(f"select doc_id, sha256({_sql_redact('text')}) redacted_sha256, {_sql_redact('text')} <> text changed from documents")
def redact_text(spark, sf_dir):
    redacted = F.when(F.col("text").isNotNull(), text.redact(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(redacted, 256).alias("redacted_sha256"), (redacted != F.col("text")).alias("changed"))


def _sql_hits(kind: str) -> str:
    pattern, group = _PLAIN.get(kind, (text.SENSITIVE[kind][0], 0))
    return f"len(regexp_extract_all(text, '{pattern.replace(chr(39), chr(39) * 2)}', {group}))"


@query("select * from (" + " union all ".join(f"select doc_id, '{k}' kind, {_sql_hits(k)} hits from documents" for k in text.SENSITIVE) + ") where hits > 0")
def pii_hits(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.sensitive_hits(F.col("text"))).alias("h"))
    return docs.select("doc_id", "h.kind", F.col("h.hits").cast("long").alias("hits"))


_FOUND = " union all ".join(
    f"select doc_id, '{kind}' entity_type, '{sensitivity}' sensitivity, {confidence} confidence, unnest(regexp_extract_all(text, '{(pattern if kind != 'username' else r'(?:^|[^0-9A-Za-z_.])(@[A-Za-z0-9_.]{3,32})' + chr(92) + 'b').replace(chr(39), chr(39) * 2)}', {1 if kind == 'username' else 0})) v from documents"
    for kind, pattern, confidence, sensitivity in text.ENTITIES
)
_ENTITIES = f"with e as ({_FOUND}), c as (select distinct doc_id, entity_type, sensitivity, confidence, lower(trim(regexp_replace(v, '\\s+', ' ', 'g'), ' ,.;:|()[]{{}}')) low from e)"


@query(_ENTITIES + " select doc_id, entity_type, low, confidence from c where low <> ''")
def entities_long(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.entities(F.col("text"))).alias("e"))
    return docs.select("doc_id", "e.entity_type", F.lower("e.value").alias("low"), "e.confidence")


@query(_ENTITIES + " select entity_type, sensitivity, count(*) entities, count(distinct doc_id) records from c where low <> '' group by all")
def privacy_review(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.entities(F.col("text"))).alias("e"))
    return docs.groupBy("e.entity_type", "e.sensitivity").agg(F.count(F.lit(1)).alias("entities"), F.count_distinct("doc_id").alias("records"))


@query("select sha256(text) sha256, count(*) members, min(doc_id) first_id, max(doc_id) last_id from documents group by text having count(*) > 1")
def exact_duplicates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha256"))
    return relations.exact_duplicates(docs)


#: Sign bits of the vectors, and copies of every third with some bits turned over.
_BITS = """with own as (select vec_id id, list_reduce([case when embedding[i] > 0 then (1::hugeint << (i - 1)) else 0::hugeint end for i in range(1, 65)], lambda a, b: a + b) h from embeddings),
bits as (select * from own union all select 1000000 + id, xor(h, ((1::hugeint << (id % 9)::int) - 1) << (id % 50)::int) from own where id % 3 = 0),
pairs as (select a.id left_id, b.id right_id, cast(bit_count(xor(a.h, b.h)) as int) distance from bits a join bits b on a.id < b.id)"""


def _sign_hashes(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), vectors.sign_bits(F.col("embedding")).alias("hash"))
    turned = F.call_function("shiftleft", F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("id") % 9).cast("int")) - 1, (F.col("id") % 50).cast("int"))
    return own.unionByName(own.where("id % 3 = 0").select((F.col("id") + 1000000).alias("id"), F.col("hash").bitwiseXOR(turned).alias("hash")))


@query(_BITS + " select * from pairs where distance <= 6")
def hamming_pairs(spark, sf_dir):
    return relations.hamming_pairs(_sign_hashes(spark, sf_dir), 6)


@query(
    _BITS
    + """, near as (select left_id u, right_id v from pairs where distance <= 6 union all select right_id, left_id from pairs where distance <= 6),
reach as (with recursive r(id, root) as (select u, u from near union select r.id, near.v from r join near on near.u = r.root) select * from r)
select id, min(root) cluster_id from reach group by id"""
)
def duplicate_clusters(spark, sf_dir):
    return relations.clusters(relations.near_hash_edges(_sign_hashes(spark, sf_dir), 6))


@query(
    """select sha256(text) grp, count(*) members, count(distinct source) source_values, count(distinct lang) lang_values from documents group by text
having count(*) > 1 and (count(distinct source) > 1 or count(distinct lang) > 1)"""
)
def duplicate_context_conflict(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("grp", F.sha2("text", 256))
    return relations.context_conflicts(docs, "grp", ["source", "lang"])


@query(
    f"""with {EVIDENCE_SQL}, d as (select *, evidence_id % 50 dup, case when evidence_id % 4 = 0 then device_model end place, case when evidence_id % 4 = 0 then ocr_confidence end conf from evidence),
donor as (select dup, arg_min(place, evidence_id) p, arg_min(conf, evidence_id) c from d where place is not null group by dup)
select evidence_id, coalesce(place, p) place, case when place is null and p is not null then greatest(least(c - 8, 70), 0) else conf end conf, place is null and p is not null inherited from d left join donor using (dup)"""
)
def propagate_context(spark, sf_dir):
    given = F.col("evidence_id") % 4 == 0
    e = evidence(spark, sf_dir).select("evidence_id", (F.col("evidence_id") % 50).alias("dup"), F.when(given, F.col("device_model")).alias("place"), F.when(given, F.col("ocr_confidence")).alias("conf"))
    return relations.propagate(e, "dup", "evidence_id", "place", "conf").select("evidence_id", "place", "conf", "inherited")


def _log(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.col("turn").cast("string").alias("time"), F.lit(None).cast("string").alias("evidence"), custody.action_code(F.col("role")).alias("action"), F.col("text").alias("details"))


@query(
    """with recursive log as (select conv_id, turn, row_number() over (partition by conv_id order by turn) n, concat_ws('|', conv_id, turn, 'CASE', replace(upper(trim(role)), ' ', '_'), coalesce(text, '')) body from conversations),
chain as (select conv_id, turn, n, 'GENESIS' prev_hash, sha256(body || '|GENESIS') event_hash from log where n = 1
  union all select l.conv_id, l.turn, l.n, c.event_hash, sha256(l.body || '|' || c.event_hash) from chain c join log l on l.conv_id = c.conv_id and l.n = c.n + 1)
select conv_id, turn, prev_hash, event_hash from chain"""
)
def hash_chain(spark, sf_dir):
    return custody.build_chain(_log(spark, sf_dir), "conv_id", "turn").select("conv_id", "turn", "prev_hash", "event_hash")


@query("select conv_id, count(*) events, min(case when turn = 2 then turn end) first_break from conversations group by conv_id")
def hash_chain_verify(spark, sf_dir):
    """Every conversation's log, damaged at turn 2 where there is one."""
    chain = custody.build_chain(_log(spark, sf_dir), "conv_id", "turn")
    chain = chain.withColumn("details", F.when(F.col("turn") == 2, F.concat("details", F.lit("!"))).otherwise(F.col("details")))
    return custody.verify_chain(chain, "conv_id", "turn")


_COS = """with s as (select q.vec_id query_id, v.vec_id id, v.label, list_sum([cast(v.embedding[i] as double) * cast(q.embedding[i] as double) for i in range(1, len(q.embedding) + 1)])
  / (sqrt(list_sum([cast(x as double) * cast(x as double) for x in v.embedding])) * sqrt(list_sum([cast(x as double) * cast(x as double) for x in q.embedding]))) c from embeddings v, embeddings q where q.vec_id % 50 = 0)"""


def _cosines(spark, sf_dir, **wanted):
    """Every vector whose id is divisible by 50 as a query against all vectors."""
    e = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    return relations.cosine_search(e, e.where("id % 50 = 0"), **wanted)


@query(_COS + " select query_id, id, round(least(c, 1), 5) similarity from s where c > 0 qualify row_number() over (partition by query_id order by c desc, id) <= 8")
def cosine_topk(spark, sf_dir):
    """The eight vectors most like each query; the limit is the feature."""
    return relations.best_of_each(_cosines(spark, sf_dir, least=0.0, best=8)).withColumn("similarity", F.round("similarity", 5))


@query(
    _COS
    + """ select query_id, id, label, round((greatest(least(c, 1), -1) + 1) * 50, 2) score, case when (c + 1) * 50 >= 96 then 'near-identical' when (c + 1) * 50 >= 90 then 'very similar' else 'similar' end band
from s where round((greatest(least(c, 1), -1) + 1) * 50, 2) >= 60"""
)
def similarity_threshold(spark, sf_dir):
    raw = (F.col("c") + 1) * 50
    out = _cosines(spark, sf_dir, least=0.1998).withColumn("score", vectors.similarity_score(F.col("c"))).where("score >= 60")  # 59.995 is rounded to 60, a cosine of 0.1999
    return out.select("query_id", "id", "label", "score", F.when(raw >= 96, "near-identical").when(raw >= 90, "very similar").otherwise("similar").alias("band"))


@query(
    r"""select page_id, regexp_extract(url, '^([a-z]+)://', 1) scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) host, nullif(regexp_extract(url, '[?]([^#]*)', 1), '') query,
  list_aggregate(regexp_split_to_array(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '[.]'), 'last') tld from pages"""
)
def url_parts(spark, sf_dir):
    host = F.parse_url("url", F.lit("HOST"))
    return table(spark, sf_dir, "pages").select("page_id", F.parse_url("url", F.lit("PROTOCOL")).alias("scheme"), host.alias("host"), F.parse_url("url", F.lit("QUERY")).alias("query"), F.element_at(F.split(host, "[.]"), -1).alias("tld"))


def _sql_labels(column: str, patterns) -> str:
    return "list_filter([" + ", ".join(f"case when regexp_matches({column}, '{p.replace(chr(39), chr(39) * 2)}') then '{label}' end" for p, label in patterns) + "], lambda x: x is not null)"


@query(f"select page_id, array_to_string({_sql_labels('html', text.CODE_MARKERS)}, '; ') markers, array_to_string({_sql_labels('url', text.SUSPICIOUS_URLS)}, '; ') url_flags from pages")
def code_markers(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(text.labels_of(F.col("html"), text.CODE_MARKERS), "; ").alias("markers"), F.array_join(text.labels_of(F.col("url"), text.SUSPICIOUS_URLS), "; ").alias("url_flags"))


@query("select page_id, len(r) runs, coalesce(list_max([len(x) for x in r]), 0) longest from (select page_id, regexp_extract_all(html, '[ -~]{8,}') r from pages)")
def readable_runs(spark, sf_dir):
    runs = text.readable_runs(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(runs).cast("long").alias("runs"), F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)).cast("long").alias("longest"))


@query(
    f"""with {EVIDENCE_SQL} select case_id, count(*) total, count(gps_latitude) gps_enabled, count(*) filter (risk_level <> 'Low') anomalies, count(distinct case when device_model <> 'Unknown' then device_model end) devices,
  count(*) filter (integrity_status <> 'Pending Review') checked, count(*) filter (source_type like '%Screenshot%' or source_type like '%Messaging%') screenshots, cast(round_even(avg(suspicion_score), 0) as int) avg_score,
  count(*) filter (parser_status <> 'Valid' or signature_status = 'Mismatch') parser_issues, count(*) filter (bookmarked) bookmarked from evidence group by case_id"""
)
def case_stats(spark, sf_dir):
    return casework.case_stats(evidence(spark, sf_dir))


@query(f"with {EVIDENCE_SQL} select source_type, count(*) records, cast(round_even(avg(suspicion_score), 0) as int) avg_score from evidence group by source_type")
def source_histogram(spark, sf_dir):
    return evidence(spark, sf_dir).groupBy("source_type").agg(F.count(F.lit(1)).alias("records"), casework.percent(F.avg("suspicion_score")).alias("avg_score"))


@query(f"""with {EVIDENCE_SQL} select case_id, count(*) filter (risk_level = 'High') high, count(*) filter (risk_level = 'Medium') medium, count(*) filter (risk_level = 'Low') low from evidence group by case_id""")
def risk_histogram(spark, sf_dir):
    return casework.risk_histogram(evidence(spark, sf_dir))


@query(
    f"""with {EVIDENCE_SQL}, c as (select case_id, device_model, count(*) n, min(evidence_id) f from evidence where device_model <> 'Unknown' group by all)
select case_id, device_model, n from c qualify row_number() over (partition by case_id order by n desc, f) = 1"""
)
def dominant_value(spark, sf_dir):
    return casework.dominant(evidence(spark, sf_dir), "case_id", "device_model", "evidence_id")


_STRENGTH = """(case when integrity_status = 'Verified' then 24 else 0 end + case when parser_status = 'Valid' and signature_status <> 'Mismatch' then 14 else 0 end
  + case when timestamp_confidence >= 80 then 20 when timestamp_confidence > 0 then 8 else 0 end
  + case when gps_latitude is not null and gps_confidence >= 80 then 24 when gps_latitude is not null then 16 when derived_geo_confidence > 0 then 8 when map_confidence > 0 then 5 else 0 end + case when ocr_confidence >= 70 then 6 else 0 end)"""


@query(
    f"""with {EVIDENCE_SQL}, s as (select *, {_STRENGTH} score from evidence), t as (select *, score >= 78 and integrity_status = 'Verified' and (gps_latitude is not null or timestamp_confidence >= 80) proof,
  integrity_status <> 'Verified' or not (parser_status = 'Valid' and signature_status <> 'Mismatch') or timestamp_confidence < 80 or (gps_latitude is not null and gps_confidence < 80) or (gps_latitude is null and (derived_geo_confidence > 0 or map_confidence > 0)) limited from s)
select evidence_id, score, case when proof and not limited then 'PROOF' when proof or score >= 55 then 'STRONG_INDICATOR' when score >= 20 then 'LEAD' when score > 0 then 'WEAK_SIGNAL' else 'NO_SIGNAL' end label from t"""
)
def evidence_strength(spark, sf_dir):
    score, label = scoring.evidence_strength()
    return evidence(spark, sf_dir).select("evidence_id", score.alias("score"), label.alias("label"))


@query(
    """with l as (select * from orders where o_orderpriority like '1%'), r as (select * from orders where o_orderpriority like '2%')
select 'o_custkey' field, cast(o_custkey as varchar) "value" from (select o_custkey from l intersect select o_custkey from r)
union all select 'o_orderstatus', o_orderstatus from (select o_orderstatus from l intersect select o_orderstatus from r)"""
)
def compare_cases(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return relations.shared_values(o.where("o_orderpriority like '1%'"), o.where("o_orderpriority like '2%'"), ["o_custkey", "o_orderstatus"])


@query(
    f"""with {EVIDENCE_SQL}, w as (select *, suspicion_score + 10 * (case when bookmarked then 1 else 0 end) + 6 * (case when parser_status <> 'Valid' then 1 else 0 end) weight from evidence)
select evidence_id, case_id, weight, row_number() over (partition by case_id order by weight desc, suspicion_score desc, ocr_confidence desc, evidence_id desc) priority_rank from w"""
)
def priority_rank(spark, sf_dir):
    weight = casework.weight_of(F.col("suspicion_score"), F.col("bookmarked").cast("int"), F.lit(0), (F.col("parser_status") != "Valid").cast("int"))
    out = casework.priority_rank(evidence(spark, sf_dir).withColumn("weight", weight))
    return out.select("evidence_id", "case_id", "weight", F.col("priority_rank").cast("long").alias("priority_rank"))


_SEARCHED = ["evidence_id", "case_id", "source_type", "device_model", "parser_status"]


@query(f"""with {EVIDENCE_SQL} select evidence_id, row_number() over (order by ts desc nulls first, evidence_id desc) place from evidence where parser_status <> 'Valid' or signature_status = 'Mismatch' order by ts desc nulls first, evidence_id desc limit 100""")
def inventory_sort(spark, sf_dir):
    """The first hundred of an inventory in order; the limit is the feature."""
    top = casework.inventory(evidence(spark, sf_dir), "Parser Issues", "", "Time ↓", _SEARCHED).limit(100)
    return top.select("evidence_id", F.row_number().over(Window.orderBy(F.desc_nulls_first("ts"), F.desc("evidence_id"))).cast("long").alias("place"))


def _checks(spark, sf_dir):
    truth, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    both = truth.join(docs, "doc_id", "left")
    loud = F.col("text").rlike("!!|[|]|%%%|&&&")
    return both.select(F.col("doc_id").alias("name"), F.when(F.col("text").isNotNull(), loud == (F.col("quality") == 0)).alias("passed"))


_CHECKS = "with c as (select l.doc_id, case when d.text is not null then regexp_matches(d.text, '!!|[|]|%%%|&&&') = (l.quality = 0) end passed from labels l left join documents d using (doc_id))"


@query(_CHECKS + " select count(passed) checks, count(*) filter (passed) passed, count(*) filter (not passed) failed, count(*) filter (passed is null) skipped, round(100.0 * count(*) filter (passed) / count(passed), 2) pass_rate from c")
def validation_metrics(spark, sf_dir):
    return casework.validation(_checks(spark, sf_dir))


@query(_CHECKS + " select doc_id, passed, case when passed then 'hit' when not passed then 'miss' else 'skipped' end outcome from c")
def accuracy_report(spark, sf_dir):
    out = _checks(spark, sf_dir)
    return out.select(F.col("name").alias("doc_id"), "passed", F.when(F.col("passed"), "hit").when(~F.col("passed"), "miss").otherwise("skipped").alias("outcome"))


@query(
    """with n as (select doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' t from documents),
a as (select distinct n_name, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) al from nation)
select doc_id, n_name place from n join a on contains(t, ' ' || al || ' ')"""
)
def gazetteer_match(spark, sf_dir):
    """Documents that name a nation, by whole words."""
    aliases = table(spark, sf_dir, "nation").select(F.col("n_name").alias("place"), F.col("n_name").alias("alias"))
    return gazetteer.match(table(spark, sf_dir, "documents").select(F.col("doc_id"), "text"), aliases).select("doc_id", "place").distinct()




@query(
    """with l as (select p_partkey ord, p_name label, [x for x in regexp_split_to_array(lower(p_name), '[^a-z0-9]+') if len(x) >= 3] w from part),
k as (select *, array_to_string(w[1:3], ' ') "key" from l where len(w) > 0),
g as (select "key", count(*) members, arg_min(label, ord) first_label, arg_max(len(label), ord) n from k group by "key")
select "key", members, first_label, cast(least(92, 48 + 12 * members + least(20, n // 3)) as int) confidence from g order by members desc, "key" limit 8"""
)
def label_clusters(spark, sf_dir):
    return casework.label_clusters(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("label")))


@query("select o_orderkey, case when o_custkey % 3 = 0 then 'Z' else o_orderstatus end status from orders")
def upsert_evidence(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"))
    new = o.where("o_custkey % 3 = 0").withColumn("status", F.lit("Z"))
    return casework.upsert(o, new, ["o_orderkey"]).select("o_orderkey", "status")


@query("select o_orderkey from orders where o_custkey % 3 <> 0")
def rollback_import(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return casework.rollback(o, o.where("o_custkey % 3 = 0"), ["o_orderkey"]).select("o_orderkey")


@query("select c_custkey, (select count(*) from orders where o_custkey = c_custkey) records from customer")
def list_cases(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return casework.list_cases(table(spark, sf_dir, "customer"), orders, "c_custkey", "c_acctbal").select("c_custkey", "records")


@query(
    """with d as (select row_number() over () r, doc_id, text from documents where text <> ''), c as (select r, doc_id, unnest(string_split(text, '')) ch from d), n as (select r, doc_id, ch, count(*) k from c group by all), t as (select r, sum(k) total from n group by r)
select doc_id, round(-sum(k / total * log2(k / total)) + 0.0, 4) entropy from n join t using (r) group by r, doc_id"""
)
def char_entropy(spark, sf_dir):
    """Counted inside the row: sorted characters, and the lengths of their runs."""
    docs = table(spark, sf_dir, "documents").where("text <> ''")
    return docs.select("doc_id", F.round(text.entropy(F.split("text", "")), 4).alias("entropy"))



@query(
    f"""with {EVIDENCE_SQL}, b as (select evidence_id, timestamp_confidence c, case evidence_id % 4 when 0 then 'Native EXIF' when 1 then 'Filename Pattern' when 2 then 'Filesystem Modified' else 'Unavailable' end src from evidence),
s as (select *, cast(case evidence_id % 4 when 0 then greatest(c, least(95, c + 8)) when 1 then least(case when c = 0 then 58 else c end, 65) when 2 then least(greatest(c, 42), 70) else c end as int) score from b)
select evidence_id, score, case when score >= 85 then 'strong timeline anchor' when score >= 65 then 'usable timeline lead' when score >= 35 then 'weak timeline lead' else 'no reliable timeline anchor' end label from s"""
)
def timeline_confidence(spark, sf_dir):
    names = F.array(*(F.lit(x) for x in ("Native EXIF", "Filename Pattern", "Filesystem Modified", "Unavailable")))
    e = evidence(spark, sf_dir).withColumn("src", F.get(names, (F.col("evidence_id") % 4).cast("int")))
    score = timeparse.timeline_confidence(F.col("timestamp_confidence"), F.col("src"), F.lit(False), F.lit(False))
    return e.select("evidence_id", score.alias("score"), timeparse.timeline_label(score).alias("label"))


@query(
    f"""with {EVIDENCE_SQL} select evidence_id, case when gps_latitude is null then 0 else least(greatest(92 - case when source_type in ('Edited / Exported', 'Unknown') then 8 else 0 end - case when source_type in ('Messaging Export', 'Screenshot', 'Screenshot / Export') then 18 else 0 end, 20), 98) end confidence from evidence"""
)
def gps_confidence(spark, sf_dir):
    score = geo.gps_confidence(F.col("gps_latitude"), F.col("gps_longitude"), F.lit("Native EXIF"), F.lit(None).cast("double"), F.col("source_type"))
    return evidence(spark, sf_dir).select("evidence_id", score.alias("confidence"))


@query(
    f"""with {POINTS_SQL} select id, round(lat - 500 / 111320.0, 6) south, round(lon - 500 / (111320.0 * cos(radians(lat))), 6) west, round(lat + 500 / 111320.0, 6) north, round(lon + 500 / (111320.0 * cos(radians(lat))), 6) east, 8 resolution from points"""
)
def geo_cells(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("b", geo.box(F.col("lat"), F.col("lon"), F.lit(500)))
    return p.select("id", "b.south", "b.west", "b.north", "b.east", geo.cell_resolution(F.lit(500)).alias("resolution"))
