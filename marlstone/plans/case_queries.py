"""Registered queries of cases, duplicates, candidates, privacy and risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import assessment, candidates, case_tables, relations, rules
from ..sources.records import RECORDS_SQL, records
from ..sources.tables import table
from .queries import _BITS, _sign_hashes, query
from .record_queries import _COURT, _DERIVED, _EDITOR, _GPS, _HIDDEN, _SHOWN, _SOUND, _TIMED

# ------------------------------------------------------------------ duplicates

_FACTS = "select id, id % 9 = 0 hint, id % 5 dims, 1000 + id % 50 size, case id % 4 when 0 then 'Camera Photo' when 1 then 'Map Screenshot' when 2 then 'Unknown' else 'Graphic Asset' end source from bits"
_RELATED = f"""{_BITS}, f as ({_FACTS}), family as (select *, case when contains(lower(source), 'camera') then 'camera' when regexp_matches(lower(source), 'screenshot|export|messaging|chat|browser|desktop|mobile') then 'screen' when regexp_matches(lower(source), 'asset|graphic|malformed') then 'asset' else 'other' end fam from f),
met as (select left_id, right_id, distance d, a.hint or b.hint hint, a.dims = b.dims same, least(a.size, b.size) / greatest(a.size, b.size) ratio, a.fam lf, b.fam rf, (left_id + right_id) % 4 words from pairs join family a on a.id = left_id join family b on b.id = right_id where distance <= 10),
related as (select left_id, right_id, case when d <= 6 and (words >= 2 or (hint and (same or (lf = rf and d <= 2))) or (d <= 1 and ratio >= 0.95 and lf = rf and lf <> 'asset')) then 'Near duplicate' when words >= 2 or (hint and same) then 'Derivative / related' end relation, d
  from met where not (lf = 'camera' and rf = 'screen') and not (lf = 'screen' and rf = 'camera') and ((lf <> 'asset' and rf <> 'asset') or hint)),
scored as (select left_id, right_id, relation, cast(case relation when 'Near duplicate' then greatest(72, least(99, 100 - 7 * d)) else greatest(48, least(86, 90 - 4 * d)) end as int) score, d distance from related where relation is not null)"""


def _related(spark, sf_dir):
    bits = _sign_hashes(spark, sf_dir)
    k = F.col("id")
    facts = bits.select(k, (k % 9 == 0).alias("hint"), (k % 5).alias("dims"), (1000 + k % 50).alias("size"), relations.source_family(F.get(F.array(*(F.lit(x) for x in ("Camera Photo", "Map Screenshot", "Unknown", "Graphic Asset"))), (k % 4).cast("int"))).alias("fam"))
    left, right = (facts.select(*(F.col(c).alias(f"{side}_{c}") for c in facts.columns)) for side in ("left", "right"))
    met = relations.hamming_pairs(bits, 10).join(left, "left_id").join(right, "right_id")
    r = relations.relation(
        F.lit(False), F.col("distance"), (F.col("left_id") + F.col("right_id")) % 4, F.col("left_hint") | F.col("right_hint"), F.col("left_dims") == F.col("right_dims"),
        F.least("left_size", "right_size") / F.greatest("left_size", "right_size"), F.col("left_fam"), F.col("right_fam"),
    )
    return met.select("left_id", "right_id", r.alias("r")).where("r is not null").select("left_id", "right_id", "r.*")


@query(_RELATED + " select * from scored")
def duplicate_relations(spark, sf_dir):
    return _related(spark, sf_dir)


@query(
    _RELATED
    + """, sides as (select left_id id, right_id peer, relation, score, distance from scored union all select right_id, left_id, relation, score, distance from scored)
select id, peer, relation, score, distance, count(*) over (partition by id) peers from sides qualify row_number() over (partition by id order by score desc, distance, peer) = 1"""
)
def duplicate_peers(spark, sf_dir):
    return case_tables.best_peers(_related(spark, sf_dir))


# ------------------------------------------------------------------ cases and logs


@query("""select c_nationkey case_id, count(*) filter (c_custkey % 10 = 0) + 1 cases, count(*) filter (c_custkey = 20) active from customer where c_custkey % 10 = 0 group by c_nationkey""")
def case_table(spark, sf_dir):
    """Cases are inserted, renamed and one of them activated; counted by nation."""
    c = table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("case_id"), F.col("c_name").alias("case_name"), F.col("c_nationkey").alias("nation"))
    more = c.groupBy("nation").agg((F.max("case_id") + 1).alias("case_id")).select("case_id", F.lit("new").alias("case_name"), "nation")
    all_cases = case_tables.set_active(case_tables.rename(case_tables.insert_cases(c, more), 10, "renamed"), 20)
    return all_cases.groupBy(F.col("nation").alias("case_id")).agg(F.count(F.lit(1)).alias("cases"), F.count_if("is_active").alias("active"))


_LOG = "log as (select conv_id * 1000 + turn id, conv_id case_id, turn evidence, sha256(text || conv_id || turn) event_hash from conversations)"


def _log(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    event = F.sha2(F.concat("text", F.col("conv_id").cast("string"), F.col("turn").cast("string")), 256)
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("case_id"), F.col("turn").alias("evidence"), event.alias("event_hash"))


@query(f"with {_LOG} select id, event_hash from log where case_id = 1 and evidence = 1 union all select id, event_hash from log where case_id = 2")
def custody_log(spark, sf_dir):
    """The log of a record and that of a case."""
    log = _log(spark, sf_dir)
    return case_tables.log_of(log, "case_id", 1, "evidence", 1).unionByName(case_tables.log_of(log, "case_id", 2)).select("id", "event_hash")


@query(f"with {_LOG} select case_id, arg_max(event_hash, id) last_hash from log group by case_id")
def latest_hash(spark, sf_dir):
    return case_tables.latest_hash(_log(spark, sf_dir), "case_id")


@query(
    f"""with {RECORDS_SQL}, t as (select case_id, evidence_id, case when timestamp_source <> 'Unavailable' then ts end t from records)
select case_id, evidence_id, row_number() over (partition by case_id order by t is null, t, evidence_id) place, count(t) over (partition by case_id) dated, 'IMG-' || case when n < 1000 then lpad(n::varchar, 3, '0') else n::varchar end "number"
from (select *, row_number() over (partition by case_id order by evidence_id) n from t)"""
)
def timeline_order(spark, sf_dir):
    e = records(spark, sf_dir).select("case_id", "evidence_id", F.when(assessment.known_time(), F.col("ts")).alias("t"))
    out = case_tables.evidence_numbers(case_tables.timeline(e, "case_id", "t", "evidence_id"), "case_id", "evidence_id")
    return out.select("case_id", "evidence_id", F.col("place").cast("long").alias("place"), "dated", "number")


@query(
    f"""with {RECORDS_SQL}, v as (select case_id, evidence_id t, 0 k, 'duplicate' reason, duplicate_group v from records where duplicate_group <> '' union all select case_id, evidence_id, 1, 'device', device_model from records where device_model <> 'Unknown'
  union all select case_id, evidence_id, 2, 'day', cast(cast(ts as date) as varchar) from records),
s as (select case_id, first_value(t) over (partition by case_id, k, v order by t) source, t target, k, reason from v)
select case_id, source, target, arg_min(reason, k) reason from s where source <> target group by all"""
)
def relationships(spark, sf_dir):
    return case_tables.relationships(records(spark, sf_dir), "case_id", "evidence_id", F.to_date("ts").cast("string"))


@query(f"with {RECORDS_SQL}, n as (select case_id, source_type, count(*) n from records group by all) select case_id, source_type, n, row_number() over (partition by case_id order by n desc, source_type) nth from n qualify nth <= 2")
def top_sources(spark, sf_dir):
    return case_tables.top_values(records(spark, sf_dir), "case_id", "source_type").withColumn("nth", F.col("nth").cast("long"))


@query(
    """with e as (select min(o_totalprice) lo, max(o_totalprice) hi from orders), b as (select cast(least(floor((o_totalprice - lo) / ((hi - lo) / 8)), 7) as int) bin, count(*) n from orders, e group by 1)
select r.bin::int bin, round(lo + r.bin * ((hi - lo) / 8), 4) low, round(lo + (r.bin + 1) * ((hi - lo) / 8), 4) high, coalesce(n, 0) n from range(8) r(bin) cross join e left join b on b.bin = r.bin"""
)
def value_histogram(spark, sf_dir):
    out = case_tables.histogram(table(spark, sf_dir, "orders"), "o_totalprice")
    return out.select("bin", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "n")


@query(
    f"""with {RECORDS_SQL} select case_id, count(*) total, count(*) filter ({_GPS} and gps_confidence >= 80) gps, count(*) filter (parser_status = 'Valid') parser, count(*) filter ({_HIDDEN}) hidden, count(*) filter (integrity_status in ('Verified', 'Partial')) integrity,
  count(*) filter (map_labels > 0 or visible_urls > 0) entities, count(*) filter ({_DERIVED} or map_labels > 0) derived, count(*) filter (ai_flags > 0) flagged, array_to_string(list(evidence_id order by suspicion_score desc, evidence_id)[1:3], ', ') first_three from records group by case_id"""
)
def validation_summary(spark, sf_dir):
    e = records(spark, sf_dir)
    c = F.col
    holds = {"gps": assessment.native() & (c("gps_confidence") >= 80), "parser": c("parser_status") == "Valid", "hidden": assessment.hidden(), "integrity": c("integrity_status").isin("Verified", "Partial"), "entities": (c("map_labels") > 0) | (c("visible_urls") > 0), "derived": assessment.derived() | (c("map_labels") > 0), "flagged": c("ai_flags") > 0}
    counts = e.groupBy("case_id").agg(F.count(F.lit(1)).alias("total"), *(F.count_if(x).alias(n) for n, x in holds.items()))
    first = rules.first_rows(e, "case_id", [F.desc("suspicion_score"), F.col("evidence_id")], 3).groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "evidence_id"))), lambda x: x["evidence_id"].cast("string")), ", ").alias("first_three"))
    return counts.join(first, "case_id")


@query(
    f"""with {RECORDS_SQL}, i as (select case_id, 'raw_filename' issue, 'Low' severity from records union all select case_id, 'coordinates', 'High' from records where gps_latitude is not null or {_DERIVED}
  union all select case_id, 'ocr_text', 'High' from records where visible_text or visible_urls > 0 union all select case_id, 'entities', 'Medium' from records where map_labels > 0 or visible_urls > 0)
select case_id, issue, severity, count(*) records from i group by all"""
)
def privacy_audit(spark, sf_dir):
    rows = records(spark, sf_dir).select("case_id", F.explode(case_tables.privacy_issues()).alias("i"))
    return rows.groupBy("case_id", "i.issue", "i.severity").agg(F.count(F.lit(1)).alias("records"))


@query(
    f"""with {RECORDS_SQL}, r as (select *, {_COURT} court from records) select case_id, max(court) best_court, count(*) filter (risk_level <> 'Low') risks, count(*) filter ({_HIDDEN} or pixel_score >= 40) hidden, count(distinct case when duplicate_group <> '' then duplicate_group end) duplicate_groups,
  count(*) filter ({_GPS}) located, count(*) filter (route) routes, cast(round_even(100 * avg(cast(copy_verified as int)), 0) as int) verified from r group by case_id"""
)
def guardian_cards(spark, sf_dir):
    """Seven figures of each case."""
    return rules.guardian_cards(records(spark, sf_dir).withColumn("court", rules.courtroom_strength()))


@query(
    f"""with {RECORDS_SQL} select evidence_id, {_TIMED} reliable_time, case when {_GPS} then 'gps:' || printf('%.4f,%.4f', gps_latitude, gps_longitude) when {_SHOWN} then 'displayed' else '' end signature, {_HIDDEN} hidden, {_EDITOR} edited,
  case when contains(lower(source_type), 'camera') then 'camera' when regexp_matches(lower(source_type), 'screenshot|export|messaging') then 'screen' when regexp_matches(lower(source_type), 'asset|graphic|malformed') then 'asset' else 'other' end family, {_SOUND} sound from records"""
)
def record_predicates(spark, sf_dir):
    signature = F.when(assessment.native(), F.concat(F.lit("gps:"), F.format_string("%.4f,%.4f", "gps_latitude", "gps_longitude"))).when(assessment.displayed_place(), "displayed").otherwise("")
    return records(spark, sf_dir).select(
        "evidence_id", assessment.reliable_time().alias("reliable_time"), signature.alias("signature"), assessment.hidden().alias("hidden"), assessment.edited().alias("edited"), relations.source_family(F.col("source_type")).alias("family"), assessment.sound().alias("sound")
    )


_RISK = """select evidence_id, hidden_codes % 2 = 1 or hidden_embeds = 1 dangerous, evidence_id % 6 = 0 visible_code, hidden_codes codes, hidden_embeds embeds, cast(evidence_id % 19 = 0 as int) payloads, lsb_strings lsb, evidence_id % 4 = 3 marked_lsb, quality_flag = 'Alpha residue' alpha, pixel_score, cast(evidence_id % 5 as int) entropy_channels, evidence_id % 2 = 0 jpeg from records"""


@query(
    f"""with {RECORDS_SQL}, r as ({_RISK}), s as (select *, (case when dangerous and codes > 0 then 42 when dangerous then 26 else 0 end + case when embeds > 0 or payloads > 0 then 30 else 0 end + case when lsb > 0 then 34 + case when marked_lsb then 18 else 0 end else 0 end + case when alpha then 16 else 0 end
  + case when pixel_score >= 40 and lsb = 0 then 14 else 0 end + case when entropy_channels >= 2 then 8 else 0 end) a, (35 + case when dangerous and codes > 0 then 22 when dangerous then 12 else 0 end + case when embeds > 0 or payloads > 0 then 18 else 0 end + case when lsb > 0 then 18 + case when marked_lsb then 8 else 0 end else 0 end
  + case when alpha then 10 else 0 end + case when pixel_score >= 40 and lsb = 0 then 6 else 0 end + case when entropy_channels >= 2 then 4 else 0 end) b, visible_code and not dangerous and codes = 0 and embeds = 0 and payloads = 0 and lsb = 0 only_seen from r),
t as (select evidence_id, least(100, case when only_seen then least(a, 24) else a end) risk, case when only_seen then greatest(b, 55) else b end - case when jpeg and pixel_score >= 40 and lsb = 0 then 6 else 0 end sure, jpeg and pixel_score >= 40 and lsb = 0 less from s),
u as (select evidence_id, risk, least(100, case when less then greatest(20, sure) else sure end) confidence from t)
select evidence_id, cast(risk as int) risk, cast(confidence as int) confidence, case when risk >= 72 and confidence >= 62 then 'ISOLATE' when risk >= 45 then 'REVIEW' when risk >= 18 then 'WATCH' else 'CLEAR' end verdict from u"""
)
def digital_risk(spark, sf_dir):
    from_records = _RISK.removesuffix(" from records").removeprefix("select ")
    rows = records(spark, sf_dir).selectExpr(*_split(from_records))
    risk, confidence, verdict = scoring.digital_risk()
    return rows.select("evidence_id", risk.alias("risk"), confidence.alias("confidence"), verdict.alias("verdict"))


def _split(columns: str) -> list[str]:
    """Expressions of a select list, at commas outside parentheses."""
    out, depth = [""], 0
    for ch in columns:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return [x.strip() for x in out]


# ------------------------------------------------------------------ candidates

_CANDIDATES = f"""cand as (select evidence_id, round(gps_latitude, 4) || ', ' || round(gps_longitude, 4) "name", 'coordinates' "level", greatest(85, gps_confidence) confidence, 'proof' strength from records where {_GPS}
  union all select evidence_id, round(derived_latitude, 4) || ', ' || round(derived_longitude, 4), 'coordinates', least(92, greatest(70, case when derived_geo_confidence > 0 then derived_geo_confidence else 80 end)), 'lead' from records where {_DERIVED}
  union all select evidence_id, 'map address', 'poi', greatest(72, map_intelligence), 'lead' from records where map_url
  union all select evidence_id, 'place label', 'place', map_intelligence, case when map_intelligence >= 55 then 'lead' else 'weak_signal' end from records where place_candidates > 0
  union all select evidence_id, 'visual context', 'visual_context', least(38, greatest(28, image_confidence)), 'weak_signal' from records where image_confidence > 0
  union all select evidence_id, 'file name', 'filename_hint', 35, 'weak_signal' from records where basis = 'filename'
  union all select evidence_id, 'region', 'country', scene_confidence, case when scene_confidence >= 55 then 'lead' else 'weak_signal' end from records where scene_confidence >= 30),
merged as (select evidence_id, "level", arg_max("name", confidence) "name", max(confidence) confidence, arg_max(strength, row(confidence, case strength when 'proof' then 0 when 'lead' then -1 else -2 end)) strength from cand group by evidence_id, "level", lower("name"))"""


def _candidates(spark, sf_dir):
    rows = records(spark, sf_dir).select("evidence_id", F.explode(candidates.geo_candidates()).alias("c")).select("evidence_id", "c.*")
    return candidates.merge_candidates(rows, "evidence_id")


@query(
    f"""with {RECORDS_SQL}, {_CANDIDATES} select evidence_id, "level", confidence, strength, row_number() over (partition by evidence_id order by case strength when 'proof' then 0 when 'lead' then 1 when 'weak_signal' then 2 else 3 end,
  case "level" when 'coordinates' then 0 when 'poi' then 1 when 'area' then 2 when 'city' then 3 when 'country' then 4 when 'place' then 5 when 'visual_context' then 8 else 9 end * 100 - confidence, lower("name")) place from merged"""
)
def geo_candidates(spark, sf_dir):
    return candidates.rank_candidates(_candidates(spark, sf_dir), "evidence_id").select("evidence_id", "level", "confidence", "strength", F.col("place").cast("long").alias("place"))


_SOLVED = f"""with {RECORDS_SQL}, {_CANDIDATES}, a as (select evidence_id, max(confidence) best, bool_or(strength = 'proof') proof, bool_or("level" = 'coordinates' and strength = 'lead') co, bool_or("level" in ('poi', 'area') and confidence >= 65) poi, bool_and("level" = 'filename_hint') named,
  bool_or("level" not in ('visual_context', 'filename_hint') and strength in ('proof', 'lead') and confidence >= 45) stable, bool_or("level" = 'visual_context') visual, bool_and("level" in ('visual_context', 'filename_hint')) ctx, count(distinct "level") filter ("level" <> 'filename_hint') families from merged group by evidence_id),
b as (select *, greatest(best, case when proof then 92 else 0 end, case when co then 82 else 0 end, case when poi then 68 else 0 end) s from a), c as (select *, case when named then least(s, 35) else s end s2 from b),
solved as (select *, case when not stable and (ctx or visual) then least(s2, 38) else s2 end score from c)"""


@query(_SOLVED + " select evidence_id, cast(score as int) score, case when not stable and ctx then 'context only' when score >= 90 then 'exact' when score >= 75 then 'strong' when score >= 55 then 'likely' when score >= 30 then 'regional' else 'none' end label from solved")
def solvability(spark, sf_dir):
    return candidates.solvability(_candidates(spark, sf_dir), "evidence_id")


@query(
    _SOLVED
    + f""", r as (select r.evidence_id, coalesce(score, 0) solved, coalesce(best, 0) best, coalesce(families, 0) families, coalesce(ctx, false) ctx, {_GPS} located, {_DERIVED} or map_url mapped, map_intelligence ready, pixel_score from records r left join solved using (evidence_id)),
m as (select *, greatest(solved, best, ready, case when located then 90 when mapped then 78 else 0 end) a from r), n as (select *, case when families >= 2 and best >= 50 then least(100, a + 8) else a end b from m), o as (select *, case when pixel_score >= 70 then least(100, b + 5) else b end c from n)
select evidence_id, cast(case when ctx then least(c, 38) else c end as int) score from o"""
)
def methodology_readiness(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    facts = c.groupBy("evidence_id").agg(F.max("confidence").alias("best"), F.count_distinct(F.when(F.col("level") != "filename_hint", F.col("level"))).alias("families"), F.bool_and(F.col("level").isin("visual_context", "filename_hint")).alias("ctx"))
    e = records(spark, sf_dir).join(candidates.solvability(c, "evidence_id").withColumnRenamed("score", "solved"), "evidence_id", "left").join(facts, "evidence_id", "left")
    e = e.fillna(0, ["solved", "best", "families"]).withColumn("ctx", F.coalesce("ctx", F.lit(False)))
    score = candidates.methodology_score(F.col("solved"), F.col("map_intelligence"), assessment.native(), assessment.derived() | F.col("map_url"), F.col("best"), F.col("families"), F.col("pixel_score"), F.col("ctx"))
    return e.select("evidence_id", score.cast("int").alias("score"))


_MAPPED = "case when map_intelligence > 0 then map_intelligence else map_confidence end"
_HYPOTHESES = f"""hyp as (select evidence_id, 'native gps' title, case when gps_confidence >= 80 then 'proof' else 'lead' end strength, gps_confidence confidence from records where {_GPS} union all select evidence_id, 'derived coordinate', 'lead', derived_geo_confidence from records where {_DERIVED}
  union all select evidence_id, 'map address', 'lead', 82 from records where map_url union all select evidence_id, 'visible place', case when {_MAPPED} >= 65 then 'lead' else 'weak_signal' end, {_MAPPED} from records where place_candidates > 0
  union all select evidence_id, 'map context', 'weak_signal', least(88, greatest(35, {_MAPPED})) from records where place_candidates = 0 and basis <> '' and {_MAPPED} >= 50
  union all select evidence_id, 'file name', 'weak_signal', 35 from records where basis = 'filename' and place_candidates = 0 and not map_url and not {_GPS}
  union all select evidence_id, 'ranked places', case when {_MAPPED} >= 65 then 'lead' else 'weak_signal' end, least(92, greatest(35, {_MAPPED})) from records where place_candidates > 1)"""


@query(
    f"""with {RECORDS_SQL}, {_HYPOTHESES}, m as (select evidence_id, list_filter([case when not {_GPS} then 'native-gps' end, case when visible_urls = 0 then 'source-url' end, case when not visible_text then 'stable-label' end, case when not (copy_verified or integrity_status = 'Verified') then 'verified-copy' end], lambda x: x is not null) lacks from records)
select evidence_id, title, strength, confidence, array_to_string(lacks, '; ') missing, case when strength = 'proof' and len(lacks) = 0 then 'corroborated' when strength = 'lead' and len(lacks) <= 2 then 'strong_lead' else 'needs_corroboration' end status,
  case when evidence_id % 10 = 0 and title = 'native gps' then 'rejected' when strength = 'proof' and confidence >= 80 then 'auto_generated' else 'needs_review' end decision from hyp join m using (evidence_id)"""
)
def location_hypotheses(spark, sf_dir):
    """Hypotheses with what each still lacks and the decision on it."""
    e = records(spark, sf_dir).select("evidence_id", F.explode(candidates.hypotheses()).alias("h"), candidates.missing_bases().alias("lacks")).select("evidence_id", "h.*", "lacks")
    given = records(spark, sf_dir).where("evidence_id % 10 = 0").select("evidence_id", F.lit("native gps").alias("title"), F.lit("rejected").alias("decision"), F.lit(1).alias("at"))
    out = candidates.attach_decisions(e, given.unionByName(given.withColumns({"decision": F.lit("verified"), "at": F.lit(0)})), ["evidence_id", "title"])
    return out.select("evidence_id", "title", "strength", "confidence", F.array_join("lacks", "; ").alias("missing"), candidates.corroboration_status(F.col("strength"), F.col("lacks")).alias("status"), "decision")


@query("""select c_custkey, n_name place, round(n_nationkey * 3.5::double - 40, 4) lat, round(n_nationkey * 7.25::double - 90, 4) lon from customer join nation on c_nationkey = n_nationkey""")
def place_centroids(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    centroids = nation.select(F.col("n_name").alias("name"), F.round(F.col("n_nationkey") * 3.5 - 40, 4).alias("lat"), F.round(F.col("n_nationkey") * 7.25 - 90, 4).alias("lon"))
    c = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat(F.lower("n_name"), F.lit(" ")).alias("given"), F.col("n_name").alias("place"))
    return candidates.place_centroids(c, centroids, "given").select("c_custkey", "place", "lat", "lon")
