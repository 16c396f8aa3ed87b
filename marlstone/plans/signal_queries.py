"""Registered queries of scenes, sources, files, pixels, markers in texts, packages and searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import assessment, casework, custody, gazetteer, pixels, relations, travel
from ..sources import files
from ..sources.records import RECORDS_SQL, records
from ..sources.tables import table
from .place_queries import _PLACES, _places
from .queries import _sql_labels, query
from .record_queries import _DERIVED, _GPS, _HIDDEN


@query()
def scene_groups(spark, sf_dir):
    """Scenes are first-fit, a scan in time; tests hold them against the plain rule."""
    e = records(spark, sf_dir).select("case_id", F.col("evidence_id").alias("id"), F.when(assessment.known_time(), F.col("ts")).alias("ts"), F.col("source_type").alias("source"), "app", "duplicate_group")
    return travel.scene_groups(e, "case_id")


_CHAT = "app in ('WhatsApp', 'Telegram', 'Signal', 'Discord', 'Facebook', 'Instagram', 'X / Twitter')"
_MAPPED = f"(app = 'Google Maps' or map_labels > 0 or place_candidates > 0 or {_GPS} or {_DERIVED} or map_intelligence >= 50)"


@query(
    f"""with {RECORDS_SQL} select evidence_id, case when {_MAPPED} then case when route then 'route map' else 'map' end when {_CHAT} then 'messaging' when visible_urls > 0 then 'browser' when source_type = 'Camera Photo' then 'camera' else 'screen' end label,
  cast(case when {_MAPPED} then greatest(derived_geo_confidence, gps_confidence, map_intelligence, 58, case when app = 'Google Maps' then 84 else 0 end, case when {_DERIVED} then 78 else 0 end) when {_CHAT} then 82 when visible_urls > 0 then 74
  when source_type = 'Camera Photo' then case when device_model <> 'Unknown' then 80 else 68 end else 54 end as int) confidence from records"""
)
def scene_labels(spark, sf_dir):
    label, confidence = assessment.scene()
    return records(spark, sf_dir).select("evidence_id", label.alias("label"), confidence.cast("int").alias("confidence"))


@query(
    f"""with {RECORDS_SQL}, p as (select evidence_id, case when width = 0 or height = 0 then 'malformed' when app = 'Google Maps' or (map_labels > 0 and source_type in ('Screenshot', 'Screenshot / Export', 'Messaging Export')) then 'map screen' when {_CHAT} then 'chat screen' when source_type = 'Camera Photo' then 'camera original'
  when source_type = 'Edited / Exported' then 'edited export' when source_type in ('Screenshot', 'Screenshot / Export') then case when width >= height then 'desktop capture' else 'mobile screen' end when source_type = 'Messaging Export' then 'chat export' when source_type = 'Graphic Asset' then 'graphic' else 'unknown' end kind, app, has_exif from records)
select evidence_id, kind, case kind when 'malformed' then 74 when 'map screen' then case when app = 'Google Maps' then 84 else 74 end when 'chat screen' then 80 when 'camera original' then case when has_exif then 86 else 62 end when 'edited export' then 76 when 'desktop capture' then 72 when 'mobile screen' then 72 when 'chat export' then 78 when 'graphic' then 70 else 48 end confidence from p"""
)
def source_profiles(spark, sf_dir):
    return records(spark, sf_dir).select("evidence_id", assessment.source_profile().alias("p")).select("evidence_id", "p.*")


_FILE = """case evidence_id % 9 when 0 then 'IMG_1.JPG' when 1 then 'Screenshot 2.png' when 2 then 'WhatsApp Image.jpeg' when 3 then 'a.gif' when 4 then 'x.heif' when 5 then 'my_export.webp' when 6 then 'b.tiff' when 7 then 'c.png' else 'noname' end"""
_FAMILY = """case evidence_id % 5 when 0 then 'JPEG' when 1 then 'PNG' when 2 then 'HEIC' when 3 then 'Unknown' else 'TIFF' end"""


@query(
    f"""with {RECORDS_SQL}, f as (select *, {_FILE} n, {_FAMILY} fam, lower(regexp_extract({_FILE}, '\\.([A-Za-z0-9]+)$', 1)) ext from records),
s as (select *, case when fam = 'Unknown' then 'Unknown' when (fam = 'JPEG' and ext in ('jpg', 'jpeg')) or (fam = 'PNG' and ext = 'png') or (fam = 'HEIC' and ext = 'heic') or (fam = 'TIFF' and ext in ('tif', 'tiff')) then 'Matched' when fam = 'HEIC' and ext = 'heif' then 'Compatible' else 'Mismatch' end st from f)
select evidence_id, st signature, case when st = 'Mismatch' then 'Conflict' when parser_status = 'Failed' then case when st in ('Matched', 'Compatible') then 'Header-only' else 'Weak' end when st in ('Matched', 'Compatible') then 'Verified' else 'Weak' end trust,
  case when parser_status = 'Failed' then 'Malformed / Unsupported Asset' when regexp_matches(lower(software), 'photoshop|lightroom|snapseed|canva|gimp') then 'Edited / Exported' when has_exif and ext in ('jpg', 'jpeg', 'tif', 'tiff', 'heic', 'heif') and greatest(width, height) >= 1200 then 'Camera Photo'
  when contains(lower(n), 'screenshot') then 'Screenshot' when regexp_matches(lower(n), 'whatsapp image|telegram|export') then 'Messaging Export' when ext in ('png', 'webp') and not has_exif then 'Screenshot / Export' when ext in ('gif', 'bmp') then 'Graphic Asset' else 'Unknown' end kind from s"""
)
def file_types(spark, sf_dir):
    e = records(spark, sf_dir).withColumns({"n": F.expr(_FILE), "fam": F.expr(_FAMILY)})
    status = files.signature_status(F.col("n"), F.col("fam"))
    kind = files.source_type(F.col("n"), F.col("has_exif"), F.col("software"), F.col("width"), F.col("height"), F.col("parser_status"))
    return e.select("evidence_id", status.alias("signature"), files.format_trust(status, F.col("parser_status")).alias("trust"), kind.alias("kind"))


@query(
    f"""with {RECORDS_SQL}, z as (select evidence_id, route, unnest(['search bar', 'pin bubble', 'route card', 'labels', 'corners']) zone, unnest([92, 90, 86, 78, 72]) priority from records where map_intelligence > 0 or route)
select evidence_id, zone, priority from z union all select evidence_id, 'waypoints', 95 from records where route"""
)
def map_zones(spark, sf_dir):
    return records(spark, sf_dir).select("evidence_id", F.explode(assessment.map_zones()).alias("z")).select("evidence_id", "z.*")


_AT = f"case when {_GPS} then gps_latitude when {_DERIVED} then derived_latitude end"
_ON = f"case when {_GPS} then gps_longitude when {_DERIVED} then derived_longitude end"


@query(
    f"""with {RECORDS_SQL}, a as (select evidence_id, case when {_GPS} then 'native' else 'derived' end kind, {_AT} la, {_ON} lo from records where {_GPS} or {_DERIVED})
select evidence_id, kind, 'Google Maps' provider, 'https://www.google.com/maps/search/?api=1&query=' || printf('%.6f,%.6f', la, lo) url from a union all select evidence_id, kind, 'Apple Maps', 'https://maps.apple.com/?ll=' || printf('%.6f,%.6f', la, lo) from a
union all select evidence_id, kind, 'OpenStreetMap', printf('https://www.openstreetmap.org/?mlat=%.6f&mlon=%.6f#map=16/%.6f/%.6f', la, lo, la, lo) from a"""
)
def provider_links(spark, sf_dir):
    a = records(spark, sf_dir).select("evidence_id", assessment.best_anchor().alias("a")).where("a is not null")
    return a.select("evidence_id", "a.kind", F.explode(assessment.provider_links(F.col("a.lat"), F.col("a.lon"))).alias("l")).select("evidence_id", "kind", "l.*")


_KIND = "case evidence_id % 4 when 0 then 'city' when 1 then 'area' when 2 then 'landmark' else 'candidate' end"


@query(
    f"""with {RECORDS_SQL} select evidence_id, cast(least(100, case {_KIND} when 'city' then 52 when 'area' then 58 when 'landmark' then 66 else 44 end + case when visible_text then 10 else 0 end + case when map_url then 16 else 0 end + case when basis = 'visual-map-colors' then 7 else 0 end
  + case when {_GPS} then 10 else 0 end + least(10, ocr_confidence // 10)) as int) score from records"""
)
def place_scores(spark, sf_dir):
    score = assessment.place_score(F.expr(_KIND), F.col("visible_text"), F.col("map_url"), F.col("basis") == "visual-map-colors", assessment.native(), F.col("ocr_confidence"))
    return records(spark, sf_dir).select("evidence_id", score.alias("score"))


_TRUTH = {"native_gps": "case evidence_id % 3 when 0 then 'true' when 1 then 'false' end", "hidden_payload": "case when evidence_id % 4 = 0 then 'true' end", "metadata_stripped": "case when evidence_id % 5 < 2 then 'false' end", "source_type_contains": "case when evidence_id % 6 = 0 then 'shot' end", "ocr_confidence_min": "case evidence_id % 7 when 0 then '50' when 1 then 'x' end", "map_route_detected": "case when evidence_id % 8 = 0 then 'maybe' when evidence_id % 8 = 1 then 'true' end"}


@query(
    f"""with {RECORDS_SQL}, t as (select *, {", ".join(f"{e} t_{k}" for k, e in _TRUTH.items())} from records)
select evidence_id, 'native_gps' "key", {_GPS} = (t_native_gps = 'true') passed from t where t_native_gps is not null union all select evidence_id, 'hidden_payload', {_HIDDEN} = (t_hidden_payload = 'true') from t where t_hidden_payload is not null
union all select evidence_id, 'metadata_stripped', (not has_exif) = (t_metadata_stripped = 'true') from t where t_metadata_stripped is not null union all select evidence_id, 'source_type_contains', contains(lower(source_type), 'shot') from t where t_source_type_contains is not null
union all select evidence_id, 'ocr_confidence_min', ocr_confidence >= 50 from t where t_ocr_confidence_min = '50' union all select evidence_id, 'map_route_detected', route from t where t_map_route_detected = 'true'"""
)
def truth_checks(spark, sf_dir):
    truth = F.map_from_arrays(F.array(*(F.lit(k) for k in _TRUTH)), F.array(*(F.expr(e) for e in _TRUTH.values())))
    e = records(spark, sf_dir).withColumn("truth", truth)
    return e.select("evidence_id", F.explode(assessment.truth_checks(F.col("truth"))).alias("c")).select("evidence_id", "c.*")


# ------------------------------------------------------------------ inventory

_TEXT = "lower(concat_ws(' ', evidence_id, case_id, source_type, device_model, parser_status))"
_SEARCHED = ["evidence_id", "case_id", "source_type", "device_model", "parser_status"]
_SQL_MODES = {
    "All": "true", "Has GPS": "gps_latitude is not null", "High Risk": "risk_level = 'High'", "Medium Risk": "risk_level = 'Medium'", "Low Risk": "risk_level = 'Low'", "Screenshots": "contains(source_type, 'Screenshot')", "Camera": "source_type = 'Camera Photo'",
    "Edited": "source_type = 'Edited / Exported'", "Duplicates": "duplicate_group <> ''", "Geo Anchors": "gps_latitude is not null or derived_latitude is not null", "Hidden Content": _HIDDEN, "Parser Issues": "parser_status <> 'Valid' or signature_status = 'Mismatch'", "Bookmarked": "bookmarked",
}
_SEARCHES = {
    "gps:yes risk:high": "gps_latitude is not null and risk_level = 'High'", "geo:no camera": f"gps_latitude is null and derived_latitude is null and contains({_TEXT}, 'camera')", "hidden:yes code:no": f"{_HIDDEN} and not hidden_codes > 0",
    "url:yes source:screenshot score:60": "visible_urls > 0 and contains(lower(source_type), 'screenshot') and suspicion_score >= 60", "parser:failed d1": f"lower(parser_status) = 'failed' and contains({_TEXT}, 'd1')", "": "true",
}


@query(f"with {RECORDS_SQL} " + " union all ".join(f"select '{m}' \"mode\", count(*) n, sum(evidence_id) ids from records where {w}" for m, w in _SQL_MODES.items()))
def inventory_modes(spark, sf_dir):
    """Size and sum of ids of what each mode of the inventory keeps."""
    e, out = records(spark, sf_dir), None
    for mode in casework.MODES:
        rows = casework.inventory(e, mode, "", "ID ↑", _SEARCHED).agg(F.lit(mode).alias("mode"), F.count(F.lit(1)).alias("n"), F.sum("evidence_id").alias("ids"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"with {RECORDS_SQL} " + " union all ".join(f"select '{s}' search, evidence_id from records where {w}" for s, w in _SEARCHES.items()))
def inventory_search(spark, sf_dir):
    e, out = records(spark, sf_dir), None
    for search in _SEARCHES:
        rows = e.where(casework.search(search, _SEARCHED)).select(F.lit(search).alias("search"), "evidence_id")
        out = rows if out is None else out.unionByName(rows)
    return out


# ------------------------------------------------------------------ texts

_FAMILIES = {"payload": text.PAYLOAD_MARKERS, "secret": text.VISIBLE_SECRETS, "privacy": text.VISIBLE_PRIVACY, "document": text.VISIBLE_DOCUMENTS}


@query("select doc_id, " + ", ".join(f"array_to_string({_sql_labels('text', patterns)}, '; ') {name}" for name, patterns in _FAMILIES.items()) + " from documents where text is not null")
def text_markers(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", *(F.array_join(text.labels_of(F.col("text"), p), "; ").alias(name) for name, p in _FAMILIES.items()))


@query(f"select page_id, array_to_string({_sql_labels('html', text.PAYLOAD_MARKERS)}, '; ') markers from pages where html is not null")
def payload_markers(spark, sf_dir):
    return table(spark, sf_dir, "pages").where("html is not null").select("page_id", F.array_join(text.labels_of(F.col("html"), text.PAYLOAD_MARKERS), "; ").alias("markers"))


@query(
    """with t as (select page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) || case when page_id % 3 = 0 then ' 30.12345, 31.54321' else '' end term from pages), q as (select page_id, case when page_id % 3 = 0 then ['30.12345, 31.54321', '"30.12345, 31.54321"']
  else list_concat(list_concat(flatten(list_transform(regexp_extract_all(term, '(?i)\\b(?:[a-z0-9-]+\\.)+[a-z]{2,}\\b')[1:2], lambda d: ['"' || d || '"', 'site:' || d])), ['"' || term || '" "Egypt"']), ['"' || term || '" address']) end q from t)
select page_id, unnest(q) search from q"""
)
def search_queries(spark, sf_dir):
    host = F.parse_url("url", F.lit("HOST"))
    term = F.when(F.col("page_id") % 3 == 0, F.concat(host, F.lit(" 30.12345, 31.54321"))).otherwise(host)
    return table(spark, sf_dir, "pages").select("page_id", F.explode(text.search_queries(term, F.lit("Egypt"))).alias("search"))


# ------------------------------------------------------------------ pixels

_BYTES = "list_transform(embedding, lambda x: cast(floor(abs(cast(x as double)) * 1000) as bigint) % 256)"


@query(
    f"""with b as (select vec_id, {_BYTES} b from embeddings), p as (select vec_id, list_transform(range(16), lambda i: b[4 * i + 1]) r, list_transform(range(16), lambda i: b[4 * i + 2]) g, list_transform(range(16), lambda i: b[4 * i + 3]) bl, list_transform(range(16), lambda i: b[4 * i + 4]) a from b),
w as (select *, list_transform(range(4), lambda y: list_sum(list_transform(range(4), lambda x: r[4 * y + x + 1] % 2)) / 4) share from p), m as (select *, list_sum(share) / 4 mean from w)
select vec_id, round(list_sum(list_transform(r, lambda x: x % 2)) / 16, 6) ones_r, round(list_sum(list_transform(g, lambda x: x % 2)) / 16, 6) ones_g, round(list_sum(list_transform(bl, lambda x: x % 2)) / 16, 6) ones_b,
  round(list_sum(list_transform(share, lambda x: (x - mean) * (x - mean))) / 4, 6) row_variance, cast(len(list_filter(share, lambda x: abs(x - mean) >= 0.18)) as int) spike_rows, round(len(list_filter(a, lambda x: x <= 5)) / 16, 6) transparent, round(len(list_filter(a, lambda x: x < 255)) / 16, 6) translucent from m"""
)
def pixel_statistics(spark, sf_dir):
    """Vectors as images of four by four pixels."""
    byte = F.transform("embedding", lambda x: (F.floor(F.abs(x.cast("double")) * 1000) % 256).cast("int"))
    raw = F.unhex(F.array_join(F.transform(byte, lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    images = table(spark, sf_dir, "embeddings").select("vec_id", raw.alias("rgba"), F.lit(4).alias("width"))
    out = pixels.profile(images)
    return out.select("vec_id", *(F.round(c, 6).alias(c) for c in ("ones_r", "ones_g", "ones_b", "row_variance")), "spike_rows", *(F.round(c, 6).alias(c) for c in ("transparent", "translucent")))


# ------------------------------------------------------------------ packages and places


@query("""with e as (select case when doc_id % 2 = 0 then 'artifacts' else 'report_assets' end s, 'd' || lpad(doc_id::varchar, 9, '0') p, sha256(coalesce(text, '')) h, row_number() over () r from documents) select sha256('manifest' || string_agg(s || '|' || p || '|' || h || chr(10), '' order by s, p, h)) root, count(*) entries from e""")
def package_root(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    section = F.when(F.col("doc_id") % 2 == 0, "artifacts").otherwise("report_assets")
    entries = d.select(section.alias("section"), F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("relative_path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    return custody.package_root(entries, "manifest").select("root", F.lit(entries.count()).cast("long").alias("entries"))


@query(
    """select o_orderkey, case when o_orderkey % 11 = 1 then 'signature missing' when o_orderkey % 11 = 2 then 'sidecar missing' when o_orderkey % 11 = 3 then 'manifest missing' when o_orderkey % 7 = 0 then 'sidecar differs' when o_orderkey % 5 = 0 then 'root differs'
  when o_orderkey % 3 = 0 and o_orderkey % 2 = 0 then 'hmac differs' else 'verified' end outcome from orders"""
)
def signature_outcomes(spark, sf_dir):
    k = F.col("o_orderkey")
    part = lambda missing: F.when(~missing, F.lit("x"))
    side = F.when(k % 11 != 2, F.when(k % 7 == 0, F.lit("bad  s.json")).otherwise(F.lit("good  s.json")))
    mark = F.when(k % 3 == 0, F.when(k % 2 == 0, F.lit("m1")).otherwise(F.lit("m")))
    outcome = custody.signature_outcome(part(k % 11 == 1), side, part(k % 11 == 3), F.lit("good"), F.when(k % 5 == 0, F.lit("r1")).otherwise(F.lit("r")), F.lit("r"), mark, F.lit("m"))
    return table(spark, sf_dir, "orders").select("o_orderkey", outcome.alias("outcome"))


@query(
    """with v as (select c_custkey, unnest([c_name, c_mktsegment, n_name, case when c_custkey % 2 = 0 then lower(n_name) else 'Unknown' end, case when c_custkey % 3 = 0 then ' ' || c_mktsegment end]) v from customer join nation on c_nationkey = n_nationkey)
select c_custkey, min(trim(v)) "value" from v where v is not null and lower(trim(v)) not in ('', 'unknown') group by c_custkey, lower(trim(v))"""
)
def union_of_places(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    even = F.when(F.col("c_custkey") % 2 == 0, F.lower("n_name")).otherwise("Unknown")
    third = F.when(F.col("c_custkey") % 3 == 0, F.array(F.concat(F.lit(" "), "c_mktsegment")))
    return relations.union_values(c.withColumns({"even": even, "more": third}), "c_custkey", ["c_name", "c_mktsegment", "n_name", "even"], ["more"])


@query(f"""with {_PLACES} select "level", count(*) places, count(*) filter (own < 60) bare, count(*) filter (own % 2 = 0) unplaced, round(avg(case when own < 60 then 0 else 2 end), 4) aliases from places where n >= 3 group by "level\"""")
def alias_health(spark, sf_dir):
    p = _places(spark, sf_dir).withColumns({"aliases": F.when(F.col("source_confidence") >= 60, F.col("aliases")), "latitude": F.when(F.col("source_confidence") % 2 != 0, F.lit(1.0))})
    return gazetteer.alias_health(p)
