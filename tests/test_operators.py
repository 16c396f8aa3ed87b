"""Operators that SQL cannot hold: scans in time, pixels, containers, readers, exports, registry, against plain Python."""

import hashlib
import hmac
import io
import json
import random
import struct
import zipfile
import zlib
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone import registry, sinks
from marlstone.functions import map_text, text, timeparse, vectors
from marlstone.operators import candidates, case_tables, casework, custody, gazetteer, ordering, pixels, relations, travel
from marlstone.sources import containers, files


def test_scene_groups_equal_the_plain_rule(spark):
    rng = random.Random(3)
    start = datetime(2026, 1, 1)
    rows = []
    for i in range(300):
        ts = None if rng.random() < 0.1 else start + timedelta(minutes=rng.randrange(0, 6000))
        rows.append((f"c{i % 3}", i, ts, rng.choice("ABC"), rng.choice(["Unknown", "Maps", "Chat"]), rng.choice(["", "", "", "G1", "G2"])))
    rows.append(("c0", 300, None, None, None, None))
    want = {}
    for case in ("c0", "c1", "c2"):
        mine = sorted((r for r in rows if r[0] == case), key=lambda r: (r[2] is None, r[2] or start, r[1]))
        groups = []
        for r in mine:
            for g in groups:
                a = g[0]
                if r[2] is None or a[2] is None:
                    continue
                same = r[3] == a[3] or ((r[4] or "Unknown") != "Unknown" and r[4] == a[4])
                if (r[5] and r[5] == a[5]) or (same and abs((r[2] - a[2]).total_seconds()) <= 6 * 3600):
                    g.append(r)
                    break
            else:
                groups.append([r])
        want |= {r[1]: frozenset(x[1] for x in g) for g in groups if len(g) > 1 for r in g}
    df = spark.createDataFrame(rows, "case_id string, id int, ts timestamp, source string, app string, duplicate_group string")
    got = travel.scene_groups(df, "case_id").collect()
    members = {}
    for r in got:
        members.setdefault((r["case_id"], r["scene"]), set()).add(r["id"])
    assert {r["id"]: frozenset(members[r["case_id"], r["scene"]]) for r in got} == want and all(r["members"] == len(members[r["case_id"], r["scene"]]) for r in got)
    assert travel.scene_groups(df.where("false"), "case_id").count() == 0


def test_places_in_large_groups(spark):
    rng = random.Random(1)
    rows = [(("a", "b", None)[min(2, rng.randrange(9))] if i % 50 else "c", i, rng.randrange(40)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, id int, v int")
    got = {(r["g"], r["id"]): r["place"] for r in ordering.place_in_group(df.where("g is not null"), "g", [F.desc("v"), F.col("id")], "place").collect()}
    for g in "abc":
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
        assert all(got[g, r[1]] == k for k, r in enumerate(mine, 1))


def test_package_signature(spark):
    entries = spark.createDataFrame([("report_assets", "b", "2"), ("artifacts", "z", "1"), ("artifacts", "a", None)], "section string, relative_path string, sha256 string")
    want = hashlib.sha256(b"m" + b"artifacts|a|\nartifacts|z|1\nreport_assets|b|2\n").hexdigest()
    r = custody.package_root(entries, "m", b"key").first()
    assert r["root"] == want and r["hmac"] == hmac.new(b"key", want.encode(), hashlib.sha256).hexdigest()
    assert custody.package_root(entries.where("false"), "m").first()["root"] == hashlib.sha256(b"m").hexdigest()


def test_pixels():
    rng = np.random.default_rng(1)
    px = rng.integers(0, 256, (64, 4)).astype(np.uint8)
    bits = px[:, 0] & 1
    c = pixels.channel(px[:, 0])
    raw = bytes(int("".join(map(str, bits[k : k + 8])), 2) for k in range(0, 64, 8))
    back = bytes(int("".join(map(str, bits[k : k + 8][::-1])), 2) for k in range(0, 64, 8))
    plain = lambda b: -sum(b.count(x) / len(b) * np.log2(b.count(x) / len(b)) for x in set(b))
    assert c["ones"] == pytest.approx(bits.mean()) and c["entropy"] == pytest.approx(max(plain(raw), plain(back))) and c["compression"] == len(zlib.compress(raw, 6)) / 8
    assert pixels.byte_entropy(b"") == 0 and pixels.byte_entropy(bytes(range(256))) == 8
    message = b"the secret is here"
    hidden = np.zeros((60, 4), np.uint8)
    flat = [int(b) for x in message for b in f"{x:08b}"]
    for k, b in enumerate(flat):
        hidden[k // 3, k % 3] = 254 + b
    assert any("RGB-bit0: the secret is here" in s for s in pixels.streams(hidden))
    clear = np.array([[200, 10, 10, 0], [0, 0, 0, 0], [9, 9, 9, 255], [5, 5, 5, 100]], np.uint8)
    assert pixels.transparency(clear) == {"transparent": 0.5, "coloured": 0.5, "vivid": 0.5, "translucent": 0.75}
    ramp = np.zeros((72, 4), np.uint8)
    ramp[:, :3] = (np.arange(72) % 9 * 20)[:, None]
    assert pixels.difference_hash(ramp, 9) == "00" * 8 and pixels.difference_hash(ramp[::-1], 9) == "ff" * 8
    white = np.full((64, 4), 255, np.uint8)
    assert pixels.average_hash(white, 8) == "ff" * 8


def test_pixel_table(spark):
    df = spark.createDataFrame([(1, bytes([255, 255, 255, 255] * 64), 8), (2, b"", 0), (3, None, None), (4, b"abc", 5)], "id int, rgba binary, width int")
    got = {r["id"]: r for r in pixels.profile(df).collect()}
    assert got[1]["ones_r"] == 1 and got[2]["dhash"] == "" and got[3]["entropy_r"] == 0 and got[4]["strings"] == []
    score, label = pixels.pixel_verdict(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(True), F.lit(3), F.lit(False), F.lit(False))
    r = spark.range(1).select(score.alias("s"), label.alias("l")).first()
    assert (r["s"], r["l"]) == (100, "strong")


def png(width, height, kind, raw, extra=b"", tail=b""):
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return containers.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"") + tail


def test_png_pixels():
    rng = np.random.default_rng(4)
    for kind, n in containers.CHANNELS.items():
        if kind == 3:
            continue
        w, h = 7, 10
        image = rng.integers(0, 256, (h, w * n)).astype(int)
        raw = b""
        for y in range(h):
            how, line = y % 5, []
            for x in range(w * n):
                left, up, corner = (image[y, x - n] if x >= n else 0), (image[y - 1, x] if y else 0), (image[y - 1, x - n] if y and x >= n else 0)
                p = left + up - corner
                near = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                line.append((image[y, x] - (0, left, up, (left + up) // 2, near)[how]) % 256)
            raw += bytes([how]) + bytes(int(v) for v in line)
        width, rgba = containers.png_pixels(png(w, h, kind, raw))
        got = np.frombuffer(rgba, np.uint8).reshape(-1, 4)
        flat = image.reshape(-1, n)
        assert width == w and (got[:, 0] == flat[:, 0]).all() and (got[:, 3] == (flat[:, -1] if n in (2, 4) else 255)).all()
    assert containers.png_pixels(b"no") is None and containers.png_pixels(png(3, 3, 2, b"short")) is None


def exif(order):
    o = "<" if order == b"II" else ">"
    make, gps = b"Maker\x00", struct.pack(o + "IIIIII", 30, 1, 2, 1, 3984, 100)
    body = order + struct.pack(o + "HI", 42, 8)
    at = 8 + 2 + 3 * 12 + 4
    gps_at = at + len(make)
    values = gps_at + 2 + 12 + 4
    body += struct.pack(o + "H", 3) + struct.pack(o + "HHII", 0x010F, 2, len(make), at) + struct.pack(o + "HHI", 0x0112, 3, 1) + struct.pack(o + "HH", 6, 0) + struct.pack(o + "HHII", 0x8825, 4, 1, gps_at) + struct.pack(o + "I", 0)
    return body + make + struct.pack(o + "H", 1) + struct.pack(o + "HHII", 2, 5, 3, values) + struct.pack(o + "I", 0) + gps


def test_containers(spark):
    for order in (b"II", b"MM"):
        body = exif(order)
        assert containers.exif_tags(b"\xff\xd8\xff\xe1\x00\x99Exif\x00\x00" + body) == {"Make": "Maker", "Orientation": "6", "GPSLatitude": "30/1, 2/1, 3984/100"} == containers.exif_tags(body if order == b"MM" else body[:2] + b"*\x00" + body[4:])
    chunk = struct.pack(">I", 3) + b"tEXt" + b"a\x00b" + b"\0\0\0\0"
    data = png(4, 5, 2, bytes((4 * 3 + 1) * 5), chunk, b"PK\x03\x04rest")
    assert containers.image_size(data) == ("PNG", 4, 5, 1)
    found = containers.findings(data)
    assert [(f[0], f[3]) for f in found] == [("metadata chunk", "tEXt"), ("trailing bytes", "zip"), ("inline payload", "zip")] and found[1][2] == 8
    assert containers.findings(data[:40])[0][0] == "no end marker"
    assert containers.image_size(b"GIF89a\x03\x00\x04\x00" + b"\x00\x21\xf9\x04" * 2) == ("GIF", 3, 4, 2)
    assert containers.image_size(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x09\x00\x07\x00") == ("JPEG", 7, 9, 1)
    assert containers.image_size(b"") == ("Unknown", 0, 0, 0) and containers.exif_tags(b"") == {} and containers.findings(b"") == []
    df = spark.createDataFrame([("a.png", data), ("b", None)], "path string, content binary")
    got = {r["path"]: r for r in containers.describe(df).collect()}
    assert got["a.png"]["width"] == 4 and len(got["a.png"]["findings"]) == 3 and got["b"]["format"] == "Unknown"
    assert [(r["path"], bytes(r["content"])) for r in containers.carve(df).collect()] == [("a.png", b"PK\x03\x04rest")]


def test_place_payloads(spark, tmp_path):
    payloads = {
        "list.json": json.dumps([{"name": "A", "lat": "1.5", "lon": 2}, {"title": " B "}, {"x": 1}]),
        "places.json": json.dumps({"places": [{"name": "C", "aliases": ["c1", "c2"], "population": 7}]}),
        "geo.geojson": json.dumps({"type": "FeatureCollection", "features": [{"properties": {"name": "D", "country": "E"}, "geometry": {"type": "Point", "coordinates": [31.2, 30.1]}}]}),
        "one.json": json.dumps({"name": "F", "longitude": 3}),
        "lines.jsonl": '{"name": "G"}\nbroken\n{"name": "H", "pop": "9"}\n',
    }
    for name, body in payloads.items():
        (tmp_path / name).write_text(body)
    got = {r["name"]: r for r in files.json_places(spark, str(tmp_path)).collect()}
    assert set(got) == set("ABCDFGH") and (got["A"]["latitude"], got["A"]["longitude"]) == (1.5, 2.0) and got["C"]["aliases"] == ["c1", "c2"] and (got["D"]["latitude"], got["D"]["country"]) == (30.1, "E") and got["H"]["population"] == 9
    kinds = spark.createDataFrame([(x,) for x in ("EG.txt", "alternateNames.txt", "a.geojson", "b.zip", "c.tsv", "d.pdf")], "n string").select(files.place_kind(F.col("n")).alias("k"))
    assert [r["k"] for r in kinds.collect()] == ["geonames", "auxiliary", "json", "zip", "delimited", "other"]
    (tmp_path / "z").mkdir()
    for name, members in {"EG.zip": {"readme.txt": "r", "EG.txt": "rows", "../evil.txt": "x"}, "bad.zip": None}.items():
        b = io.BytesIO(b"no zip")
        if members:
            b = io.BytesIO()
            with zipfile.ZipFile(b, "w") as z:
                for m, body in members.items():
                    z.writestr(m, body)
        (tmp_path / "z" / name).write_bytes(b.getvalue())
    assert [(r["member"], bytes(r["content"])) for r in files.zip_members(spark, str(tmp_path / "z")).collect()] == [("EG.txt", b"rows")]
    (tmp_path / "c.txt").write_text("# comment\nEG\tEGY\t818\tEG\tEgypt\tCairo\t1\t2\tAF\n")
    (tmp_path / "a2.txt").write_text("EG.11.22\tGiza\tGiza\t1\n")
    assert files.countries(spark, str(tmp_path / "c.txt")).first()["country"] == "Egypt"
    assert tuple(files.admin_codes(spark, str(tmp_path / "a2.txt")).first()) == ("EG", "11.22", "Giza")
    (tmp_path / "t.json").write_text(json.dumps({"_dataset": "x", "a.jpg": {"native_gps": True, "_note": "n"}, "b.jpg": {"source_type_contains": "shot"}}))
    assert {tuple(r) for r in files.ground_truth(spark, str(tmp_path / "t.json")).collect()} == {("a.jpg", "native_gps", "true"), ("b.jpg", "source_type_contains", "shot")}


def test_place_index(spark):
    places = spark.createDataFrame([("Giza", "Cairo", "Egypt", ["gz"], 5), ("Oslo", None, "Norway", None, None)], "name string, city string, country string, aliases array<string>, population long")
    names = spark.createDataFrame([("egypt", "Misr"), ("CAIRO", "Al Qahira"), ("Egypt", "Misr")], "name string, alias string")
    got = {r["name"]: r["aliases"] for r in gazetteer.enrich_aliases(places, names).collect()}
    assert got["Giza"] == ["Giza", "Cairo", "Egypt", "gz", "Misr", "Al Qahira"] and got["Oslo"] == ["Oslo", "Norway"]
    assert [r["name"] for r in gazetteer.index_order(places).collect()] == ["Giza", "Oslo"]
    docs = spark.createDataFrame([(1, "We flew to the United Kingdom of Great Britain and Northern Ireland today"), (2, "Ireland, Northern"), (3, "")], "doc_id int, text string")
    aliases = spark.createDataFrame([("UK", "United Kingdom of Great Britain and Northern Ireland"), ("NI", "Northern Ireland")], "place string, alias string")
    assert {(r["doc_id"], r["place"]) for r in gazetteer.match(docs, aliases).collect()} == {(1, "UK"), (1, "NI")}
    assert {(r["doc_id"], r["place"], r["exact"]) for r in gazetteer.alias_hits(docs, aliases).collect()} == {(1, "UK", True), (1, "NI", True), (2, "NI", False)}


def test_entities_have_no_cap(spark):
    body = " ".join(f"http://h{i}.example.org/" for i in range(31)) + " someone@example.org"
    df = spark.createDataFrame([(body,)], "t string")
    kinds = [x["entity_type"] for x in df.select(text.entities(F.col("t")).alias("e")).first()["e"]]
    assert kinds.count("url") == 31 and kinds.count("email") == 1 and len(df.select(text.entities(F.col("t"), 30).alias("e")).first()["e"]) == 30


def test_redaction_against_plain_python(spark):
    """All kinds, over the texts of a table, with Python's own patterns."""
    import re

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null")
    odd = spark.createDataFrame([(-1, r"see C:\a\b.txt /home/u/x www.a.org me@b.org @name 30.12345, 31.54321 +20 100 123 4567 token=abcdefghij done")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(odd)
    got = {r["doc_id"]: r for r in rows.select("doc_id", "text", text.redacted_with_audit(F.col("text")).alias("a")).collect()}
    for r in got.values():
        out, hits = r["text"], {}
        for kind, (pattern, mark) in text.SENSITIVE.items():
            n = len(re.findall(pattern, r["text"], re.A))
            hits |= {kind: n} if n else {}
            out = re.sub(pattern, mark, out, flags=re.A)
        if r["text"].isascii():  # borders of words differ beyond
            assert r["a"]["text"] == out and {h["kind"]: h["hits"] for h in r["a"]["hits"]} == hits, r["doc_id"]
    assert len(got[-1]["a"]["hits"]) == len(text.SENSITIVE)


def test_exports(spark):
    df = spark.createDataFrame([("c", 1, "a.jpg", 30.0, 31.0, "Cam")], "case_id string, evidence_id int, file_name string, gps_latitude double, gps_longitude double, device_model string")
    assert sinks.flat(df, "full").first()["gps_latitude"] == 30.0 and sinks.flat(df).first()["gps_latitude"] is None and len(sinks.flat(df).columns) == 21
    assert len(sinks.nested(df).first()["records"]) == 1
    m = spark.createDataFrame([("a.csv", "12"), ("../b.csv", "3"), ("x.exe", "4"), ("/c.json", "5")], "relative_path string, sha256 string")
    assert [r["relative_path"] for r in sinks.allowed(m).collect()] == ["a.csv"] and sinks.sidecar(m).first()["value"] == "12  a.csv"
    assert {r["kind"] for r in sinks.leaks(spark.createDataFrame([("a", "me@b.org"), ("b", "fine")], "relative_path string, text string")).collect()} == {"email"}
    assert sinks.truth_template(df).first()["file_name"] == "a.jpg"


def test_case_tables(spark):
    cases = spark.createDataFrame([(1, "a"), (2, "b")], "case_id int, case_name string")
    with pytest.raises(ValueError):
        case_tables.insert_cases(cases, spark.createDataFrame([(2, "c")], "case_id int, case_name string"))
    both = case_tables.insert_cases(cases, spark.createDataFrame([(3, "z"), (3, "c")], "case_id int, case_name string"))
    assert sorted(map(tuple, both.collect())) == [(1, "a"), (2, "b"), (3, "c")]
    counts = spark.createDataFrame([(2, 9)], "case_id int, records long")
    assert tuple(case_tables.active_case(case_tables.set_active(both, 2), counts).select("case_id", "records").first()) == (2, 9)
    assert case_tables.active_case(case_tables.set_active(both, 77), counts).count() == 0
    same = spark.createDataFrame([(5.0,), (5.0,), (None,)], "v double")
    assert [(r["bin"], r["n"]) for r in case_tables.histogram(same, "v").collect() if r["n"]] == [(0, 2)]


def test_registry(spark):
    r = registry.default_registry()
    assert r.get(" Map_Signals ").handler is map_text.map_signals and {p.name for p in r.list() if not p.enabled} == {"local_model", "local_vision"}
    assert r.manifest(spark).where("not enabled").count() == 2 and all(p.handler for p in r.list(enabled_only=True))
    with pytest.raises(ValueError):
        r.register(registry.Plugin(" ", "x"))
    assert registry.register_functions(spark) and spark.sql("select byte_entropy(unhex('00FF'))").first()[0] == 1.0


def test_file_names(spark):
    names = {"Photo 2026-04-16 at 1.05.09 PM.png": "2026:04:16 13:05:09", "Photo 2026-04-16 at 12.05.09 AM": "2026:04:16 00:05:09", "2026-02-30 101010": None, "x": None, "W20210101101559": "2021:01:01 10:15:59", "v-2022-01-02-3-10-20 PM": "2022:01:02 15:10:20"}
    got = spark.createDataFrame([(x,) for x in names], "n string").select("n", timeparse.from_file_name(F.col("n")).alias("t")).collect()
    assert {r["n"]: r["t"] for r in got} == names


def test_decisions(spark):
    claims = spark.createDataFrame([(1, "proof", 90), (2, "lead", 90)], "id int, strength string, confidence int")
    given = spark.createDataFrame([(2, "verified", 1), (2, "rejected", 2)], "id int, decision string, at int")
    assert {r["id"]: r["decision"] for r in candidates.attach_decisions(claims, given, ["id"]).collect()} == {1: "auto_generated", 2: "rejected"}


def test_hash_pairs_against_all_pairs(spark):
    rng = random.Random(2)
    hashes = [rng.getrandbits(64) for _ in range(40)]
    hashes += [h ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(9))) for h in hashes for _ in range(3)]
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    df = spark.createDataFrame(list(enumerate(signed)), "id int, hash long")
    want = {(i, j, bin(hashes[i] ^ hashes[j]).count("1")) for j in range(len(hashes)) for i in range(j) if bin(hashes[i] ^ hashes[j]).count("1") <= 6}
    got = [tuple(r) for r in relations.hamming_pairs(df, 6).collect()]
    assert len(got) == len(want) and set(got) == want
    assert casework.MODES and relations.near_hash_edges(df).count() >= 1


def test_visible_text(spark):
    from marlstone.functions import ocr_text

    lines = {"Main Street 12": True, "--- ::": False, "a": False, "a!!": False, "خريطة": True, "ab": False, "x1 2": True, "......a....": False}
    got = spark.createDataFrame([(x,) for x in lines], "t string").select("t", ocr_text.readable(F.col("t")).alias("r")).collect()
    assert {r["t"]: r["r"] for r in got} == lines
    strings = {"hello world again": True, "IHDR something": False, "#$%^&*()_+!@": False, "see http://x": True, "short": False, "zzzzzzzzzz": True, "0123 4567 8901": False}
    got = spark.createDataFrame([(x,) for x in strings], "t string").select("t", ocr_text.readable_string(F.col("t")).alias("r")).collect()
    assert {r["t"]: r["r"] for r in got} == strings
    r = spark.createDataFrame([("Giza — 78% — city", "byuctf{City-State}", "cairo_trip-2024.jpg")], "a string, f string, n string").select(
        ocr_text.rank_label(F.col("a")).alias("l"), ocr_text.flag_answer(F.lit("Giza, Egypt"), F.col("f")).alias("w"), ocr_text.file_name_hints(F.col("n"), ["Cairo", "Giza"]).alias("h"), ocr_text.region_hint(F.lit("Egypt / x")).alias("g"), ocr_text.good_label(F.lit(" Maps ")).alias("b")
    ).first()
    assert tuple(r["l"]) == ("Giza", 78, "city") and r["w"] == "byuctf{Giza-Egypt}" and r["h"] == ["Cairo"] and r["g"] == "Egypt" and not r["b"]


def test_components_of_masks():
    rng = np.random.default_rng(3)
    for diagonal in (False, True):
        for _ in range(30):
            mask = rng.random((12, 15)) < 0.45
            seen, want = np.zeros(mask.shape, bool), []
            for y, x in zip(*np.nonzero(mask)):
                if seen[y, x]:
                    continue
                todo, part = [(y, x)], []
                seen[y, x] = True
                while todo:
                    a, b = todo.pop()
                    part.append((a, b))
                    for da in (-1, 0, 1):
                        for db in (-1, 0, 1):
                            if (da, db) != (0, 0) and (diagonal or not da or not db):
                                p, q = a + da, b + db
                                if 0 <= p < 12 and 0 <= q < 15 and mask[p, q] and not seen[p, q]:
                                    seen[p, q] = True
                                    todo.append((p, q))
                if len(part) >= 2:
                    ys, xs = zip(*part)
                    want.append((min(xs), min(ys), max(xs) + 1, max(ys) + 1, len(part)))
            assert sorted(pixels.component_boxes(mask, 2, diagonal)) == sorted(want)


def test_colours():
    px = np.array([[255, 255, 255, 255], [0, 0, 0, 255], [0, 100, 200, 255], [200, 50, 50, 0]], np.uint8)
    r = pixels.colour_ratios(px)
    assert (r["light"], r["dark"], r["white"], r["black"], r["red"], r["alpha"], r["route_blue"]) == (0.25,) * 7
    assert pixels.map_scores(dict.fromkeys(pixels.COLOURS, 0.0) | {"light": 0.5, "white": 0.3, "route_blue": 0.01, "red": 0.01}, 0.0) == (42, 82)
    assert pixels.edge_density(px, 2) == 0.75 or pixels.edge_density(px, 2) > 0.4
    assert len(pixels.image_vector(px, 2)) == 42 and np.linalg.norm(pixels.image_vector(px, 2)) == pytest.approx(1)


def test_snapshots_and_caches(spark, tmp_path):
    path = str(tmp_path / "s.json")
    for name in ("first", "second"):
        sinks.write_snapshot(spark.createDataFrame([(name,)], "case_id string"), path)
    assert files.snapshot(spark, path, "case_id string").first()[0] == "second"
    import shutil

    shutil.rmtree(path)
    assert files.snapshot(spark, path, "case_id string").first()[0] == "first"
    rows = spark.createDataFrame([(1, "h", "x"), (2, "old", "y")], "evidence_id int, sha256 string, result string")
    sinks.write_cache(rows, str(tmp_path / "cache"), 3)
    sinks.write_cache(rows.withColumn("result", F.lit("stale")), str(tmp_path / "cache"), 2)
    wanted = spark.createDataFrame([(1, "h"), (2, "new")], "evidence_id int, sha256 string")
    assert [r["result"] for r in sinks.read_cache(spark, str(tmp_path / "cache"), wanted, 3).collect()] == ["x"]
    one = spark.createDataFrame([("c", 1, "<a&b>.jpg", 30.0, 31.0)], "case_id string, evidence_id int, file_name string, lat double, lon double")
    assert "&lt;a&amp;b&gt;.jpg" in sinks.html_table(one, "full").first()[0] and json.loads(sinks.map_features(one).first()[0])["geometry"]["coordinates"] == [31.0, 30.0]


def test_cities_and_landmarks(spark):
    values = spark.createDataFrame([("Alxandria",), ("greater cairo",), ("Cairo",), ("Oslo",), ("",)], "value string")
    aliases = spark.createDataFrame([("Alexandria", "Alexandria", 0), ("Cairo", "Cairo", 1)], "name string, alias string, ord int")
    got = {r["value"]: (r["name"], r["score"]) for r in gazetteer.normalise_cities(values, aliases).collect()}
    assert got["Alxandria"][0] == "Alexandria" and got["greater cairo"] == ("Cairo", 0.94) and got["Cairo"] == ("Cairo", 1.0) and got["Oslo"] == ("Oslo", 0.0)
    a, b = (spark.createDataFrame([(n, src)], "name string, src string") for n, src in (("Big Ben", "mine"), ("big ben ", "built in")))
    assert [r["src"] for r in gazetteer.landmarks(a, b).collect()] == ["mine"]


def test_alias_hits_keep_texts_in_place(spark):
    """Every word of a long alias counts, no word of a text is moved, and the words are those of the column's normaliser."""
    long = [f"w{k}" for k in range(70)]
    rows = [(1, " ".join(long)), (2, " ".join(reversed(long))), (3, " ".join(w for w in long if w != "w65")), (4, "Straße in Łódź, al-Qāhira, القاهرة أحمد\u200fK"), (5, None), (6, "!")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    aliases = spark.createDataFrame([("L", " ".join(long)), ("S", "STRASSE"), ("Q", "qahira القاهره"), ("W", "w3 w4"), ("X", "w4 w3 w2"), ("N", "?")], "place string, alias string")
    found = gazetteer.alias_hits(docs, aliases)
    assert {(r["doc_id"], r["place"], r["exact"]) for r in found.collect()} == {(1, "L", True), (2, "L", False), (4, "S", True), (4, "Q", True), (1, "W", True), (2, "W", False), (3, "W", True), (1, "X", False), (2, "X", True), (3, "X", False)}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r["doc_id"], r["place"]) for r in gazetteer.match(docs, aliases).collect()} == {(1, "L"), (4, "S"), (4, "Q"), (1, "W"), (3, "W"), (2, "X")}
    for r in docs.select("text", text.normalize_place(F.col("text")).alias("t")).collect():
        assert " ".join(text.place_words(r["text"])) == r["t"]


def test_best_places_where_the_text_is(spark, monkeypatch):
    """The best places are the same in one share of the aliases, in several, and by the way of repeated rows."""
    docs = spark.createDataFrame([(k, f"alpha{k % 5} beta{k % 3} gamma delta{k % 7} mu") for k in range(40)], "doc_id long, text string")
    places = spark.createDataFrame([(f"P{k}", ("poi", "area", "city", "country", "x")[k % 5], 50 + k % 40, k % 2 == 0, [f"beta{k % 3} gamma", f"gamma alpha{k % 5}", "mu", f"d{k}"]) for k in range(30)], "place string, level string, source_confidence int, generated boolean, aliases array<string>")
    whole = sorted(map(tuple, gazetteer.match_places(docs, places, 4).collect()))
    monkeypatch.setattr(gazetteer, "ALIASES_AT_ONCE", 40)
    assert sorted(map(tuple, gazetteer.match_places(docs, places, 4).collect())) == whole
    monkeypatch.setattr(gazetteer, "_repeated", lambda rows, key: True)
    assert sorted(map(tuple, gazetteer.match_places(docs, places, 4).collect())) == whole and len(whole) > 100


def test_best_places_of_repeated_ids(spark, monkeypatch):
    """Rows of one id are one text, rows of one place stay apart, and hits are added up where the texts are."""
    docs = spark.createDataFrame([(None if k % 11 == 0 else k % 9 if k < 60 else k, f"alpha{k % 5} beta{k % 3} gamma delta{k % 7} mu") for k in range(90)], "doc_id long, text string").repartition(5)
    rows = [(None if k == 7 else f"P{k % 20}", ("poi", "area", "city", "country", "x")[k % 5], 50 + k % 40, k % 2 == 0, [f"beta{k % 3} gamma", f"gamma alpha{k % 5}", "mu", f"d{k}"]) for k in range(45)]
    places = spark.createDataFrame(rows, "place string, level string, source_confidence int, generated boolean, aliases array<string>")
    rank, groups = {"poi": 0, "area": 1, "city": 2, "country": 3}, {}
    for r in gazetteer.match_places(docs, places, None).collect():
        groups.setdefault(r["doc_id"], []).append(r)
    best = [tuple(r) for g in groups.values() for r in sorted(g, key=lambda r: (-r["confidence"], rank.get(r["level"], 9), r["place"].lower()))[:4]]
    monkeypatch.setattr(gazetteer, "alias_hits", None)  # single hits are not shuffled
    order = lambda rows: sorted(rows, key=str)
    for at_once, texts in ((50_000, 1000), (50_000, 5), (30, 5), (30, 1000)):
        monkeypatch.setattr(gazetteer, "ALIASES_AT_ONCE", at_once)
        monkeypatch.setattr(gazetteer, "TEXTS_AT_ONCE", texts, raising=False)
        assert order(map(tuple, gazetteer.match_places(docs, places, 4).collect())) == order(best) and len(best) > 100


def test_cosine_search_by_blocks(spark, monkeypatch):
    """Blocks, equal vectors, zeros, other lengths and nulls give what all pairs give, and pairs under the bound are not made."""
    rnd = random.Random(3)
    rows = [(k, "ab"[k % 2], [rnd.gauss(0, 1) for _ in range(6)]) for k in range(150)] + [(k, "c", [1.0, 2.0, 3.0, 0.1, 0.7, 0.2]) for k in range(150, 190)]
    rows += [(190, "z", [0.0] * 6), (191, "s", [1.0, 2.0]), (192, "n", None), (193, "m", [1.0, None, 2.0, 3.0, 1.0, 1.0])]
    v = spark.createDataFrame(rows, "id long, label string, embedding array<float>")
    kept = spark.createDataFrame([r for r in rows if r[0] < 192], "id long, label string, embedding array<float>")
    q = kept.where("id % 10 = 0")
    every = sorted(map(tuple, kept.crossJoin(q.select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))).select("query_id", "id", "label", vectors.cosine(F.col("embedding"), F.col("q")).alias("c")).collect()))
    monkeypatch.setattr(relations, "VECTORS_AT_ONCE", 60)
    monkeypatch.setattr(relations, "QUERIES_AT_ONCE", 7)
    assert sorted(map(tuple, relations.cosine_search(v, q).collect())) == every
    some = relations.cosine_search(v, q, least=0.4)
    assert sorted(map(tuple, some.where("c >= 0.4").collect())) == [r for r in every if r[3] >= 0.4] and some.count() < len(every) / 2
    best = sorted(r for k in {r[0] for r in every} for r in sorted((r for r in every if r[0] == k and r[3] > 0), key=lambda r: (-r[3], r[1]))[:8])
    got = relations.best_of_each(relations.cosine_search(v, q, least=0.0, best=8))
    assert sorted((r[0], r[1]) for r in got.collect()) == [r[:2] for r in best]


def test_evidence_graph_of_many_at_one_point(spark, monkeypatch):
    """Cases that duplicates fill get no lighter edges made, and others keep the first edges among many records at two near points."""
    row = lambda case, k, group, lat: (case, k, group, "Unknown", f"item {k + 1}" if k % 9 == 0 else "", lat, 31.0)
    rows = [row("full", k, "G", 30.0) for k in range(40)] + [row("some", k, "G" if k < 3 else "", 30.0 + k % 2 * 0.01) for k in range(40)]
    made = spark.createDataFrame(rows, "case_id string, id long, duplicate_group string, device_model string, link_text string, lat double, lon double")
    edges = {"full": [], "some": []}
    for c, k, g, _, t, la, _ in rows:
        for d, j, h, _, u, lb, _ in rows:
            if c == d and k < j:
                edges[c] += [(-96, "duplicate_group", k, j)] * (g == h == "G") + [(-74, "same_location", k, j) if la == lb else (-52, "nearby_location", k, j)]
                edges[c] += [(-65, "case_link", k, j)] * (t == f"item {j}" or u == f"item {k}")
    for most in (5, 30):
        got = {c: sorted((-r["weight"], r["relation"], r["source_id"], r["target_id"]) for r in relations.evidence_graph(made, most=most).collect() if r["case_id"] == c) for c in edges}
        assert got == {c: sorted(e)[:most] for c, e in edges.items()}
    points, near = [], relations.nearby_edges
    monkeypatch.setattr(relations, "nearby_edges", lambda p, **a: points.append(p) or near(p, **a))
    relations.evidence_graph(made, most=30)
    assert {r["case_id"] for r in points[0].select("case_id").distinct().collect()} == {"some"}
