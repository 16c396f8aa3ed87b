"""Readers, exports and streams on small files."""

import json

from pyspark.sql import functions as F

from marlstone import sinks
from marlstone.operators import custody, gazetteer
from marlstone.sources import files
from marlstone.sources.tables import points
from marlstone.streaming import evidence as streaming


def test_scan(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.png").write_bytes(b"\x89PNG\r\n\x1a\n123")
    (tmp_path / "a/y.jpg").write_bytes(b"GIF89a..")
    (tmp_path / "z.webp").write_bytes(b"RIFF\0\0\0\0WEBPVP8L")
    (tmp_path / "no.txt").write_text("x")
    got = {r["name"]: (r["family"], r["signature_status"]) for r in files.scan(spark, str(tmp_path)).collect()}
    assert got == {"x.png": ("PNG", "Matched"), "y.jpg": ("GIF", "Mismatch"), "z.webp": ("WEBP", "Matched")}
    both = files.scan(spark, str(tmp_path))
    assert {r["copy_status"] for r in files.verify_copies(both, both.where("name <> 'x.png'")).collect()} == {"verified", "missing"}


def test_gazetteer_build(spark, tmp_path):
    row = ["3530597", "Cairo", "Cairo", "Al Qahirah,Kahira", "30.0444", "31.2357", "P", "PPLC", "EG", "", "11", "", "", "", "9606916", "", "", "", "2024-01-01"]
    small = ["1", "Hamlet", "Hamlet", "", "1", "2", "P", "PPL", "EG", "", "11", "", "", "", "5", "", "", "", "2024-01-01"]
    (tmp_path / "EG.txt").write_text("\t".join(row) + "\n" + "\t".join(small) + "\n")
    (tmp_path / "alt.txt").write_text("1\t3530597\tar\tالقاهرة\n2\t3530597\ten\tKAHIRA\n3\t9\ten\tElsewhere\n")
    places = gazetteer.normalise(files.geonames(spark, str(tmp_path / "EG.txt"), 1000))
    assert places.count() == 1
    countries = spark.createDataFrame([("EG", "Egypt")], "country_code string, country string")
    admin = spark.createDataFrame([("EG", "11", "Cairo Gov")], "country_code string, code string, name string")
    zones = spark.createDataFrame([("EG", "Africa/Cairo")], "country_code string, timezone string")
    out = gazetteer.add_alternate_names(gazetteer.enrich(places, countries, admin, zones), files.alternate_names(spark, str(tmp_path / "alt.txt"))).first()
    assert (out["name"], out["country"], out["admin1_name"], out["timezone"], out["confidence"]) == ("Cairo", "Egypt", "Cairo Gov", "Africa/Cairo", 78)
    assert "القاهرة" in out["aliases"] and "Elsewhere" not in out["aliases"]
    again = gazetteer.combine(places, places.withColumn("country_code", F.lit("XX")))
    assert [r["country_code"] for r in again.collect()] == ["EG"]


def test_readers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a;b\n1;2\n")
    assert files.delimited(spark, str(tmp_path / "t.csv")).columns == ["a", "b"]
    (tmp_path / "g.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"properties": {"name": "X"}, "geometry": {"type": "Point", "coordinates": [31.2, 30.1]}}]}))
    r = files.geojson(spark, str(tmp_path / "g.json")).first()
    assert (r["name"], r["latitude"], r["longitude"]) == ("X", 30.1, 31.2)
    (tmp_path / "s.json").write_text("{broken")
    (tmp_path / "s.json.bak").write_text('{"case_id": "c1"}')
    assert files.snapshot(spark, str(tmp_path / "s.json"), "case_id string").first()[0] == "c1"
    (tmp_path / "f.jsonl").write_text('{"time": "1", "message": "a"}\nnot json\n{"time": "2", "message": "b"}\n')
    assert [r["message"] for r in files.failures(spark, str(tmp_path / "f.jsonl")).collect()] == ["b", "a"]


def test_exports_and_package(spark, tmp_path):
    df = spark.createDataFrame([("IMG-1", "/home/u/pic.jpg", "pic.jpg", "30.1, 31.2", "Unknown", "mail a@b.org")], "evidence_id string, file_path string, file_name string, gps_display string, device_model string, note string")
    r = sinks.masked(df, "redacted_text").first()
    assert (r["file_path"], r["file_name"], r["gps_display"], r["device_model"], r["note"]) == ("[REDACTED]/[REDACTED_FILE].jpg", "IMG-1.jpg", "[REDACTED_LOCATION]", "Unknown", "mail [REDACTED_EMAIL]")
    assert sinks.masked(df, "full").first() == df.first()
    sinks.export_csv(df, str(tmp_path / "pkg/csv"))
    sinks.export_json(df, str(tmp_path / "pkg/json"))
    m = sinks.manifest(spark, str(tmp_path / "pkg"))
    root = custody.package_root(m, "x").first()["root"]
    assert len(root) == 64 and {r["outcome"] for r in custody.verify_files(m, m).collect()} == {"ok"}


def test_streams(spark, tmp_path):
    batch = points(spark, "/root/testdata/sf0.001")
    batch.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = streaming.counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(points) from counts").first()[0] == batch.count()
    q = streaming.rapid_moves(stream).writeStream.format("memory").queryName("moves").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    from marlstone.operators import travel

    pairs = travel.with_previous(batch, "subject", ["ts", "id"]).where("km >= 25 and hours > 0 and km / hours >= 220")
    assert spark.sql("select count(*) from moves").first()[0] == pairs.count() > 0
