"""Literal cases of the functions and operators."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from marlstone.functions import geo, scoring, text, timeparse, vectors
from marlstone.operators import casework, custody, gazetteer, relations, travel


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_dms(spark):
    assert value(spark, geo.dms_to_decimal(F.lit(30.0), F.lit(2.0), F.lit(39.84), F.lit("N"))) == pytest.approx(30.0444, abs=1e-6)
    assert value(spark, geo.dms_to_decimal(F.lit(31.0), F.lit(14.0), F.lit(8.52), F.lit("W"))) == pytest.approx(-31.2357, abs=1e-6)
    assert value(spark, geo.ratio(F.lit("3/0"))) == 3.0


def test_file_name_time(spark):
    assert value(spark, timeparse.from_file_name(F.lit("IMG_20260306_203406.png"))) == "2026:03:06 20:34:06"
    assert value(spark, timeparse.from_file_name(F.lit("Screenshot 2026-04-16 113759.png"))) == "2026:04:16 11:37:59"
    assert value(spark, timeparse.from_file_name(F.lit("IMG_20261306_203406.png"))) is None
    assert value(spark, timeparse.parse_timestamp(F.lit("2026:04:24 10:00:00"))) == datetime(2026, 4, 24, 10)
    assert value(spark, timeparse.parse_timestamp(F.lit("Unknown"))) is None


def test_redaction(spark):
    t = "see https://a.example/x?y=1 or mail bob@example.org, ask @somebody at 30.12345, 31.54321 token=abcdefgh12"
    out = value(spark, text.redact(F.lit(t)))
    for secret in ("a.example", "bob@", "@somebody", "30.12345", "abcdefgh12"):
        assert secret not in out
    assert value(spark, text.redact_at(F.lit(t), F.lit("full"))) == t
    kinds = {h["kind"] for h in value(spark, text.sensitive_hits(F.lit(t)))}
    assert {"url", "email", "username", "coordinates", "token"} <= kinds


def test_entities(spark):
    t = "A@b.org a@B.ORG on 2026-04-16 at 10:30 PM, www.example.com"
    found = [(e["entity_type"], e["value"]) for e in value(spark, text.entities(F.lit(t)))]
    assert found.count(("email", "A@b.org")) == 1 and ("email", "a@B.ORG") not in found
    assert ("date", "2026-04-16") in found and ("url", "www.example.com") in found


def test_place_text(spark):
    assert value(spark, text.normalize_place(F.lit("  São-Tomé, Évora!"))) == "sao tome evora"
    assert value(spark, text.fuzzy_ratio(F.lit("Alexandria"), F.lit("Alxandria"))) >= 0.80
    assert value(spark, text.unique_fold(F.array(*(F.lit(x) for x in ("a  b", "A b", " c", ""))))) == ["a b", "c"]


def test_similarity_score(spark):
    """Scores are rounded as the query's SQL rounds them, where a decimal of the double has another last place."""
    duckdb = pytest.importorskip("duckdb")
    cosines = [k / 10000 for k in range(-10000, 10001)] + [0.1999, 0.9861, 0.9883, 1.0000000002]
    rows = spark.createDataFrame([(c,) for c in cosines], "c double").select("c", vectors.similarity_score(F.col("c")).alias("s"), F.round((F.col("c") + 1) * 50, 2).alias("d")).collect()
    want = [r[0] for r in duckdb.sql("select round((greatest(least(c, 1), -1) + 1) * 50, 2) from (select unnest($c) c)", params={"c": [r["c"] for r in rows]}).fetchall()]
    assert [r["s"] for r in rows] == want != [r["d"] for r in rows]


def test_hashes(spark):
    assert value(spark, vectors.hex_hamming(F.lit("abcd000000000000"), F.lit("abcd000000000001"))) == 1
    assert value(spark, vectors.hex_hamming(F.lit("0000"), F.lit("0001"))) == 64
    assert value(spark, vectors.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    related = lambda *x: value(spark, relations.relation(*(F.lit(v) for v in x)))
    assert related(False, 1, 0, False, False, 1.0, "other", "other")[:2] == ("Near duplicate", 93)
    assert related(True, 64, 0, False, False, 0.0, "camera", "screen")[:2] == ("Exact duplicate", 100)
    assert related(False, 0, 5, True, True, 1.0, "camera", "screen") is None and related(False, 3, 0, False, True, 1.0, "other", "other") is None
    assert related(False, 9, 2, False, False, 0.0, "other", "screen")[:2] == ("Derivative / related", 54)


def test_travel(spark):
    rows = [(1, "c", datetime(2026, 4, 24, 10, 0), 30.0444, 31.2357), (2, "c", datetime(2026, 4, 24, 10, 10), 30.05, 31.24), (3, "c", datetime(2026, 4, 24, 10, 20), 31.2001, 29.9187)]
    points = spark.createDataFrame(rows, "id long, subject string, ts timestamp, lat double, lon double")
    out = travel.impossible_travel(points, "subject").collect()
    assert [(r["id"], r["flag"]) for r in out] == [(3, "impossible_travel")]
    assert travel.impossible_travel(points.where("false"), "subject").count() == 0


def test_hamming_pairs_find_every_pair(spark):
    import random

    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(20)]
    values = [b ^ sum(1 << rng.randrange(63) for _ in range(rng.randrange(9))) for b in base for _ in range(6)]
    df = spark.createDataFrame(list(enumerate(values)), "id long, hash long")
    got = {(r[0], r[1], r[2]) for r in relations.hamming_pairs(df, 6).collect()}
    want = {(i, j, d) for i in range(len(values)) for j in range(i + 1, len(values)) if (d := bin((values[i] ^ values[j]) & (2**64 - 1)).count("1")) <= 6}
    assert got == want and want


def test_nearby_edges_at_the_date_line_and_pole(spark):
    import math
    import random

    rng = random.Random(6)
    points = [(i, lat + rng.uniform(-0.05, 0.05), (lon + rng.uniform(-0.05, 0.05) + 180) % 360 - 180) for i, (lat, lon) in enumerate([(0, 180)] * 25 + [(60, -180)] * 25 + [(88.9, 10)] * 10 + [(-45, 0)] * 25)]

    def km(a, b):
        la, lo, lb, ob = map(math.radians, (a[1], a[2], b[1], b[2]))
        x = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((ob - lo) / 2) ** 2
        return 2 * 6371.0088 * math.atan2(math.sqrt(x), math.sqrt(1 - x))

    want = {(a[0], b[0]) for a in points for b in points if a[0] < b[0] and km(a, b) <= 3}
    got = [(r[0], r[1]) for r in relations.nearby_edges(spark.createDataFrame(points, "id long, lat double, lon double")).collect()]
    assert sorted(got) == sorted(want)


def test_custody(spark):
    log = spark.createDataFrame([("c", i, str(i), None, "open", f"d{i}") for i in range(4)], "case string, n int, time string, evidence string, action string, details string")
    chain = custody.build_chain(log, "case", "n")
    assert custody.verify_chain(chain, "case", "n").first()["first_break"] is None
    broken = chain.withColumn("details", F.when(F.col("n") == 2, "x").otherwise(F.col("details")))
    assert custody.verify_chain(broken, "case", "n").first()["first_break"] == 2


def test_gazetteer(spark):
    docs = spark.createDataFrame([(1, "We met in New  Cairo, then Giza."), (2, "Cairos"), (3, None)], "doc_id long, text string")
    aliases = spark.createDataFrame([("Cairo", "cairo"), ("New Cairo", "New Cairo")], "place string, alias string")
    assert {(r[0], r[1]) for r in gazetteer.match(docs, aliases).collect()} == {(1, "Cairo"), (1, "New Cairo")}
    labels = spark.createDataFrame([("Caïro",), ("Giza",)], "label string")
    assert [r["place"] for r in gazetteer.fuzzy_match(labels, aliases).collect()] == ["Cairo"]


def test_scores(spark):
    assert [value(spark, scoring.risk_call(F.lit(s), F.lit(c))) for s, c in ((90, 90), (90, 50), (30, 90), (3, 90))] == ["ISOLATE", "REVIEW", "WATCH", "CLEAR"]
    assert value(spark, scoring.weighted_confidence(F.array(F.lit(60), F.lit(None).cast("int"), F.lit(70)))) == 100
    assert value(spark, timeparse.timeline_confidence(F.lit(90), F.lit("EXIF"), F.lit(False), F.lit(True))) == 55


def test_upsert_and_rollback(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "id long, v string")
    assert sorted(map(tuple, casework.upsert(a, b, ["id"]).collect())) == [(1, "x"), (2, "z"), (3, "w")]
    assert [r[0] for r in casework.rollback(a, b, ["id"]).collect()] == [1]


def test_fuzzy_match_misses_no_pair(spark):
    """Against the ratio of all pairs; labels have letters lost, doubled and swapped, at the first place too."""
    import random
    from difflib import SequenceMatcher

    rng = random.Random(5)
    names = ["".join(rng.choice("abcdeinorst ") for _ in range(rng.randrange(4, 22))).strip() or "xy" for _ in range(60)]
    labels = []
    for name in names:
        x = list(name)
        for _ in range(rng.randrange(0, 3)):
            k = rng.randrange(len(x))
            x[k : k + 1] = rng.choice([[], [x[k], x[k]], ["z"]])
            x = x or ["q"]
        labels.append("".join(x))
    labels += ["xlexandria", "two one"]
    names += ["alexandria", "one two"]
    clean = lambda s: " ".join(s.split())

    def ratio(a, b):
        a, b = clean(a), clean(b)
        if not a or not b:
            return 0.0
        s, t = {w for w in a.split()}, {w for w in b.split()}
        return 1.0 if a == b else max(SequenceMatcher(None, a, b).ratio(), len(s & t) / len(s | t))

    for least in (0.88, 0.8):
        got = {r["label"]: r["ratio"] for r in gazetteer.fuzzy_match(spark.createDataFrame([(x,) for x in labels], "label string"), spark.createDataFrame([(x, x) for x in names], "place string, alias string"), least).collect()}
        want = {x: max(ratio(x, n) for n in names) for x in labels if clean(x)}
        want = {x: r for x, r in want.items() if r >= least}
        assert set(got) == set(want) and all(abs(got[x] - want[x]) < 1e-9 for x in want)
