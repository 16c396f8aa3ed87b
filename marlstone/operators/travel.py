"""Movement of a subject in time: impossible travel, outliers, jumps, gaps, scenes."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_km, jump_km

#: Limits in km, km/h and hours.
NEAR_KM, IMPOSSIBLE_KMH, IMPOSSIBLE_KM, RAPID_KMH, RAPID_KM, RAPID_HOURS = 25, 900, 50, 220, 40, 6


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1e6


def with_previous(points: DataFrame, subject: str, order: list[str]) -> DataFrame:
    """Adds what the subject's previous point was: prev_id, prev_lat, prev_lon, hours, km."""
    w = Window.partitionBy(subject).orderBy(*order)
    before = {n: F.lag(n).over(w) for n in ("id", "ts", "lat", "lon")}
    out = points.withColumns({f"prev_{n}": c for n, c in before.items()}).where("prev_id is not null")
    out = out.withColumn("hours", seconds_between(F.to_timestamp("ts"), F.to_timestamp("prev_ts")) / 3600)
    return out.withColumn("km", haversine_km(F.col("prev_lat"), F.col("prev_lon"), F.col("lat"), F.col("lon")))


def impossible_travel(points: DataFrame, subject: str) -> DataFrame:
    """Pairs of consecutive points that no one travels: flag, delta, and the share of it that the earlier point bears."""
    pairs = with_previous(points, subject, ["ts", "id"]).where(F.col("km") >= NEAR_KM)
    speed = F.col("km") / F.col("hours")
    flag = (
        F.when(F.col("hours") <= 0, "time_geo_conflict")
        .when((speed >= IMPOSSIBLE_KMH) & (F.col("km") >= IMPOSSIBLE_KM), "impossible_travel")
        .when((speed >= RAPID_KMH) & (F.col("km") >= RAPID_KM) & (F.col("hours") <= RAPID_HOURS), "rapid_travel")
    )
    out = pairs.withColumn("flag", flag).where("flag is not null")
    delta = F.when(F.col("flag") == "time_geo_conflict", 20).when(F.col("flag") == "impossible_travel", 22).otherwise(12)
    return out.withColumn("delta", delta).withColumn("peer_delta", F.greatest(F.lit(4), F.floor(F.col("delta") / 3).cast("int")))


def contradictions(points: DataFrame, subject: str, most: int = 20) -> DataFrame:
    """The first ``most`` pairs of each subject that are out of order or faster than 220 km/h."""
    pairs = with_previous(points, subject, ["ts", "id"]).where((F.col("hours") <= 0) | (F.col("km") / F.col("hours") >= RAPID_KMH))
    nth = F.row_number().over(Window.partitionBy(subject).orderBy("ts", "id"))
    return pairs.withColumn("nth", nth).where(F.col("nth") <= most)


def geo_outliers(points: DataFrame, case: str) -> DataFrame:
    """Points far from their case's median centre; cases of three points or more. Aggregates join back, so no case is one task's."""
    centre = points.groupBy(case).agg(F.count(F.lit(1)).alias("points"), F.median("lat").alias("c_lat"), F.median("lon").alias("c_lon")).where("points >= 3")
    far = points.join(centre, case).withColumn("km", haversine_km(F.col("c_lat"), F.col("c_lon"), F.col("lat"), F.col("lon")))
    middle = far.groupBy(case).agg(F.median("km").alias("median_km"))
    limit = F.greatest(F.lit(35.0), 3.5 * F.col("median_km") + 15)
    return far.join(middle, case).withColumn("limit_km", limit).where((F.col("km") > F.col("limit_km")) & (F.col("km") >= 45))


def spatial_jumps(points: DataFrame, case: str, order: str, least_km: float = 500) -> DataFrame:
    """Consecutive anchors, in order of ingest, that lie ``least_km`` or more apart."""
    w = Window.partitionBy(case).orderBy(order)
    out = points.withColumns({"p_lat": F.lag("lat").over(w), "p_lon": F.lag("lon").over(w), "prev_id": F.lag("id").over(w)}).where("prev_id is not null")
    return out.withColumn("km", jump_km(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"))).where(F.col("km") >= least_km)


def timeline_gaps(points: DataFrame, case: str, least_hours: float = 4) -> DataFrame:
    w = Window.partitionBy(case).orderBy("ts", "id")
    out = points.withColumns({"prev_id": F.lag("id").over(w), "prev_ts": F.lag("ts").over(w)}).where("prev_id is not null")
    return out.withColumn("hours", seconds_between(F.to_timestamp("ts"), F.to_timestamp("prev_ts")) / 3600).where(F.col("hours") >= least_hours)


def timeline_span(points: DataFrame, case: str) -> DataFrame:
    ends = points.groupBy(case).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("points"))
    return ends.withColumn("hours", F.round(seconds_between(F.to_timestamp("last_ts"), F.to_timestamp("first_ts")) / 3600, 1))


def scene_groups(records: DataFrame, case: str, hours: float = 6) -> DataFrame:
    """(case, id, scene, members) of the records of ``records(case, id, ts, source, app, duplicate_group)`` that share a scene.

    In the order of time, then id, a record joins the first scene whose first record has its duplicate group, or its source
    or app within ``hours``; else it starts one. A record without a time starts one that no other joins.
    Scenes are first-fit, and so a scan; a task sorts its cases and remembers only the scenes that a
    later record may still join: those within the window, and the first of each duplicate group.
    """
    kinds = dict(records.dtypes)
    limit = hours * 3600

    def scan(batches):
        now, number = object(), 0
        for pdf in batches:
            out = []
            for c, ts, source, app, group in zip(pdf[case], pdf["ts"], pdf["source"], pdf["app"], pdf["duplicate_group"]):
                if c != now:
                    now, number, by_source, by_app, by_group = c, 0, {}, {}, {}
                if pd.isna(ts):
                    number += 1
                    out.append(number)
                    continue
                fits = [by_group[group]] if group and group in by_group else []
                for held, key in ((by_source, source), (by_app, app if app != "Unknown" else None)):
                    queue = held.get(key) if key is not None else None
                    while queue and (ts - queue[0][0]).total_seconds() > limit:
                        queue.popleft()
                    if queue:
                        fits.append(queue[0][1])
                if fits:
                    out.append(min(fits))
                    continue
                number += 1
                by_source.setdefault(source, deque()).append((ts, number))
                by_app.setdefault(app, deque()).append((ts, number))
                if group:
                    by_group.setdefault(group, number)
                out.append(number)
            yield pd.DataFrame({case: pdf[case], "id": pdf["id"], "scene": out})

    rows = records.select(case, "id", "ts", "source", F.coalesce("app", F.lit("Unknown")).alias("app"), F.coalesce("duplicate_group", F.lit("")).alias("duplicate_group"))
    rows = rows.repartition(case).sortWithinPartitions(case, F.col("ts").isNull(), "ts", "id")
    labelled = rows.mapInPandas(scan, f"{case} {kinds[case]}, id {kinds['id']}, scene int")
    sizes = labelled.groupBy(case, "scene").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return labelled.join(sizes, [case, "scene"])
