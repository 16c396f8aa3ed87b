"""Evidence as a stream: counts by window, travel alarms by subject. The same Column logic as in batch."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.geo import haversine_km


def _timed(points: DataFrame) -> DataFrame:
    """Watermarks want instants; evidence carries times without a zone, which are read as UTC."""
    return points.withColumn("ts", F.to_timestamp("ts"))


def counts(points: DataFrame, window: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Points of each source by time window, with late points up to ``late``."""
    return _timed(points).withWatermark("ts", late).groupBy(F.window("ts", window), "source").agg(F.count(F.lit(1)).alias("points"))


def rapid_moves(points: DataFrame, least_kmh: float = 220.0, late: str = "1 hour") -> DataFrame:
    """Moves of a subject faster than ``least_kmh`` between points as they arrive; state is each subject's last point."""

    def move(key, batches, state):
        last = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        out = []
        for r in rows.itertuples():
            now = (int(r.id), r.ts.value / 1e9, float(r.lat), float(r.lon))
            if last is not None and now[1] > last[1]:
                out.append((key[0], last[0], now[0], (now[1] - last[1]) / 3600, last[2], last[3], now[2], now[3]))
            if last is None or now[1] >= last[1]:
                last = now
        state.update(last)
        yield pd.DataFrame(out, columns=["subject", "prev_id", "id", "hours", "prev_lat", "prev_lon", "lat", "lon"])

    pairs = _timed(points).withWatermark("ts", late).groupBy("subject").applyInPandasWithState(
        move, "subject long, prev_id long, id long, hours double, prev_lat double, prev_lon double, lat double, lon double", "id long, ts double, lat double, lon double", "append", GroupStateTimeout.NoTimeout
    )
    km = haversine_km(F.col("prev_lat"), F.col("prev_lon"), F.col("lat"), F.col("lon"))
    return pairs.withColumn("km", km).where((F.col("km") >= 25) & (F.col("km") / F.col("hours") >= least_kmh))
