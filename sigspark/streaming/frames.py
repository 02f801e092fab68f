"""Frame levels of unbounded signals in event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import EPS, to_db
from ..operators.framing import KEY


def stream_levels(samples: DataFrame, window: str, hop: str, late: str, time: str = "ts") -> DataFrame:
    """(recording_id, start, end, n, rms, db) of sliding windows over a stream (recording_id, ts, v).

    Samples later than ``late`` are dropped by the watermark; a window is emitted once it has passed.
    The same function gives the same rows over a batch.
    """
    rows = samples.withWatermark(time, late) if samples.isStreaming else samples
    got = rows.groupBy(KEY, F.window(time, window, hop)).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("v") * F.col("v")) + EPS).alias("rms"))
    return got.select(KEY, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "rms", to_db(F.col("rms")).alias("db"))


def stream_crossings(samples: DataFrame, threshold: float, gap: str, late: str, time: str = "ts") -> DataFrame:
    """(recording_id, start, end, n, peak) of sessions of samples over a threshold, a pause of ``gap`` ending one."""
    hot = samples.where(F.abs("v") >= threshold)
    hot = hot.withWatermark(time, late) if samples.isStreaming else hot
    got = hot.groupBy(KEY, F.session_window(time, gap)).agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("v")).alias("peak"))
    return got.select(KEY, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "peak")
