"""Silence regions and track boundaries over frame levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .framing import KEY, local_minima, same_mean
from .intervals import inside_spans, runs_of_true


def regions(frames: DataFrame, threshold: DataFrame, lengths: DataFrame, window: int, hop: int, min_frames: int) -> DataFrame:
    """Runs of at least min_frames frames at or under the threshold, as sample spans.

    threshold: (recording_id, threshold_db); lengths: (recording_id, n). A run at the first or last
    frame reaches to the recording's edge.
    """
    quiet = frames.join(threshold, KEY)
    runs = runs_of_true(quiet, F.col("db") <= F.col("threshold_db"), idx="frame").withColumnsRenamed({"start_idx": "start_frame", "end_idx": "end_frame"})
    runs = runs.where(F.col("end_frame") - F.col("start_frame") >= min_frames)
    last = frames.groupBy(KEY).agg((F.max("frame") + 1).alias("_frames"))
    got = runs.join(last, KEY).join(lengths, KEY)
    start = F.when(F.col("start_frame") == 0, F.lit(0)).otherwise(F.col("start_frame") * hop)
    end = F.when(F.col("end_frame") == F.col("_frames"), F.col("n")).otherwise((F.col("end_frame") - 1) * hop + window)
    return got.select(KEY, start.cast("long").alias("start_idx"), end.cast("long").alias("end_idx"), "start_frame", "end_frame", "n")


def music_edges(frames: DataFrame, found: DataFrame, margin: float, value: str = "db") -> DataFrame:
    """The settling frames of each region: the first at most margin over its minimum (where the
    programme has ended) and the last at most margin over its median (before it begins)."""
    spans = found.select(KEY, F.col("start_frame").alias("start_idx"), F.col("end_frame").alias("end_idx"))
    rows = inside_spans(frames, "frame", spans).withColumnsRenamed({"start_idx": "start_frame", "end_idx": "end_frame"})
    stat = rows.groupBy(KEY, "start_frame", "end_frame").agg(F.min(value).alias("_min"), F.median(value).alias("_median"))
    rows = rows.join(stat, [KEY, "start_frame", "end_frame"])
    got = rows.groupBy(KEY, "start_frame", "end_frame").agg(
        F.min(F.when(F.col(value) <= F.col("_min") + margin, F.col("frame"))).alias("end_of_music"), F.max(F.when(F.col(value) <= F.col("_median") + margin, F.col("frame"))).alias("start_of_music")
    )
    return got.withColumn("end_of_music", F.coalesce("end_of_music", F.col("end_frame") - 1)).withColumn("start_of_music", F.coalesce("start_of_music", "start_frame"))


def valleys(frames: DataFrame, taps: int, order: int, depth: float) -> DataFrame:
    """Local minima of the smoothed levels at least depth under their 90th percentile."""
    smooth = same_mean(frames, "db", taps, "smooth")
    high = smooth.groupBy(KEY).agg(F.percentile("smooth", F.lit(0.9)).alias("_p90"))
    low = local_minima(smooth, "smooth", order).join(high, KEY)
    return low.where(F.col("smooth") <= F.col("_p90") - depth).select(KEY, "frame", "smooth", (F.col("_p90") - F.col("smooth")).alias("depth_db"))


def candidates(found: DataFrame, low: DataFrame, hop: int) -> DataFrame:
    """Boundary candidates of both detectors, by sample and method: the middles of inner regions, and valleys."""
    inner = found.where((F.col("start_idx") > 0) & (F.col("end_idx") < F.col("n")))
    silent = inner.select(KEY, F.expr("(start_idx + end_idx) div 2").alias("sample"), F.lit("silence").alias("method"))
    dips = low.select(KEY, (F.col("frame") * hop).cast("long").alias("sample"), F.lit("rms_valley").alias("method"))
    return silent.unionByName(dips).orderBy(KEY, "sample", "method")


def playable(found: DataFrame, lengths: DataFrame) -> DataFrame:
    """Where the lead-in ends (a region at 0) and the lead-out begins (a region at the end)."""
    got = found.groupBy(KEY).agg(F.min(F.when(F.col("start_idx") == 0, F.col("end_idx"))).alias("lead_in_end_sample"), F.max(F.when(F.col("end_idx") == F.col("n"), F.col("start_idx"))).alias("lead_out_start_sample"))
    return lengths.select(KEY).join(got, KEY, "left")
