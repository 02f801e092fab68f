"""Where a recording's last programme has settled into its run-out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .framing import KEY, running_median


def settled(levels: DataFrame, *, tail: int, margin: float, median_width: int, anchors: DataFrame | None = None) -> DataFrame:
    """The first frame (from the anchor on) at which every band's running median is at most margin
    over the median of that band's last ``tail`` frames; null if there is none.

    levels: (recording_id, frame, band, db); anchors: (recording_id, anchor).
    """
    rows = running_median(levels, "db", median_width, "level", keys=(KEY, "band")) if median_width > 1 else levels.withColumn("level", F.col("db"))
    back = F.row_number().over(Window.partitionBy(KEY, "band").orderBy(F.desc("frame")))
    ends = levels.withColumn("_back", back).where(F.col("_back") <= tail).groupBy(KEY, "band").agg(F.median("db").alias("_tail"))
    calm = rows.join(ends, [KEY, "band"]).groupBy(KEY, "frame").agg(F.bool_and(F.col("level") <= F.col("_tail") + margin).alias("_calm"))
    if anchors is not None:
        calm = calm.join(anchors, KEY).withColumn("_calm", F.col("_calm") & (F.col("frame") >= F.col("anchor")))
    return calm.groupBy(KEY).agg(F.min(F.when(F.col("_calm"), F.col("frame"))).alias("start_frame"))


def last_programme_window(windows: DataFrame, factor: float = 1.5) -> DataFrame:
    """(recording_id, anchor): the end of the last window whose best period is clearer than the platter's own by factor.

    windows: (recording_id, end_idx, top_r, revolution_r).
    """
    programme = F.col("top_r") > factor * F.greatest("revolution_r", F.lit(0.0))
    return windows.groupBy(KEY).agg(F.max(F.when(programme, F.col("end_idx"))).alias("anchor"), F.max("end_idx").alias("_end")).select(KEY, F.when(F.col("anchor") < F.col("_end"), F.col("anchor")).alias("anchor"))
