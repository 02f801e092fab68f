"""Runs and intervals: gaps and islands, merging, range joins, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .framing import BLOCK, KEY


def runs_of_true(rows: DataFrame, flag: Column, idx: str = "idx", block: int = BLOCK) -> DataFrame:
    """(recording_id, start_idx, end_idx): maximal runs where flag holds, end exclusive.

    Runs are found within blocks of idx, each in one task, and then joined across the blocks' edges.
    """
    hot = rows.where(flag).select(KEY, F.col(idx).alias("i")).withColumn("block", F.floor(F.col("i") / block))
    place = F.row_number().over(Window.partitionBy(KEY, "block").orderBy("i"))
    runs = hot.withColumn("g", F.col("i") - place).groupBy(KEY, "block", "g").agg(F.min("i").alias("start_idx"), (F.max("i") + 1).alias("end_idx"))
    return merge_runs(runs.select(KEY, "start_idx", "end_idx"), 1)


def merge_runs(runs: DataFrame, gap: int, keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    """Runs with fewer than ``gap`` values between them become one."""
    w = Window.partitionBy(*keys).orderBy("start_idx", "end_idx")
    reach = F.max("end_idx").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("start_idx") - reach < gap, 0).otherwise(1)
    rows = runs.withColumn("_new", fresh).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_g").agg(F.min("start_idx").alias("start_idx"), F.max("end_idx").alias("end_idx")).drop("_g")


def covered(points: DataFrame, position: str, spans: DataFrame, bin_width: int = BLOCK) -> DataFrame:
    """points with inside: whether a span [start_idx, end_idx) of the same recording holds the position.

    A range join by equal bins: a span stands in every bin that it touches.
    """
    first, last = F.floor(F.col("start_idx") / bin_width), F.floor((F.col("end_idx") - 1) / bin_width)
    binned = spans.where("end_idx > start_idx").select(KEY, "start_idx", "end_idx", F.explode(F.sequence(first, last)).alias("_bin"))
    at = points.withColumn("_bin", F.floor(F.col(position) / bin_width))
    hit = at.join(binned, [KEY, "_bin"], "left").withColumn("_in", (F.col(position) >= F.col("start_idx")) & (F.col(position) < F.col("end_idx")))
    own = [c for c in points.columns]
    return hit.groupBy(*own).agg(F.coalesce(F.bool_or("_in"), F.lit(False)).alias("inside"))


def inside_spans(rows: DataFrame, idx: str, spans: DataFrame, bin_width: int = BLOCK) -> DataFrame:
    """Every row with every span that holds it (inner join by equal bins)."""
    first, last = F.floor(F.col("start_idx") / bin_width), F.floor((F.col("end_idx") - 1) / bin_width)
    binned = spans.where("end_idx > start_idx").withColumn("_bin", F.explode(F.sequence(first, last)))
    at = rows.withColumn("_bin", F.floor(F.col(idx) / bin_width))
    return at.join(binned, [KEY, "_bin"]).where((F.col(idx) >= F.col("start_idx")) & (F.col(idx) < F.col("end_idx"))).drop("_bin")


def nearest(points: DataFrame, position: str, spans: DataFrame, reach: int) -> DataFrame:
    """For each point the nearest span within reach (0 inside); ties go to the smaller start."""
    lo, hi = F.floor((F.col(position) - reach) / BLOCK), F.floor((F.col(position) + reach) / BLOCK)
    at = points.withColumn("_bin", F.explode(F.sequence(lo, hi)))
    first, last = F.floor(F.col("start_idx") / BLOCK), F.floor((F.col("end_idx") - 1) / BLOCK)
    binned = spans.withColumn("_bin", F.explode(F.sequence(first, last)))
    p = F.col(position)
    far = F.when((p >= F.col("start_idx")) & (p < F.col("end_idx")), 0).otherwise(F.least(F.abs(F.col("start_idx") - p), F.abs(F.col("end_idx") - p)))
    found = at.join(binned, [KEY, "_bin"]).withColumn("_far", far).where(F.col("_far") <= reach)
    return found.groupBy(*points.columns).agg(F.min(F.struct("_far", "start_idx", "end_idx")).alias("_hit")).select(*points.columns, "_hit.start_idx", "_hit.end_idx", F.col("_hit._far").alias("distance"))


def consecutive(rows: DataFrame, order: tuple[str, ...], columns: tuple[str, ...], keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    """Each row with the named columns of the one before it, as prev_<name>."""
    w = Window.partitionBy(*keys).orderBy(*order)
    for c in columns:
        rows = rows.withColumn(f"prev_{c}", F.lag(c).over(w))
    return rows
