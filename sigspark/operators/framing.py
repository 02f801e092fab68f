"""Frames, rolling statistics and buckets over long sample series.

Samples are rows (recording_id, idx, v); idx is dense from 0 in each recording. A
recording may be far longer than a task can hold, so that windows never run over a whole
recording: ``haloed`` deals samples into blocks, each with copies of the rows around
it, and window functions run per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import EPS, to_db

KEY = "recording_id"
#: Samples of a block.
BLOCK = 1 << 16
#: Widths from which on a rolling sum is made from running sums.
WIDE = 64


def haloed(samples: DataFrame, before: int, after: int, block: int = BLOCK, idx: str = "idx") -> DataFrame:
    """samples with block and own: each block has its own rows, ``before`` rows in front and ``after`` behind."""
    lo = F.greatest(F.lit(0), F.floor((F.col(idx) - after) / block))
    hi = F.floor((F.col(idx) + before) / block)
    home = F.floor(F.col(idx) / block)
    spread = samples.withColumn("block", F.explode(F.sequence(F.least(lo, home), F.greatest(hi, home))))
    return spread.withColumn("own", F.floor(F.col(idx) / block) == F.col("block"))


def by_block(idx: str = "idx"):
    """The window of one block in order."""
    return Window.partitionBy(KEY, "block").orderBy(idx)


def hop_frames(samples: DataFrame, window: int, hop: int) -> DataFrame:
    """(recording_id, frame, rms, db): whole frames [frame * hop, frame * hop + window).

    rms is sqrt(mean square + EPS). A recording shorter than a frame gives one frame over all of it.
    """
    n = samples.groupBy(KEY).agg(F.max("idx").alias("last"))
    last = F.greatest(F.lit(0), F.floor((F.col("last") + 1 - window) / hop))
    first = F.greatest(F.lit(0), F.ceil((F.col("idx") - window + 1) / hop))
    at = samples.join(n, KEY).withColumn("last_frame", last)
    upto = F.least(F.floor(F.col("idx") / hop), F.col("last_frame"))
    at = at.where(first <= upto).withColumn("frame", F.explode(F.sequence(first, upto)))
    frames = at.groupBy(KEY, "frame").agg(F.sqrt(F.sum(F.col("v") * F.col("v")) / F.count(F.lit(1)) + EPS).alias("rms"))
    return frames.withColumn("db", to_db(F.col("rms")))


def power_blocks(samples: DataFrame, window: int, hop: int) -> DataFrame:
    """(recording_id, frame, power): mean squares of whole frames; a recording shorter than one has none."""
    first = F.greatest(F.lit(0), F.ceil((F.col("idx") - window + 1) / hop))
    at = samples.withColumn("frame", F.explode(F.sequence(first, F.greatest(first, F.floor(F.col("idx") / hop)))))
    at = at.where(F.col("frame") * hop <= F.col("idx"))
    return at.groupBy(KEY, "frame").agg((F.sum(F.col("v") * F.col("v")) / window).alias("power"), F.count(F.lit(1)).alias("n")).where(F.col("n") == window).drop("n")


def rolling_mean(samples: DataFrame, value: Column, width: int, name: str, block: int = BLOCK) -> DataFrame:
    """samples with ``name``: the centred mean over [i - width // 2, i - width // 2 + width).

    At the right edge the window is cut; at the left edge it keeps its width and starts at 0.
    """
    half = width // 2
    rows = samples.withColumn("_x", value)
    head = rows.where(F.col("idx") < width).groupBy(KEY).agg(F.avg("_x").alias("_head"))
    rows = haloed(rows, width + 1, width + 1, block)
    w = by_block()
    if width < WIDE:
        mean = F.avg("_x").over(w.rowsBetween(-half, width - half - 1))
    else:
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.withColumn("_run", F.sum("_x").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_row", F.row_number().over(w))
        upper = F.coalesce(F.lead("_run", width - half - 1).over(w), F.last("_run").over(whole))
        lower = F.coalesce(F.lag("_run", half + 1).over(w), F.lit(0.0))
        count = F.least(F.col("_row") + (width - half - 1), F.count(F.lit(1)).over(whole)) - F.greatest(F.col("_row") - half - 1, F.lit(0))
        mean = (upper - lower) / count
    rows = rows.withColumn(name, mean).where("own").drop("block", "own", "_run", "_row")
    return rows.join(head, KEY).withColumn(name, F.when(F.col("idx") < half, F.col("_head")).otherwise(F.col(name))).drop("_head", "_x")


def energy_ratio(samples: DataFrame, detect: int, context: int, name: str = "ratio") -> DataFrame:
    """Energy around a sample in relation to that of its wider surroundings."""
    square = F.col("v") * F.col("v")
    both = rolling_mean(rolling_mean(samples, square, detect, "_near"), square, context, "_wide")
    return both.withColumn(name, F.col("_near") / (F.col("_wide") + EPS)).drop("_near", "_wide")


def second_difference(samples: DataFrame, name: str = "curvature", block: int = BLOCK) -> DataFrame:
    """v[i+1] - 2 v[i] + v[i-1], zero at both ends of a recording."""
    w = by_block()
    rows = haloed(samples, 1, 1, block)
    curve = F.lead("v").over(w) - 2 * F.col("v") + F.lag("v").over(w)
    return rows.withColumn(name, F.coalesce(curve, F.lit(0.0))).where("own").drop("block", "own")


def curvature_ratio(samples: DataFrame, context: int, name: str = "ratio") -> DataFrame:
    """The size of a sample's curvature in relation to its surroundings' mean."""
    rows = second_difference(samples)
    rows = rolling_mean(rows, F.abs("curvature"), context, "_mean")
    return rows.withColumn(name, F.abs("curvature") / (F.col("_mean") + EPS)).drop("_mean")


def same_mean(series: DataFrame, value: str, taps: int, name: str, idx: str = "frame") -> DataFrame:
    """Moving average of ``taps`` values, zero beyond the ends: an even number reaches one further to the left."""
    w = Window.partitionBy(KEY).orderBy(idx)
    left = taps // 2
    return series.withColumn(name, F.sum(value).over(w.rowsBetween(-left, taps - left - 1)) / taps)


def running_median(series: DataFrame, value: str, width: int, name: str, idx: str = "frame", keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    """Median of ``width`` values around each, the first and last value repeated beyond the ends."""
    w = Window.partitionBy(*keys).orderBy(idx)
    left, right = width // 2, width - width // 2 - 1
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = series.withColumn("_row", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(whole))
    rows = rows.withColumn("_first", F.first(value).over(whole)).withColumn("_last", F.last(value).over(whole))
    inside = F.collect_list(value).over(w.rowsBetween(-left, right))
    pad_left = F.array_repeat(F.col("_first"), F.greatest(F.lit(0), left - F.col("_row") + 1).cast("int"))
    pad_right = F.array_repeat(F.col("_last"), F.greatest(F.lit(0), F.col("_row") + right - F.col("_n")).cast("int"))
    rows = rows.withColumn("_all", F.array_sort(F.concat(pad_left, inside, pad_right)))
    low, high = F.element_at("_all", (width + 1) // 2), F.element_at("_all", width // 2 + 1)
    return rows.withColumn(name, (low + high) / 2).drop("_row", "_n", "_first", "_last", "_all")


def local_minima(series: DataFrame, value: str, order: int, idx: str = "frame") -> DataFrame:
    """Rows that are strictly smaller than ``order`` neighbours on either side; the ends are none."""
    w = Window.partitionBy(KEY).orderBy(idx)
    left, right = F.min(value).over(w.rowsBetween(-order, -1)), F.min(value).over(w.rowsBetween(1, order))
    return series.withColumn("_l", left).withColumn("_r", right).where((F.col(value) < F.col("_l")) & (F.col(value) < F.col("_r"))).drop("_l", "_r")


def dense_counts(events: DataFrame, position: str, width: int, buckets: DataFrame) -> DataFrame:
    """(recording_id, bucket, n) for every bucket from 0; what lies beyond counts in the last.

    buckets: (recording_id, buckets).
    """
    bucket = F.least(F.floor(F.col(position) / width), F.col("buckets") - 1)
    counts = events.join(buckets, KEY).groupBy(KEY, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    every = buckets.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1))).drop("buckets")
    return every.join(counts, [KEY, "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
