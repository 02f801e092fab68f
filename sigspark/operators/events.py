"""Event detection by local ratios, and what events say about a recording."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import EPS
from .framing import KEY, by_block, haloed
from .intervals import covered, inside_spans, runs_of_true


def ratio_runs(rows: DataFrame, threshold: float, column: str = "ratio") -> DataFrame:
    """Runs in which the ratio lies over the threshold."""
    return runs_of_true(rows, F.col(column) > threshold)


def crackle(rows: DataFrame, threshold: float, max_width: int) -> DataFrame:
    """Runs of at most max_width samples with their largest amplitude; wider ones are dropped."""
    runs = ratio_runs(rows, threshold).where(F.col("end_idx") - F.col("start_idx") <= max_width)
    inside = inside_spans(rows.where(F.col("ratio") > threshold).select(KEY, "idx", "v"), "idx", runs)
    return inside.groupBy(KEY, "start_idx", "end_idx").agg(F.max(F.abs("v")).alias("peak"))


def ladder(rows: DataFrame, thresholds: tuple[float, ...], column: str = "ratio") -> DataFrame:
    """(recording_id, threshold, start_idx, end_idx) for each rung; only samples over the lowest rung are repeated."""
    hot = rows.where(F.col(column) > min(thresholds)).select(KEY, "idx", column)
    rungs = hot.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))).where(F.col(column) > F.col("threshold"))
    keyed = rungs.select(F.struct(KEY, "threshold").alias(KEY), "idx")
    runs = runs_of_true(keyed, F.lit(True))
    return runs.select(F.col(f"{KEY}.{KEY}").alias(KEY), F.col(f"{KEY}.threshold").alias("threshold"), "start_idx", "end_idx")


def rates_by_region(events: DataFrame, spans: DataFrame, lengths: DataFrame, per: float) -> DataFrame:
    """Events inside and outside of spans, and their rates per ``per`` samples (null without samples there)."""
    hits = covered(events.select(KEY, "start_idx").withColumnRenamed("start_idx", "position"), "position", spans)
    counts = hits.groupBy(KEY).agg(F.count(F.when(F.col("inside"), 1)).alias("inside"), F.count(F.when(~F.col("inside"), 1)).alias("outside"))
    size = spans.groupBy(KEY).agg(F.sum(F.col("end_idx") - F.col("start_idx")).alias("_span"))
    got = lengths.join(counts, KEY, "left").join(size, KEY, "left").na.fill(0, ["inside", "outside", "_span"])
    rate = lambda n, d: F.when(d > 0, n * per / d)
    return got.select(KEY, "inside", "outside", rate(F.col("inside"), F.col("_span")).alias("inside_rate"), rate(F.col("outside"), F.col("n") - F.col("_span")).alias("outside_rate"))


def onsets(frames: DataFrame, mad_factor: float, min_rise: float) -> DataFrame:
    """First frames of runs of rises over max(mad_factor * sigma, min_rise) dB; frame i rises to i + 1."""
    from .levels import robust_sigma

    rise = haloed(frames.withColumnRenamed("frame", "idx"), 0, 1).withColumn("_next", F.lead("db").over(by_block())).where("own and _next is not null")
    rise = rise.select(KEY, "idx", F.greatest(F.col("_next") - F.col("db"), F.lit(0.0)).alias("rise"))
    sigma = robust_sigma(rise, F.col("rise"))
    hot = rise.join(sigma, KEY)
    return runs_of_true(hot, F.col("rise") > F.greatest(mad_factor * F.col("sigma"), F.lit(min_rise))).select(KEY, F.col("start_idx").alias("frame"))


def onset_coincidence(samples: DataFrame, events: DataFrame, window: int, stride: int = 64, rise_db: float = 6.0) -> DataFrame:
    """How much more often events sit on a rise of energy than places of a fixed grid do."""
    from pyspark.sql import Window

    square = F.col("v") * F.col("v")
    rows = haloed(samples, window, window)
    w = by_block()
    rows = rows.withColumn("_b", F.sum(square).over(w.rowsBetween(-window, -1))).withColumn("_a", F.sum(square).over(w.rowsBetween(0, window - 1))).where("own")
    n = samples.groupBy(KEY).agg((F.max("idx") + 1).alias("n"))
    rows = rows.join(n, KEY).where((F.col("idx") >= window) & (F.col("idx") < F.col("n") - window))
    rows = rows.withColumn("rises", (10 * F.log10((F.col("_a") + EPS) / (F.col("_b") + EPS)) > rise_db).cast("int"))
    grid = rows.where((F.col("idx") - window) % stride == 0).groupBy(KEY).agg(F.avg("rises").alias("_grid"), F.count(F.lit(1)).alias("_size"))
    at = events.select(KEY, F.col("start_idx").alias("idx"))
    found = rows.join(at, [KEY, "idx"]).groupBy(KEY).agg(F.avg("rises").alias("_found"), F.count(F.lit(1)).alias("events"))
    return found.join(grid, KEY).select(KEY, "events", (F.col("_found") / F.greatest(F.col("_grid"), 1 / F.col("_size"))).alias("coincidence"))
