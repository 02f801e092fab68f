"""Levels, gates and distributions: aggregates of one or two passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import EPS, clip, first_argmax, to_db
from .framing import KEY
from .intervals import runs_of_true


def peaks(samples: DataFrame) -> DataFrame:
    """Sample peak, its first place, overall RMS and crest factor of each recording."""
    got = samples.groupBy(KEY).agg(
        F.max(F.abs("v")).alias("peak"), first_argmax(F.abs(F.col("v")), F.col("idx")).alias("peak_sample"), F.sqrt(F.avg(F.col("v") * F.col("v")) + EPS).alias("rms")
    )
    got = got.select(KEY, to_db(F.col("peak")).alias("peak_db"), "peak_sample", to_db(F.col("rms")).alias("rms_db"))
    return got.withColumn("crest_factor_db", F.col("peak_db") - F.col("rms_db"))


def gated_level(blocks: DataFrame, value: Column, level: Column, keys: tuple[str, ...], *, absolute: float = -70.0, relative: float = -10.0, offset: float = 0.0) -> DataFrame:
    """Mean power of the blocks that pass two gates, per group.

    value: a block's power; level: its level in dB. The first gate is absolute, the second lies ``relative``
    below the level of those that passed the first; both are strict. A gate that nothing passes lets all pass.
    Two aggregations; the groups' values are joined back to the blocks.
    """
    rows = blocks.withColumn("_p", value).withColumn("_l", level)
    mean = lambda keep: F.avg(F.when(keep, F.col("_p")))
    first = rows.groupBy(*keys).agg(F.coalesce(mean(F.col("_l") > absolute), F.avg("_p")).alias("_m1"), F.count(F.when(F.col("_l") > absolute, 1)).alias("_n1"))
    rows = rows.join(first, list(keys)).withColumn("_gate", offset + 10 * F.log10(F.greatest(F.col("_m1"), F.lit(EPS * EPS))) + relative)
    passed = (F.col("_l") > F.col("_gate")) & ((F.col("_l") > absolute) | (F.col("_n1") == 0))
    got = rows.groupBy(*keys).agg(F.coalesce(F.avg(F.when(passed, F.col("_p"))), F.first("_m1")).alias("power"), F.count(F.lit(1)).alias("n_blocks"), F.first("_n1").alias("n_absolute"), F.count(F.when(passed, 1)).alias("n_relative"))
    return got.withColumn("level_db", offset + 10 * F.log10(F.greatest(F.col("power"), F.lit(EPS * EPS))))


def noise_floor(frames: DataFrame, floor_p: float = 0.05, quiet_p: float = 0.10) -> DataFrame:
    """The floor percentile of the frames' dB, the spread of the quiet ones, and a confidence."""
    q = frames.groupBy(KEY).agg(F.percentile("db", F.array(F.lit(floor_p), F.lit(quiet_p))).alias("q"))
    q = q.select(KEY, F.col("q")[0].alias("noise_floor_db"), F.col("q")[1].alias("_quiet"))
    got = frames.join(q, KEY).where(F.col("db") <= F.col("_quiet")).groupBy(KEY, "noise_floor_db").agg(F.coalesce(F.stddev_pop("db"), F.lit(0.0)).alias("stability_db"))
    return got.withColumn("confidence", clip(1 - F.col("stability_db") / 6, 0.1, 0.99))


def dynamic_range(frames: DataFrame, peak: DataFrame) -> DataFrame:
    """Peak level over the 95th percentile of frame levels; a recording without frames uses its RMS."""
    q = frames.groupBy(KEY).agg(F.percentile("db", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("q"))
    got = peak.join(q, KEY, "left").withColumn("loud_rms_db", F.coalesce(F.col("q")[2], F.col("rms_db")))
    return got.select(KEY, (F.col("peak_db") - F.col("loud_rms_db")).alias("dr_estimate_db"), "loud_rms_db", F.col("q")[0].alias("p05"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p95"))


def clipping(samples: DataFrame, level: float = 0.9999, run: int = 3) -> DataFrame:
    """Clipped samples, runs of at least ``run`` of them, the longest run and the clipped share."""
    hot = F.abs("v") >= level
    runs = runs_of_true(samples, hot).withColumn("len", F.col("end_idx") - F.col("start_idx"))
    runs = runs.groupBy(KEY).agg(F.count(F.when(F.col("len") >= run, 1)).alias("clipped_runs"), F.max("len").alias("longest_run"))
    got = samples.groupBy(KEY).agg(F.count(F.when(hot, 1)).alias("clipped_samples"), F.count(F.lit(1)).alias("n")).join(runs, KEY, "left")
    return got.select(KEY, "clipped_samples", F.coalesce("clipped_runs", F.lit(0)).alias("clipped_runs"), F.coalesce("longest_run", F.lit(0)).alias("longest_run"), (F.col("clipped_samples") / F.col("n")).alias("clipped_ratio"))


def stereo_info(samples: DataFrame, left: str = "l", right: str = "r") -> DataFrame:
    """DC offset, peak and RMS of both channels, their balance in dB and their correlation."""
    l, r = F.col(left), F.col(right)
    got = samples.groupBy(KEY).agg(
        F.avg(l).alias("dc_left"), F.avg(r).alias("dc_right"), to_db(F.max(F.abs(l))).alias("peak_left_db"), to_db(F.max(F.abs(r))).alias("peak_right_db"),
        to_db(F.sqrt(F.avg(l * l) + EPS)).alias("rms_left_db"), to_db(F.sqrt(F.avg(r * r) + EPS)).alias("rms_right_db"),
        F.stddev_pop(l).alias("_sl"), F.stddev_pop(r).alias("_sr"), F.corr(l, r).alias("_corr"),
    )
    got = got.withColumn("balance_db", F.col("rms_left_db") - F.col("rms_right_db"))
    return got.withColumn("correlation", F.when((F.col("_sl") > EPS) & (F.col("_sr") > EPS), F.col("_corr"))).drop("_sl", "_sr", "_corr")


def histogram(rows: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) for every bin: values beyond the edges count in the outer bins, the last bin holds its upper edge."""
    b = F.floor((clip(value, low, high) - low) * bins / (high - low))
    counts = rows.groupBy(F.least(b, F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = rows.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def remove_dc(samples: DataFrame) -> DataFrame:
    """samples less their recording's mean."""
    mean = samples.groupBy(KEY).agg(F.avg("v").alias("_dc"))
    return samples.join(mean, KEY).withColumn("v", F.col("v") - F.col("_dc")).drop("_dc")


def phase_concentration(positions: DataFrame, position: str, period: float) -> DataFrame:
    """n, resultant length r and Rayleigh's z of positions folded onto a period; null for fewer than 4."""
    import math

    phase = 2 * math.pi * ((F.col(position) % F.lit(period)) / period)
    got = positions.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), F.avg(F.cos(phase)).alias("_c"), F.avg(F.sin(phase)).alias("_s"))
    r = F.when(F.col("n") >= 4, F.sqrt(F.col("_c") ** 2 + F.col("_s") ** 2))
    return got.withColumn("r", r).withColumn("z", F.col("n") * r * r).drop("_c", "_s")


def robust_sigma(rows: DataFrame, value: Column, keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    """1.4826 times the median absolute deviation, per group, as sigma."""
    x = rows.withColumn("_x", value)
    m = x.groupBy(*keys).agg(F.median("_x").alias("_m"))
    return x.join(m, list(keys)).groupBy(*keys).agg((1.4826 * F.median(F.abs(F.col("_x") - F.col("_m")))).alias("sigma"))


def correlation_at_lag(samples: DataFrame, lag: int, block: int | None = None) -> DataFrame:
    """Normalised autocorrelation at one lag, of the series less its mean: an equi-join on idx."""
    x = remove_dc(samples).select(KEY, "idx", "v")
    energy = x.groupBy(KEY).agg(F.sum(F.col("v") * F.col("v")).alias("_e"))
    shifted = x.select(KEY, (F.col("idx") + lag).alias("idx"), F.col("v").alias("_w"))
    got = x.join(shifted, [KEY, "idx"]).groupBy(KEY).agg(F.sum(F.col("v") * F.col("_w")).alias("_s"))
    return energy.join(got, KEY).select(KEY, F.when(F.col("_e") > EPS, F.col("_s") / F.col("_e")).otherwise(0.0).alias("r"))
