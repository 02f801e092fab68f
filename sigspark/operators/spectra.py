"""Spectral measurements of framed samples by a small discrete Fourier transform."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import EPS
from .framing import KEY


def twiddles(spark, size: int) -> DataFrame:
    """(bin, idx, c, s) of a transform of ``size`` points, one-sided: of a size fixed by the frame."""
    rows = spark.range(size // 2 + 1).withColumnRenamed("id", "bin").withColumn("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))))
    angle = 2 * math.pi * ((F.col("bin") * F.col("idx")) % size) / size
    return rows.withColumn("c", F.cos(angle)).withColumn("s", F.sin(angle))


def power_spectrum(frames: DataFrame, size: int) -> DataFrame:
    """(recording_id, frame, bin, power) of frames (recording_id, frame, idx, v) of ``size`` samples each."""
    table = F.broadcast(twiddles(frames.sparkSession, size))  # size * (size / 2 + 1) rows
    got = frames.join(table, "idx").groupBy(KEY, "frame", "bin").agg(F.sum(F.col("v") * F.col("c")).alias("_re"), F.sum(F.col("v") * F.col("s")).alias("_im"))
    return got.select(KEY, "frame", "bin", (F.col("_re") ** 2 + F.col("_im") ** 2).alias("power"))


def band_levels(spectrum: DataFrame, size: int, edges: tuple[int, ...]) -> DataFrame:
    """(recording_id, frame, band, db): mean square within [edges[band], edges[band + 1]) bins, one-sided."""
    sides = F.when((F.col("bin") == 0) | (F.col("bin") == size // 2), 1.0).otherwise(2.0)
    band = F.lit(None).cast("int")
    for k, (lo, hi) in enumerate(zip(edges, edges[1:])):
        band = F.when((F.col("bin") >= lo) & (F.col("bin") < hi), F.lit(k)).otherwise(band)
    rows = spectrum.withColumn("band", band).where("band is not null").withColumn("_ms", F.col("power") * sides / (size * size))
    return rows.groupBy(KEY, "frame", "band").agg((10 * F.log10(F.greatest(F.sum("_ms"), F.lit(EPS * EPS)))).alias("db"))


def centroids(spectrum: DataFrame) -> DataFrame:
    """Mean and spread of the frames' spectral centroids, in bins, weighted by magnitude."""
    m = F.sqrt("power")
    per = spectrum.groupBy(KEY, "frame").agg((F.sum(F.col("bin") * m) / (F.sum(m) + EPS)).alias("_c"))
    return per.groupBy(KEY).agg(F.avg("_c").alias("centroid_mean"), F.stddev_pop("_c").alias("centroid_std"))


def rolloff(spectrum: DataFrame, share: float = 0.85) -> DataFrame:
    """The first bin up to which a recording's mean power reaches a share of the whole."""
    mean = spectrum.groupBy(KEY, "bin").agg(F.avg("power").alias("p"))
    w = Window.partitionBy(KEY).orderBy("bin")
    run = mean.withColumn("_run", F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return run.where(F.col("_run") >= share * F.col("_all")).groupBy(KEY).agg(F.min("bin").alias("rolloff_bin"))


def flux(spectrum: DataFrame) -> DataFrame:
    """(recording_id, frame, flux): the sum of magnitude rises since the frame before (frames in order)."""
    w = Window.partitionBy(KEY, "bin").orderBy("frame")
    m = F.sqrt("power")
    rise = spectrum.withColumn("_m", m).withColumn("_before", F.lag("_m").over(w)).where("_before is not null")
    return rise.withColumn("_d", F.greatest(F.col("_m") - F.col("_before"), F.lit(0.0))).groupBy(KEY, "frame").agg(F.sum("_d").alias("flux"))
