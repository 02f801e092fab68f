"""The tables of an input folder as signals: rows (recording_id, idx, v), idx dense from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.framing import KEY

#: Divides event values into the range of samples; nominal samples per second.
SCALE, RATE = 600.0, 100


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_mono(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one recording; event_id is dense in time order."""
    return read(spark, sf_dir, "events").select(F.lit("events").alias(KEY), F.col("event_id").alias("idx"), (F.col("value") / SCALE).alias("v"))


def events_by(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    """One recording per value of a column, in time order."""
    place = F.row_number().over(Window.partitionBy(column).orderBy("ts", "event_id")) - 1
    return read(spark, sf_dir, "events").select(F.col(column).cast("string").alias(KEY), place.cast("long").alias("idx"), (F.col("value") / SCALE).alias("v"))


def lineitem_stereo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stereo recording per return flag: (recording_id, idx, l, r)."""
    place = F.row_number().over(Window.partitionBy("l_returnflag").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")) - 1
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias(KEY), place.cast("long").alias("idx"), (F.col("l_extendedprice") / 1e5).alias("l"), (F.col("l_quantity") / 50).alias("r")
    )


def embedding_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a frame of samples: (recording_id, frame, idx, v), one recording per label."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias(KEY), F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("idx", "v"))
    return rows.select(KEY, "frame", F.col("idx").cast("long"), F.col("v").cast("double").alias("v"))
