"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each linked node reaches, itself included.

    Alternates two steps until nothing changes: every node ties its larger neighbours to
    its smallest one, then its smaller neighbours. Each step is an aggregation and
    a join, each round is written to the shared folder, and the driver sees two
    numbers. Links of a node with itself and repeated links do no harm; nodes
    without links are not in the result. Null ends are left out.
    """
    links = links.select(F.col(a).alias("hi"), F.col(b).alias("lo")).where("hi is not null and lo is not null and hi <> lo")
    pairs = cut(links.select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct(), "links")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())

    now = state(pairs)
    while now[0]:
        both = pairs.union(pairs.select("lo", "hi")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        large = cut(large, "links")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(least, "hi")
        small = joined.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").union(least.select("hi", F.col("m").alias("lo"))).distinct()
        before, pairs = pairs, cut(small, "links")
        was, now = now, state(pairs)
        drop(before)  # the rounds leave one table
        drop(large)
        if was == now:
            break
    roots = pairs.groupBy("hi").agg(F.min("lo").alias("root")).select(F.col("hi").alias("node"), "root")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
