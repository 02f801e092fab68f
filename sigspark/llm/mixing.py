"""Mixing sources to target weights by entropy balancing [DataFrame functions only].

Each document gets a rate r = min(2, exp(lambda_source * size)): the rates that lie
closest (in relative entropy, per document) to one copy of each while a source's
words meet its target. lambda is the zero of the gradient of a convex dual and is
found for all sources at once by distributed Newton steps over a (source, size)
histogram. Rates are then rounded into whole copies by cumulative rounding within
bounded buckets of a source, and a few correction passes bring each bucket's words
to its share of the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, pick, table

#: Weights by rank of the source, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Rows of a source that one rounding bucket holds, about.
BUCKET_ROWS = 8192
_WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, source_size, n, target) of (source, size) rows.

    Sources stand in code-point order, null last. The words to share are ``share`` times
    all sizes; a target stops at ``most`` times its source's size and the excess
    goes to the others by weight until none is above. That is the level L with
    sum(min(cap, L * weight)) = total: sources are filled in the order of
    cap / weight, found by running sums over the one row a source has.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    kinds = len(weights)
    rank = F.row_number().over(order) - 1
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % kinds + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("fill", F.col("cap") / F.col("w"))
    everything = Window.orderBy("fill", F.col("source").isNull(), "source")
    before = everything.rowsBetween(Window.unboundedPreceding, -1)
    whole = everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("total", F.lit(share) * F.sum("source_size").over(whole))
    per = per.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    per = per.withColumn("rest_w", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    per = per.withColumn("level", (F.col("total") - F.col("capped")) / F.col("rest_w"))
    # The first source that the level does not fill fixes it for all that follow.
    open_level = F.when(F.col("level") * F.col("w") < F.col("cap"), F.col("level"))
    per = per.withColumn("level", F.first(open_level, ignorenulls=True).over(everything.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("w")))
    return per.select("source", "source_size", "n", target.alias("target"))


def _rate(lam: Column, x: Column, most: float) -> Column:
    return F.when(lam.isNull(), F.lit(most)).otherwise(F.least(F.lit(most), F.exp(F.least(F.lit(50.0), lam * x))))


def solve_tilts(hist: DataFrame, targets: DataFrame, most: float = 2.0, tol: float = 1e-6, rounds: int = 200) -> DataFrame:
    """(source, unit, lam): the tilt of each source; lam null stands for the highest rate.

    hist: (source, size, docs). Safeguarded Newton steps on log(words taken); each step is
    one aggregation by source. A step that leaves the bracket is replaced
    by the bracket's middle. Two steps are taken between cuts of the lineage, until every source meets its
    target; a source that does not within ``rounds`` steps is an error.
    """
    start = targets.withColumn("unit", F.col("source_size") / F.col("n"))
    state = cut(
        start.select(
            F.col("source").alias("s"), "unit", "target",
            F.when(F.col("target") >= F.col("source_size") * (most * (1 - 1e-12)), None).otherwise(F.lit(0.0)).alias("lam"),
            F.lit(-1e9).alias("lo"), F.lit(1e9).alias("hi"), F.lit(1.0).alias("gap"),
        ), "mix-tilt",
    )

    def step(state: DataFrame) -> DataFrame:
        x = F.col("size") / F.col("unit")
        e = F.exp(F.least(F.lit(50.0), F.col("lam") * x))
        got = F.col("docs") * F.col("size") * F.least(F.lit(most), e)
        slope = F.when(e < most, F.col("docs") * F.col("size") * x * e).otherwise(0.0)
        sums = (
            hist.where("size > 0").join(state.where("lam is not null"), hist["source"].eqNullSafe(state["s"]))
            .groupBy("s", "unit", "target", "lam", "lo", "hi").agg(F.sum(got).alias("got"), F.sum(slope).alias("slope"))
        )
        above = F.col("got") > F.col("target")
        lo, hi = F.when(above, F.col("lo")).otherwise(F.col("lam")), F.when(above, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - F.log(F.col("got") / F.col("target")) * F.col("got") / F.col("slope")
        # While one side of the bracket is open, a wild step doubles the distance instead.
        wide = F.when(above, F.least(F.col("lam") * 2, F.col("lam") - 1)).otherwise(F.greatest(F.col("lam") * 2, F.col("lam") + 1))
        middle = F.when((lo > -1e9) & (hi < 1e9), (lo + hi) / 2).otherwise(wide)
        fine = newton.isNotNull() & ~F.isnan(newton) & (newton > lo) & (newton < hi) & (F.abs(newton - F.col("lam")) < 64)
        gap = F.abs(F.col("got") / F.col("target") - 1)
        new = F.when(gap < tol, F.col("lam")).when(fine, newton).otherwise(middle)
        return sums.select("s", "unit", "target", new.alias("lam"), lo.alias("lo"), hi.alias("hi"), gap.alias("gap"))

    closed = state.where("lam is null")
    active = state.where("lam is not null and target > 0")
    for _ in range(0, rounds, 2):
        active = cut(step(step(active)), "mix-tilt")
        if not active.where(F.col("gap") >= tol).limit(1).count():
            break
    else:
        raise RuntimeError(f"targets not met within {rounds} Newton steps")
    # Sums over executors differ in their last bits from run to run; nine digits do not.
    return active.unionByName(closed).select("s", "unit", F.round("lam", 9).alias("lam"))


def entropy_balance(
    docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", *, share: float = 1.5, most: float = 2.0,
    weights: tuple = WEIGHTS,
) -> DataFrame:
    """Copies of each document under the targets of its source.

    Returns one row per row of docs: key, source, size, source_size, target, rate
    and copies (0, 1 or 2). A null text has size 0, a null source is a source of
    its own (the last), null and repeated keys are kept; further columns are left out.
    Rows that are equal in key and size may swap their copies. Documents of size
    0 get one copy. An empty table gives an empty result.
    """
    base = pick(docs, key=key, source=source, text=text)
    base = base.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long"))
    narrow = cut(base.select("key", "source", "size"), "mix-sizes")
    return _balance(narrow, share, most, weights).withColumnRenamed("key", key)


def _balance(narrow: DataFrame, share: float, most: float, weights: tuple = WEIGHTS) -> DataFrame:
    targets = cut(source_targets(narrow, share, most, weights), "mix-targets")
    hist = cut(narrow.groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs")), "mix-hist")
    tilts = solve_tilts(hist, targets, most)
    per = cut(
        targets.join(tilts, targets["source"].eqNullSafe(tilts["s"]), "left").select(
            F.col("source").alias("s"), "source_size", "n", "target", F.col("unit"), "lam",
            F.ceil(F.col("n") / BUCKET_ROWS).cast("long").alias("buckets"),
        ), "mix-sources",
    )
    rows = narrow.join(per, narrow["source"].eqNullSafe(per["s"]))
    rate = F.when(F.col("target") <= 0, 0.0).otherwise(_rate(F.col("lam"), F.col("size") / F.col("unit"), most))
    rows = rows.withColumn("rate", F.when(F.col("size") == 0, 1.0).otherwise(rate))
    # Keys are spread over a source's buckets; a key that many rows share is spread by size as well.
    # Rows of size 0 take one copy wherever they stand: any place in the table will do, so that they form no bucket of their own.
    spread = F.when(F.col("size") > 0, F.xxhash64("key", "size")).otherwise(F.monotonically_increasing_id())
    rows = rows.withColumn("bucket", F.pmod(spread, F.col("buckets")))
    order = Window.partitionBy("s", "bucket").orderBy(F.desc("size"), F.xxhash64("key"), "key")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run = F.sum("rate").over(upto)
    rows = rows.withColumn("run", run).withColumn("goal", F.sum(F.col("rate") * F.col("size")).over(whole))
    copies = F.floor(F.col("run") + 0.5) - F.floor(F.col("run") - F.col("rate") + 0.5)
    rows = rows.withColumn("copies", F.greatest(F.lit(0), F.least(F.lit(int(most)), copies)).cast("long"))
    for _ in range(3):
        rows = rows.withColumn("left", F.col("goal") - F.sum(F.col("copies") * F.col("size")).over(whole))
        more = F.col("left") > 0
        room = F.when(more, F.col("copies") < int(most)).otherwise(F.col("copies") > 0)
        fits = (F.col("size") > 0) & room & (F.col("size") <= F.abs("left"))
        rows = rows.withColumn("fits", fits)
        rows = rows.withColumn("used", F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0)).over(upto))
        move = F.col("fits") & (F.col("used") <= F.abs("left"))
        rows = rows.withColumn("copies", F.when(move, F.col("copies") + F.when(more, 1).otherwise(-1)).otherwise(F.col("copies")))
    return rows.select("key", "source", "size", "source_size", "target", "rate", "copies")


def op10_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 % of their words: doc_id, size, source_size, target, taken, rate, copies."""
    got = entropy_balance(table(spark, sf_dir, "documents"))
    return got.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "rate", "copies",
    )
