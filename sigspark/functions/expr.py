"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keeps logarithms and ratios finite.
EPS = 1e-12


def to_db(x: Column) -> Column:
    """Level of an amplitude in dB, not below -240."""
    return 20 * F.log10(F.greatest(F.abs(x), F.lit(EPS)))


def from_db(db: Column) -> Column:
    """Amplitude of a level in dB."""
    return F.pow(F.lit(10.0), db / 20)


def clip(x: Column, low: float, high: float) -> Column:
    """x held within [low, high]."""
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def map_position(p: Column, ratio: float, limit: int) -> Column:
    """A position after a change of speed: rounded half to even, within [0, limit]."""
    return F.least(F.greatest(F.bround(p * ratio), F.lit(0)), F.lit(limit)).cast("long")


def fade_gain(idx: Column, start: Column, end: Column, fade_in: Column, fade_out: Column) -> Column:
    """Raised-cosine gain of a sample of [start, end); the fade out gets what the fade in leaves."""
    import math

    k, r = idx - start, end - 1 - idx
    out = F.least(fade_out, end - start - fade_in)
    rising = F.when(k < fade_in, 0.5 * (1 - F.cos(math.pi * k / fade_in))).otherwise(1.0)
    falling = F.when(r < out, 0.5 * (1 - F.cos(math.pi * r / out))).otherwise(1.0)
    return rising * falling


def safe_name(x: Column) -> Column:
    """A file name's component: forbidden characters become _, no blanks or dots at its end,
    120 characters at most, "untitled" if nothing is left."""
    clean = F.regexp_replace(x, r'[<>:"/\\|?*\x00-\x1f]', "_")
    clean = F.regexp_replace(F.trim(clean), r"[ .]+$", "")
    clean = F.regexp_replace(F.substring(clean, 1, 120), r"[ .]+$", "")
    return F.when(F.coalesce(clean, F.lit("")) == "", F.lit("untitled")).otherwise(clean)


def first_argmax(value: Column, idx: Column) -> Column:
    """The smallest idx that bears the largest value (an aggregate)."""
    return F.min(F.struct((-value).alias("minus"), idx.alias("idx")))["idx"]
