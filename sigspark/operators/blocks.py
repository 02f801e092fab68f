"""Kernels over blocks of samples with halos.

A block holds BLOCK samples of its own and as many around them as the kernel needs, so that its
results do not depend on where recordings are cut. Groups are bounded by the block's size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as k
from .framing import BLOCK, KEY, haloed


def to_blocks(samples: DataFrame, before: int, after: int, block: int = BLOCK) -> DataFrame:
    """(recording_id, block, start_idx, own_lo, own_hi, n, values): values from start_idx on, own ones at [own_lo, own_hi)."""
    size = samples.groupBy(KEY).agg((F.max("idx") + 1).alias("n"))
    rows = haloed(samples.select(KEY, "idx", "v"), before, after, block)
    packed = rows.groupBy(KEY, "block").agg(F.array_sort(F.collect_list(F.struct("idx", "v"))).alias("s"), F.min("idx").alias("start_idx"), F.count(F.when(F.col("own"), 1)).alias("own_n"), F.min(F.when(F.col("own"), F.col("idx"))).alias("own_at"))
    packed = packed.where("own_n > 0").join(size, KEY)
    lo = F.col("own_at") - F.col("start_idx")
    return packed.select(KEY, "block", "start_idx", lo.alias("own_lo"), (lo + F.col("own_n")).alias("own_hi"), "n", F.transform("s", lambda x: x["v"]).alias("values"))


def map_blocks(blocks: DataFrame, fn: Callable[[np.ndarray, int, int, int, int], list[tuple]], schema: str) -> DataFrame:
    """fn(values, start_idx, own_lo, own_hi, n) of each block gives rows; recording_id is put in front of each.

    Further columns of blocks are passed by name.
    """
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(len(columns) + 1)]
            for r in range(batch.num_rows):
                row = {c: batch.column(i)[r] for i, c in enumerate(batch.schema.names)}
                values = row["values"].values.to_numpy(zero_copy_only=False)
                more = {c: row[c].as_py() for c in row if c not in _OWN}
                for got in fn(values, row["start_idx"].as_py(), row["own_lo"].as_py(), row["own_hi"].as_py(), row["n"].as_py(), **more):
                    out[0].append(row[KEY].as_py())
                    for place, x in zip(out[1:], got):
                        place.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), *[pa.array(x, _arrow(s.split(" ", 1)[1])) for x, s in zip(out[1:], schema.split(", "))]], [KEY, *columns])

    return blocks.mapInArrow(run, f"{KEY} string, {schema}")


_OWN = frozenset((KEY, "block", "start_idx", "own_lo", "own_hi", "n", "values"))


def _arrow(kind: str) -> pa.DataType:
    return {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}[kind]


def _samples(transform: Callable[[np.ndarray, int, int, int, int], np.ndarray], blocks: DataFrame) -> DataFrame:
    """Rows (recording_id, idx, v) of a kernel that gives each block's own samples anew."""

    def fn(values, start, lo, hi, n, **more):
        return [(start + lo, np.asarray(transform(values, start, lo, hi, n, **more), float).tolist())]

    packed = map_blocks(blocks, fn, "start_idx long, out array<double>")
    return packed.select(KEY, "start_idx", F.posexplode("out").alias("_i", "v")).select(KEY, (F.col("start_idx") + F.col("_i")).alias("idx"), "v")


def filtered(samples: DataFrame, sections: np.ndarray, block: int = BLOCK) -> DataFrame:
    """A cascade of biquads from rest over each recording."""
    halo = len(k.impulse_response(sections))
    return _samples(lambda x, s, lo, hi, n: k.filter_block(x, sections)[lo:hi], to_blocks(samples, halo, 0, block))


def k_weighted(samples: DataFrame, rate: float, block: int = BLOCK) -> DataFrame:
    """The K weighting."""
    return filtered(samples, k.k_weighting_sections(rate), block)


def subsonic(samples: DataFrame, rate: float, cutoff: float, db_per_octave: int = 24, block: int = BLOCK) -> DataFrame:
    """A forward Butterworth high-pass of 6 dB per octave and order."""
    if db_per_octave % 6 or not 6 <= db_per_octave <= 36:
        raise ValueError(f"a slope of {db_per_octave} dB per octave cannot be made")
    return filtered(samples, k.highpass_sections(db_per_octave // 6, cutoff, rate), block)


def zero_phase_highpass(samples: DataFrame, rate: float, cutoff: float, order: int = 4, block: int = BLOCK) -> DataFrame:
    """A high-pass without delay; nothing is done if the cutoff is near half the rate."""
    if cutoff >= 0.98 * rate / 2:
        return samples.select(KEY, "idx", "v")
    sections = k.highpass_sections(order, cutoff, rate)
    halo = len(k.impulse_response(sections))

    def one(x, start, lo, hi, n):
        if n < 3 * order:
            return x[lo:hi]
        return k.zero_phase(x, sections, start == 0, start + len(x) == n)[lo:hi]

    return _samples(one, to_blocks(samples, 2 * halo, 2 * halo, block))


def true_peaks(samples: DataFrame, oversample: int = 4, block: int = BLOCK) -> DataFrame:
    """(recording_id, true_peak): the largest magnitude at ``oversample`` times the rate."""
    got = map_blocks(to_blocks(samples, 16, 16, block), lambda x, s, lo, hi, n: [(k.true_peak(x, lo, hi, oversample),)], "peak double")
    return got.groupBy(KEY).agg(F.max("peak").alias("true_peak"))


def resampled(samples: DataFrame, up: int, down: int, block: int = BLOCK) -> DataFrame:
    """Rows at up / down times the rate: each block gives the outputs that fall into it."""
    reach = 20 * max(up, down) // up + 2

    def one(x, start, lo, hi, n):
        first = -(-(start + lo) * up // down)
        last = -(-(start + hi) * up // down)
        return [(first, k.resample(x, up, down, first, last - first, start).tolist())]

    packed = map_blocks(to_blocks(samples, reach, reach, block), one, "first long, out array<double>")
    return packed.select(KEY, "first", F.posexplode("out").alias("_i", "v")).select(KEY, (F.col("first") + F.col("_i")).alias("idx"), "v")


def frame_bands(samples: DataFrame, rate: float, window: int, hop: int, edges: list[tuple[float, float]], block: int = BLOCK) -> DataFrame:
    """(recording_id, frame, band, db): levels of whole frames in bands of frequencies."""

    def fn(x, start, lo, hi, n):
        out = []
        for frame in range(-(-(start + lo) // hop), -(-(start + hi) // hop)):
            at = frame * hop - start
            if frame * hop + window <= n:
                squares = k.band_squares(x[at : at + window], rate, edges)
                out += [(frame, b, float(10 * np.log10(max(s, 1e-24)))) for b, s in enumerate(squares)]
        return out

    return map_blocks(to_blocks(samples, 0, window, block), fn, "frame long, band int, db double")


def onset_flux(samples: DataFrame, window: int, hop: int, block: int = BLOCK) -> DataFrame:
    """(recording_id, frame, flux): rises of the spectrum from each whole frame to the next, less their mean over the recording."""

    def fn(x, start, lo, hi, n):
        first, last = -(-(start + lo) // hop), -(-(start + hi) // hop)
        last = min(last, max(0, (n - window) // hop))
        if last <= first:
            return []
        flux = k.onset_flux(x[first * hop - start : last * hop - start + window], window, hop)
        return list(zip(range(first, last), flux.tolist()))

    rows = map_blocks(to_blocks(samples, 0, window + hop, block), fn, "frame long, flux double")
    mean = rows.groupBy(KEY).agg(F.avg("flux").alias("_m"))
    return rows.join(mean, KEY).select(KEY, "frame", (F.col("flux") - F.col("_m")).alias("flux"))


def periodicity(flux: DataFrame, step: float, window: int, hop: int, shortest: float, longest: float, revolutions: tuple[float, ...], top: int = 3) -> DataFrame:
    """(recording_id, window, start_frame, peaks, baseline_r, revolution_r) of probe windows over the flux frames."""
    first = F.greatest(F.lit(0), F.ceil((F.col("frame") - window + 1) / hop))
    rows = flux.withColumn("window", F.explode(F.sequence(first, F.greatest(first, F.floor(F.col("frame") / hop))))).where(F.col("frame") >= F.col("window") * hop)
    packed = rows.groupBy(KEY, "window").agg(F.array_sort(F.collect_list(F.struct("frame", "flux"))).alias("s")).where(F.size("s") == window)
    packed = packed.select(KEY, "window", (F.col("window") * hop).alias("start_frame"), F.transform("s", lambda x: x["flux"]).alias("values"))

    def run(batches):
        for batch in batches:
            peaks, base, own = [], [], []
            for row in batch.column(3):
                x = row.values.to_numpy(zero_copy_only=False)
                found, median = k.period_peaks(x, step, shortest, longest, top)
                r = k.autocorrelation(x)
                peaks.append([{"period_seconds": p, "r": v} for p, v in found])
                base.append(median)
                own.append([float(r[i]) if (i := int(round(p / step))) < len(r) else 0.0 for p in revolutions])
            kind = pa.list_(pa.struct([("period_seconds", pa.float64()), ("r", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(peaks, kind), pa.array(base, pa.float64()), pa.array(own, pa.list_(pa.float64()))], [KEY, "window", "start_frame", "peaks", "baseline_r", "revolution_r"])

    return packed.mapInArrow(run, f"{KEY} string, window long, start_frame long, peaks array<struct<period_seconds:double,r:double>>, baseline_r double, revolution_r array<double>")


def spectral_frames(samples: DataFrame, rate: float, size: int = 4096, block: int = BLOCK) -> DataFrame:
    """(recording_id, frame, centroid, flux, power array): half-overlapping Hann frames; flux is null for the first."""
    hop = size // 2

    def fn(x, start, lo, hi, n):
        frames = -(-(n + 2 * hop - size) // hop) + 1
        first, last = -(-(start + lo) // hop), -(-(start + hi) // hop)
        if start + hi == n:
            last = frames
        w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
        hz, out, before = np.fft.rfftfreq(size, 1 / rate), [], None
        for f in range(max(0, first - 1), last):
            at = f * hop - hop - start  # frame f covers [f * hop - hop, f * hop + hop)
            part = np.zeros(size)
            a, b = max(at, 0), min(at + size, len(x))
            if b > a:
                part[a - at : b - at] = x[a:b]
            m = np.abs(np.fft.rfft(part * w)) / w.sum()
            if f >= first:
                rise = None if before is None else float(np.maximum(m - before, 0).sum())
                out.append((f, float((hz * m).sum() / (m.sum() + 1e-12)), rise, (m * m).tolist()))
            before = m
        return out

    return map_blocks(to_blocks(samples, 2 * size, 2 * size, block), fn, "frame long, centroid double, flux double, power array<double>")
