"""Click detection and repair over blocks with halos."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as k
from .blocks import _samples, map_blocks, to_blocks
from .framing import BLOCK, KEY, second_difference
from .levels import robust_sigma

#: Detection defaults: high-pass (Hz), windows (ms), widest click (ms), curvature threshold in sigmas.
HIGHPASS, NEAR_MS, WIDE_MS, WIDTH_MS, SIGMAS = 3000.0, 0.2, 40.0, 2.0, 6.0


def detect(samples: DataFrame, rate: float, thresholds: tuple[float, ...], *, highpass: float = HIGHPASS, near_ms: float = NEAR_MS, wide_ms: float = WIDE_MS, width_ms: float = WIDTH_MS, block: int = BLOCK) -> DataFrame:
    """(recording_id, threshold, start_idx, end_idx, peak) of clicks, for a whole ladder in one pass.

    The high-passed signal's local energy ratio over a threshold marks a span; spans closer than the widest click are one;
    the span is moved onto the unfiltered signal's nearest impulse and dropped if it is wider than a click. Half
    a wide window at either end of a recording holds none. sigma is measured once per recording.
    """
    near = max(3, round(near_ms / 1000 * rate))
    wide = max(4 * near, round(wide_ms / 1000 * rate))
    width = max(1, round(width_ms / 1000 * rate))
    guard_width = round(wide_ms / 1000 * rate) // 2
    sections = k.highpass_sections(4, highpass, rate)
    filtering = highpass < 0.98 * rate / 2
    halo = 2 * len(k.impulse_response(sections)) + wide + 4 * width + 16
    curve = second_difference(samples.select(KEY, "idx", "v"))
    sigma = robust_sigma(curve, F.col("curvature"))
    blocks = to_blocks(samples, halo, halo, block).join(sigma, KEY)

    def one(x, start, lo, hi, n, sigma):
        high = k.zero_phase(x, sections, start == 0, start + len(x) == n) if filtering and n >= 12 else x
        ratio, bent = k.local_ratio(high, near, wide), k.bend(x)
        guard = min(guard_width, n // 2)
        at = np.arange(start, start + len(x))
        ratio[(at < guard) | (at >= n - guard)] = 0
        out = []
        for t in thresholds:
            spans = k.merge(k.runs(ratio > t), width)
            for c, d in k.localise(bent, spans, SIGMAS * sigma, width).tolist():
                if d - c <= width and lo <= c < hi:
                    out.append((float(t), start + c, start + d, float(np.abs(high[c:d]).max())))
        return out

    return map_blocks(blocks, one, "threshold double, start_idx long, end_idx long, peak double").dropDuplicates([KEY, "threshold", "start_idx", "end_idx"])


def confirm(samples: DataFrame, events: DataFrame, factor: float, partials: int = 5, margin: int = 50, block: int = BLOCK) -> DataFrame:
    """The events whose span stands out of what a few partials leave of their surroundings, by factor deviations."""
    blocks = with_events(to_blocks(samples, 4 * margin, 4 * margin, block), events, 4 * margin, block)

    def one(x, start, lo, hi, n, events):
        by: dict[int, list] = {}  # segments of one length are taken together
        for e in events or []:
            a, b = e["start_idx"] - start, e["end_idx"] - start
            c, d = max(0, a - margin), min(len(x), b + margin)
            if lo <= a < hi and d - c >= 32:
                by.setdefault(d - c, []).append((c, a - c, max(a - c + 1, b - c), e))
        out = []
        for size, found in by.items():
            rest = k.sinusoidal_residual(np.stack([x[c : c + size] for c, *_ in found]), partials)
            for row, spread, (_, a, b, e) in zip(np.abs(rest), rest.std(1), found):
                if row[a:b].max() > factor * spread:
                    out.append((e["start_idx"], e["end_idx"]))
        return out

    return map_blocks(blocks, one, "start_idx long, end_idx long").join(events, [KEY, "start_idx", "end_idx"])


def with_events(blocks: DataFrame, events: DataFrame, halo: int, block: int = BLOCK) -> DataFrame:
    """blocks with events, those that touch the block or its halo, in order."""
    first, last = F.floor((F.col("start_idx") - halo) / block), F.floor((F.col("end_idx") + halo) / block)
    spread = events.select(KEY, "start_idx", "end_idx", F.explode(F.sequence(first, last)).alias("block"))
    lists = spread.groupBy(KEY, "block").agg(F.array_sort(F.collect_list(F.struct("start_idx", "end_idx"))).alias("events"))
    return blocks.join(lists, [KEY, "block"], "left")


def repair(samples: DataFrame, events: DataFrame, method: str, strength: float = 1.0, *, order: int = 32, rounds: int = 3, context: int = 2048, block: int = BLOCK) -> DataFrame:
    """samples with the events bridged: "linear", "hermite" or "ar". No repair leaves its neighbourhood's range."""
    if method not in ("linear", "hermite", "ar"):
        raise ValueError(f"unknown method of repair {method!r}")
    blocks = with_events(to_blocks(samples, context, context, block), events, context, block)

    def one(x, start, lo, hi, n, events):
        near = [(e["start_idx"] - start, e["end_idx"] - start) for e in events or []]
        inside = [(a, b) for a, b in near if a >= 0 and b <= len(x) and (a > 0 or start > 0)]
        return k.repair(x, inside, strength, method, order, rounds)[lo:hi]

    return _samples(one, blocks)
