"""Signals whose truth is known by construction."""

import numpy as np


def side(rate=4000, seed=11):
    """A stereo side: noise, a tone, a gap, a tone, a lead-out; clicks at known places."""
    rng = np.random.default_rng(seed)
    n = int(21.7 * rate)
    t = np.arange(n) / rate
    x = rng.normal(0, 4e-4, n)
    spans = [(2.0, 10.0, 220.0), (12.2, 19.2, 294.0)]
    for a, b, f in spans:
        inside = (t >= a) & (t < b)
        ramp = np.clip(np.minimum(t - a, b - t) / 0.05, 0, 1)
        x[inside] += (ramp * (0.45 * np.sin(2 * np.pi * f * t) + 0.2 * np.sin(2 * np.pi * 2.5 * f * t)))[inside]
    clicks = [int(s * rate) for s in (3.3, 5.1, 7.9, 14.2, 16.05)]
    for c in clicks:
        x[c : c + 3] += 0.45
    return np.stack([x, 0.985 * x], 1), [(int(a * rate), int(b * rate)) for a, b, _ in spans], clicks


def frame(spark, x, recording="side"):
    """Samples (recording_id, channel, idx, v) of an array (frames, channels)."""
    import pandas as pd

    n, c = x.shape
    rows = pd.DataFrame({"recording_id": recording, "channel": np.repeat(np.arange(c, dtype="int32"), n), "idx": np.tile(np.arange(n), c), "v": x.T.ravel()})
    return spark.createDataFrame(rows).repartition(4, "idx")


def series(spark, x, recording="x"):
    """Samples (recording_id, idx, v) of one channel."""
    return frame(spark, np.asarray(x, float)[:, None], recording).drop("channel")
