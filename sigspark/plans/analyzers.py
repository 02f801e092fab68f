"""The fourteen measurements and the registry that resolves what they need.

A measurement is a function of a Context that returns a lazy DataFrame with one row per
recording (series and lists as arrays), so that sections that nobody asks for cost nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import EPS, to_db
from ..operators import blocks as bl
from ..operators import clicks as cl
from ..operators import events as ev
from ..operators import framing as fr
from ..operators import levels as lv
from ..operators import run_out as ro
from ..operators import silence as si
from ..operators.framing import KEY


@dataclass(frozen=True)
class Analyzer:
    """A registered measurement."""

    name: str
    version: str
    requires: tuple[str, ...]
    defaults: dict
    fn: Callable[[Context], DataFrame]


REGISTRY: dict[str, Analyzer] = {}


def analyzer(name: str, version: str = "1.0", requires: tuple[str, ...] = (), **defaults):
    """Register a measurement; a name may be registered once."""

    def put(fn):
        if name in REGISTRY:
            raise ValueError(f"analyzer {name!r} is registered twice")
        REGISTRY[name] = Analyzer(name, version, requires, defaults, fn)
        return fn

    return put


def resolve_order(names: Iterable[str] | None = None) -> list[Analyzer]:
    """The named measurements and all they need, dependencies first, names in order; a cycle is refused."""
    out: dict[str, Analyzer] = {}

    def visit(name: str, above: tuple[str, ...]) -> None:
        if name in above:
            raise ValueError(f"analyzers need each other: {' -> '.join([*above, name])}")
        if name not in REGISTRY:
            raise ValueError(f"unknown analyzer {name!r}")
        for need in REGISTRY[name].requires:
            if need not in out:
                visit(need, (*above, name))
        out.setdefault(name, REGISTRY[name])

    for name in sorted(REGISTRY if names is None else set(names)):
        visit(name, ())
    return list(out.values())


@dataclass
class Context:
    """What measurements share: the samples (recording_id, channel, idx, v), the rate, parameters and results."""

    samples: DataFrame
    rate: int
    params: dict = field(default_factory=dict)
    sections: dict[str, DataFrame] = field(default_factory=dict)
    made: dict[str, DataFrame] = field(default_factory=dict)

    def get(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A shared intermediate result, defined once."""
        if name not in self.made:
            self.made[name] = make()
        return self.made[name]

    @property
    def mono(self) -> DataFrame:
        """The mean of the channels."""
        return self.get("mono", lambda: self.samples.groupBy(KEY, "idx").agg(F.avg("v").alias("v")))

    @property
    def lengths(self) -> DataFrame:
        return self.get("lengths", lambda: self.samples.groupBy(KEY).agg((F.max("idx") + 1).alias("n")))

    def frames(self, window: float, hop: float) -> DataFrame:
        """Frame levels in dB, rounded to two digits: later measurements see the rounded values."""
        w, h = max(1, round(window * self.rate)), max(1, round(hop * self.rate))
        make = lambda: fr.hop_frames(self.mono, w, h).withColumn("db", F.round("db", 2))
        return self.get(f"frames-{w}-{h}", make)

    def profile(self) -> DataFrame:
        p = self.params["rms_profile"]
        return self.frames(p["window_seconds"], p["hop_seconds"])

    def profile_steps(self) -> tuple[int, int]:
        p = self.params["rms_profile"]
        return max(1, round(p["window_seconds"] * self.rate)), max(1, round(p["hop_seconds"] * self.rate))


def _series(df: DataFrame, idx: str, value: str, name: str, keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(idx, value))), lambda x: x[value]).alias(name))


@analyzer("recording_info")
def recording_info(c: Context) -> DataFrame:
    per = c.samples.groupBy(KEY, "channel").agg(F.avg("v").alias("dc"), to_db(F.max(F.abs("v"))).alias("peak"), F.sqrt(F.avg(F.col("v") ** 2) + EPS).alias("rms"))
    sort = lambda name: F.transform(F.array_sort(F.collect_list(F.struct("channel", name))), lambda x: x[name])
    rows = per.withColumn("rms", to_db(F.col("rms"))).groupBy(KEY).agg(F.count(F.lit(1)).alias("channels"), sort("dc").alias("dc_offset"), sort("peak").alias("channel_peak_db"), sort("rms").alias("channel_rms_db"))
    two = c.samples.groupBy(KEY, "idx").agg(F.max(F.when(F.col("channel") == 0, F.col("v"))).alias("l"), F.max(F.when(F.col("channel") == 1, F.col("v"))).alias("r"))
    two = two.groupBy(KEY).agg(F.when((F.stddev_pop("l") > EPS) & (F.stddev_pop("r") > EPS), F.corr("l", "r")).alias("correlation"))
    rows = rows.join(two, KEY)
    balance = F.when(F.col("channels") == 2, F.col("channel_rms_db")[0] - F.try_element_at("channel_rms_db", F.lit(2)))
    return rows.withColumn("balance_db", balance).withColumn("correlation", F.when(F.col("channels") == 2, F.col("correlation")))


@analyzer("rms_profile", window_seconds=0.2, hop_seconds=0.1)
def rms_profile(c: Context) -> DataFrame:
    return _series(c.profile(), "frame", "db", "values_db")


@analyzer("band_profile", window_seconds=0.2, hop_seconds=0.2, edges_hz=(40, 150, 400, 1000, 3000, 8000), floor_percentile=0.1)
def band_profile(c: Context) -> DataFrame:
    p = c.params["band_profile"]
    edges = list(zip(p["edges_hz"], p["edges_hz"][1:]))
    w, h = max(1, round(p["window_seconds"] * c.rate)), max(1, round(p["hop_seconds"] * c.rate))
    levels = c.get("bands", lambda: bl.frame_bands(c.mono, c.rate, w, h, edges).withColumn("db", F.round("db", 2)))
    floors = levels.groupBy(KEY, "band").agg(F.percentile("db", F.lit(p["floor_percentile"])).alias("floor_db"))
    rows = _series(levels, "frame", "db", "values_db", (KEY, "band")).join(floors, [KEY, "band"])
    return rows.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("band", "floor_db", "values_db"))).alias("bands"))


@analyzer("surface_noise", requires=("rms_profile",), floor_percentile=0.05, quiet_percentile=0.10)
def surface_noise(c: Context) -> DataFrame:
    p = c.params["surface_noise"]
    return lv.noise_floor(c.profile(), p["floor_percentile"], p["quiet_percentile"]).withColumn("noise_floor_db", F.round("noise_floor_db", 2))


@analyzer("silence", "2.0", requires=("rms_profile", "surface_noise"), margin_db=8.0, min_seconds=0.5, settle_seconds=1.0, settle_db=3.0)
def silence(c: Context) -> DataFrame:
    p, (w, h) = c.params["silence"], c.profile_steps()
    threshold = c.sections["surface_noise"].select(KEY, (F.col("noise_floor_db") + p["margin_db"]).alias("threshold_db"))
    least = max(1, round(p["min_seconds"] * c.rate / h))
    found = c.get("regions", lambda: si.regions(c.profile(), threshold, c.lengths, w, h, least))
    smooth = fr.same_mean(c.profile(), "db", max(1, round(p["settle_seconds"] * c.rate / h)), "smooth")
    edges = si.music_edges(smooth, found, p["settle_db"], "smooth")
    rows = found.join(edges, [KEY, "start_frame", "end_frame"]).join(threshold, KEY)
    item = F.struct("start_idx", "end_idx", (F.col("end_of_music") * h).alias("music_end_sample"), (F.col("start_of_music") * h + w).alias("music_start_sample"), ((F.col("end_idx") - F.col("start_idx")) / c.rate).alias("duration_seconds"))
    rows = rows.groupBy(KEY).agg(F.array_sort(F.collect_list(item)).alias("regions"))
    return threshold.join(rows, KEY, "left")


@analyzer("boundaries", requires=("rms_profile", "silence"), valley_db=12.0, order=10, smooth_frames=5, nperseg=4096, top=20, z=4.0, separation_seconds=0.5)
def boundaries(c: Context) -> DataFrame:
    p, (_, h) = c.params["boundaries"], c.profile_steps()
    found = c.made["regions"]
    rows = si.candidates(found, si.valleys(c.profile(), p["smooth_frames"], p["order"], p["valley_db"]), h)
    rows = rows.unionByName(spectral_changes(c.mono, c.rate, p["nperseg"], p["top"], p["z"], p["separation_seconds"]))
    lists = rows.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("sample", "method"))).alias("candidates"))
    return si.playable(found, c.lengths).join(lists, KEY, "left")


def spectral_changes(mono: DataFrame, rate: int, size: int, top: int, z: float, separation: float) -> DataFrame:
    """(recording_id, sample, method) of the largest rises of the spectrum that stand out of the rest, apart from each other."""
    flux = bl.spectral_frames(mono, rate, size).where("flux is not null").select(KEY, "frame", "flux")
    center = flux.groupBy(KEY).agg(F.median("flux").alias("_m"))
    sigma = lv.robust_sigma(flux, F.col("flux"))
    hot = flux.join(center, KEY).join(sigma, KEY).withColumn("_z", (F.col("flux") - F.col("_m")) / F.greatest("sigma", F.lit(EPS))).where(F.col("_z") >= z)
    best = hot.groupBy(KEY).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("_z")).alias("minus"), F.col("frame").alias("frame")))), 1, top).alias("best"))
    hop, gap = size // 2, separation * rate
    far = lambda taken, x: F.forall(taken, lambda y: F.abs(y - x) >= gap)
    pick = F.aggregate("best", F.expr("CAST(array() AS array<bigint>)"), lambda acc, x: F.when(far(acc, x["frame"] * hop), F.array_append(acc, x["frame"] * hop)).otherwise(acc))
    return best.select(KEY, F.explode(pick).alias("sample"), F.lit("spectral_change").alias("method"))


@analyzer("clicks", "2.0", requires=("silence",), ladder=(10.0, 15.0, 25.0, 50.0, 75.0, 100.0, 150.0, 250.0, 400.0), promoted=50.0, max_positions=5000, revolution_seconds=1.8, min_gap_seconds=2.0)
def clicks(c: Context) -> DataFrame:
    p = c.params["clicks"]
    events = c.get("clicks", lambda: cl.detect(c.mono, c.rate, tuple(p["ladder"])))
    gaps = c.made["regions"].where((F.col("end_idx") - F.col("start_idx")) >= p["min_gap_seconds"] * c.rate).select(KEY, "start_idx", "end_idx")
    own = events.where(F.col("threshold") == p["promoted"])
    sweep = events.groupBy(KEY, "threshold").agg(F.count(F.lit(1)).alias("count"))
    sweep = sweep.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("threshold", "count"))).alias("threshold_sweep"))
    places = own.groupBy(KEY).agg(F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_list("start_idx")).alias("_all"))
    places = places.select(KEY, "count", F.slice("_all", 1, p["max_positions"]).alias("positions_sample"), (F.col("count") > p["max_positions"]).alias("positions_truncated"))
    rates = ev.rates_by_region(own, gaps, c.lengths, 60.0 * c.rate)
    turning = lv.phase_concentration(own, "start_idx", p["revolution_seconds"] * c.rate).select(KEY, F.col("r").alias("revolution_r"), F.col("z").alias("revolution_lock"))
    return rates.join(places, KEY, "left").join(sweep, KEY, "left").join(turning, KEY, "left").na.fill(0, ["count"])


@analyzer("peaks", oversample=4)
def peaks(c: Context) -> DataFrame:
    channels = c.samples.withColumn(KEY, F.concat_ws("\x01", KEY, F.col("channel").cast("string")))
    whole = lambda df: df.withColumn(KEY, F.split(KEY, "\x01")[0])
    one = c.samples.groupBy(KEY, "idx").agg(F.max(F.abs("v")).alias("m"), F.sum(F.col("v") ** 2).alias("s"), F.count(F.lit(1)).alias("k"))
    got = one.groupBy(KEY).agg(F.max("m").alias("peak"), F.min(F.struct((-F.col("m")).alias("minus"), "idx"))["idx"].alias("peak_sample"), F.sqrt(F.sum("s") / F.sum("k") + EPS).alias("rms"))
    true = whole(bl.true_peaks(channels, c.params["peaks"]["oversample"])).groupBy(KEY).agg(F.max("true_peak").alias("true_peak"))
    window, hop = round(0.4 * c.rate), round(0.1 * c.rate)
    power = one.select(KEY, "idx", F.sqrt(F.col("s") / F.col("k")).alias("v"))
    level = F.col("rms") ** 2
    gated = lv.gated_level(fr.hop_frames(power, window, hop), level, 10 * F.log10(level), (KEY,)).select(KEY, F.col("level_db").alias("gated_rms_db"))
    rows = got.join(true, KEY).join(gated, KEY, "left").join(loudness(c.samples, c.rate), KEY, "left")
    rows = rows.select(KEY, to_db(F.col("peak")).alias("peak_db"), "peak_sample", to_db(F.col("rms")).alias("rms_db"), to_db(F.col("true_peak")).alias("true_peak_db"), "gated_rms_db", "lufs")
    return rows.withColumn("crest_factor_db", F.round(F.col("peak_db") - F.col("rms_db"), 2))


def loudness_blocks(samples: DataFrame, rate: int) -> DataFrame:
    """(recording_id, frame, power): K-weighted 400 ms blocks with three quarters overlap, channels weighted and
    added: surround by 1.41, the low-frequency channel of six by 0."""
    channels = samples.groupBy(KEY).agg((F.max("channel") + 1).alias("channels"))
    keyed = samples.withColumn(KEY, F.concat_ws("\x01", KEY, F.col("channel").cast("string")))
    window = round(0.4 * rate)
    blocks = fr.power_blocks(bl.k_weighted(keyed, rate), window, round(window * 0.25))
    blocks = blocks.withColumn("channel", F.split(KEY, "\x01")[1].cast("int")).withColumn(KEY, F.split(KEY, "\x01")[0]).join(channels, KEY)
    k, n = F.col("channel"), F.col("channels")
    weight = F.when((n == 5) & (k >= 3), 1.41).when((n == 6) & (k == 3), 0.0).when((n == 6) & (k >= 4), 1.41).otherwise(1.0)
    return blocks.groupBy(KEY, "frame").agg(F.sum(weight * F.col("power")).alias("power"))


def loudness(samples: DataFrame, rate: int) -> DataFrame:
    """(recording_id, lufs): gated integrated loudness; a recording without blocks has none."""
    blocks = loudness_blocks(samples, rate)
    level = -0.691 + 10 * F.log10(F.greatest("power", F.lit(EPS * EPS)))
    return lv.gated_level(blocks, F.col("power"), level, (KEY,), offset=-0.691).select(KEY, F.col("level_db").alias("lufs"))


@analyzer("dynamic_range", requires=("rms_profile", "peaks"))
def dynamic_range(c: Context) -> DataFrame:
    return lv.dynamic_range(c.profile(), c.sections["peaks"])


@analyzer("clipping", level=0.9999, run=3)
def clipping(c: Context) -> DataFrame:
    p = c.params["clipping"]
    loudest = c.samples.groupBy(KEY, "idx").agg(F.max(F.abs("v")).alias("v"))
    return lv.clipping(loudest, p["level"], p["run"]).withColumn("clipped_ratio", F.round("clipped_ratio", 8))


@analyzer("spectral", nperseg=4096, rumble_hz=40.0, hiss_hz=12000.0, rolloff=0.85)
def spectral(c: Context) -> DataFrame:
    p = c.params["spectral"]
    frames = bl.spectral_frames(c.mono, c.rate, p["nperseg"])
    per = frames.groupBy(KEY).agg(F.avg("centroid").alias("centroid_mean_hz"), F.stddev_pop("centroid").alias("centroid_std_hz"))
    step = c.rate / p["nperseg"]
    bins = frames.select(KEY, F.posexplode("power").alias("bin", "p")).groupBy(KEY, "bin").agg(F.avg("p").alias("power"))
    total = bins.groupBy(KEY).agg(F.sum("power").alias("_all"), F.sum(F.when(F.col("bin") * step <= p["rumble_hz"], F.col("power"))).alias("_low"), F.sum(F.when(F.col("bin") * step >= p["hiss_hz"], F.col("power"))).alias("_high"))
    from ..operators.spectra import rolloff

    off = rolloff(bins.select(KEY, F.lit(0).alias("frame"), "bin", "power"), p["rolloff"])
    rel = lambda x: 10 * F.log10((F.coalesce(x, F.lit(0.0)) + EPS) / (F.col("_all") + EPS))
    return per.join(total, KEY).join(off, KEY, "left").select(KEY, "centroid_mean_hz", "centroid_std_hz", (F.col("rolloff_bin") * step).alias("rolloff_hz"), rel(F.col("_low")).alias("rumble_db"), rel(F.col("_high")).alias("hiss_db"))


@analyzer("transients", hop_seconds=0.01, mad_factor=6.0, min_rise_db=3.0)
def transients(c: Context) -> DataFrame:
    p = c.params["transients"]
    h = max(1, round(p["hop_seconds"] * c.rate))
    frames = fr.hop_frames(c.mono, max(1, round(2 * p["hop_seconds"] * c.rate)), h)
    found = ev.onsets(frames, p["mad_factor"], p["min_rise_db"]).withColumn("sample", F.col("frame") * h)
    buckets = c.lengths.select(KEY, F.greatest(F.ceil(F.col("n") / c.rate), F.lit(1)).cast("long").alias("buckets"))
    per = fr.dense_counts(found, "sample", c.rate, buckets)
    return per.groupBy(KEY).agg(F.avg("n").alias("mean_per_second"), F.max("n").alias("peak_per_second"), F.transform(F.array_sort(F.collect_list(F.struct("bucket", "n"))), lambda x: x["n"]).alias("density_per_second"))


@analyzer("periodicity", requires=("silence",), window_seconds=0.02, hop_seconds=0.005, probe_seconds=12.0, step_seconds=4.0, shortest=0.25, longest=4.0, top=3, revolutions=(1.8, 1.3333))
def periodicity(c: Context) -> DataFrame:
    rows = probe_windows(c)
    item = F.struct("start_idx", "end_idx", "peaks", "baseline_r", "revolution_r")
    lists = rows.groupBy(KEY).agg(F.array_sort(F.collect_list(item)).alias("windows"))
    silent = c.made["regions"].select(KEY, F.col("start_idx").alias("_a"), F.col("end_idx").alias("_b"))
    inside = rows.join(silent, KEY, "left").groupBy(KEY, "start_idx", "end_idx").agg(F.coalesce(F.bool_or((F.col("_a") < F.col("end_idx")) & (F.col("_b") > F.col("start_idx"))), F.lit(False)).alias("_silent"))
    best = rows.join(inside.where("not _silent"), [KEY, "start_idx", "end_idx"]).where(F.size("peaks") > 0)
    best = best.groupBy(KEY).agg(F.median(F.col("peaks")[0]["period_seconds"]).alias("programme_period_seconds"), F.median(F.col("peaks")[0]["r"] - F.col("baseline_r")).alias("programme_peak_prominence"))
    return lists.join(best, KEY, "left")


def probe_windows(c: Context) -> DataFrame:
    """(recording_id, start_idx, end_idx, peaks, baseline_r, revolution_r) of the periodicity measurement."""
    p = c.params["periodicity"]
    w, h = max(1, round(p["window_seconds"] * c.rate)), max(1, round(p["hop_seconds"] * c.rate))

    def make():
        flux = bl.onset_flux(c.mono, w, h)
        size, step = round(p["probe_seconds"] * c.rate) // h, round(p["step_seconds"] * c.rate) // h
        rows = bl.periodicity(flux, h / c.rate, size, step, p["shortest"], p["longest"], tuple(p["revolutions"]), p["top"])
        return rows.select(KEY, (F.col("start_frame") * h).alias("start_idx"), ((F.col("start_frame") + size) * h).alias("end_idx"), "peaks", "baseline_r", "revolution_r")

    return c.get("probes", make)


@analyzer("run_out", requires=("band_profile", "periodicity"), factor=1.5, tail_seconds=30.0, margin_db=3.0, median_seconds=1.0)
def run_out(c: Context) -> DataFrame:
    p, b = c.params["run_out"], c.params["band_profile"]
    h = max(1, round(b["hop_seconds"] * c.rate))
    top = F.when(F.size("peaks") > 0, F.col("peaks")[0]["r"]).otherwise(0.0)
    anchors = ro.last_programme_window(probe_windows(c).select(KEY, "end_idx", top.alias("top_r"), F.array_max("revolution_r").alias("revolution_r")), p["factor"])
    per_second = c.rate / h
    anchors = anchors.where("anchor is not null").select(KEY, F.ceil(F.col("anchor") / h).alias("anchor"))
    got = ro.settled(c.made["bands"], tail=max(1, round(p["tail_seconds"] * per_second)), margin=p["margin_db"], median_width=max(1, round(p["median_seconds"] * per_second)), anchors=anchors)
    return c.lengths.select(KEY).join(anchors.select(KEY, (F.col("anchor") * h).alias("anchor_sample")), KEY, "left").join(got.select(KEY, (F.col("start_frame") * h).alias("start_sample")), KEY, "left")


def merge_params(spec: Analyzer, own: dict | None) -> dict:
    """Defaults with the given values; an unknown one is refused."""
    if extra := set(own or {}) - set(spec.defaults):
        raise ValueError(f"unknown parameters {sorted(extra)} of {spec.name}")
    return {**spec.defaults, **(own or {})}


@dataclass
class Analysis:
    """The sections that were made and a record per measurement: (name, version, status, message)."""

    sections: dict[str, DataFrame]
    runs: list[tuple[str, str, str, str]]

    def document(self) -> DataFrame:
        """One row per recording with a nullable struct per section, as it goes to JSON."""
        out = None
        for name, df in self.sections.items():
            part = df.select(KEY, F.struct(*[c for c in df.columns if c != KEY]).alias(name))
            out = part if out is None else out.join(part, KEY, "full_outer")
        return out


def analyze(samples: DataFrame, rate: int, names: Iterable[str] | None = None, params: dict | None = None) -> Analysis:
    """Plan the named measurements (all by default) and what they need over samples
    (recording_id, channel, idx, v).

    One that cannot be planned is recorded as failed, those that need it as skipped; the rest goes on.
    """
    specs = resolve_order(names)
    params = params or {}
    if extra := set(params) - set(REGISTRY):
        raise ValueError(f"parameters of unknown analyzers {sorted(extra)}")
    context = Context(samples, rate, {s.name: merge_params(s, params.get(s.name)) for s in specs})
    runs = []
    for s in specs:
        missing = [r for r in s.requires if r not in context.sections]
        if missing:
            runs.append((s.name, s.version, "skipped", f"needs {', '.join(missing)}"))
            continue
        try:
            context.sections[s.name] = s.fn(context)
            runs.append((s.name, s.version, "ok", ""))
        except Exception as error:  # the other measurements go on
            runs.append((s.name, s.version, "failed", str(error)))
    return Analysis(context.sections, runs)


def frequency_step(rate: int, size: int) -> np.ndarray:
    """The frequencies of a transform's bins."""
    return np.fft.rfftfreq(size, 1 / rate)
