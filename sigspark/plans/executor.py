"""Execution of a processing plan over one or many recordings.

Ten stages in a fixed order: prefilter, declick, decrackle, mono_merge and speed on whole recordings, then
split, normalize, resample, export and metadata on tracks. Samples are rows
(recording_id, channel, idx, v); every stage is a lazy DataFrame transformation.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import fade_gain, to_db
from ..functions.kernels import speed_ratio
from ..operators import blocks as bl
from ..operators import clicks as cl
from ..operators import events as ev
from ..operators import framing as fr
from ..operators import levels as lv
from ..operators.framing import KEY
from ..operators.intervals import inside_spans
from ..operators.transforms import apply_gain, mono_merge
from .analyzers import loudness_blocks
from .receipts import digest_json
from .schemas import complete

STAGES = ("prefilter", "declick", "decrackle", "mono_merge", "speed", "split", "normalize", "resample", "export", "metadata")
_MARK = "\x01"


def by_channel(samples: DataFrame) -> DataFrame:
    """Each channel as a recording of its own."""
    return samples.select(F.concat_ws(_MARK, KEY, F.col("channel").cast("string")).alias(KEY), "idx", "v")


def from_channels(samples: DataFrame) -> DataFrame:
    """Back from by_channel."""
    parts = F.split(KEY, _MARK)
    return samples.select(parts[0].alias(KEY), parts[1].cast("int").alias("channel"), "idx", "v")


def spread_events(events: DataFrame, samples: DataFrame) -> DataFrame:
    """The same events on every channel of a recording."""
    channels = samples.select(KEY, "channel").distinct()
    return events.join(channels, KEY).select(F.concat_ws(_MARK, KEY, F.col("channel").cast("string")).alias(KEY), "start_idx", "end_idx")


def repair_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """(recording_id, changed, total): frames in which a repair changed any channel."""
    was = before.select(KEY, "channel", "idx", F.col("v").alias("was"))
    frames = after.join(was, [KEY, "channel", "idx"]).groupBy(KEY, "idx").agg(F.max(F.col("v") != F.col("was")).alias("changed"))
    return frames.groupBy(KEY).agg(F.count_if("changed").alias("changed"), F.count(F.lit(1)).alias("total"))


@dataclass
class Result:
    """tracks: (recording_id, track_index, channel, idx, v); gains; stages: (stage, status, params digest, detail)."""

    tracks: DataFrame
    gains: DataFrame
    tags: DataFrame
    events: dict[str, DataFrame] = field(default_factory=dict)
    #: By repair stage: (recording_id, changed, total), counted over frames.
    repairs: dict[str, DataFrame] = field(default_factory=dict)
    stages: list[tuple[str, str, str, str]] = field(default_factory=list)
    rate: int = 0


def execute(samples: DataFrame, plan: dict, lengths: DataFrame | None = None) -> Result:
    """Run a plan. Disabled stages are left out and recorded as skipped; what an algorithm cannot honour is refused.

    Nothing is written: export and metadata are recorded as pending, until render writes the tracks.
    With lengths (recording_id, n) the plan's positions are shares of its num_samples, laid over each recording's n samples.
    """
    plan = complete(plan)
    rate, out = plan["source"]["sample_rate"], Result(samples, None, None)

    def done(stage: str, detail: str = "", ran: bool = True, status: str = "applied") -> None:
        section = plan.get({"resample": "export"}.get(stage, stage), {})
        out.stages.append((stage, status if ran else "skipped", digest_json({k: v for k, v in section.items() if k != "decision"}), detail))

    samples = _prefilter(samples, plan["prefilter"], rate, done)
    samples = _declick(samples, plan["declick"], rate, out, done)
    samples = _decrackle(samples, plan["decrackle"], rate, out, done)
    samples = _mono_merge(samples, plan["mono_merge"], rate, done)
    samples, ratio = _speed(samples, plan["speed"], done)
    tracks = _split(samples, plan["split"], plan["source"], ratio, rate, done, lengths)
    tracks, out.gains = _normalize(tracks, plan["normalize"], rate, done)
    tracks, out.rate = _resample(tracks, plan["export"], rate, done)
    out.tracks = tracks
    done("export", "no file is written yet", status="pending")
    out.tags = _tags(samples.sparkSession, plan)
    done("metadata", "no tag is written yet", ran=plan["metadata"]["enabled"], status="pending")
    return out


def _prefilter(samples: DataFrame, p: dict, rate: int, done) -> DataFrame:
    if not p["enabled"] or not p["dc_block"] and p["highpass_hz"] is None:
        done("prefilter", ran=False)
        return samples
    keyed = by_channel(samples)
    if p["dc_block"]:
        keyed = lv.remove_dc(keyed)
    if p["highpass_hz"] is not None:
        keyed = bl.subsonic(keyed, rate, p["highpass_hz"], p["highpass_rolloff_db_per_octave"])
    done("prefilter")
    return from_channels(keyed)


def _mono(samples: DataFrame) -> DataFrame:
    return samples.groupBy(KEY, "idx").agg(F.avg("v").alias("v"))


def _declick(samples: DataFrame, p: dict, rate: int, out: Result, done) -> DataFrame:
    if not p["enabled"]:
        done("declick", ran=False)
        return samples
    if p["algorithm"] != "block_ratio" or p["preset"]:
        raise ValueError(f"declick cannot honour algorithm {p['algorithm']!r} with preset {p['preset']!r}")
    if p["threshold"] is None:
        raise ValueError("declick needs a threshold")
    mono, params = _mono(samples), p["params"]
    if extra := set(params) - {"confirm_k", "repair"}:
        raise ValueError(f"unknown parameters {sorted(extra)} of declick")
    events = cl.detect(mono, rate, (float(p["threshold"]),), width_ms=p["max_click_width_ms"])
    if "confirm_k" in params:
        events = cl.confirm(mono, events, float(params["confirm_k"]))
    out.events["declick"] = events
    # Widest click in samples: the order of the prediction follows it.
    order = 3 * max(1, round(p["max_click_width_ms"] / 1000 * rate)) + 2
    fixed = cl.repair(by_channel(samples), spread_events(events, samples), params.get("repair", "hermite"), p["strength"], order=order, context=max(2048, 8 * order))
    done("declick", f"threshold {p['threshold']}")
    out.repairs["declick"] = repair_counts(samples, from_channels(fixed))
    return from_channels(fixed)


def _decrackle(samples: DataFrame, p: dict, rate: int, out: Result, done) -> DataFrame:
    if not p["enabled"]:
        done("decrackle", ran=False)
        return samples
    if p["algorithm"] != "curvature_ratio":
        raise ValueError(f"decrackle cannot honour algorithm {p['algorithm']!r}")
    if p["threshold"] is None:
        raise ValueError("decrackle needs a threshold")
    context = max(3, round(float(p["params"].get("context_ms", 40.0)) / 1000 * rate))
    events = ev.crackle(fr.curvature_ratio(_mono(samples), context), p["threshold"], p["max_event_width_samples"])
    out.events["decrackle"] = events
    done("decrackle", f"threshold {p['threshold']}")
    fixed = from_channels(cl.repair(by_channel(samples), spread_events(events, samples), "hermite", p["strength"]))
    out.repairs["decrackle"] = repair_counts(samples, fixed)
    return fixed


def _mono_merge(samples: DataFrame, p: dict, rate: int, done) -> DataFrame:
    if not p["enabled"]:
        done("mono_merge", ran=False)
        return samples
    done("mono_merge", p["strategy"])
    if p["strategy"] in ("left", "right"):
        return samples.where(F.col("channel") == (p["strategy"] == "right")).withColumn("channel", F.lit(0))
    two = samples.groupBy(KEY, "idx").agg(F.max(F.when(F.col("channel") == 0, F.col("v"))).alias("l"), F.max(F.when(F.col("channel") == 1, F.col("v"))).alias("r"))
    merged = mono_merge(two.withColumn("r", F.coalesce("r", "l")), max(1, round(p["level_window_seconds"] * rate)))
    return merged.select(KEY, F.lit(0).alias("channel"), "idx", "v")


def _speed(samples: DataFrame, p: dict, done):
    if not p["enabled"] or p["played_rpm"] == p["intended_rpm"]:
        done("speed", ran=False)
        return samples, None
    ratio = speed_ratio(p["played_rpm"], p["intended_rpm"])
    done("speed", f"{ratio.numerator}/{ratio.denominator}")
    return from_channels(bl.resampled(by_channel(samples), ratio.numerator, ratio.denominator)), ratio


def _split(samples: DataFrame, p: dict, source: dict, ratio, rate: int, done, lengths: DataFrame | None = None) -> DataFrame:
    if not p["enabled"]:
        done("split", ran=False)
        return samples.withColumn("track_index", F.lit(1))
    # Positions stay those of the source; a changed speed maps them by the realised ratio.
    n = source["num_samples"]
    realised = -(-n * ratio.numerator // ratio.denominator) / n if ratio else 1.0
    if lengths is not None:
        realised = 1.0
    place = lambda x: min(max(round(x * realised), 0), round(n * realised))
    rows = [(t["index"], place(t["start_sample"]), place(t["end_sample"]), round(t.get("fade_in_ms", 0) / 1000 * rate), round(t.get("fade_out_ms", 0) / 1000 * rate)) for t in p["tracks"]]
    spans = samples.sparkSession.createDataFrame(rows, "track_index int, start_idx long, end_idx long, fade_in int, fade_out int")
    if lengths is None:
        # The plan's tracks alone are a short list; what they make with the recordings grows with these.
        spans = samples.select(KEY).distinct().join(F.broadcast(spans))
    else:
        long = F.col("n") if ratio is None else F.expr(f"(n * {ratio.numerator} + {ratio.denominator - 1}) div {ratio.denominator}")
        spans = lengths.select(KEY, long.alias("long")).join(F.broadcast(spans))
        spans = spans.withColumns({c: F.expr(f"{c} * long div {n}") for c in ("start_idx", "end_idx")}).drop("long")
    inside = inside_spans(samples, "idx", spans)
    gain = fade_gain(F.col("idx"), F.col("start_idx"), F.col("end_idx"), F.col("fade_in"), F.col("fade_out"))
    done("split", f"{len(rows)} tracks")
    return inside.select(KEY, "track_index", "channel", (F.col("idx") - F.col("start_idx")).alias("idx"), (F.col("v") * gain).alias("v"))


def _as_recordings(tracks: DataFrame) -> DataFrame:
    return tracks.select(F.concat_ws(_MARK, KEY, F.col("track_index").cast("string")).alias(KEY), "channel", "idx", "v")


def _album(df: DataFrame) -> DataFrame:
    return df.withColumn("track_index", F.split(KEY, _MARK)[1].cast("int")).withColumn(KEY, F.split(KEY, _MARK)[0])


def _normalize(tracks: DataFrame, p: dict, rate: int, done):
    none = tracks.sparkSession.createDataFrame([], f"{KEY} string, gain_db double")
    if not p["enabled"] or p["mode"] == "none":
        done("normalize", ran=False)
        return tracks, none
    mode, target, keys = p["mode"], p["target_db"], (KEY,)
    keyed = _as_recordings(tracks)
    if mode == "track_peak":
        keys = (KEY, "track_index")
        level = tracks.groupBy(*keys).agg(to_db(F.max(F.abs("v"))).alias("level_db"))
    elif mode == "album_peak":
        level = tracks.groupBy(*keys).agg(to_db(F.max(F.abs("v"))).alias("level_db"))
    elif mode == "album_rms":
        level = tracks.groupBy(*keys).agg(to_db(F.sqrt(F.avg(F.col("v") ** 2))).alias("level_db"))
    elif mode == "album_gated_rms":
        power = keyed.groupBy(KEY, "idx").agg(F.sqrt(F.avg(F.col("v") ** 2)).alias("v"))
        blocks = _album(fr.hop_frames(power, round(0.4 * rate), round(0.1 * rate)))
        square = F.col("rms") ** 2
        level = lv.gated_level(blocks, square, 10 * F.log10(square), keys)
    elif mode == "album_lufs":
        blocks = _album(loudness_blocks(keyed, rate))
        level = lv.gated_level(blocks, F.col("power"), -0.691 + 10 * F.log10(F.greatest("power", F.lit(1e-24))), keys, offset=-0.691)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    gain = level.select(*keys, (F.lit(target) - F.col("level_db")).alias("gain_db"))
    if p["peak_ceiling_db"] is not None:
        # The tracks of all modes but track_peak share one gain, held back by the loudest of them.
        peaks = from_channels_peaks(bl.true_peaks(by_channel(keyed)), keys)
        gain = gain.join(peaks, list(keys)).select(*keys, F.least("gain_db", F.lit(p["peak_ceiling_db"]) - F.col("true_peak_db")).alias("gain_db"))
    gain = gain.withColumn("gain_db", F.round("gain_db", 4))  # what is recorded is what is applied
    done("normalize", f"{mode} {target}")
    return apply_gain(tracks, gain, keys), gain


def from_channels_peaks(peaks: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """True peaks of tracks' channels as (keys, true_peak_db)."""
    parts = F.split(KEY, _MARK)
    rows = peaks.select(parts[0].alias(KEY), parts[1].cast("int").alias("track_index"), "true_peak")
    return rows.groupBy(*keys).agg(to_db(F.max("true_peak")).alias("true_peak_db"))


def _resample(tracks: DataFrame, p: dict, rate: int, done):
    wanted = p["sample_rate"]
    if wanted is None or wanted == rate:
        done("resample", ran=False)
        return tracks, rate
    g = math.gcd(wanted, rate)
    keyed = tracks.select(F.concat_ws(_MARK, KEY, F.col("track_index").cast("string"), F.col("channel").cast("string")).alias(KEY), "idx", "v")
    new = bl.resampled(keyed, wanted // g, rate // g)
    parts = F.split(KEY, _MARK)
    done("resample", f"{rate} to {wanted}")
    return new.select(parts[0].alias(KEY), parts[1].cast("int").alias("track_index"), parts[2].cast("int").alias("channel"), "idx", "v"), wanted


def _tags(spark: SparkSession, plan: dict) -> DataFrame:
    """(track_index, key, value): album tags on each track, the track's own title, artist and position."""
    m, rows = plan["metadata"], []
    if m["enabled"]:
        total = len(plan["split"]["tracks"])
        for t in plan["split"]["tracks"]:
            own = next((x for x in m["tracks"] if x["index"] == t["index"]), {})
            values = {"title": own.get("title") or f"Track {t['index']:02d}", "artist": own.get("artist") or m["artist"] or m["album_artist"], "album": m["album"], "albumartist": m["album_artist"], "date": m["year"], "genre": m["genre"], "catalognumber": m["catalog_number"], "position": own.get("position"), "tracknumber": f"{t['index']}/{total}"}
            rows += [(t["index"], k, str(v)) for k, v in values.items() if v is not None]
    return spark.createDataFrame(rows, "track_index int, key string, value string")
