"""Checks of processing plans: findings over a table of plans.

A rule is a condition and a message in SQL over p (the plan), a (its recording's measurements, or
null) and, for rules on tracks, t (a track) and u (the one before). All rules of a plan
are evaluated in one projection; nothing is joined but a group for equal file names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import safe_name
from .schemas import SCHEMA_VERSION

#: Engines and what they can do.
ENGINES = {"spark": ("prefilter", "split", "declick", "decrackle", "mono_merge", "speed", "gain")}
AVAILABLE = frozenset(ENGINES)
_STAGES = (("prefilter", "prefilter"), ("split", "split"), ("declick", "declick"), ("decrackle", "decrackle"), ("mono_merge", "mono_merge"), ("speed", "speed"), ("normalize", "gain"))
_ORDER = ("error", "warning", "info")


@dataclass(frozen=True)
class Rule:
    severity: str
    code: str
    when: str
    message: str
    location: str


_LEVEL = "p.normalize.mode IN ('album_rms', 'album_gated_rms', 'album_lufs')"
_ACTIVE = "p.normalize.enabled AND p.normalize.mode <> 'none'"
_CEILING = "coalesce(p.normalize.peak_ceiling_db, CASE WHEN p.normalize.mode IN ('album_peak', 'track_peak') THEN p.normalize.target_db END)"
_RATIO = "(p.speed.played_rpm / p.speed.intended_rpm)"
_GAIN = (
    "CASE WHEN p.normalize.enabled THEN p.normalize.target_db - CASE WHEN p.normalize.mode IN ('album_peak', 'track_peak') THEN a.peak_db "
    "WHEN p.normalize.mode = 'album_gated_rms' THEN coalesce(a.gated_rms_db, a.rms_db) WHEN p.normalize.mode = 'album_rms' THEN a.rms_db END END"
)
_SAME = "a.sha256 = p.source.sha256"
_MEASURED = f"a IS NOT NULL AND {_SAME}"
_LAST = "element_at(p.split.tracks, -1).end_sample"
_CONTIGUOUS = "size(filter(p.split.tracks, (t, i) -> i > 0 AND t.start_sample = get(p.split.tracks, i - 1).end_sample))"
_HARD = "aggregate(p.split.tracks, 0, (n, t) -> n + int(t.fade_in_ms = 0 AND t.start_sample > 0) + int(t.fade_out_ms = 0 AND t.end_sample < p.source.num_samples))"
_ORPHANS = "array_except(transform(p.metadata.tracks, m -> m.index), transform(p.split.tracks, t -> t.index))"

PLAN_RULES = (
    Rule("error", "schema-version", f"split(p.schema_version, '[.]')[0] <> '{SCHEMA_VERSION.split('.')[0]}'", "concat('schema version ', p.schema_version, ' is not understood')", "schema_version"),
    *[
        Rule("error", code, f"p.{section}.enabled" + (" AND p.normalize.mode <> 'none'" if section == "normalize" else "") + f" AND {test}", f"concat('engine ', p.{section}.engine, '{text}')", f"{section}.engine")
        for section, capability in _STAGES
        for code, test, text in (
            ("unknown-engine", f"p.{section}.engine NOT IN ({', '.join(map(repr, ENGINES))})", " is not known"),
            ("engine-capability", f"p.{section}.engine IN ({', '.join(map(repr, ENGINES))}) AND p.{section}.engine NOT IN ({', '.join([repr(e) for e, c in ENGINES.items() if capability in c] or [repr('')])})", f" cannot do {capability}"),
            ("engine-unavailable", f"p.{section}.engine IN ({', '.join(map(repr, ENGINES))}) AND p.{section}.engine NOT IN ({', '.join(map(repr, AVAILABLE))})", " is not available"),
        )
    ],
    Rule("warning", "prefilter-no-op", "p.prefilter.enabled AND NOT p.prefilter.dc_block AND p.prefilter.highpass_hz IS NULL", "'prefilter is enabled and does nothing'", "prefilter"),
    Rule("warning", "subsonic-cutoff-high", "p.prefilter.enabled AND p.prefilter.highpass_hz > 40", "concat('a cutoff of ', p.prefilter.highpass_hz, ' Hz takes away music')", "prefilter.highpass_hz"),
    Rule("info", "subsonic-cutoff-outside-band", "p.prefilter.enabled AND p.prefilter.highpass_hz <= 40 AND p.prefilter.highpass_hz NOT BETWEEN 20 AND 30", "concat('a cutoff of ', p.prefilter.highpass_hz, ' Hz lies outside of 20 to 30')", "prefilter.highpass_hz"),
    Rule("error", "decrackle-without-threshold", "p.decrackle.enabled AND p.decrackle.threshold IS NULL", "'decrackle has no threshold'", "decrackle.threshold"),
    Rule("warning", "decrackle-width-is-clicks", "p.decrackle.enabled AND p.decrackle.max_event_width_samples > 3", "concat('events of ', p.decrackle.max_event_width_samples, ' samples are clicks')", "decrackle.max_event_width_samples"),
    Rule("info", "decrackle-without-declick", "p.decrackle.enabled AND NOT p.declick.enabled", "'decrackle runs without declick'", "decrackle"),
    Rule("warning", "decrackle-with-pitch-protection", "p.decrackle.enabled AND map_contains_key(p.declick.params, 'confirm_k')", "'decrackle undoes what the confirmation of clicks protects'", "decrackle"),
    Rule("warning", "mono-merge-without-two-walls", "p.mono_merge.enabled AND p.source.channels < 2", "concat('the source has ', p.source.channels, ' channel')", "mono_merge"),
    Rule("warning", "mono-merge-window-short", "p.mono_merge.enabled AND p.mono_merge.strategy = 'level_matched' AND p.mono_merge.level_window_seconds < 0.05", "concat('a window of ', p.mono_merge.level_window_seconds, ' s follows the damage')", "mono_merge.level_window_seconds"),
    Rule("error", "speed-without-both-rpm", "p.speed.enabled AND (p.speed.played_rpm IS NULL OR p.speed.intended_rpm IS NULL)", "'speed needs both speeds'", "speed"),
    Rule("warning", "speed-no-op", f"p.speed.enabled AND {_RATIO} = 1", "'both speeds are the same'", "speed"),
    Rule("warning", "speed-correction-is-gross", f"p.speed.enabled AND {_RATIO} <> 1 AND abs(1200 * log2({_RATIO})) > 100", f"concat('a correction of ', round(abs(1200 * log2({_RATIO}))), ' cents')", "speed"),
    Rule("info", "speed-and-resample", f"p.speed.enabled AND {_RATIO} IS NOT NULL AND p.export.sample_rate IS NOT NULL", "'the signal is resampled twice'", "speed"),
    Rule("warning", "unsplit-multitrack", "NOT p.split.enabled AND size(p.metadata.tracks) > 1", "concat('no split, but ', size(p.metadata.tracks), ' tracks are named')", "split"),
    Rule("warning", "orphan-metadata", f"p.split.enabled AND size({_ORPHANS}) > 0", f"concat('tracks that are not made: ', array_join({_ORPHANS}, ', '))", "metadata.tracks"),
    Rule("warning", "hard-cut", f"p.split.enabled AND size(p.split.tracks) > 0 AND {_HARD} > 0 AND {_CONTIGUOUS} < size(p.split.tracks) - 1", f"concat({_HARD}, ' edges without a fade')", "split.tracks"),
    Rule("error", "filename-template", r"size(array_except(regexp_extract_all(p.export.track_filename_template, '[{]([^}:]*)', 1), array('index', 'title', 'artist', 'album_artist', 'album', 'year', 'position', 'catalog_number'))) > 0", "concat('unknown field in ', p.export.track_filename_template)", "export.track_filename_template"),
    Rule("warning", "rms-without-peak-ceiling", f"{_ACTIVE} AND {_LEVEL} AND p.normalize.peak_ceiling_db IS NULL", "concat(p.normalize.mode, ' says nothing of peaks')", "normalize.peak_ceiling_db"),
    Rule("warning", "lufs-target-is-loud", f"{_ACTIVE} AND p.normalize.mode = 'album_lufs' AND p.normalize.target_db > -9", "concat('a target of ', p.normalize.target_db, ' LUFS')", "normalize.target_db"),
    Rule("info", "ungated-rms", f"{_ACTIVE} AND p.normalize.mode = 'album_rms'", "'silence counts in an ungated level'", "normalize.mode"),
    Rule("warning", "no-headroom", f"{_ACTIVE} AND {_CEILING} > -0.5", f"concat('a ceiling of ', {_CEILING}, ' dB')", "normalize"),
    Rule("info", "pointless-dither", "p.export.dither <> 'none' AND p.export.bit_depth >= 24", "'dither at 24 bits is below the noise'", "export.dither"),
    Rule("info", "resampling", "p.export.sample_rate <> p.source.sample_rate", "concat(p.source.sample_rate, ' Hz to ', p.export.sample_rate, ' Hz')", "export.sample_rate"),
    Rule("warning", "no-album-title", "p.export.write_tags AND p.metadata.enabled AND coalesce(p.metadata.album, '') = ''", "'no title of the album'", "metadata.album"),
    Rule("error", "missing-audio", "a IS NOT NULL AND NOT a.file_exists", "concat('no file ', p.source.path)", "source"),
    Rule("error", "source-mismatch", "a.file_exists AND a.digest <> p.source.sha256", "'the file is not the one of the plan'", "source.sha256"),
    Rule("error", "source-length-mismatch", "a.file_exists AND a.num_samples <> p.source.num_samples", "concat('the file has ', a.num_samples, ' samples')", "source.num_samples"),
    Rule("warning", "analysis-digest-drift", "p.analysis.sha256 <> a.analysis_sha256", "'the analysis has changed since the plan was made'", "analysis.sha256"),
    Rule("error", "analysis-mismatch", f"a IS NOT NULL AND NOT ({_SAME})", "'the analysis is of another recording'", "analysis"),
    Rule("info", "track-into-runout", f"{_MEASURED} AND p.split.enabled AND {_LAST} > a.lead_out_start_sample + p.source.sample_rate", "'the last track reaches into the run-out'", "split.tracks"),
    Rule("warning", "mono-merge-on-stereo-material", f"{_MEASURED} AND p.mono_merge.enabled AND a.channel_correlation < 0.9", "concat('a correlation of ', round(a.channel_correlation, 3))", "mono_merge"),
    Rule("warning", "normalize-clipped-source", f"{_MEASURED} AND a.clipped_regions > 0 AND {_GAIN} > 0", "concat(a.clipped_regions, ' clipped regions get louder')", "normalize"),
    Rule("warning", "true-peak-over-full-scale", f"{_MEASURED} AND p.normalize.peak_ceiling_db IS NULL AND a.true_peak_db + {_GAIN} > 0", "'the true peak will clip'", "normalize"),
    Rule("info", "thin-true-peak-headroom", f"{_MEASURED} AND p.normalize.peak_ceiling_db IS NULL AND a.true_peak_db + {_GAIN} > -0.7 AND a.true_peak_db + {_GAIN} <= 0", "'less than 0.7 dB over the true peak'", "normalize"),
)
_SECONDS = "((t.end_sample - t.start_sample) / p.source.sample_rate)"
TRACK_RULES = (
    Rule("warning", "short-track", f"{_SECONDS} < 5", f"concat('track ', t.index, ' lasts ', round({_SECONDS}, 2), ' s')", "split.tracks"),
    Rule("error", "track-past-end", "p.source.num_samples > 0 AND t.end_sample > p.source.num_samples", "concat('track ', t.index, ' ends after the recording')", "split.tracks"),
    Rule("error", "fade-longer-than-track", f"(t.fade_in_ms + t.fade_out_ms) / 1000 > {_SECONDS}", "concat('the fades of track ', t.index, ' are longer than it')", "split.tracks"),
    Rule("warning", "missing-title", "p.metadata.enabled AND NOT exists(p.metadata.tracks, m -> m.index = t.index AND m.title IS NOT NULL)", "concat('track ', t.index, ' has no title')", "metadata.tracks"),
    Rule("error", "gapless-fade", "u IS NOT NULL AND t.start_sample = u.end_sample AND (u.fade_out_ms > 0 OR t.fade_in_ms > 0)", "concat('a fade at the joint of tracks ', u.index, ' and ', t.index)", "split.tracks"),
)


def _fired(rule: Rule) -> str:
    return f"CASE WHEN coalesce({rule.when}, false) THEN named_struct('severity', '{rule.severity}', 'code', '{rule.code}', 'message', {rule.message}, 'location', '{rule.location}') END"


def lint(plans: DataFrame) -> DataFrame:
    """(plan_id, severity, code, message, location) of plans (plan_id, p, a): a may be null."""
    own = "array(" + ", ".join(_fired(r) for r in PLAN_RULES) + ")"
    per_track = "array(" + ", ".join(_fired(r) for r in TRACK_RULES).replace("u.", "get(p.split.tracks, i - 1).").replace("u IS NOT NULL", "i > 0") + ")"
    tracks = f"CASE WHEN p.split.enabled THEN flatten(transform(p.split.tracks, (t, i) -> {per_track})) ELSE array() END"
    found = plans.select("plan_id", F.explode(F.expr(f"filter(concat({own}, {tracks}), f -> f IS NOT NULL)")).alias("f")).select("plan_id", "f.*")
    return found.unionByName(collisions(plans))


def collisions(plans: DataFrame) -> DataFrame:
    """Tracks of a plan that get the same file name, by their titles."""
    rows = plans.where("p.split.enabled").select("plan_id", "p.metadata.tracks", F.col("p.export.track_filename_template").alias("template"), F.explode("p.split.tracks").alias("t"))
    title = F.coalesce(F.expr("get(filter(tracks, m -> m.index = t.index), 0).title"), F.format_string("Track %02d", F.col("t.index")))
    name = F.replace(F.replace(F.col("template"), F.lit("{index:02d}"), F.lpad(F.col("t.index").cast("string"), 2, "0")), F.lit("{title}"), safe_name(title))
    named = rows.select("plan_id", F.col("t.index").alias("index"), name.alias("name"))
    again = named.withColumn("first", F.min("index").over(Window.partitionBy("plan_id", "name"))).where("index > first")
    return again.select("plan_id", F.lit("error").alias("severity"), F.lit("filename-collision").alias("code"), F.format_string("tracks %d and %d both get %s", "first", "index", "name").alias("message"), F.lit("export.track_filename_template").alias("location"))


def by_severity(findings: DataFrame) -> DataFrame:
    """Errors first, then warnings, then remarks."""
    rank = F.array_position(F.array(*map(F.lit, _ORDER)), F.col("severity"))
    return findings.orderBy("plan_id", rank, "code", "location", "message")


def errors(findings: DataFrame) -> DataFrame:
    """Findings that stop a run."""
    return findings.where("severity = 'error'")
