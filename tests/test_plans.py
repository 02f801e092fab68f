"""Checks, execution and measurements of plans."""

import ast
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.plans import analyzers as an
from sigspark.plans import lint, naming, receipts
from sigspark.plans.executor import STAGES, execute
from sigspark.plans.schemas import ANALYSIS, PLAN, complete

from . import synth

RATE = 44_100


def plan(**changes):
    base = {
        "source": {"path": "a.wav", "sha256": "s", "sample_rate": RATE, "channels": 2, "num_samples": 60 * RATE},
        "split": {"tracks": [{"index": 1, "start_sample": 0, "end_sample": 20 * RATE, "fade_in_ms": 20.0, "fade_out_ms": 30.0}, {"index": 2, "start_sample": 22 * RATE, "end_sample": 50 * RATE, "fade_in_ms": 20.0, "fade_out_ms": 30.0}]},
        "declick": {"threshold": 20.0}, "metadata": {"album": "A", "tracks": [{"index": 1, "title": "One"}, {"index": 2, "title": "Two"}]},
    }
    out = complete(base)
    for section, values in changes.items():
        out[section] = values if not isinstance(values, dict) else {**out.get(section, {}), **values}
    return out


def track(index, start, end, fade_in=20.0, fade_out=30.0):
    return {"index": index, "start_sample": int(start * RATE), "end_sample": int(end * RATE), "fade_in_ms": fade_in, "fade_out_ms": fade_out}


MEASURED = {"sha256": "s", "analysis_sha256": "a", "digest": "s", "num_samples": 60 * RATE, "file_exists": True, "channel_correlation": 0.99, "peak_db": -6.0, "rms_db": -20.0, "true_peak_db": -5.9, "clipped_regions": 0, "lead_out_start_sample": 55 * RATE}
CASES = [
    ("schema-version", plan(schema_version="4.0"), None), ("unknown-engine", plan(declick={"engine": "other"}), None),
    ("prefilter-no-op", plan(prefilter={"enabled": True}), None), ("subsonic-cutoff-high", plan(prefilter={"enabled": True, "highpass_hz": 60.0}), None),
    ("subsonic-cutoff-outside-band", plan(prefilter={"enabled": True, "highpass_hz": 35.0}), None), ("decrackle-without-threshold", plan(decrackle={"enabled": True}), None),
    ("decrackle-width-is-clicks", plan(decrackle={"enabled": True, "threshold": 4.0, "max_event_width_samples": 5}), None), ("decrackle-without-declick", plan(decrackle={"enabled": True, "threshold": 4.0}, declick={"enabled": False}), None),
    ("decrackle-with-pitch-protection", plan(decrackle={"enabled": True, "threshold": 4.0}, declick={"params": {"confirm_k": "5"}}), None), ("mono-merge-without-two-walls", plan(mono_merge={"enabled": True}, source={"channels": 1}), None),
    ("mono-merge-window-short", plan(mono_merge={"enabled": True, "level_window_seconds": 0.01}), None), ("speed-without-both-rpm", plan(speed={"enabled": True, "played_rpm": 33.3}), None),
    ("speed-no-op", plan(speed={"enabled": True, "played_rpm": 45.0, "intended_rpm": 45.0}), None), ("speed-correction-is-gross", plan(speed={"enabled": True, "played_rpm": 45.0, "intended_rpm": 33.3}), None),
    ("speed-and-resample", plan(speed={"enabled": True, "played_rpm": 33.4, "intended_rpm": 33.3}, export={"sample_rate": 48000}), None), ("unsplit-multitrack", plan(split={"enabled": False}), None),
    ("orphan-metadata", plan(metadata={"tracks": [{"index": i, "title": str(i)} for i in (1, 2, 3)]}), None), ("hard-cut", plan(split={"tracks": [track(1, 1, 20, 0.0), track(2, 22, 50)]}), None),
    ("filename-template", plan(export={"track_filename_template": "{nothing}"}), None), ("rms-without-peak-ceiling", plan(normalize={"mode": "album_rms", "target_db": -20.0}), None),
    ("lufs-target-is-loud", plan(normalize={"mode": "album_lufs", "target_db": -5.0}), None), ("ungated-rms", plan(normalize={"mode": "album_rms", "target_db": -20.0}), None),
    ("no-headroom", plan(normalize={"target_db": -0.1}), None), ("pointless-dither", plan(export={"dither": "tpdf"}), None), ("resampling", plan(export={"sample_rate": 48000}), None),
    ("no-album-title", plan(metadata={"album": None}), None), ("missing-audio", plan(), {**MEASURED, "file_exists": False}), ("source-mismatch", plan(), {**MEASURED, "digest": "t"}),
    ("source-length-mismatch", plan(), {**MEASURED, "num_samples": 5}), ("analysis-digest-drift", plan(analysis={"sha256": "b"}), MEASURED), ("analysis-mismatch", plan(), {**MEASURED, "sha256": "t"}),
    ("track-into-runout", plan(), {**MEASURED, "lead_out_start_sample": 40 * RATE}), ("mono-merge-on-stereo-material", plan(mono_merge={"enabled": True}), {**MEASURED, "channel_correlation": 0.5}),
    ("normalize-clipped-source", plan(), {**MEASURED, "clipped_regions": 3}), ("true-peak-over-full-scale", plan(), {**MEASURED, "true_peak_db": -4.0}), ("thin-true-peak-headroom", plan(), {**MEASURED, "true_peak_db": -5.2}),
    ("short-track", plan(split={"tracks": [track(1, 1, 3), track(2, 22, 50)]}), None), ("track-past-end", plan(split={"tracks": [track(1, 1, 20), track(2, 22, 90)]}), None),
    ("fade-longer-than-track", plan(split={"tracks": [track(1, 1, 20, 9000.0, 12000.0), track(2, 22, 50)]}), None), ("missing-title", plan(metadata={"tracks": [{"index": 1, "title": "One"}]}), None),
    ("gapless-fade", plan(split={"tracks": [track(1, 1, 20), track(2, 20, 50)]}), None), ("filename-collision", plan(metadata={"tracks": [{"index": 1, "title": "One"}, {"index": 2, "title": "One"}]}, export={"track_filename_template": "{title}"}), None),
]


@pytest.fixture(scope="module")
def findings(spark):
    rows = [("clean", json.dumps(plan()), json.dumps(MEASURED))] + [(code, json.dumps(p), None if a is None else json.dumps(a)) for code, p, a in CASES]
    df = spark.createDataFrame(rows, "plan_id string, p string, a string")
    parsed = df.select("plan_id", F.from_json("p", PLAN).alias("p"), F.from_json("a", ANALYSIS).alias("a"))
    return lint.lint(parsed).collect()


@pytest.mark.parametrize("code", [c for c, _, _ in CASES])
def test_each_rule(findings, code):
    hits = [f for f in findings if f["plan_id"] == code and f["code"] == code]
    assert hits and hits[0]["message"]


def test_clean_plan(findings):
    assert [f["code"] for f in findings if f["plan_id"] == "clean"] == []


def test_engine_rules(monkeypatch):
    assert {r.code for r in lint.PLAN_RULES + lint.TRACK_RULES} | {"filename-collision"} == {c for c, _, _ in CASES} | {"engine-capability", "engine-unavailable"}


def test_unknown_fields_are_refused():
    for bad in ({"nothing": {}}, {"split": {"nothing": 1}}, {"schema_version": "2.0"}, {"split": {"tracks": [track(1, 5, 5)]}}, {"split": {"tracks": [track(1, 1, 20), track(2, 10, 30)]}}):
        with pytest.raises(ValueError):
            complete(bad)


def run(spark, x, rate, **changes):
    p = {"source": {"sample_rate": rate, "channels": x.shape[1], "num_samples": len(x)}, "declick": {"enabled": False}, "split": {"tracks": [{"index": 1, "start_sample": 2 * rate, "end_sample": 10 * rate, "fade_in_ms": 20.0, "fade_out_ms": 30.0}, {"index": 2, "start_sample": 12 * rate, "end_sample": 19 * rate}]}}
    return execute(synth.frame(spark, x), {**p, **changes})


def arrays(tracks):
    out = {}
    for r in tracks.collect():
        out.setdefault((r["track_index"], r["channel"]), []).append((r["idx"], r["v"]))
    return {key: np.array([v for _, v in sorted(rows)]) for key, rows in out.items()}


def test_album_peak_and_split(spark):
    x, _, _ = synth.side(2000)
    result = run(spark, x, 2000)
    got = arrays(result.tracks)
    assert {k: len(v) for k, v in got.items()} == {(1, 0): 16_000, (1, 1): 16_000, (2, 0): 14_000, (2, 1): 14_000}
    assert 20 * np.log10(max(np.abs(v).max() for v in got.values())) == pytest.approx(-1.0, abs=0.001)
    assert got[1, 0][0] == 0 and [s for s, *_ in result.stages] == list(STAGES)
    gain = 10 ** (result.gains.collect()[0]["gain_db"] / 20)
    assert np.allclose(got[2, 0], x[24_000:38_000, 0] * gain)


def test_track_peak_keeps_ceiling_and_resamples(spark):
    x, _, _ = synth.side(2000)
    x[:20_000] *= 0.5
    result = run(spark, x, 2000, normalize={"mode": "track_peak", "target_db": -1.0, "peak_ceiling_db": -3.0}, export={"sample_rate": 3000})
    got = arrays(result.tracks)
    assert result.rate == 3000 and len(got[1, 0]) == 24_000
    for t in (1, 2):
        assert 20 * np.log10(max(np.abs(got[t, c]).max() for c in (0, 1))) <= -2.9


def test_declick_and_crackle_repair(spark):
    x, _, clicks = synth.side(8000)
    result = run(spark, x, 8000, declick={"threshold": 30.0, "params": {"repair": "ar"}}, split={"enabled": False}, normalize={"mode": "none"})
    got = arrays(result.tracks)[1, 0]
    clean = x[:, 0].copy()
    for c in clicks:
        clean[c : c + 3] -= 0.45
        assert np.abs(got[c - 2 : c + 6] - clean[c - 2 : c + 6]).max() < 0.15  # a repair does not leave the range of its surroundings
    far = np.ones(len(clean), bool)
    for c in clicks:
        far[c - 40 : c + 40] = False
    assert np.abs(got - x[:, 0])[far].max() == 0


def test_prefilter_mono_and_speed(spark):
    x, _, _ = synth.side(2000)
    result = run(spark, x + 0.1, 2000, prefilter={"enabled": True, "dc_block": True, "highpass_hz": 25.0}, mono_merge={"enabled": True}, speed={"enabled": True, "played_rpm": 33.4, "intended_rpm": 33.3}, normalize={"mode": "none"})
    got = arrays(result.tracks)
    assert set(got) == {(1, 0), (2, 0)} and abs(len(got[1, 0]) - 16_000 * 33.4 / 33.3) < 2
    assert abs(np.mean(got[2, 0])) < 0.01


@pytest.mark.parametrize("changes", [{"declick": {"enabled": True}}, {"declick": {"enabled": True, "threshold": 5.0, "preset": "x"}}, {"decrackle": {"enabled": True, "threshold": 4.0, "algorithm": "y"}}, {"normalize": {"mode": "loudest"}}])
def test_refusals(spark, changes):
    with pytest.raises(ValueError):
        run(spark, np.zeros((40_000, 2)), 2000, **changes)


def test_registry_order_and_errors():
    assert len(an.REGISTRY) == 14
    order = [s.name for s in an.resolve_order(["run_out"])]
    assert order.index("silence") < order.index("periodicity") < order.index("run_out") and "clicks" not in order
    with pytest.raises(ValueError):
        an.resolve_order(["nothing"])
    with pytest.raises(ValueError):
        an.merge_params(an.REGISTRY["silence"], {"nothing": 1})


def test_measurements_of_a_side(spark):
    rate = 2000
    x, spans, _ = synth.side(rate)
    got = an.analyze(synth.frame(spark, x), rate, ["recording_info", "silence", "boundaries", "peaks", "dynamic_range", "clipping", "transients"])
    assert all(status == "ok" for _, _, status, _ in got.runs), got.runs
    doc = got.document().collect()[0]
    regions = [(r["start_idx"], r["end_idx"]) for r in doc["silence"]["regions"]]
    truth = [(0, spans[0][0]), (spans[0][1], spans[1][0]), (spans[1][1], len(x))]
    assert len(regions) == 3 and all(abs(a - c) <= 0.3 * rate and abs(b - d) <= 0.3 * rate for (a, b), (c, d) in zip(regions, truth))
    assert doc["recording_info"]["correlation"] == pytest.approx(1, abs=1e-6) and doc["recording_info"]["balance_db"] == pytest.approx(-20 * np.log10(0.985), abs=1e-3)
    assert doc["peaks"]["peak_db"] == pytest.approx(20 * np.log10(np.abs(x).max()), abs=1e-9) and doc["peaks"]["true_peak_db"] >= doc["peaks"]["peak_db"] - 0.1
    assert any(c["method"] == "silence" and spans[0][1] < c["sample"] < spans[1][0] for c in doc["boundaries"]["candidates"])


def test_remaining_measurements(spark):
    rate = 2000
    x, _, _ = synth.side(rate)
    got = an.analyze(synth.frame(spark, x), rate, ["band_profile", "spectral", "clicks", "run_out", "periodicity"], {"band_profile": {"edges_hz": (40, 150, 400, 900)}, "spectral": {"nperseg": 512, "hiss_hz": 800.0}})
    assert all(status == "ok" for _, _, status, _ in got.runs), got.runs
    for name in ("band_profile", "spectral", "clicks", "periodicity", "run_out"):
        rows = got.sections[name].collect()
        assert len(rows) == 1 and rows[0]["recording_id"] == "side", name
    assert 200 < got.sections["spectral"].collect()[0]["centroid_mean_hz"] < 900


def test_names_and_receipts(spark):
    tracks = spark.createDataFrame([(1, 'A/B: "x"?. '), (2, ""), (3, None), (4, "é")], "index int, title string")
    got = {r["index"]: r["filename"] for r in naming.render(tracks.withColumn("title", F.coalesce("title", F.lit(""))), "{index:02d} - {title}", "flac").collect()}
    assert got == {1: "01 - A_B_ _x__.flac", 2: "02 - untitled.flac", 3: "03 - untitled.flac", 4: "04 - é.flac"}
    with pytest.raises(ValueError):
        naming.render(tracks, "{nothing}", "flac")
    assert receipts.canonical_json({"b": 1, "a": [1.5, None]}) == '{"a":[1.5,null],"b":1}'
    assert receipts.run_key("s", {"x": 1}) == receipts.run_key("s", {"x": 1}) != receipts.run_key("s", {"x": 2})
    assert len(receipts.short_digest(receipts.digest_json({}))) == 12


def test_layers_do_not_import_upwards():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "sigspark")
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) == "llm":
            continue
        for name in files:
            if not name.endswith(".py"):
                continue
            with open(os.path.join(folder, name)) as f:
                tree = ast.parse(f.read())
            for node in ast.walk(tree):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n.split(".") for n in names), (folder, name)
                if os.path.basename(folder) in ("functions", "operators"):
                    assert not any("plans" in n.split(".") for n in names), (folder, name)


def test_registered_plan_covers_whole_recordings(spark):
    from sigspark import queries
    from sigspark.sources import signals as sg

    sf_dir = "/root/testdata/sf0.01"
    n = {r["recording_id"]: r["n"] for r in queries.lengths(sg.events_by(spark, sf_dir, "event_type")).collect()}
    assert min(n.values()) > 1000
    got = {(r["recording_id"], r["track_index"]): r["n"] for r in queries.execute_plan(spark, sf_dir).collect()}
    assert got == {(k, i): b * m // 1000 - a * m // 1000 for k, m in n.items() for i, a, b in queries.PLAN_TRACKS}


def test_render_writes_measures_and_verifies(spark, tmp_path):
    from sigspark.plans import render as rd

    rng = np.random.default_rng(2)
    x = np.stack([0.3 * np.sin(np.arange(6000) * 0.05), 0.29 * np.sin(np.arange(6000) * 0.05)], 1) + 1e-4 * rng.normal(size=(6000, 2))
    x[[1500, 3300]] += 0.2
    plan = {
        "source": {"sample_rate": 2000, "channels": 2, "num_samples": 6000}, "prefilter": {"enabled": False}, "declick": {"enabled": False}, "decrackle": {"enabled": True, "threshold": 8.0},
        "split": {"tracks": [{"index": 1, "start_sample": 100, "end_sample": 3000}, {"index": 2, "start_sample": 3000, "end_sample": 5900}]},
        "normalize": {"mode": "album_peak", "target_db": -1.0, "peak_ceiling_db": -0.5}, "export": {"format": "wav", "bit_depth": 16, "dither": "none"}, "metadata": {"enabled": False},
    }
    samples, folder = synth.frame(spark, x), str(tmp_path / "out")
    pending = {stage: status for stage, status, _, _ in execute(samples, plan).stages}
    assert pending["export"] == "pending", "nothing is written, so nothing is recorded as applied"
    manifest = rd.render(samples, plan, folder, "s" * 64)
    stages = {x["stage"]: x for x in manifest["stages"]}
    assert manifest["outputs"] == 2 and stages["export"]["status"] == "applied" and not manifest["warnings"]
    assert "repaired" in stages["decrackle"]["detail"] and "1 in " in stages["decrackle"]["detail"]
    out = spark.read.parquet(f"{folder}/outputs").orderBy("track_index").collect()
    import hashlib

    for r in out:
        with open(r["path"], "rb") as f:
            assert hashlib.sha256(f.read()).hexdigest() == r["sha256"]
        assert r["num_samples"] == 2900 and r["over"] == 0 and not r["tagged"]
    assert max(r["true_peak_db"] for r in out) == manifest["applied_true_peak_db"] <= -0.5 + 1e-3
    repairs = spark.read.parquet(f"{folder}/repairs").collect()
    assert [(r["stage"], r["total"]) for r in repairs] == [("decrackle", 6000)] and 2 <= repairs[0]["changed"] <= 20
    with pytest.raises(rd.RenderError):
        rd.render(samples, plan, folder, "s" * 64)
    assert {r["status"] for r in rd.verify(samples, folder, str(tmp_path / "again"), "s" * 64).collect()} == {"same"}
    with pytest.raises(rd.RenderError):
        rd.verify(samples, folder, str(tmp_path / "fourth"), "t" * 64)
