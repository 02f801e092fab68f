"""Schemas of the documents and tables, as Spark DDL."""

from __future__ import annotations

#: The major version that is understood; minor versions add optional sections.
SCHEMA_VERSION = "3.8"

TRACK = "struct<index:int,start_sample:bigint,end_sample:bigint,fade_in_ms:double,fade_out_ms:double>"
PLAN = (
    "struct<schema_version:string,source:struct<path:string,sha256:string,sample_rate:int,channels:int,num_samples:bigint>,analysis:struct<path:string,sha256:string>,"
    "prefilter:struct<enabled:boolean,engine:string,dc_block:boolean,highpass_hz:double,highpass_rolloff_db_per_octave:int>,"
    f"split:struct<enabled:boolean,engine:string,tracks:array<{TRACK}>>,"
    "declick:struct<enabled:boolean,engine:string,algorithm:string,threshold:double,max_click_width_ms:double,strength:double,preset:string,params:map<string,string>>,"
    "decrackle:struct<enabled:boolean,engine:string,algorithm:string,threshold:double,max_event_width_samples:int,strength:double,params:map<string,string>>,"
    "mono_merge:struct<enabled:boolean,engine:string,strategy:string,level_window_seconds:double>,"
    "speed:struct<enabled:boolean,engine:string,played_rpm:double,intended_rpm:double>,"
    "normalize:struct<enabled:boolean,engine:string,mode:string,target_db:double,peak_ceiling_db:double>,"
    "metadata:struct<enabled:boolean,album:string,album_artist:string,artist:string,year:int,genre:string,catalog_number:string,tracks:array<struct<index:int,title:string,artist:string,position:string>>>,"
    "export:struct<format:string,bit_depth:int,sample_rate:int,dither:string,dither_seed:bigint,track_filename_template:string,write_tags:boolean>>"
)
#: What plans are checked against: a summary of a recording's measurements and its file.
ANALYSIS = (
    "struct<sha256:string,analysis_sha256:string,digest:string,num_samples:bigint,file_exists:boolean,channel_correlation:double,peak_db:double,rms_db:double,gated_rms_db:double,true_peak_db:double,"
    "clipped_regions:bigint,lead_out_start_sample:bigint>"
)
FINDINGS = "plan_id string, severity string, code string, message string, location string"

#: Values of sections that a plan leaves out.
DEFAULTS = {
    "prefilter": {"enabled": False, "engine": "spark", "dc_block": False, "highpass_hz": None, "highpass_rolloff_db_per_octave": 24},
    "split": {"enabled": True, "engine": "spark", "tracks": []},
    "declick": {"enabled": True, "engine": "spark", "algorithm": "block_ratio", "threshold": None, "max_click_width_ms": 2.0, "strength": 1.0, "preset": None, "params": {}},
    "decrackle": {"enabled": False, "engine": "spark", "algorithm": "curvature_ratio", "threshold": None, "max_event_width_samples": 3, "strength": 1.0, "params": {}},
    "mono_merge": {"enabled": False, "engine": "spark", "strategy": "level_matched", "level_window_seconds": 1.0},
    "speed": {"enabled": False, "engine": "spark", "played_rpm": None, "intended_rpm": None},
    "normalize": {"enabled": True, "engine": "spark", "mode": "album_peak", "target_db": -1.0, "peak_ceiling_db": None},
    "metadata": {"enabled": True, "album": None, "album_artist": None, "artist": None, "year": None, "genre": None, "catalog_number": None, "tracks": []},
    "export": {"format": "wav", "bit_depth": 24, "sample_rate": None, "dither": "none", "dither_seed": 0, "track_filename_template": "{index:02d} - {title}", "write_tags": True},
}


def complete(plan: dict) -> dict:
    """A plan with the defaults filled in; unknown sections, fields and a foreign major version are refused."""
    allowed = {"schema_version", "source", "analysis", "created_by", "document_type", "notes", *DEFAULTS}
    if extra := set(plan) - allowed:
        raise ValueError(f"unknown sections {sorted(extra)}")
    version = str(plan.get("schema_version", SCHEMA_VERSION))
    if version.split(".")[0] != SCHEMA_VERSION.split(".")[0]:
        raise ValueError(f"schema version {version} is not understood")
    out = {k: v for k, v in plan.items() if k not in DEFAULTS} | {"schema_version": version}
    for section, values in DEFAULTS.items():
        own = plan.get(section) or {}
        if extra := set(own) - set(values) - {"decision"}:
            raise ValueError(f"unknown fields {sorted(extra)} in {section}")
        out[section] = values | own
    tracks = out["split"]["tracks"]
    for i, t in enumerate(tracks):
        if t["end_sample"] <= t["start_sample"] or t["index"] != i + 1 or (i and t["start_sample"] < tracks[i - 1]["end_sample"]):
            raise ValueError(f"track {t['index']} is empty, out of order or overlaps the one before")
    return out
