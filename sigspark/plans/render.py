"""Writing a run's tracks, its receipt, and checking a receipt by running again."""

from __future__ import annotations

import json
import platform
from datetime import UTC, datetime

import numpy as np
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks as bl
from ..operators.framing import KEY
from ..sources.pcm import write_tracks
from .executor import Result, _as_recordings, by_channel, execute, from_channels_peaks
from .receipts import compare_digests, digest_json, run_key
from .schemas import complete


class RenderError(RuntimeError):
    """A run that may not or cannot be written."""


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def repair_rates(result: Result) -> DataFrame:
    """(recording_id, stage, changed, total, rate): rate is "1 in N" or "nothing changed"."""
    rows = None
    for stage, counts in result.repairs.items():
        own = counts.withColumn("stage", F.lit(stage))
        rows = own if rows is None else rows.unionByName(own)
    if rows is None:
        return result.tracks.sparkSession.createDataFrame([], f"{KEY} string, stage string, changed long, total long, rate string")
    one_in = F.concat(F.lit("1 in "), F.expr("total div changed").cast("string"))
    return rows.select(KEY, "stage", "changed", "total", F.when(F.col("changed") > 0, one_in).otherwise("nothing changed").alias("rate"))


def measured(result: Result) -> DataFrame:
    """(recording_id, track_index, true_peak_db, over): what is about to be written, after gain and resampling; over counts values past full scale."""
    over = result.tracks.groupBy(KEY, "track_index").agg(F.count_if(F.abs("v") > 1).alias("over"))
    peaks = from_channels_peaks(bl.true_peaks(by_channel(_as_recordings(result.tracks))), (KEY, "track_index"))
    return over.join(peaks.withColumn("true_peak_db", F.round("true_peak_db", 4)), [KEY, "track_index"], "left")


def render(samples: DataFrame, plan: dict, folder: str, source_sha256: str, *, overwrite: bool = False, lengths: DataFrame | None = None) -> dict:
    """Run a plan, write its tracks as WAV files into a folder that all executors share, and leave a receipt beside them.

    Below the folder: the tracks; samples, files, outputs, repairs and tags as Parquet tables; plan.json and manifest.json, one line each. Returns the manifest: run key,
    digests, stages, the number of outputs and warnings. An earlier receipt is only replaced with overwrite.
    """
    spark, plan, started = samples.sparkSession, complete(plan), datetime.now(UTC).isoformat(timespec="seconds")
    if not overwrite and _exists(spark, f"{folder}/manifest.json"):
        raise RenderError(f"{folder} holds a receipt already")
    export = plan["export"]
    if export["format"] not in ("wav", "flac"):
        raise RenderError(f"no writer for {export['format']!r}")
    result = execute(samples, plan, lengths)
    # The tracks' samples are written once: they are encoded, and measured as they are encoded.
    result.tracks.write.mode("overwrite").parquet(f"{folder}/samples")
    result.tracks = spark.read.parquet(f"{folder}/samples")
    seed = export["dither_seed"] if export["dither"] == "tpdf" else None
    files = write_tracks(result.tracks, folder, result.rate, export["bit_depth"], seed)
    files.write.mode("overwrite").parquet(f"{folder}/files")
    files = spark.read.parquet(f"{folder}/files")
    outputs = files.join(measured(result), [KEY, "track_index"], "left")
    outputs = outputs.withColumn("sample_rate", F.lit(result.rate)).withColumn("duration_seconds", F.round(F.col("num_samples") / result.rate, 3)).withColumn("tagged", F.lit(False))
    outputs.drop("over_full_scale").write.mode("overwrite").parquet(f"{folder}/outputs")
    repair_rates(result).write.mode("overwrite").parquet(f"{folder}/repairs")
    result.tags.write.mode("overwrite").parquet(f"{folder}/tags")
    outputs = spark.read.parquet(f"{folder}/outputs")
    n, peak, clipped = outputs.agg(F.count(F.lit(1)), F.max("true_peak_db"), F.count_if(F.col("over") > 0)).first()
    changed = {r["stage"]: (r["changed"], r["total"]) for r in spark.read.parquet(f"{folder}/repairs").groupBy("stage").agg(F.sum("changed").alias("changed"), F.sum("total").alias("total")).collect()}
    stages = []
    for stage, status, digest, detail in result.stages:
        if stage in changed:
            some, total = changed[stage]
            detail = f"{detail}; repaired {some} of {total} samples ({f'1 in {total // some}' if some else 'nothing changed'})"
        if stage == "export":
            status, detail = "applied", f"{n} files, wav, {export['bit_depth']} bit, dither {export['dither']}"
        elif stage == "metadata" and status == "pending":
            status, detail = "table", "tags are a table; WAV files are not tagged"
        stages.append({"stage": stage, "status": status, "params_digest": digest, "detail": detail})
    manifest = {
        "document_type": "manifest", "run_key": run_key(source_sha256, plan), "source": source_sha256, "plan": digest_json(plan), "stages": stages, "outputs": n,
        "applied_true_peak_db": peak, "warnings": [f"{clipped} tracks clip"] if clipped else [],
        "environment": {"python": platform.python_version(), "numpy": np.__version__, "pyspark": pyspark.__version__}, "started_at": started, "completed_at": datetime.now(UTC).isoformat(timespec="seconds"),
    }
    for name, value in (("plan", plan), ("manifest", manifest)):
        spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}.json")
    return manifest


def verify(samples: DataFrame, folder: str, scratch: str, source_sha256: str, *, lengths: DataFrame | None = None) -> DataFrame:
    """(recording_id, track_index, status): run the retained plan again into scratch and compare the digests; same, changed, missing or unexpected.

    A receipt of another source or plan is an error."""
    spark = samples.sparkSession
    manifest, plan = (json.loads(spark.read.text(f"{folder}/{name}.json").first()[0]) for name in ("manifest", "plan"))
    if manifest["run_key"] != run_key(source_sha256, plan):
        raise RenderError("the receipt is of another source or plan")
    render(samples, plan, scratch, source_sha256, overwrite=True, lengths=lengths)
    keyed = lambda path: spark.read.parquet(f"{path}/outputs").select(F.to_json(F.struct(KEY, "track_index")).alias("track"), "sha256")
    status = compare_digests(keyed(folder), keyed(scratch), "track")
    track = F.from_json("track", f"{KEY} string, track_index int")
    return status.select(track[KEY].alias(KEY), track["track_index"].alias("track_index"), "status")
