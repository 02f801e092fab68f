"""PCM files and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.sources import pcm
from sigspark.streaming.frames import stream_crossings, stream_levels

from . import synth


@pytest.mark.parametrize("bits", [16, 24])
def test_write_and_read_back(spark, tmp_path, bits):
    x = np.random.default_rng(0).uniform(-1.2, 1.2, (5000, 2))
    tracks = synth.frame(spark, x).withColumn("track_index", F.lit(1))
    made = pcm.write_tracks(tracks, str(tmp_path), 8000, bits).collect()
    assert len(made) == 1 and made[0]["num_samples"] == 5000 and made[0]["over_full_scale"] == int((np.abs(x) > 1).sum())
    again = pcm.write_tracks(tracks.repartition(7), str(tmp_path), 8000, bits).collect()
    assert again[0]["sha256"] == made[0]["sha256"]
    back = pcm.read_pcm(spark, made[0]["path"])
    for c in (0, 1):
        v = np.array([r["v"] for r in back.where(F.col("channel") == c).orderBy("idx").collect()])
        assert np.abs(v - np.clip(x[:, c], -1, 1)).max() <= 1.01 * 2.0 ** -(bits - 1)
    info = pcm.recordings(spark, made[0]["path"]).collect()[0]
    assert (info["sample_rate"], info["channels"], info["num_samples"], info["bit_depth"], info["sha256"]) == (8000, 2, 5000, bits, made[0]["sha256"])


def test_decoding_of_all_widths():
    assert pcm.decode(bytes([0, 128, 255]), 1, 1).ravel().tolist() == [-1.0, 0.0, 127 / 128]
    assert pcm.decode(b"\x00\x80\xff\x7f", 2, 1).ravel().tolist() == [-1.0, 32767 / 32768]
    assert pcm.decode(b"\x00\x00\x80\xff\xff\x7f", 3, 1).ravel().tolist() == [-1.0, 8388607 / 8388608]
    with pytest.raises(pcm.PcmError):
        pcm.decode(b"", 5, 1)


def test_unreadable_file(spark, tmp_path):
    (tmp_path / "x.wav").write_bytes(b"no audio")
    with pytest.raises(Exception, match="PcmError|x.wav"):
        pcm.read_pcm(spark, str(tmp_path / "x.wav")).collect()


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(2000).select(F.lit("r").alias("recording_id"), F.timestamp_millis(F.col("id") * 10).alias("ts"), (F.sin(F.col("id") / 7) * (F.col("id") % 300 < 150).cast("int")).alias("v"))
    rows.repartition(1).write.parquet(str(tmp_path / "in"))
    for k, make in enumerate((lambda df: stream_levels(df, "1 second", "500 milliseconds", "0 seconds"), lambda df: stream_crossings(df, 0.9, "200 milliseconds", "0 seconds"))):
        batch = make(spark.read.parquet(str(tmp_path / "in")))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        q = make(stream).writeStream.format("memory").queryName(f"out{k}").outputMode("append").start()
        q.processAllAvailable()
        q.stop()
        got = {(r["start"], r["n"]) for r in spark.sql(f"select * from out{k}").collect()}
        expected = {(r["start"], r["n"]) for r in batch.collect()}
        assert got <= expected and len(got) >= len(expected) - 3 and got
