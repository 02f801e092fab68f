"""WAV files: a data source that reads them as blocks of samples, and a writer of tracks."""

from __future__ import annotations

import hashlib
import io
import os
import uuid
import wave

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.kernels import dither as tpdf
from ..operators.framing import KEY

#: Frames of a block that the source yields.
FRAMES = 1 << 16


class PcmError(ValueError):
    """A file that cannot be read as PCM audio."""


def decode(data: bytes, width: int, channels: int) -> np.ndarray:
    """PCM bytes as values in [-1, 1), (frames, channels)."""
    if width == 1:
        x = (np.frombuffer(data, np.uint8).astype(float) - 128) / 128
    elif width == 2:
        x = np.frombuffer(data, "<i2") / 2.0**15
    elif width == 3:
        raw = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((raw[:, 0] << 8 | raw[:, 1] << 16 | raw[:, 2] << 24) >> 8) / 2.0**23
    elif width == 4:
        x = np.frombuffer(data, "<i4") / 2.0**31
    else:
        raise PcmError(f"samples of {width} bytes")
    return x.reshape(-1, channels)


def encode(x: np.ndarray, bits: int, seed: int | None = None) -> bytes:
    """Values clipped to [-1, 1] and quantised once, with dither if a seed is given."""
    if bits not in (16, 24):
        raise PcmError(f"{bits} bits")
    if seed is not None:
        x = x + tpdf(x.shape, bits, seed, 0, len(x))
    top = 2 ** (bits - 1)
    q = np.clip(np.rint(np.clip(x, -1, 1) * top), -top, top - 1).astype(np.int32)
    if bits == 16:
        return q.astype("<i2").tobytes()
    return np.ascontiguousarray(q.reshape(-1, 1).view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()


class _Part(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("path", "").split(",") if p]

    def partitions(self):
        out = []
        for path in self.paths:
            with _open(path) as w:
                n = w.getnframes()
            out += [_Part(path, a, min(n, a + 16 * FRAMES)) for a in range(0, max(n, 1), 16 * FRAMES)]
        return out

    def read(self, part):
        with _open(part.path) as w:
            w.setpos(part.first)
            channels, width, rate = w.getnchannels(), w.getsampwidth(), w.getframerate()
            for at in range(part.first, part.last, FRAMES):
                x = decode(w.readframes(min(FRAMES, part.last - at)), width, channels)
                yield part.path, at // FRAMES, at, rate, [x[:, c].tolist() for c in range(channels)]


def _open(path: str):
    try:
        return wave.open(path.removeprefix("file://"), "rb")
    except (OSError, EOFError, wave.Error) as error:
        raise PcmError(f"{path}: {error}") from error


class PcmSource(DataSource):
    """spark.read.format("pcm").load("a.wav,b.wav"): (path, block_id, start_idx, sample_rate, ch)."""

    @classmethod
    def name(cls):
        return "pcm"

    def schema(self):
        return "path string, block_id long, start_idx long, sample_rate int, ch array<array<double>>"

    def reader(self, schema):
        return _Reader(dict(self.options))


def read_pcm(spark: SparkSession, *paths: str) -> DataFrame:
    """Samples (recording_id, channel, idx, v) of WAV files, a path being a recording."""
    spark.dataSource.register(PcmSource)
    blocks = spark.read.format("pcm").load(",".join(paths))
    rows = blocks.select(F.col("path").alias(KEY), "start_idx", F.posexplode("ch").alias("channel", "x"))
    rows = rows.select(KEY, "channel", "start_idx", F.posexplode("x").alias("i", "v"))
    return rows.select(KEY, "channel", (F.col("start_idx") + F.col("i")).alias("idx"), "v")


def recordings(spark: SparkSession, *paths: str) -> DataFrame:
    """(recording_id, path, sha256, sample_rate, channels, num_samples, duration_seconds, bit_depth) from headers."""
    files = spark.read.format("binaryFile").load(list(paths)).select("path", F.sha2("content", 256).alias("sha256"), "content")

    @F.pandas_udf("struct<sample_rate:int,channels:int,num_samples:long,bit_depth:int>")
    def header(content: pd.Series) -> pd.DataFrame:
        out = []
        for data in content:
            with wave.open(io.BytesIO(data)) as w:
                out.append((w.getframerate(), w.getnchannels(), w.getnframes(), 8 * w.getsampwidth()))
        return pd.DataFrame(out, columns=["sample_rate", "channels", "num_samples", "bit_depth"])

    got = files.withColumn("h", header("content"))
    return got.select(F.col("path").alias(KEY), "path", "sha256", "h.*", (F.col("h.num_samples") / F.col("h.sample_rate")).alias("duration_seconds"))


def write_tracks(tracks: DataFrame, folder: str, rate: int, bits: int = 24, seed: int | None = None) -> DataFrame:
    """One WAV file per (recording_id, track_index) in a folder that all executors share.

    tracks: (recording_id, track_index, channel, idx, v). Returns (recording_id, track_index, path, sha256, bytes,
    num_samples, over_full_scale). A track is one file and so one task; a repeated task moves the same bytes to the same name.
    """
    schema = f"{KEY} string, track_index int, path string, sha256 string, bytes long, num_samples long, over_full_scale long"

    def save(key: tuple, table: pa.Table) -> pa.Table:
        name, index = (x.as_py() for x in key)
        channel, idx = table.column("channel").to_numpy(), table.column("idx").to_numpy()
        x = np.zeros((int(idx.max()) + 1, int(channel.max()) + 1))
        x[idx, channel] = table.column("v").to_numpy()
        buffer = io.BytesIO()
        with wave.open(buffer, "wb") as w:
            w.setnchannels(x.shape[1])
            w.setsampwidth(bits // 8)
            w.setframerate(rate)
            w.writeframes(encode(x, bits, seed))
        data = buffer.getvalue()
        own = hashlib.sha256(name.encode()).hexdigest()[:12]
        path = f"{folder.removeprefix('file://')}/{own}-{index:03d}.wav"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        temporary = f"{path}.{uuid.uuid4().hex}"
        with open(temporary, "wb") as f:
            f.write(data)
        os.replace(temporary, path)
        row = {KEY: name, "track_index": index, "path": path, "sha256": hashlib.sha256(data).hexdigest(), "bytes": len(data), "num_samples": len(x), "over_full_scale": int((np.abs(x) > 1).sum())}
        return pa.Table.from_pylist([row], schema=pa.schema([(KEY, pa.string()), ("track_index", pa.int32()), ("path", pa.string()), ("sha256", pa.string()), ("bytes", pa.int64()), ("num_samples", pa.int64()), ("over_full_scale", pa.int64())]))

    return tracks.groupBy(KEY, "track_index").applyInArrow(save, schema)
