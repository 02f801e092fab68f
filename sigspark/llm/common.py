"""Helpers shared by the operators: column picking, lineage cuts, Arrow text views."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Select ``new=old`` by exact name and position.

    Further columns are left out, so that their names cannot clash (a column
    "Text" beside "text", or the name of a column that the operator makes). Of
    two columns with the very same name the first is taken.
    """
    names = df.columns
    for old in columns.values():
        if old not in names:
            raise ValueError(f"no column {old!r} among {names}")
    placed = df.toDF(*[f"c{i}" for i in range(len(names))])
    return placed.select(*[F.col(f"c{names.index(old)}").alias(new) for new, old in columns.items()])


#: Rows of an Arrow batch of whole texts or pages; the default of 10,000 is meant for short rows.
BATCH_ROWS = 1000


def light_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches small enough for rows of whole texts, and its Parquet pages out
    of direct buffers: both are memory that an executor holds beside its heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    spark.conf.set("spark.sql.parquet.compression.codec", "zstd")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where the cluster names none, as in tests on one machine, a temporary folder
    is made once and kept in the session's setting.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("sigspark.shared.dir", None)
    if not given:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        given = "file://" + tempfile.mkdtemp(prefix="sigspark-")
        spark.conf.set("sigspark.shared.dir", given)
    return given.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path made by shared_path."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    This ends the lineage, survives lost executors, and gives the planner real
    sizes, so that it broadcasts a side only if it is small.
    """
    path = shared_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.cut_path = path
    return made


def drop(made: DataFrame) -> None:
    """Delete a table made by cut, which nothing reads any more."""
    drop_path(made.sparkSession, made.cut_path)


def utf8_view(column) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an Arrow string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if offsets is None or not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return off, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def groups(off: np.ndarray, most: int = 1 << 20):
    """Runs (i, j) of rows with about ``most`` bytes together; a longer row stands alone."""
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + most, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64 over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = np.ones(1, np.uint64)


def powers64(n: int) -> np.ndarray:
    """B**0 .. B**(n-1) modulo 2**64 for a fixed odd B."""
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 2 * len(_powers)), 0x9E3779B97F4A7C15, np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers[:n]


def word_spans(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes; no run crosses a row's bound."""
    inside = is_word[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    at = bounds[(bounds > 0) & (bounds < len(data))]
    start[at] = inside[at]
    end[at - 1] = inside[at - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each span of bytes, mixed with its length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    total = int(size.sum())
    if total > 1 << 20 and len(starts) > 1:  # long texts by halves, to bound memory
        half = len(starts) // 2
        return np.concatenate([hash_spans(data, starts[:half], ends[:half]), hash_spans(data, starts[half:], ends[half:])])
    first = np.cumsum(size) - size
    within = np.arange(total) - np.repeat(first, size)
    values = (data[within + np.repeat(starts, size)].astype(np.uint64) + np.uint64(1)) * powers64(int(size.max()))[within]
    return mix64(np.add.reduceat(values, first) ^ (size.astype(np.uint64) << np.uint64(40)))


def ascii_lower() -> np.ndarray:
    """Byte table that lower-cases A-Z alone."""
    lut = np.arange(256, dtype=np.uint8)
    lut[65:91] += 32
    return lut
