"""WARC archives with a Zstandard dictionary.

Each archive starts with a skippable frame that holds a dictionary built from its
records; every record is a frame of its own, compressed with that dictionary, so that a
reader can start at any record. Payloads that occur more than once are stored once and
referred to by revisit records.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop_path, light_batches, pick, shared_path, table

#: Magic number of the skippable frame and of a Zstandard frame.
DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
#: Bytes of a dictionary, of the records that it is built from (at most), and compression level.
DICT_BYTES, SAMPLE_BYTES, LEVEL = 64 << 10, 4 << 20, 3
#: Payloads from this size on are stored once.
REVISIT_FROM = 100
#: Bytes of records after which a task begins a new archive.
ARCHIVE_BYTES = 1 << 30
_SPACE_ID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the name space of URLs
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id, digest: str, row: int) -> str:
    """The record's URN, the same on each run over the same input."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE_ID, f'{page_id}:{digest}:{row}')}>"


def _line(value: str) -> str:
    return "".join(c if c.isprintable() else "%{:02X}".format(ord(c)) for c in value)


def record(page_id, url: str | None, payload: bytes, digest: str, row: int, refers: tuple | None, date: str) -> bytes:
    """One WARC record; refers is (page_id, row) of the response that holds the payload, or None."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest, row)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_line(url)}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers[0], digest, refers[1])}"]
        if refers[0] is not None:
            lines.append(f"X-Refers-To-Page: {refers[0]}")
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    block = head if refers else head + payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes]) -> bytes:
    """A dictionary from records spread evenly over the given ones; b"" if they are too few."""
    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    sample, total = [], 0
    for r in records[::step]:
        sample.append(r[: SAMPLE_BYTES // 16])
        total += len(sample[-1])
        if total > SAMPLE_BYTES:
            break
    if len(sample) < 16 or total < 10 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, total // 8), sample, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # records without anything in common
        return b""


def filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI."""
    if "://" not in path:
        return pyarrow.fs.LocalFileSystem(), path.removeprefix("file:")
    return pyarrow.fs.FileSystem.from_uri(path)


class ArchiveWriter:
    """Writes one archive under a temporary name and moves it when it is whole."""

    def __init__(self, path: str, first: list[bytes]):
        self.path = path
        self.fs, self.place = filesystem(path)
        self.temporary = f"{self.place}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.temporary)
        dictionary = build_dictionary(first)
        self.size = self.records = 0
        if dictionary:
            self._put(struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, data: bytes) -> None:
        self._put(self.compressor.compress(data))
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        self.fs.move(self.temporary, self.place)
        return self.path, self.records, self.size


def read_archive(path: str):
    """(headers, block) of each record of an archive."""
    fs, place = filesystem(path)
    with fs.open_input_file(place) as f:
        head = f.read(8)
        dictionary = None
        if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICT_MAGIC:
            dictionary = zstandard.ZstdCompressionDict(f.read(struct.unpack("<I", head[4:])[0]))
        else:
            f.seek(0)
        stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(f, read_across_frames=True), 1 << 18)
        while line := stream.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no WARC record in {path}: {line[:40]!r}")
            headers = {}
            while (line := stream.readline().rstrip(b"\r\n")):
                name, _, value = line.decode("utf-8", "replace").partition(": ")
                headers[name] = value
            yield headers, stream.read(int(headers["Content-Length"]))


def write(pages: DataFrame, folder: str, html: str = "html", key: str = "page_id", url: str = "url", *, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write one record per row of pages to archives in a folder that all executors share.

    Returns (path, records, bytes) per archive. A null html counts as empty, a null
    url or key leaves its header out. Of equal payloads of REVISIT_FROM bytes or more the row with
    the smallest key (null last; of rows with one key the first of the table) is the
    response, so that rows may repeat. A repeated task writes the same names again, each moved into place when whole.
    """
    light_batches(pages.sparkSession)
    rows = pick(pages, key=key, url=url, html=html).withColumn("html", F.coalesce("html", F.lit("")))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("size", F.octet_length("html"))
    each = cut(rows.groupBy("digest", "key", "size").agg(F.count(F.lit(1)).alias("n")), "payloads")
    if each.where("n > 1").limit(1).count():
        # Rows with equal keys and payloads: a number that is written with them tells them apart.
        rows = cut(rows.withColumn("row", F.monotonically_increasing_id()), "pages")
        each = rows.select("digest", "key", "size", "row", F.lit(1).alias("n"))
    else:
        rows, each = rows.withColumn("row", F.lit(0).cast("long")), each.withColumn("row", F.lit(0).cast("long"))
    first = F.min(F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("id"), "row"))
    many = each.where(F.col("size") >= REVISIT_FROM).groupBy("digest").agg(F.sum("n").alias("n"), first.alias("first")).where("n > 1")
    many = cut(many.select(F.col("digest").alias("same"), F.col("first.id").alias("first_id"), F.col("first.row").alias("first_row")), "firsts")
    joined = rows.join(many, rows["digest"] == many["same"], "left").select("key", "url", "html", "digest", "row", "first_id", "first_row")

    def run(batches):
        place, number, done, out = TaskContext.get().partitionId(), 0, [], None
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                records = []
                for page, address, text, digest, row, first, first_row in zip(*[c.to_pylist() for c in part.columns]):
                    refers = (first, first_row) if first_row is not None and (first, first_row) != (page, row) else None
                    records.append(record(page, address, text.encode("utf-8", "surrogatepass"), digest, row, refers, date))
                if out is None:
                    out = ArchiveWriter(f"{folder}/part-{place:06d}-{number:04d}.warc.zst", records)
                    number += 1
                for r in records:
                    out.add(r)
                if out.size > ARCHIVE_BYTES:
                    done.append(out.close())
                    out = None
        if out is not None:
            done.append(out.close())
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "records", "bytes"), d)) for d in done], schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    jvm_path = pages.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    jvm_path.getFileSystem(pages.sparkSession.sparkContext._jsc.hadoopConfiguration()).mkdirs(jvm_path)
    return cut(joined.mapInArrow(run, "path string, records long, bytes long"), "archives")


def read(archives: DataFrame, path: str = "path") -> DataFrame:
    """One row per record of the archives: page_id, payload_bytes, payload_digest, record_type and
    refers_to (strings where the header is text). A response's payload is hashed anew and
    must bear the digest of its header; an archive per task."""
    paths = pick(archives, path=path)
    schema = pa.schema([("page_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())])

    def run(batches):
        for batch in batches:
            for place in batch.column(0).to_pylist():
                rows = []
                for headers, block in read_archive(place):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                    size, digest = int(fields["Content-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    if headers["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"a damaged record {headers['WARC-Record-ID']} in {place}")
                    rows.append({"page_id": headers.get("X-Page-Id"), "payload_bytes": size, "payload_digest": digest, "record_type": headers["WARC-Type"], "refers_to": headers.get("X-Refers-To-Page")})
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    # One small table of paths, dealt out evenly: as many tasks as archives.
    return paths.repartition(max(1, paths.count())).mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    folder = shared_path(spark, "warc")
    got = read(write(pages, folder))
    got = cut(got.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind)), "records")
    drop_path(spark, folder)
    return got


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     d AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS digest FROM p),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
