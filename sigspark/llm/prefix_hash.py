"""Document fingerprints from prefix polynomial hashes.

A text's prefix arrays (modulo two primes) give the hash of any span in constant time,
decide whether two spans are equal, and locate the longest common extension of two
places by binary search. A fingerprint is the whole text's hash and sketches: the
smallest span hash in each of SLOTS classes over all windows of a width. Every text has a sketch of windows of 16 code points;
shorter texts have further ones of narrower windows, so that what two short texts share is graded too.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, light_batches, mix64, pick, table

#: Two primes and a base for each.
PRIMES, BASES = (2**31 - 1, 2**31 - 19), (911_382_323, 972_663_749)
#: Code points of a window, and below which length a text is sketched by such windows; classes of a sketch.
WIDTHS, SLOTS = ((16, None), (4, 96), (1, 16)), 64


class _Powers:
    """Powers of a base modulo a prime, and of its inverse, grown on demand."""

    def __init__(self, base: int, prime: int):
        self.base, self.prime, self.values = base, prime, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.values) < n:
            step = np.uint64(pow(self.base, len(self.values), self.prime))
            self.values = np.concatenate([self.values, self.values * step % np.uint64(self.prime)])
        return self.values[:n]


_POWERS = [_Powers(b, p) for b, p in zip(BASES, PRIMES)]
_INVERSE = [_Powers(pow(b, -1, p), p) for b, p in zip(BASES, PRIMES)]


class PrefixHash:
    """Prefix arrays of one text; positions are code points."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(codes)
        self.arrays = []
        for powers, prime in zip(_POWERS, PRIMES):
            p = np.uint64(prime)
            out = np.zeros(self.n + 1, np.uint64)
            np.cumsum(codes * powers.upto(self.n) % p, out=out[1:])
            self.arrays.append(out % p)

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The hash of text[start:end], which does not depend on where the span stands."""
        return tuple(
            (int(a[end]) - int(a[start])) * pow(b, -start, p) % p for a, b, p in zip(self.arrays, BASES, PRIMES)
        )  # type: ignore[return-value]

    def windows(self, width: int) -> np.ndarray:
        """The hash (first prime) of each window; a shorter text is one window."""
        width = min(width, self.n)
        if not width:
            return np.zeros(0, np.uint64)
        a, p = self.arrays[0], np.uint64(PRIMES[0])
        count = self.n - width + 1
        return (a[width:] + p - a[:count]) % p * _INVERSE[0].upto(count) % p


def equal_spans(x: PrefixHash, i: int, y: PrefixHash, j: int, length: int) -> bool:
    """Whether x[i:i+length] equals y[j:j+length]."""
    return x.span(i, i + length) == y.span(j, j + length)


def longest_common_extension(x: PrefixHash, i: int, y: PrefixHash, j: int) -> int:
    """How many code points the texts share from places i and j on, by binary search."""
    low, high = 0, min(x.n - i, y.n - j)
    if i == j == 0:  # prefixes are the arrays themselves
        (a, b), (c, d) = x.arrays, y.arrays
        while low < high:
            middle = (low + high + 1) // 2
            if a[middle] == c[middle] and b[middle] == d[middle]:
                low = middle
            else:
                high = middle - 1
        return low
    while low < high:
        middle = (low + high + 1) // 2
        if equal_spans(x, i, y, j, middle):
            low = middle
        else:
            high = middle - 1
    return low


def sketch(x: PrefixHash, width: int) -> np.ndarray:
    """A byte per class: 0 if no window falls in it, else 1 + the smallest hash modulo 255."""
    out = np.zeros(SLOTS, np.uint8)
    hashes = mix64(x.windows(width) + np.uint64(width << 40))
    if len(hashes):
        slot = (hashes >> np.uint64(58)).astype(np.uint8)  # SLOTS is 2**6
        order = np.argsort(slot, kind="stable")
        slot, hashes = slot[order], hashes[order]
        first = np.concatenate([[0], np.flatnonzero(slot[1:] != slot[:-1]) + 1])
        least = np.minimum.reduceat(hashes, first)
        out[slot[first]] = 1 + (least % np.uint64(255)).astype(np.uint8)
    return out


def fingerprint(x: PrefixHash) -> str:
    """Hex digits: 16 of the whole text's hash, then two per class of each sketch that the text's length calls for."""
    own = [sketch(x, width).tobytes().hex() for width, below in WIDTHS if below is None or x.n < below]
    return "".join([*[f"{int(a[-1]):08x}" for a in x.arrays], *own])


def likeness(a: str, b: str) -> float:
    """The share of classes in which two fingerprints agree (0 to 1), less chance agreement; 1 if they are equal.

    It estimates the Jaccard similarity of the texts' windows: of single code points if both are below 16, of 4 if both are below 96, else of 16."""
    if a == b:
        return 1.0
    end = min(len(a), len(b))
    x, y = (np.frombuffer(bytes.fromhex(t[end - 2 * SLOTS : end]), np.uint8) for t in (a, b))
    used = np.count_nonzero(x | y)
    if not used:
        return 0.0
    share = np.count_nonzero((x == y) & (x > 0)) / used
    return float(max(0.0, (share - 1 / 255) / (1 - 1 / 255)))


class _Doc:
    __slots__ = ("key", "text", "hash", "print")

    def __init__(self, key, text: str):
        self.key, self.text, self.hash = key, text, PrefixHash(text)
        self.print = fingerprint(self.hash)


_FIELDS = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "shared_edited", "shared_next"]


def compare(doc: _Doc, following: _Doc) -> tuple:
    """The row of a document, given the next one; shared_*: code points of the common prefix."""
    n = len(doc.text)
    third = n // 3
    edited = doc.text[: n - third] + following.text[:third]
    hashed = PrefixHash(edited)
    printed = fingerprint(hashed)
    return (
        doc.key, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), doc.print, printed,
        likeness(doc.print, printed), likeness(doc.print, following.print),
        longest_common_extension(doc.hash, 0, hashed, 0), longest_common_extension(doc.hash, 0, following.hash, 0),
    )


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprint every whole text and its edited text, one row per row of docs.

    The edited text has its last third replaced by the beginning of the next document's. The next
    document follows in descending key (null last; equal keys by text); after the last comes the
    first, and a single document follows itself. A null text counts as empty. Rows are range-partitioned once;
    the first and last rows of the partitions, two per partition, meet in a second step.
    """
    spark = docs.sparkSession
    light_batches(docs.sparkSession)
    rows = pick(docs, key=key, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    kind = rows.schema["key"].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc_nulls_last("key"), F.asc("text")]
    placed = rows.repartitionByRange(parts, F.desc_nulls_last("key")).sortWithinPartitions(*order)
    row = f"key {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, shared_edited long, shared_next long"

    def emit(out: list[tuple], edge: list[tuple], key_type):
        kinds = [key_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        whole = [(*r, None, None, None) for r in out] + [(k, *[None] * 8, part, what, t) for k, part, what, t in edge]
        columns = zip(*whole) if whole else [[] for _ in kinds]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], [*_FIELDS, "part", "edge", "text"])

    def run(batches):
        part, last, key_type = TaskContext.get().partitionId(), None, None
        for batch in batches:
            key_type = batch.schema.field(0).type
            out, edge = [], []
            for k, t in zip(batch.column(0), batch.column(1)):
                doc = _Doc(k.as_py(), t.as_py())
                if last is None:
                    edge.append((doc.key, part, "head", doc.text))
                else:
                    out.append(compare(last, doc))
                last = doc
                if len(out) == 2000:
                    yield emit(out, edge, key_type)
                    out, edge = [], []
            yield emit(out, edge, key_type)
        if last is not None:
            yield emit([], [(last.key, part, "tail", last.text)], key_type)

    made = cut(placed.mapInArrow(run, f"{row}, part long, edge string, text string"), "prefixes")
    edges = made.where("edge is not null").select("key", "part", "edge", "text")
    used = sorted(r[0] for r in edges.where("edge = 'head'").select("part").collect())  # one number per partition
    follows = spark.createDataFrame(list(zip(used, used[1:] + used[:1])), "part long, following long")
    tails = edges.where("edge = 'tail'").join(follows, "part").select("key", "text", F.col("following").alias("part"))
    heads = edges.where("edge = 'head'").select("part", F.col("key").alias("next_key"), F.col("text").alias("next_text"))
    pairs = tails.join(heads, "part").select("key", "text", "next_key", "next_text")

    def finish(batches):
        for batch in batches:
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
            out = [compare(_Doc(a, b), _Doc(c, d)) for a, b, c, d in zip(*[x.to_pylist() for x in batch.columns])]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[] for _ in kinds], kinds)], _FIELDS)

    return made.where("edge is null").select(*_FIELDS).union(pairs.mapInArrow(finish, row)).withColumnRenamed("key", key)


def op6_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints(table(spark, sf_dir, "documents"))
