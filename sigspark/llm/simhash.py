"""SimHash near-duplicates by segment-popcount embedding.

A fingerprint's 32 segments of two bits have 0, 1 or 2 bits set. The Manhattan distance of
two such vectors never exceeds the Hamming distance of the fingerprints. The grid range-join works
in two subspaces of 16 segments, cells one unit wide: of two vectors at Manhattan distance 3 or less
one half differs by 1 at most. In each subspace a fingerprint has its home cell, and one whose
coordinates have an odd sum visits the neighbouring cells as well: vectors one unit apart differ in
that parity, so that each such pair meets in the home cell of one of the two. Within a cell homes are
held against homes and visitors: the Manhattan distance is the lower bound and the Hamming distance the exact test.

A cell has about 1 in 2**24 of unrelated fingerprints. What grows are cells of near copies; there all
that link with the cell's smallest fingerprint are connected by it, and only the rest is held against every one of the cell,
block by block. A cell's links connect the same fingerprints as all its pairs would.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, groups, light_batches, pick, table, utf8_view
from .graph import components

#: Largest Hamming distance of linked fingerprints; words of a shingle; seed.
DISTANCE, SHINGLE, SEED = 3, 3, 42
#: Fingerprints of a cell that one block holds, about.
BLOCK = 4096
_ODD = 0x5555555555555555
_HALVES = (0x00000000FFFFFFFF, 0xFFFFFFFF00000000 - (1 << 64))


def shingle_digests(text: str | None, shingle: int = SHINGLE) -> list[bytes]:
    """The digests of a text's shingles, repeats included; a text of fewer words is one shingle, without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    own = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*[words[k:] for k in range(shingle)]))
    return list(map(_digest, own))


def majority(digests: list[bytes]) -> int:
    """The fingerprint of these digests: the bits that over half of them have, as a signed 64-bit number."""
    return majority_of(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8))


def majority_of(hashes: np.ndarray) -> int:
    """majority of digests given as rows of eight bytes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)], axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">i8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text, as a signed 64-bit number."""
    return majority(shingle_digests(text, shingle))


def _digest(data: bytes) -> bytes:
    return xxhash.xxh64_digest(data, SEED)


def fingerprints(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), *, shingle: int = SHINGLE) -> DataFrame:
    """The carried columns and fp (long), one row per row of docs; null and empty texts have 0."""
    light_batches(docs.sparkSession)
    source = pick(docs, **{f"k{i}": c for i, c in enumerate(carry)}, text=text)
    n = len(carry)
    fields = "".join(f"k{i} {source.schema[f'k{i}'].dataType.simpleString()}, " for i in range(n))

    def run(batches):
        for batch in (b.slice(i, j - i) for b in batches for i, j in groups(utf8_view(b.column(n))[0])):
            got = pa.array([fingerprint(t.as_py(), shingle) for t in batch.column(n)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], got], [*[f"k{i}" for i in range(n)], "fp"])

    return source.mapInArrow(run, fields + "fp long").toDF(*carry, "fp")


def embedding(fp: Column) -> Column:
    """The popcounts of all segments, in unary: 0, 1 or 2 is 00, 01 or 11. The Manhattan
    distance of two embeddings is the number of bits in which these differ."""
    half = F.shiftrightunsigned(fp, 1)
    both, any_ = fp.bitwiseAND(half).bitwiseAND(F.lit(_ODD)), fp.bitwiseOR(half).bitwiseAND(F.lit(_ODD))
    return F.shiftleft(both, 1).bitwiseOR(any_)


def _embed(fp: np.ndarray) -> np.ndarray:
    x, odd = fp.view(np.uint64), np.uint64(_ODD)
    half = x >> np.uint64(1)
    return ((x & half & odd) << np.uint64(1)) | ((x | half) & odd)


def _signed(bit: int) -> int:
    return bit - (1 << 64) if bit >> 63 else bit


def grid_cells(distinct: DataFrame) -> DataFrame:
    """(fp, space, cell, home) of distinct (fp): each fingerprint's home cell in both subspaces and, where the sum of its
    coordinates there is odd, the cells one unit away."""
    rows = distinct.select("fp", embedding(F.col("fp")).alias("place"))
    every = []
    for space, mask in enumerate(_HALVES):
        own = F.col("place").bitwiseAND(F.lit(mask))
        odd = F.bit_count(own) % 2 == 1
        near = []
        for s in range(16 * space, 16 * space + 16):
            low, high = F.lit(_signed(1 << (2 * s))), F.lit(_signed(2 << (2 * s)))
            # 00 <-> 01 flips the low bit while the high one is off; 01 <-> 11 the high one while the low one is on.
            near.append(F.when(odd & (own.bitwiseAND(high) == 0), own.bitwiseXOR(low)))
            near.append(F.when(odd & (own.bitwiseAND(low) != 0), own.bitwiseXOR(high)))
        every.append(F.struct(F.lit(space).alias("space"), own.alias("own"), F.array_compact(F.array(own, *near)).alias("cells")))
    rows = rows.select("fp", F.explode(F.array(*every)).alias("at")).select("fp", "at.space", "at.own", F.explode("at.cells").alias("cell"))
    return rows.select("fp", "space", "cell", (F.col("cell") == F.col("own")).alias("home"))


def connect(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """(fp, smallest fp linked with it) for all but the smallest of each connected set, by the pairs of a left and a right
    (fps, homes) of which one is a home."""
    (x, x_home), (y, y_home) = left, right
    x_place, y_place, x_bits, y_bits = _embed(x), _embed(y), x.view(np.uint64), y.view(np.uint64)
    lefts, rights = [], []
    step = max(1, (1 << 22) // max(1, len(y)))
    for at in range(0, len(x), step):
        near = np.bitwise_count(x_place[at : at + step, None] ^ y_place[None, :]) <= distance
        i, j = np.nonzero(near)
        i += at
        keep = (x[i] != y[j]) & (x_home[i] | y_home[j])
        i, j = i[keep], j[keep]
        exact = np.bitwise_count(x_bits[i] ^ y_bits[j]) <= distance
        lefts.append(x[i[exact]])
        rights.append(y[j[exact]])
    if not sum(map(len, lefts)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fps, ends = np.unique(np.concatenate([*lefts, *rights]), return_inverse=True)
    half = len(ends) // 2
    i, j, label = ends[:half], ends[half:], np.arange(len(fps))
    while True:
        low = np.minimum(label[i], label[j])
        new, hop = label.copy(), np.arange(len(fps))
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        # What two labels meet at one link, all that bear the larger one take along.
        np.minimum.at(hop, label[i], low)
        np.minimum.at(hop, label[j], low)
        new = np.minimum(new, hop[new])
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(fps))
    return fps[moved], fps[label[moved]]


def _within(a: Column, b: Column, distance: int) -> Column:
    """The Manhattan bound, then the exact test."""
    return (F.bit_count(embedding(a).bitwiseXOR(embedding(b))) <= distance) & (F.bit_count(a.bitwiseXOR(b)) <= distance)


def links(distinct: DataFrame, distance: int = DISTANCE, cells: DataFrame | None = None) -> DataFrame:
    """(a, b): fingerprints at the distance or less, enough to connect all that such links connect.

    The cells (fp, space, cell, home) are those of grid_cells, which lose no pair at distance 3 or less;
    for larger distances give other cells, in which pairs with a home are tested alike.
    """
    if cells is None:
        if distance > 3:
            raise ValueError("the grid's cells serve distances up to 3")
        cells = grid_cells(distinct)
    at = ["space", "cell"]
    lead = F.min(F.when(F.col("home"), F.col("fp")))
    counts = cells.groupBy(*at).agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("homes"), lead.alias("lead"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    counts = cut(counts.where("n > 1 and homes > 0"), "cells")
    two = counts.where("n = 2").where(_within(F.col("a"), F.col("b"), distance)).select("a", "b")
    many = cells.join(counts.where("n > 2").select(*at, "n", "homes", "lead"), at).where("fp <> lead")
    many = cut(many.withColumn("near", _within(F.col("fp"), F.col("lead"), distance)), "many")
    star = many.where("near").select(F.col("fp").alias("a"), F.col("lead").alias("b"))
    # What does not link with the lead, in chunks, meets all of its cell, in blocks: one task holds one chunk and one block.
    rest = many.where("homes > 1 and not near").groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("chunks"))
    dense = many.join(rest, at).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("long"))
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    mine = lambda c: F.array(F.pmod(F.xxhash64("fp"), F.col(c)))
    part = lambda chunk, block, left: F.struct(chunk.alias("chunks"), block.alias("blocks"), F.lit(left).alias("left"))
    roles = F.array(part(upto("chunks"), mine("blocks"), False), F.when(~F.col("near"), part(mine("chunks"), upto("blocks"), True)))
    dense = dense.select(*at, "fp", "home", F.explode(F.array_compact(roles)).alias("role"))
    dense = dense.select(*at, "fp", "home", "role.left", "role.blocks", F.explode("role.chunks").alias("chunk"))
    dense = dense.select(*at, "chunk", F.explode("blocks").alias("block"), "fp", "home", "left")

    def run(batches):
        kinds = (np.int64, np.int64, np.int64, np.int64, np.int64, bool, bool)
        held, last = [], None

        def links_of(held):
            fps, homes, left = (np.concatenate(x) for x in zip(*held))
            return connect((fps[left], homes[left]), (fps[~left], homes[~left]), distance)

        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False).astype(kinds[i]) for i in range(7)]
            keys, rows = np.stack(columns[:4], 1), columns[4:]
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            got = []
            for i, j in zip(edges, edges[1:]):
                if i == j:
                    continue
                here = tuple(keys[i].tolist())
                if here != last and held:
                    got.append(links_of(held))
                    held = []
                last = here
                held.append(tuple(r[i:j] for r in rows))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*got)], ["a", "b"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in links_of(held)], ["a", "b"])

    by = [*at, "chunk", "block"]
    dense = dense.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a long, b long")
    return two.union(star).union(dense)


def near_duplicates(prints: DataFrame, key: str = "doc_id", *, distance: int = DISTANCE) -> DataFrame:
    """prints (key, fp) with component: the smallest key of all rows that links reach.

    Equal fingerprints are one node. Null keys are allowed; component is null only if all
    keys of its rows are.
    """
    distinct = cut(prints.groupBy("fp").agg(F.min(key).alias("rep")), "fps")
    roots = cut(components(links(distinct, distance)), "roots")
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "rep", "root")
    least = cut(named.where("root is not null").groupBy("root").agg(F.min("rep").alias("least")), "least")
    named = cut(named.join(least, "root", "left").select(F.col("fp").alias("of"), F.coalesce("least", "rep").alias("component")), "classes")
    return prints.join(named, prints["fp"] == named["of"]).drop("of")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, fingerprint (16 hex digits) and component_id."""
    prints = cut(fingerprints(table(spark, sf_dir, "documents")), "prints")
    got = near_duplicates(prints)
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
