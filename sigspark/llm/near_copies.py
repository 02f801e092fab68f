"""Op 4's near-dedup over five-word shingles at a Jaccard similarity of 0.8 or more.

Fingerprints are simhash's, of distinct five-word shingles. Such pairs differ in 10 of 64 bits on average, which no grid of segment popcounts
can tell from unrelated ones at size; so simhash.links runs with a radius of RADIUS bits in other cells: texts meet that agree in one band of ROWS
minima of their shingles. There the popcounts' Manhattan distance is the lower bound and the Hamming distance the
test, as in op 4; then the shingles themselves decide: texts with SIMILARITY or more are linked.
Sets of linked fingerprints are verified block by block; what links with a set's first text needs no further pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import cut, drop, groups, light_batches, mix64, pick, utf8_view
from .graph import components

#: Words of a shingle; least similarity of near copies.
SHINGLE, SIMILARITY = 5, 0.8
#: Largest Hamming distance that is verified: a pair at similarity 0.8 differs in 10 bits, with a deviation of 3.
RADIUS = 22
#: Bands and minima of a band: a pair at similarity 0.8 shares no band with probability (1 - 0.8**6)**40, 5e-6.
BANDS, ROWS = 40, 6
#: Texts of a gathered set that one block holds, about.
BLOCK = 256
#: A multiplier for each minimum. 32 bits order shingles well enough: minima that meet by chance add candidates and lose none.
_MIX = (mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; a text of fewer words is one shingle, without words none."""
    digests = simhash.shingle_digests(text, SHINGLE)
    return np.unique(np.frombuffer(b"".join(digests), ">u8").astype(np.uint64))


def bands(own: np.ndarray) -> np.ndarray:
    """One hash for each band of minima, as signed 64-bit numbers; a text without shingles has none."""
    if not len(own):
        return np.zeros(0, np.int64)
    least = np.full(len(_MIX), np.iinfo(np.uint32).max, np.uint32)
    folded = (own ^ (own >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(own), 512):
        # Odd multipliers alone keep order too well: a second one follows after the high half is folded in.
        mixed = folded[None, at : at + 512] * _MIX[:, None]
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        np.minimum(least, mixed.min(1), out=least)
    rows = mix64(least.astype(np.uint64)).reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return out.view(np.int64)


def connect(nodes: np.ndarray, sets: list[np.ndarray], similarity: float = SIMILARITY) -> tuple[list[int], list[int]]:
    """Links (a, b) of nodes whose sets are that similar, enough to connect what all such links connect."""
    n = len(nodes)
    a: list[int] = []
    b: list[int] = []
    if n < 2:
        return a, b
    sizes = np.array([len(s) for s in sets])
    names, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    order = np.argsort(ids, kind="stable")
    by, first = owner[order], np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=len(names)))])
    label = np.arange(n)
    for i in range(n - 1):
        if (label[i + 1 :] == label[i]).all():
            continue
        mine = ids[ends[i] : ends[i + 1]]
        count = first[mine + 1] - first[mine]
        at = np.repeat(first[mine] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        common = np.bincount(by[at], minlength=n)
        # common / (union) >= similarity, in floats as a plain test has it.
        near = common / np.maximum(sizes[i] + sizes - common, 1) >= similarity
        near[: i + 1] = False
        for j in np.flatnonzero(near & (label != label[i])).tolist():
            if label[j] != label[i]:
                a.append(int(nodes[i]))
                b.append(int(nodes[j]))
                label[label == label[j]] = label[i]
    return a, b


def _prints(docs: DataFrame, text: str, key: str, row: str) -> DataFrame:
    """(key, row, fp, print, bands): print is equal for equal sets of shingles."""
    light_batches(docs.sparkSession)
    source = pick(docs, key=key, row=row, text=text)

    def run(batches):
        for batch in (b.slice(i, j - i) for b in batches for i, j in groups(utf8_view(b.column(2))[0])):
            fps, digests, found = [], [], []
            for value in batch.column(2):
                own = shingles(value.as_py())
                fps.append(simhash.majority_of(own.astype(">u8").view(np.uint8).reshape(-1, 8)))
                digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                found.append(bands(own))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, np.int64)
            arrays = [batch.column(0), batch.column(1), pa.array(fps, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "row", "fp", "print", "bands"])

    return source.mapInArrow(run, f"key {source.schema['key'].dataType.simpleString()}, row long, fp long, print binary, bands array<long>")


def _with_shingles(texts: DataFrame) -> DataFrame:
    """(node, root, n, lead, own) of texts (node, root, n, lead, text)."""

    def sets(batches):
        for batch in (b.slice(i, j - i) for b in batches for i, j in groups(utf8_view(b.column(4))[0])):
            found = [shingles(t.as_py()) for t in batch.column(4)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["node", "root", "n", "lead", "own"])

    return texts.select("node", "root", "n", "lead", "text").mapInArrow(sets, "node long, root long, n long, lead long, own array<long>")


def _linked(dealt: DataFrame, by: list[str], keep_rest: bool) -> DataFrame:
    """(a, b) within each group of dealt (*by, lead, node, own); with keep_rest also (node, null) for those of groups of
    several blocks that no link ties to lead there."""
    n = len(by)

    def run(batches):
        def links_of(nodes, own, lead, big):
            a, b = connect(np.array(nodes, np.int64), own)
            if keep_rest and big:
                up = {x: x for x in nodes}

                def top(x):
                    while up[x] != x:
                        up[x] = up[up[x]]
                        x = up[x]
                    return x

                for x, y in zip(a, b):
                    up[top(x)] = top(y)
                far = [x for x in nodes if top(x) != top(lead)]
                a, b = a + far, b + [None] * len(far)
            return a, b

        last, nodes, own = None, [], []
        for batch in batches:
            a, b = [], []
            keys = list(zip(*[batch.column(i).to_pylist() for i in range(n + 2)]))
            ids, lists = batch.column(n + 2).to_pylist(), batch.column(n + 3)
            for k, key in enumerate(keys):
                if key != last:
                    if last is not None:
                        got = links_of(nodes, own, last[n], last[n + 1])
                        a += got[0]
                        b += got[1]
                    last, nodes, own = key, [], []
                nodes.append(ids[k])
                own.append(lists[k].values.to_numpy(zero_copy_only=False).view(np.uint64).copy())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        if last is not None:
            got = links_of(nodes, own, last[n], last[n + 1])
            yield pa.RecordBatch.from_arrays([pa.array(got[0], pa.int64()), pa.array(got[1], pa.int64())], ["a", "b"])

    dealt = dealt.select(*by, "lead", (F.col("blocks") > 1).alias("big"), "node", "own")
    return dealt.repartition(*by).sortWithinPartitions(*by, "node").mapInArrow(run, "a long, b long")


def _verified(texts: DataFrame) -> DataFrame:
    """(a, b) of texts (node, root, n, lead, text): links within each root's n texts; lead is its smallest node.
    texts are a stored table: they are read up to three times."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    mine = lambda c: F.array(F.pmod(F.xxhash64("node"), F.col(c)))
    found = _with_shingles(texts).withColumn("blocks", blocks)
    # First each block by itself, with the set's lead in all of them.
    first = found.withColumn("block", F.explode(F.when(F.col("node") == F.col("lead"), upto("blocks")).otherwise(mine("blocks"))))
    got = cut(_linked(first, ["root", "block"], True), "near")
    links, rest = got.where("b is not null"), got.where("b is null").select(F.col("a").alias("node"))
    if not rest.limit(1).count():
        return links
    # Then what its block did not tie to the lead, in chunks, with every block.
    rest = cut(texts.select("node", "root").join(rest.hint("merge"), "node"), "rest")
    chunks = cut(rest.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("chunks")), "chunks")
    far = found.join(chunks, "root").join(rest.select("node", F.lit(True).alias("far")), "node", "left")
    part = lambda chunk, block: F.struct(chunk.alias("chunks"), block.alias("blocks"))
    roles = F.array(part(upto("chunks"), mine("blocks")), F.when(F.col("far"), part(mine("chunks"), upto("blocks"))))
    far = far.select("root", "lead", "node", "own", F.col("blocks").alias("all"), F.explode(F.array_compact(roles)).alias("role"))
    far = far.select("root", "lead", "node", "own", "all", "role.blocks", F.explode("role.chunks").alias("chunk"))
    far = far.select("root", "lead", "node", "own", F.col("all").alias("blocks"), "chunk", F.explode("blocks").alias("block"))
    return links.union(_linked(far, ["root", "chunk", "block"], False))


def dropped(docs: DataFrame, text: str, key: str, row: str = "row") -> DataFrame:
    """The rows (row) of docs that are near copies of one with a smaller key, as a written table; row is unique, and docs
    are a stored table: they are read several times."""
    prints = cut(_prints(docs, text, key, row), "prints")
    nodes = cut(prints.groupBy("print").agg(F.min("key").alias("rep"), F.min("row").alias("node"), F.min("fp").alias("fp")), "nodes")  # equal sets have equal fingerprints
    # Only one row of each set of shingles is compared. Sets that share a fingerprint repeat it in a cell, which does no harm.
    single = prints.join(nodes.select(F.col("node").alias("row")).hint("merge"), "row").select("fp", F.posexplode("bands").alias("space", "cell"))
    cells = cut(single.withColumn("home", F.lit(True)), "bands")
    near = cut(components(simhash.links(nodes.select("fp"), RADIUS, cells)), "gathered")
    drop(cells)
    placed = nodes.select("node", "fp").join(near.withColumnRenamed("node", "fp").hint("merge"), "fp", "left")
    placed = cut(placed.select("node", F.coalesce("root", "fp").alias("root")), "placed")
    size = cut(placed.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lead")).where("n > 1"), "sized")
    gathered = placed.join(size.hint("merge"), "root")
    texts = cut(pick(docs, node=row, text=text).join(gathered.hint("merge"), "node"), "texts")
    links = cut(_verified(texts), "verified")
    drop(texts)
    roots = cut(components(links), "roots")
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = cut(named.groupBy("root").agg(F.min("rep").alias("best")), "best")
    classes = cut(named.join(best, "root").select("print", "best"), "classes")
    out = cut(prints.select("key", "row", "print").join(classes, "print").where(F.col("key") != F.col("best")).select("row"), "dropped")
    for made in (prints, nodes, near, placed, size, links, roots, best, classes):
        drop(made)
    return out
