"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Vectors are dealt to the nearest of a bounded number of coarse centroids and, where a cell has more than a shard holds, by a hash
of their ids within it. A shard's graph grows by insertion: each vector is searched for in the graph of those before it and linked with diverse
near ones. It is stored as flat neighbour arrays, one per layer, in a row of a table. A query goes to
the shards of its nearest cells; how many cells is set when the index is built, by measuring against brute force for a sample of vectors
in how many of their nearest cells their true neighbours lie. The shards' results are merged by distance.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, pick, table

#: Vectors of a shard (about), links of a node per layer (twice as many in the lowest), size of the lists with which a new
#: node and a query search, nodes that are inserted at once (at most).
SHARD, LINKS, EF_BUILD, EF, BATCH = 8192, 16, 64, 160, 256
#: Queries that one task searches in a shard, about.
QUERY_BLOCK = 4096
#: Centroids (at most) and sampled vectors for each; sampled queries and the recall that the searched cells must reach for them.
CELLS, PER_CELL, PROBE_QUERIES, PROBE_RECALL = 512, 32, 128, 0.97


def _distances(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its row of ids; -1 is infinitely far."""
    near = vectors[ids]
    near -= queries[:, None, :]
    return np.where(ids >= 0, np.einsum("qkd,qkd->qk", near, near), np.float32(np.inf))


def _distinct(ids: np.ndarray) -> np.ndarray:
    """Rows of ids, sorted, with -1 in place of what repeats."""
    ids = np.sort(ids, 1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    return ids


def _diverse(vectors: np.ndarray, ids: np.ndarray, distance: np.ndarray, most: int) -> np.ndarray:
    """Of each row's ids (nearest first, -1 behind them) up to ``most`` that are nearer to the row's node than to any chosen
    before; free places go to the nearest left."""
    rows, c = ids.shape
    near = vectors[ids]
    square = np.einsum("rcd,rcd->rc", near, near)
    between = square[:, :, None] + square[:, None, :] - 2 * near @ near.transpose(0, 2, 1)
    chosen, count = np.zeros((rows, c), bool), np.zeros(rows, int)
    for k in range(c):
        closer = np.where(chosen, between[:, k, :], np.inf).min(1) >= distance[:, k]
        chosen[:, k] = closer & (count < most) & (ids[:, k] >= 0)
        count += chosen[:, k]
    order = np.argsort(np.where(chosen, 0, 1) * c + np.arange(c)[None, :], 1, kind="stable")[:, :most]
    return np.take_along_axis(ids, order, 1)


class Graph:
    """vectors (n, d); layers from the lowest: (nodes, flat neighbours (len(nodes), width), -1 where unused)."""

    def __init__(self, vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.vectors, self.layers = vectors, layers
        self.near = vectors.astype(np.float32)
        self.where = []
        for nodes, _ in layers:
            at = np.full(len(vectors), -1, np.int32)
            at[nodes] = np.arange(len(nodes))
            self.where.append(at)

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 0) -> Graph:
        """Layers of exponentially fewer nodes. Nodes are inserted those of the upper layers first, then in an order drawn at random, a batch
        at a time: each searches the graph so far, from the top, and is linked in all its layers with diverse ones of what it found and of
        its batch, both ways. A full list keeps its nearest links, and one drawn at random, which keeps clusters in reach."""
        rng = np.random.default_rng(seed)
        n = len(vectors)
        level = np.floor(-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int)
        order = np.lexsort((rng.random(n), -level))
        top = int(level.max(initial=0))
        layers = []
        for depth in range(top + 1):
            nodes = np.sort(order[level[order] >= depth]).astype(np.int32)
            layers.append((nodes, np.full((len(nodes), 2 * LINKS if depth == 0 else LINKS), -1, np.int32)))
        self = cls(vectors, layers)
        self._gaps = [np.full(flat.shape, np.inf, np.float32) for _, flat in layers]
        done = 0
        while done < n:
            batch = order[done : done + min(BATCH, max(1, done // 2))]
            self._insert(batch, level[batch], done == 0)
            done += len(batch)
        for (nodes, flat), gaps in zip(layers, self._gaps):  # the last place of each list is the random link
            if len(nodes) > 1:
                far = nodes[rng.integers(0, len(nodes), len(nodes))]
                flat[np.arange(len(nodes)), np.where(flat[:, -1] < 0, (flat >= 0).sum(1), flat.shape[1] - 1)] = np.where(far == nodes, -1, far)
        del self._gaps
        return self

    def _insert(self, batch: np.ndarray, level: np.ndarray, first: bool) -> None:
        queries = self.near[batch]
        found = dist = None
        for depth in range(len(self.layers) - 1, -1, -1):
            here = level >= depth
            if found is None:
                # The graph so far is entered at a node of its uppermost layer, the first one.
                if first:
                    self._entry = int(batch[0])
                    return
                found = np.full((len(batch), 1), self._entry, np.int64)
                dist = _distances(queries, self.near, found)
            if here.any() or depth:
                found, dist = self._beam(depth, queries, found, dist, EF_BUILD if here.any() else 8)
            if here.any():
                self._link(depth, batch[here], found[here], dist[here])

    def _link(self, depth: int, own: np.ndarray, found: np.ndarray, dist: np.ndarray) -> None:
        width = self.layers[depth][1].shape[1]
        if len(own) > 1:  # those of the same batch are candidates too
            peers = np.broadcast_to(own, (len(own), len(own)))
            gaps = ((self.near[own] ** 2).sum(1)[:, None] + (self.near[own] ** 2).sum(1)[None, :] - 2 * self.near[own] @ self.near[own].T).astype(np.float32)
            np.fill_diagonal(gaps, np.inf)
            take = np.argsort(gaps, 1)[:, : min(LINKS, len(own) - 1)]
            found = np.concatenate([found, np.take_along_axis(peers, take, 1)], 1)
            dist = np.concatenate([dist, np.maximum(np.take_along_axis(gaps, take, 1), 0)], 1)
        by = np.argsort(dist, 1, kind="stable")[:, :EF_BUILD]
        found, dist = np.take_along_axis(found, by, 1), np.take_along_axis(dist, by, 1)
        chosen = _diverse(self.near, np.where(np.isinf(dist), -1, found), dist, width // 2)
        gaps = _distances(self.near[own], self.near, chosen)
        ok = chosen >= 0
        new = np.repeat(own, ok.sum(1))
        self._offer(depth, np.concatenate([new, chosen[ok]]), np.concatenate([chosen[ok], new]), np.tile(gaps[ok], 2))

    def _offer(self, depth: int, nodes: np.ndarray, others: np.ndarray, gaps: np.ndarray) -> None:
        """Put others into the lists of nodes, the nearest first; full lists keep their nearest."""
        flat, held, where = self.layers[depth][1], self._gaps[depth], self.where[depth]
        width = flat.shape[1]
        at = where[nodes]
        by = np.lexsort((gaps, at))
        at, others, gaps = at[by], others[by], gaps[by]
        edges = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)]])
        rows, size = at[edges[:-1]], np.minimum(np.diff(edges), width)
        place = np.arange(len(at)) - np.repeat(edges[:-1], np.diff(edges))
        keep = place < width
        ids, far = np.full((len(rows), width), -1, np.int32), np.full((len(rows), width), np.inf, np.float32)
        row = np.repeat(np.arange(len(rows)), size)
        ids[row, place[keep]], far[row, place[keep]] = others[keep], gaps[keep]
        ids, far = np.concatenate([flat[rows], ids], 1), np.concatenate([held[rows], far], 1)
        by = np.lexsort((far, ids), 1)  # what is offered twice stands side by side
        ids, far = np.take_along_axis(ids, by, 1), np.take_along_axis(far, by, 1)
        again = np.zeros(ids.shape, bool)
        again[:, 1:] = ids[:, 1:] == ids[:, :-1]
        far[again] = np.inf
        by = np.argsort(far, 1, kind="stable")[:, :width]
        far = np.take_along_axis(far, by, 1)
        flat[rows], held[rows] = np.where(np.isinf(far), -1, np.take_along_axis(ids, by, 1)), far

    def _beam(self, depth: int, queries: np.ndarray, found: np.ndarray, dist: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, squared distances), nearest first, of up to ef nodes of a layer near each query, found from the given ones."""
        flat, where = self.layers[depth][1], self.where[depth]
        q = len(queries)
        ids, far = np.full((q, ef), -1, np.int64), np.full((q, ef), np.inf, np.float32)
        c = min(ef, found.shape[1])
        ids[:, :c], far[:, :c] = found[:, :c], dist[:, :c]
        open_ = ids >= 0
        seen = np.zeros((q, len(self.vectors) + 1), bool)  # the last column takes the -1
        np.put_along_axis(seen, ids, True, 1)
        live = np.arange(q)
        while len(live):
            own = np.argsort(~open_[live], 1, kind="stable")[:, :4]  # the nearest nodes that were not expanded
            go = np.take_along_axis(open_[live], own, 1)
            keep = go.any(1)
            live, own, go = live[keep], own[keep], go[keep]
            if not len(live):
                break
            nodes = np.where(go, np.take_along_axis(ids[live], own, 1), -1)
            state = open_[live]
            np.put_along_axis(state, own, False, 1)
            new = np.where(nodes[:, :, None] >= 0, flat[where[nodes]], -1).reshape(len(live), -1).astype(np.int64)
            fresh = seen[live]
            new[np.take_along_axis(fresh, new, 1)] = -1
            new = _distinct(new)
            np.put_along_axis(fresh, new, True, 1)
            seen[live] = fresh
            d = _distances(queries[live], self.near, new)
            every = np.concatenate([far[live], d], 1)
            by = np.argsort(every, 1, kind="stable")[:, :ef]
            far[live] = np.take_along_axis(every, by, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], new], 1), by, 1)
            open_[live] = np.take_along_axis(np.concatenate([state, new >= 0], 1), by, 1)
        return ids, far

    def search(self, queries: np.ndarray, ef: int = EF) -> np.ndarray:
        """(queries, ef): nodes near each query, nearest first, -1 where there are no more."""
        queries = np.atleast_2d(queries).astype(np.float32)
        nodes = self.layers[-1][0]
        found = np.tile(nodes[: 8].astype(np.int64), (len(queries), 1))
        dist = _distances(queries, self.near, found)
        for depth in range(len(self.layers) - 1, -1, -1):
            found, dist = self._beam(depth, queries, found, dist, 16 if depth else ef)
        return np.where(np.isinf(dist), -1, found)

    def pack(self) -> dict:
        """The arrays as bytes."""
        return {
            "size": len(self.vectors), "dim": self.vectors.shape[1], "vectors": self.vectors.tobytes(),
            "nodes": [n.tobytes() for n, _ in self.layers], "neighbours": [f.tobytes() for _, f in self.layers],
        }

    @classmethod
    def unpack(cls, row: dict) -> Graph:
        vectors = np.frombuffer(row["vectors"], np.float64).reshape(row["size"], row["dim"])
        layers = []
        for nodes, flat in zip(row["nodes"], row["neighbours"]):
            own = np.frombuffer(nodes, np.int32)
            layers.append((own, np.frombuffer(flat, np.int32).reshape(len(own), -1)))
        return cls(vectors, layers)


@dataclass
class Index:
    """table: a row per shard with the graph's arrays; coarse: by vector length, the centroids and the number of cells
    that a query searches (lengths of which one shard holds all have none); keep: keys that a node of equal vectors holds."""

    table: DataFrame
    coarse: dict[int, tuple[np.ndarray, int]]
    keep: int


def usable(embeddings: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v array<double>, dim) of the rows that take part: no null, empty or zero vector,
    no null or non-finite component, no null key."""
    rows = pick(embeddings, key=key, v=vector).where("key is not null and v is not null")
    rows = rows.select("key", F.col("v").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(finite & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def centroids_of(sample: np.ndarray, cells: int, seed: int = 0, rounds: int = 8) -> np.ndarray:
    """Lloyd's iterations from sampled vectors."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.permutation(len(sample))[:cells]].copy()
    for _ in range(rounds):
        own = nearest_cells(sample, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        count = np.bincount(own, minlength=len(centres))
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def nearest_cells(vectors: np.ndarray, centres: np.ndarray, most: int) -> np.ndarray:
    """The numbers of the ``most`` nearest centroids of each vector, nearest first."""
    gaps = (centres * centres).sum(1)[None, :] - 2 * vectors @ centres.T
    return np.argsort(gaps, 1, kind="stable")[:, :most] if most > 1 else gaps.argmin(1)[:, None]


def _matrix(column, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim) + 0.0  # -0.0 and 0.0 are equal


def _in_cells(rows: DataFrame, coarse: dict[int, tuple[np.ndarray, int]], columns: str, probe: bool) -> DataFrame:
    """rows (..., v, dim) with cell: the nearest, or with probe a row for each cell that a query searches."""
    names = rows.columns
    v, d = names.index("v"), names.index("dim")
    shared = rows.sparkSession.sparkContext.broadcast(coarse)  # CELLS centroids of a vector length, at most

    def run(batches):
        for batch in batches:
            dims = batch.column(d).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                for at in range(0, part.num_rows, 2048):
                    own = part.slice(at, 2048)
                    centres, probes = shared.value.get(int(dim), (None, 1))
                    if centres is None:
                        yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.zeros(own.num_rows, np.int32))], [*names, "cell"])
                        continue
                    cells = nearest_cells(_matrix(own.column(v), int(dim)), centres, probes if probe else 1).astype(np.int32)
                    own = own.take(pa.array(np.repeat(np.arange(own.num_rows), cells.shape[1])))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(cells.ravel())], [*names, "cell"])

    return rows.mapInArrow(run, columns + ", cell int")


def probes_for(rows: DataFrame, dim: int, centres: np.ndarray, queries: np.ndarray, k: int) -> int:
    """In how many of their nearest cells the queries' k nearest of rows (v) lie for PROBE_RECALL of them, by brute force."""
    shared = rows.sparkSession.sparkContext.broadcast((centres, queries))  # CELLS and PROBE_QUERIES vectors

    def run(batches):
        centres, queries = shared.value
        square = (queries * queries).sum(1)
        best, cells = np.full((len(queries), 0), np.inf), np.zeros((len(queries), 0), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                own = _matrix(batch.column(0).slice(at, 2048), dim)
                gaps = (own * own).sum(1)[None, :] + square[:, None] - 2 * queries @ own.T
                gaps[gaps <= 1e-9 * square[:, None]] = np.inf  # the query itself and its copies
                where = np.broadcast_to(nearest_cells(own, centres, 1)[:, 0], gaps.shape)
                best, cells = np.concatenate([best, gaps], 1), np.concatenate([cells, where], 1)
                by = np.argsort(best, 1, kind="stable")[:, :k]
                best, cells = np.take_along_axis(best, by, 1), np.take_along_axis(cells, by, 1)
        at = np.repeat(np.arange(len(queries)), best.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(best.ravel()), pa.array(cells.ravel())], ["q", "gap", "cell"])

    found = rows.select("v").mapInArrow(run, "q long, gap double, cell long").where("gap < double('infinity')")
    order = Window.partitionBy("q").orderBy("gap")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", "cell").toPandas()
    if not len(found):
        return len(centres)
    rank = np.argsort(nearest_cells(queries, centres, max(2, len(centres))), 1)
    needed = np.sort(rank[found["q"].to_numpy(int), found["cell"].to_numpy(int)]) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(PROBE_RECALL * len(needed))) - 1)])


def build_index(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", *, shard: int = SHARD, keep: int = 11) -> Index:
    """The index of every usable row.

    Equal vectors of a shard are one node, which holds its ``keep`` smallest keys, repeated ones as often as they are: enough for searches for
    fewer than ``keep`` neighbours. Vectors of different lengths never share a shard. Centroids are fitted on
    PER_CELL sampled vectors for each, CELLS at most; cells beyond a shard's size are split by a hash of the key.
    """
    spark = embeddings.sparkSession
    rows = cut(usable(embeddings, key, vector), "vectors")
    many = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard).collect()  # lengths of more than a shard
    coarse: dict[int, tuple[np.ndarray, int]] = {}
    for dim, n in ((r["dim"], r["n"]) for r in many):
        cells = min(CELLS, -(-n // shard))
        own, scale = rows.where(F.col("dim") == dim), 1 << 30
        picked = F.pmod(F.xxhash64("v"), F.lit(scale))
        wanted = max(PER_CELL * cells, 4 * PROBE_QUERIES)
        sample = own.where(picked < int(scale * min(1.0, wanted / n))).select("v").limit(2 * wanted).toPandas()["v"]
        sample = np.stack(sample.to_list()) if len(sample) else np.zeros((0, dim))
        sample = sample[np.lexsort(sample.T[::-1])] + 0.0
        if len(sample) <= cells:  # nearly all vectors are equal
            continue
        centres = centroids_of(sample, cells)
        queries = sample[np.random.default_rng(1).permutation(len(sample))[:PROBE_QUERIES]]
        coarse[dim] = (centres, probes_for(own, dim, centres, queries, keep - 1))
    columns = f"key {rows.schema['key'].dataType.simpleString()}, v array<double>, dim int"
    placed = cut(_in_cells(rows, coarse, columns, False), "placed")
    subs = cut(placed.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("subs")), "cells")
    placed = placed.join(F.broadcast(subs), ["dim", "cell"]) if len(many) <= 16 else placed.join(subs, ["dim", "cell"])
    placed = placed.withColumn("shard", F.pmod(F.xxhash64("key"), F.col("subs")).cast("int"))
    schema = "dim int, cell int, shard int, subs int, size int, vectors binary, keys array<array<long>>, nodes array<binary>, neighbours array<binary>"

    def make(group, table):
        dim, cell, number, subs = (x.as_py() for x in group)
        keys = table.column("key").to_numpy()
        own = _matrix(table.column("v").combine_chunks(), dim)
        order = np.argsort(keys, kind="stable")
        keys, own = keys[order], own[order]
        _, first, of = np.unique(np.ascontiguousarray(own).view(f"V{8 * dim}").ravel(), return_index=True, return_inverse=True)
        by = np.argsort(of.ravel(), kind="stable")  # keys stay in order within a node
        edges = np.concatenate([[0], np.flatnonzero(np.diff(of.ravel()[by])) + 1, [len(by)]])
        lists = [keys[by[i:j]][:keep].tolist() for i, j in zip(edges, edges[1:])]
        packed = Graph.build(np.ascontiguousarray(own[first])).pack()
        row = {"dim": dim, "cell": cell, "shard": number, "subs": subs, "size": packed["size"], "vectors": packed["vectors"], "keys": lists, "nodes": packed["nodes"], "neighbours": packed["neighbours"]}
        kinds = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("shard", pa.int32()), ("subs", pa.int32()), ("size", pa.int32()), ("vectors", pa.binary()), ("keys", pa.list_(pa.list_(pa.int64()))), ("nodes", pa.list_(pa.binary())), ("neighbours", pa.list_(pa.binary()))])
        return pa.Table.from_pylist([row], schema=kinds)

    return Index(cut(placed.groupBy("dim", "cell", "shard", "subs").applyInArrow(make, schema), "hnsw"), coarse, keep)


def search(index: Index, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", *, k: int = 10, ef: int = EF) -> DataFrame:
    """The k nearest of each query row: query_id, rank, vec_id, score (Euclidean distance).

    Every usable query row is answered, repeated keys and rows too. Of the indexed rows with a query's key and vector
    one counts as the query's own and is no neighbour of it; further ones are. Ties go to the smaller key. k is less than the index's keep.
    """
    if k >= index.keep:
        raise ValueError(f"the index holds {index.keep} keys of equal vectors: it answers for fewer neighbours, not {k}")
    own = cut(usable(queries, key, vector).withColumnRenamed("key", "query_id").withColumn("q", F.monotonically_increasing_id()), "queries")
    columns = f"query_id {own.schema['query_id'].dataType.simpleString()}, v array<double>, dim int, q long"
    sent = _in_cells(own, index.coarse, columns, True)
    subs = index.table.select("dim", "cell", "subs").distinct()
    sent = sent.join(subs, ["dim", "cell"]).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).drop("subs")
    sent = cut(sent, "sent")
    by = ["dim", "cell", "shard"]
    # A shard with many queries is copied, once for each block of them.
    blocks = cut(sent.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("blocks")), "blocks")
    sent = sent.join(blocks, by).withColumn("block", F.pmod(F.xxhash64("q"), F.col("blocks")).cast("int")).drop("blocks")
    sent = sent.select(*[F.col(c).alias(f"q_{c}") for c in [*by, "block"]], "q", "query_id", "v")
    graphs = index.table.join(blocks, by).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "subs")
    schema = "q long, query_id long, vec_id long, score double"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        for row in left.to_pylist():
            graph, keys = Graph.unpack(row), row["keys"]
            names, numbers = right.column("query_id").to_pylist(), right.column("q").to_pylist()
            vectors = _matrix(right.column("v").combine_chunks(), row["dim"]) if len(names) else np.zeros((0, row["dim"]))
            for at in range(0, len(names), BATCH):
                part = vectors[at : at + BATCH]
                for name, number, query, near in zip(names[at : at + BATCH], numbers[at : at + BATCH], part, graph.search(part, ef)):
                    near = near[near >= 0]
                    score = np.sqrt(((graph.vectors[near] - query) ** 2).sum(1)).tolist()
                    found = [(s, x) for s, node in zip(score, near.tolist()) for x in keys[node]]
                    if (0.0, name) in found:
                        found.remove((0.0, name))
                    best = sorted(found)[:k]
                    out[0] += [number] * len(best)
                    out[1] += [name] * len(best)
                    out[2] += [x for _, x in best]
                    out[3] += [s for s, _ in best]
        return pa.table([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["q", "query_id", "vec_id", "score"])

    group = [*by, "block"]
    found = graphs.groupBy(*group).cogroup(sent.groupBy(*[f"q_{c}" for c in group])).applyInArrow(run, schema)
    order = Window.partitionBy("q").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors to each vector whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    return search(build_index(vectors), vectors.where("vec_id % 100 = 0"))
