"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard.

Distinct vectors are dealt to shards of about ``SHARD_ROWS`` by hash, so one vector that fills a
third of the table is one node; a node carries the smallest ``k + 1`` vec_ids of its vector, all
that a list of ``k`` can need. A shard's graph is stored as one row of flat arrays: vectors,
levels, and for each level a (node x degree) neighbour array padded with -1. Nodes take a random
insertion order; each links to a diverse choice among its nearest earlier nodes on every level
it reaches, as incremental insertion would, but found by blocks of exact distances.

Every query searches every shard, queries in blocks, and the shards' results are merged.
Distances are Euclidean, in double precision on the given vectors, and exact for what is found.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part,
nor do rows with a null vec_id; vectors of other lengths are only compared among themselves;
ties go to the smaller vec_id; of rows that repeat a vec_id each is a candidate; with fewer than
``k`` candidates all are listed; empty tables give empty results; extra columns are dropped.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabgraph.distributed import materialize

SHARD_ROWS, QUERY_BLOCK = 4096, 16384
DEGREE, BASE_DEGREE, CANDIDATES, BEAM = 16, 32, 48, 128
SEED = 5


def usable(vector: Column) -> Column:
    """Neither null nor zero, and every component finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def _diverse(vectors: np.ndarray, found: np.ndarray, near: np.ndarray, degree: int) -> np.ndarray:
    """Of each row's candidates (nearest first, -1 for none) those nearer to the row's node than to
    any candidate already chosen; free places go to the nearest others."""
    rows, width = found.shape
    between = np.stack([_distances(v, v) for v in vectors[np.maximum(found, 0)]]) if rows else np.zeros((0, width, width))
    chosen = np.zeros((rows, width), bool)
    for c in range(width):
        blocked = (between[:, c, :c] < near[:, c, None]) & chosen[:, :c]
        chosen[:, c] = (found[:, c] >= 0) & ~blocked.any(axis=1) & (chosen.sum(axis=1) < degree)
    # Chosen ones first, then the others, each nearest first.
    rank = np.argsort(~chosen * 2 * width + (found < 0) * 4 * width + np.arange(width), axis=1, kind="stable")[:, :degree]
    picked = np.take_along_axis(found, rank, axis=1)
    if picked.shape[1] < degree:
        picked = np.pad(picked, ((0, 0), (0, degree - picked.shape[1])), constant_values=-1)
    return picked


def _level_graph(vectors: np.ndarray, degree: int, limit: int) -> np.ndarray:
    """Neighbours (nodes x limit) of nodes given in insertion order."""
    n = len(vectors)
    picked = np.full((n, degree), -1)
    for at in range(0, n, 256):
        rows = np.arange(at, min(at + 256, n))
        apart = _distances(vectors[rows], vectors[: rows[-1] + 1])
        apart[np.arange(rows[-1] + 1)[None, :] >= rows[:, None]] = np.inf
        width = min(CANDIDATES, apart.shape[1])
        best = np.argpartition(apart, width - 1, axis=1)[:, :width]
        near = np.take_along_axis(apart, best, axis=1)
        order = np.argsort(near, axis=1)
        best, near = np.take_along_axis(best, order, 1), np.take_along_axis(near, order, 1)
        picked[rows] = _diverse(vectors, np.where(np.isfinite(near), best, -1), near, degree)
    source, slot = np.nonzero(picked >= 0)
    target = picked[source, slot]
    ends, others = np.concatenate([source, target]), np.concatenate([target, source])
    apart = ((vectors[ends] - vectors[others]) ** 2).sum(axis=1)
    order = np.lexsort((apart, ends))
    ends, others, apart = ends[order], others[order], apart[order]
    starts = np.searchsorted(ends, np.arange(n + 1))
    links = np.full((n, limit), -1)
    counts = np.diff(starts)
    for node in np.flatnonzero(counts <= limit):
        links[node, : counts[node]] = others[starts[node]: starts[node + 1]]
    for node in np.flatnonzero(counts > limit):
        # A hub keeps a diverse choice among its nearest links.
        mine = slice(starts[node], starts[node] + min(counts[node], 4 * limit))
        links[node] = _diverse(vectors, others[mine][None, :], apart[mine][None, :], limit)[0]
    return links


class Graph:
    """A shard: vectors in insertion order, and per level its nodes and neighbour array."""

    def __init__(self, vectors: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.vectors, self.levels = vectors, levels

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = SEED) -> "Graph":
        rng = np.random.default_rng(seed)
        height = np.floor(-np.log(np.maximum(rng.random(len(vectors)), 1e-12)) / np.log(DEGREE)).astype(int)
        height[:1] = height.max(initial=0)
        levels = []
        for level in range(height.max(initial=0) + 1):
            nodes = np.flatnonzero(height >= level)
            links = _level_graph(vectors[nodes], DEGREE, BASE_DEGREE if level == 0 else DEGREE)
            levels.append((nodes, np.where(links >= 0, nodes[np.maximum(links, 0)], -1)))
        return cls(vectors, levels)

    def search(self, query: np.ndarray, k: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and squared distances of about the ``k`` nearest, nearest first."""
        vectors, start = self.vectors, 0
        apart = float(((vectors[0] - query) ** 2).sum())
        for nodes, links in self.levels[:0:-1]:
            while True:
                near = links[np.searchsorted(nodes, start)]
                near = near[near >= 0]
                if not len(near):
                    break
                d = ((vectors[near] - query) ** 2).sum(axis=1)
                best = int(d.argmin())
                if d[best] >= apart:
                    break
                start, apart = int(near[best]), float(d[best])
        links = self.levels[0][1]
        seen = np.zeros(len(vectors), bool)
        seen[start] = True
        open_, kept, beam = [(apart, start)], [(-apart, start)], max(beam, k)
        while open_:
            d, node = heapq.heappop(open_)
            if len(kept) >= beam and d > -kept[0][0]:
                break
            near = links[node]
            near = near[near >= 0]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            far = ((vectors[near] - query) ** 2).sum(axis=1)
            for d, other in zip(far.tolist(), near.tolist()):
                if len(kept) < beam:
                    heapq.heappush(kept, (-d, other))
                    heapq.heappush(open_, (d, other))
                elif d < -kept[0][0]:
                    heapq.heapreplace(kept, (-d, other))
                    heapq.heappush(open_, (d, other))
        best = sorted((-d, node) for d, node in kept)[:k]
        return np.array([n for _, n in best], int), np.array([d for d, _ in best])

    def pack(self) -> dict:
        return {"vectors": self.vectors.tobytes(), "dim": self.vectors.shape[1],
                "sizes": [len(n) for n, _ in self.levels], "degrees": [x.shape[1] for _, x in self.levels],
                "nodes": np.concatenate([n for n, _ in self.levels]).astype(np.int32).tobytes(),
                "links": np.concatenate([x.reshape(-1) for _, x in self.levels]).astype(np.int32).tobytes()}

    @classmethod
    def unpack(cls, row) -> "Graph":
        nodes, links = np.frombuffer(row["nodes"], np.int32), np.frombuffer(row["links"], np.int32)
        levels, a, b = [], 0, 0
        for size, degree in zip(row["sizes"], row["degrees"]):
            levels.append((nodes[a: a + size], links[b: b + size * degree].reshape(size, degree)))
            a, b = a + size, b + size * degree
        return cls(np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"]), levels)


def build_index(vectors: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """The graphs of all shards, one row each, and the number of shards. ``vectors`` (vec_id, embedding)."""
    clean = vectors.filter("vec_id is not null").filter(usable(F.col("embedding"))).select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    first = Window.partitionBy("embedding").orderBy("vec_id")
    nodes = materialize(clean.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k + 1).groupBy(
        "embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    shards = max(1, -(-nodes.count() // shard_rows))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(shards))).withColumn("dim", F.size("embedding"))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        order = np.random.default_rng(SEED).permutation(len(group.sort_values("ids", key=lambda s: s.str[0]).index))
        group = group.sort_values("ids", key=lambda s: s.str[0]).iloc[order]
        graph = Graph.build(np.stack(group["embedding"].to_numpy()))
        return pd.DataFrame([{"shard": group["shard"].iloc[0], **graph.pack(), "ids": [list(x) for x in group["ids"]]}])

    return materialize(dealt.groupBy("shard", "dim").applyInPandas(
        build, "shard long, dim int, vectors binary, sizes array<int>, degrees array<int>, nodes binary, links binary, "
               "ids array<array<long>>")), shards


def search(index: DataFrame, shards: int, queries: DataFrame, k: int, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query (vec_id, embedding), its own row left out."""
    asked = queries.filter("vec_id is not null").filter(usable(F.col("embedding"))).select(
        F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")).withColumn(
        "dim", F.size("embedding"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def run(graphs: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        for _, row in graphs.iterrows():
            graph, ids = Graph.unpack(row), row["ids"]
            for query, vector in zip(wanted["query_id"], wanted["embedding"]):
                vector = np.asarray(vector, np.float64)
                nodes, _ = graph.search(vector, k + 1, beam)
                score = np.sqrt(((graph.vectors[nodes] - vector) ** 2).sum(axis=1))
                hits = [(s, int(i)) for n, s in zip(nodes, score) for i in ids[n] if i != query]
                for s, i in sorted(hits)[:k]:
                    out["query_id"].append(query)
                    out["vec_id"].append(i)
                    out["score"].append(s)
        return pd.DataFrame(out)

    key = ["shard", "block", "dim"]
    found = held.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
