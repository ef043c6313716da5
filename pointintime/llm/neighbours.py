"""Approximate nearest neighbours: a navigable small-world graph per shard.

Vectors are dealt to shards of about ``SHARD`` by a hash of their id. Each shard builds its own hierarchical
graph (``LINKS`` links a node and level, twice that on level 0, candidate lists of ``BUILD``) over its
different vectors, and is stored as one row of flat arrays: vectors, ids, levels and neighbour lists. Query
blocks visit every shard; a shard answers with its ``k`` nearest, and the answers of all shards are merged.
Distances of results are Euclidean, in double precision on the original vectors; ties go to the smaller id.

All valid rows are indexed, equal vectors as one node that carries all their ids. Vectors that are null,
empty, zero or hold null or non-finite components take no part; vectors of different lengths are never
compared. Every other row is a candidate, repeated rows and rows without an id too (these come last in a tie); only
the query's own row, one of its id and vector, is not among its results. With ``SEARCH`` candidates the measured recall is in the README.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

SHARD = 8_192
LINKS = 12
BUILD = 56
SEARCH = 128
#: Queries that meet a shard at a time: so many that they weigh about as much as the shard.
BLOCK = 8_192


class Graph:
    """The graph of one shard: ``near[level]`` has a row of neighbours for each node, -1 where there is none."""

    def __init__(self, vectors: np.ndarray, near: list[np.ndarray] | None = None, entry: int = 0):
        self.v = vectors
        self.square = (vectors**2).sum(1)
        self.near = near or []
        self.entry = entry
        self.stamp = np.zeros(len(vectors), np.int64)
        self.epoch = 0

    def distances(self, nodes: np.ndarray, q: np.ndarray) -> np.ndarray:
        return self.square[nodes] - 2 * (self.v[nodes] @ q)

    def closest(self, q: np.ndarray, start: list[tuple[float, int]], width: int, level: int) -> list[tuple[float, int]]:
        """The ``width`` nearest nodes found from ``start`` on a level, nearest first."""
        self.epoch += 1
        stamp, near, epoch = self.stamp, self.near[level], self.epoch
        todo = list(start)
        heapq.heapify(todo)
        best = [(-d, n) for d, n in start]
        heapq.heapify(best)
        for _, n in start:
            stamp[n] = epoch
        while todo:
            d, n = heapq.heappop(todo)
            if len(best) >= width and d > -best[0][0]:
                break
            more = near[n]
            more = more[more >= 0]
            more = more[stamp[more] != epoch]
            if not len(more):
                continue
            stamp[more] = epoch
            far = self.distances(more, q)
            if len(best) >= width:
                use = far < -best[0][0]
                more, far = more[use], far[use]
            for x, m in zip(far.tolist(), more.tolist(), strict=True):
                if len(best) < width:
                    heapq.heappush(best, (-x, m))
                    heapq.heappush(todo, (x, m))
                elif x < -best[0][0]:
                    heapq.heapreplace(best, (-x, m))
                    heapq.heappush(todo, (x, m))
        return sorted((-d, n) for d, n in best)

    def descend(self, q: np.ndarray, to: int) -> list[tuple[float, int]]:
        at = [(float(self.square[self.entry] - 2 * self.v[self.entry] @ q), self.entry)]
        for level in range(len(self.near) - 1, to, -1):
            at = self.closest(q, at, 1, level)
        return at

    def spread(self, found: list[tuple[float, int]], most: int, own: float) -> list[tuple[float, int]]:
        """Of the candidates those that are nearer to the new node than to any one already chosen."""
        nodes = np.array([n for _, n in found])
        between = self.square[nodes][:, None] + self.square[nodes][None] - 2 * self.v[nodes] @ self.v[nodes].T
        kept: list[int] = []
        least = np.full(len(nodes), np.inf)
        for i in range(len(nodes)):
            if found[i][0] + own < least[i]:
                kept.append(i)
                if len(kept) == most:
                    break
                np.minimum(least, between[i], out=least)
        for i in range(len(nodes)):
            if len(kept) >= min(most, len(nodes)):
                break
            if i not in kept:
                kept.append(i)
        return [found[i] for i in kept]

    @classmethod
    def build(cls, vectors: np.ndarray, levels: np.ndarray) -> Graph:
        n = len(vectors)
        top = int(levels.max()) if n else 0
        g = cls(vectors, [np.full((n, 2 * LINKS if level == 0 else LINKS), -1, np.int32) for level in range(top + 1)], int(np.argmax(levels)))
        apart = [np.full(x.shape, np.inf) for x in g.near]
        for i in [g.entry, *(k for k in range(n) if k != g.entry)]:
            if i == g.entry:
                continue
            q, level = vectors[i], int(levels[i])
            at = g.descend(q, level)
            for k in range(level, -1, -1):
                at = g.closest(q, at, BUILD, k)
                picked = g.spread(at, LINKS, float(g.square[i]))
                for j, (d, m) in enumerate(picked):
                    d += float(g.square[i])
                    g.near[k][i, j], apart[k][i, j] = m, d
                    place = int(np.argmax(apart[k][m]))  # a free place is infinitely far
                    if d < apart[k][m, place]:
                        g.near[k][m, place], apart[k][m, place] = i, d
        return g


def _valid(vectors: DataFrame) -> DataFrame:
    e = F.col("embedding")
    sound = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(e.isNotNull() & F.coalesce(sound, F.lit(False)) & F.exists(e, lambda x: x != 0)).select(F.coalesce(F.col("vec_id").cast("long"), F.lit(0)).alias("vec_id"), F.col("vec_id").isNull().alias("nil"), e.cast("array<double>").alias("v"))


def index(vectors: DataFrame, shard_size: int = SHARD) -> tuple[DataFrame, int]:
    """One row a shard: dim, shard, n, and the flat arrays of its graph as bytes; and the number of shards."""
    valid = _valid(vectors)
    shards = max(1, -(-valid.count() // shard_size))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["nil", "vec_id"])
        ids, nil = pdf["vec_id"].to_numpy(np.int64), pdf["nil"].to_numpy(bool)
        v, node = np.unique(np.array(pdf["v"].tolist(), float), axis=0, return_inverse=True)
        order = np.argsort(node.ravel(), kind="stable")
        begins = np.searchsorted(node.ravel()[order], np.arange(len(v) + 1))
        rng = np.random.default_rng(len(v))
        mixed = rng.permutation(len(v))  # sorted vectors would be linked in one direction
        rows = [order[begins[m] : begins[m + 1]] for m in mixed]
        v = v[mixed]
        levels = np.minimum(np.floor(-np.log(rng.random(len(v))) / np.log(LINKS)), 6).astype(np.int64)
        g = Graph.build(v, levels)
        row = {
            "dim": v.shape[1], "shard": int(pdf["shard"].iloc[0]), "n": len(v), "entry": g.entry, "vectors": v.tobytes(),
            "ids": ids[np.concatenate(rows)].tobytes(), "nil": nil[np.concatenate(rows)].tobytes(), "ends": np.cumsum([len(x) for x in rows]).astype(np.int64).tobytes(), "near": [x.tobytes() for x in g.near],
        }
        return pd.DataFrame([row])

    dealt = valid.withColumn("dim", F.size("v").cast("long")).withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)))
    graphs = dealt.groupBy("dim", "shard").applyInPandas(build, "dim long, shard long, n long, entry long, vectors binary, ids binary, nil binary, ends binary, near array<binary>")
    return written(graphs), shards


def search(graphs: DataFrame, shards: int, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest other vectors of each row of ``queries`` (vec_id, embedding)."""
    valid = _valid(queries).withColumn("dim", F.size("v").cast("long")).withColumn("query", F.monotonically_increasing_id())
    valid = written(valid)  # rows are numbered once: the merge at the end tells them by their number
    blocks = max(1, -(-valid.count() // BLOCK))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        row = {"dim": int(pdf["dim"].iloc[0]), "q_rows": pdf["query"].to_numpy(np.int64).tobytes(), "q_ids": pdf["vec_id"].to_numpy(np.int64).tobytes(), "q_nil": pdf["nil"].to_numpy(bool).tobytes(), "q_vectors": np.array(pdf["v"].tolist(), float).tobytes()}
        return pd.DataFrame([row])

    packed = valid.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks))).groupBy("dim", "block").applyInPandas(pack, "dim long, q_rows binary, q_ids binary, q_nil binary, q_vectors binary")
    visits = packed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))

    def answer(batches):
        graph: tuple = (None, None)
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                if graph[0] != (dim, row["shard"]):
                    v = np.frombuffer(row["vectors"]).reshape(-1, dim)
                    graph = (dim, row["shard"]), Graph(v, [np.frombuffer(x, np.int32).reshape(len(v), -1) for x in row["near"]], row["entry"])
                g = graph[1]
                v = g.v
                ids, nil, ends = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["nil"], bool), np.frombuffer(row["ends"], np.int64)
                asked = zip(np.frombuffer(row["q_rows"], np.int64).tolist(), np.frombuffer(row["q_ids"], np.int64).tolist(), np.frombuffer(row["q_nil"], bool).tolist(), np.frombuffer(row["q_vectors"]).reshape(-1, dim), strict=True)
                out = []
                for q_row, q_id, q_nil, q in asked:
                    nodes = np.array([n for _, n in g.closest(q, g.descend(q, 0), SEARCH, 0)])
                    d = np.sqrt(((v[nodes] - q) ** 2).sum(1))
                    found = []
                    for j in np.argsort(d, kind="stable").tolist():
                        if len(found) > k and d[j] > found[k][0]:
                            break
                        n = int(nodes[j])
                        begin, end = int(ends[n - 1]) if n else 0, int(ends[n])
                        rows = [(float(d[j]), none, i) for i, none in zip(ids[begin : min(end, begin + k + 1)].tolist(), nil[begin : min(end, begin + k + 1)].tolist(), strict=True)]
                        own = (0.0, q_nil, q_id)
                        if not d[j]:  # the query's own row is of this node
                            if own in rows:
                                rows.remove(own)
                            elif end - begin > k:
                                rows = rows[:k]
                        found = sorted(found + rows)
                    out += [(q_row, None if q_nil else q_id, None if none else i, x) for x, none, i in found[:k]]
                columns = list(zip(*out, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query", "query_id", "vec_id", "score"])

    found = visits.join(graphs, ["dim", "shard"]).mapInArrow(answer, "query long, query_id long, vec_id long, score double")
    order = Window.partitionBy("query").orderBy("score", F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_hnsw_search(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    graphs, shards = index(vectors)
    return search(graphs, shards, vectors.where("vec_id % 100 = 0"))
