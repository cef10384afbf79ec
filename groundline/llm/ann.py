"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard (Vamana, DiskANN's graph).

Vectors are dealt to shards by a hash. In each shard points enter in batches of doubling size: a greedy beam search
from the point nearest the mean proposes neighbours, relaxed distance pruning keeps diverse ones, and edges back are
added and pruned in turn. Every query is answered by a beam search in each shard; the best over shards are its result.

Equal vectors are one row with as many of its smallest ids as a result can need, so a vector with millions of copies is one
row with few ids and yet no neighbour is lost. Rows of equal direction (multiples of each other) are one point of the
graph; they are told apart when the found points' rows are scored exactly. Points that pruning would leave
unreachable hang on the nearest point that has a free link of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts, spool, table

#: Points of a shard on average; out-degree; beam widths as it is built and searched; slack of the relaxed pruning; queries of a block.
SHARD_POINTS, DEGREE, BEAM, SEARCH_BEAM, ALPHA, QUERY_BLOCK = 4096, 32, 64, 192, 1.2, 512


def beam_search(points: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of each query's beam, nearest first; points are unit vectors, edges pad with -1, -1 ends a beam."""
    q = len(queries)
    ids = np.full((q, width), -1, dtype=np.int64)
    gap = np.full((q, width), np.inf, dtype=np.float32)
    ids[:, 0], gap[:, 0] = start, 1 - queries @ points[start]
    done = np.ones((q, width), dtype=bool)
    done[:, 0] = False
    seen = np.zeros((q, len(points)), dtype=bool)
    seen[:, start] = True
    while len(live := np.flatnonzero(~done.all(1))):
        pick = np.argmax(~done[live], axis=1)  # beams are sorted, so the first is the nearest
        done[live, pick] = True
        near = edges[ids[live, pick]]
        fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
        r, c = np.nonzero(fresh)
        seen[live[r], near[r, c]] = True
        dist = np.full(near.shape, np.inf, dtype=np.float32)
        dist[r, c] = 1 - np.einsum("ij,ij->i", points[near[r, c]], queries[live[r]])
        all_gap = np.concatenate([gap[live], dist], axis=1)
        all_ids = np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1)
        all_done = np.concatenate([done[live], ~fresh], axis=1)
        order = np.argsort(all_gap, axis=1, kind="stable")[:, :width]
        at = np.arange(len(live))[:, None]
        gap[live], ids[live], done[live] = all_gap[at, order], all_ids[at, order], all_done[at, order]
    return ids, gap


def robust_prune(points: np.ndarray, own: np.ndarray, pool: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point of `own`, at most `degree` of its row of `pool` (-1 pads): the nearest stays, and what lies closer to it
    (times alpha) than to the point goes; then the next. Distances are squared Euclidean ones of unit vectors."""
    pool = np.where(pool == own[:, None], -1, pool)
    pool = np.sort(pool, axis=1)
    pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = -1  # repeats
    vectors = points[np.maximum(pool, 0)]
    gap = 2 - 2 * np.einsum("ijk,ik->ij", vectors, points[own])
    gap[pool < 0] = np.inf
    out = np.full((len(own), degree), -1, dtype=np.int64)
    rows = np.arange(len(own))
    for d in range(degree):
        best = gap.argmin(1)
        ok = np.isfinite(gap[rows, best])
        if not ok.any():
            break
        out[ok, d] = pool[ok, best[ok]]
        between = 2 - 2 * np.einsum("ijk,ik->ij", vectors, vectors[rows, best])
        gap[(alpha * alpha * between <= gap) & ok[:, None]] = np.inf
        gap[rows[ok], best[ok]] = np.inf
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """(edges, start) over unit vectors, in their order."""
    n = len(points)
    edges = np.full((n, degree), -1, dtype=np.int64)
    start = int(np.argmax(points @ points.mean(0)))
    order = np.concatenate(([start], np.delete(np.arange(n), start)))
    at = 1
    while at < n:
        for batch in np.array_split(order[at : min(2 * at, n)], -(-min(at, n - at) // 256)):
            found, _ = beam_search(points, edges, start, points[batch], beam)
            edges[batch] = robust_prune(points, batch, found, degree, alpha)
            back = [(to, own) for own, row in zip(batch.tolist(), edges[batch].tolist()) for to in row if to >= 0]
            to, own = (np.array(x, dtype=np.int64) for x in zip(*back))
            sort = np.argsort(to, kind="stable")
            to, own = to[sort], own[sort]
            nodes, first, count = np.unique(to, return_index=True, return_counts=True)
            extra = np.full((len(nodes), count.max()), -1, dtype=np.int64)
            extra[np.repeat(np.arange(len(nodes)), count), np.arange(len(to)) - np.repeat(first, count)] = own
            for part in np.array_split(np.arange(len(nodes)), -(-len(nodes) * extra.shape[1] // 16384)):
                merged = np.concatenate([edges[nodes[part]], extra[part]], axis=1)
                held = (merged >= 0).sum(1)
                full = held > degree
                edges[nodes[part[~full]]] = -np.sort(-merged[~full], axis=1)[:, :degree]
                if full.any():
                    edges[nodes[part[full]]] = robust_prune(points, nodes[part[full]], merged[full], degree, alpha)
        at = min(2 * at, n)
    return edges, start


def connected(points: np.ndarray, edges: np.ndarray, start: int) -> np.ndarray:
    """edges with one column more, by which points that can't be reached from start hang on near ones that can."""
    n = len(points)
    extra = np.full(n, -1, dtype=np.int64)
    reached = np.zeros(n, dtype=bool)

    def spread(front: np.ndarray) -> None:
        while len(front):
            reached[front] = True
            near = np.unique(edges[front])
            near = near[near >= 0]
            front = near[~reached[near]]

    spread(np.array([start]))
    for own in range(n):
        if not reached[own]:
            free = np.flatnonzero(reached & (extra < 0))  # never empty: each link gives a point with a free one
            extra[free[np.argmax(points[free] @ points[own])]] = own
            spread(np.array([own]))
    return np.concatenate([edges, extra[:, None]], axis=1)


def usable(vector: str):
    """True for vectors without null, with finite components and some length."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors times a power of two each, their norms): sizes near 1, so that nothing overflows and nothing is rounded."""
    v = vectors * np.exp2(-np.frexp(np.abs(vectors).max(1, keepdims=True))[1].astype(np.float64))
    return v, np.sqrt((v * v).sum(1))


def _pack(x: pd.DataFrame, k: int) -> pd.DataFrame:
    """One row with the graph over the directions of a shard's rows (id, ids, embedding)."""
    x = x.sort_values("id")
    exact = np.array(x["embedding"].tolist(), dtype=np.float64)
    v, norm = scaled(exact)
    # Multiples can differ in their last bits; such neighbours at no distance are points of their own.
    directions, of = np.unique((v / norm[:, None]).astype(np.float32), axis=0, return_inverse=True)
    edges, start = build_graph(directions)
    edges = connected(directions, edges, start)
    order = np.argsort(of.ravel(), kind="stable")
    ids = np.full((len(x), k + 1), -1, dtype=np.int64)
    known = np.zeros((len(x), k + 1), dtype=np.int8)
    for i, own in enumerate(x["ids"].to_numpy()[order]):
        ids[i, : len(own)], known[i, : len(own)] = own, 1
    ends = np.cumsum(np.bincount(of.ravel(), minlength=len(directions)))
    row = {"dim": int(x["dim"].iloc[0]), "shard": int(x["shard"].iloc[0]), "n": len(x), "points": len(directions), "start": start}
    parts = {"directions": directions, "edges": edges.astype(np.int32), "ends": ends.astype(np.int64), "vectors": exact[order], "ids": ids, "known": known}
    return pd.DataFrame([row | {name: part.tobytes() for name, part in parts.items()}])


class Shard:
    """A shard's graph as its packed row has it."""

    def __init__(self, row, k: int):
        n, points, dim = int(row.n), int(row.points), int(row.dim)  # the blocks' rows have nulls here, so pandas has floats
        self.start, self.k = int(row.start), k
        self.directions = np.frombuffer(row.directions, dtype=np.float32).reshape(points, dim)
        self.edges = np.frombuffer(row.edges, dtype=np.int32).reshape(points, DEGREE + 1)
        self.ends = np.concatenate(([0], np.frombuffer(row.ends, dtype=np.int64)))
        self.vectors, self.norm = scaled(np.frombuffer(row.vectors, dtype=np.float64).reshape(n, dim))
        self.ids = np.frombuffer(row.ids, dtype=np.int64).reshape(n, k + 1)
        self.known = np.frombuffer(row.known, dtype=np.int8).reshape(n, k + 1) > 0

    def search(self, asked: np.ndarray, embeddings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query_id, vec_id, score) of the best k of each query; all rows of the found points are scored exactly."""
        exact, own_norm = scaled(embeddings)
        found, _ = beam_search(self.directions, self.edges, self.start, (exact / own_norm[:, None]).astype(np.float32), SEARCH_BEAM)
        out = []
        for i, hit in enumerate(found):
            hit = hit[hit >= 0]
            count = self.ends[hit + 1] - self.ends[hit]
            rows = np.arange(count.sum()) + np.repeat(self.ends[hit] - np.cumsum(count) + count, count)
            score = (self.vectors[rows] * exact[i]).sum(1) / (self.norm[rows] * own_norm[i])
            s, v, ok = np.repeat(score, self.k + 1), self.ids[rows].ravel(), self.known[rows].ravel()
            ok &= v != asked[i]
            s, v = s[ok], v[ok]
            best = np.lexsort((v, -s))
            _, first = np.unique(v[best], return_index=True)  # an id with several vectors counts by its nearest
            best = best[np.sort(first)][: self.k]
            out.append((np.full(len(best), asked[i]), v[best], s[best]))
        return tuple(np.concatenate(x) for x in zip(*out))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, points_per_shard: int = SHARD_POINTS) -> DataFrame:
    """vectors(vec_id, embedding), queries(query_id, embedding) -> query_id, rank (from 1), vec_id, score (cosine in double).

    A query's own id is no candidate for it; ties go to the smaller vec_id; rows of null id and unusable vectors (see
    `usable`) take no part, nor do vectors of another dimension than the query's. Repeated rows count once; an id with several vectors
    counts by the nearest, a query_id with several vectors asks with each. Fewer than k candidates: all. Empty tables give
    an empty result. Each shard's graph is loaded once, and the queries pass it in blocks.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & usable("embedding")).select("vec_id", "embedding")
    first = Window.partitionBy("embedding").orderBy("vec_id")
    points = rows.withColumn("i", F.dense_rank().over(first)).where(F.col("i") <= k + 1).groupBy("embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    points = spool(points.select(F.size("embedding").alias("dim"), F.col("ids")[0].alias("id"), "ids", F.col("embedding").cast("array<double>").alias("embedding")), "points")
    dims = [(r.dim, r.shards) for r in points.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / points_per_shard).alias("shards")).collect()]
    spark = vectors.sparkSession
    shards = spark.createDataFrame(dims, "dim int, shards long")
    dealt = points.join(F.broadcast(shards), "dim").withColumn("shard", F.pmod(F.xxhash64("id", "embedding"), "shards"))
    graph = "dim int, shard long, n long, points long, start long, directions binary, edges binary, ends binary, vectors binary, ids binary, known binary"
    index = spool(dealt.select("dim", "shard", "id", "ids", "embedding").groupBy("dim", "shard").applyInPandas(lambda x: _pack(x, k), graph), "graphs")

    asked = queries.where(F.col("query_id").isNotNull() & usable("embedding")).select("query_id", F.col("embedding").cast("array<double>").alias("embedding")).distinct()
    asked = asked.withColumn("dim", F.size("embedding"))
    per_dim = asked.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("blocks"))
    blocks = asked.join(per_dim, "dim").withColumn("block", F.pmod(F.xxhash64("query_id", "embedding"), "blocks")).groupBy("dim", "block").agg(F.collect_list("query_id").alias("query_ids"), F.flatten(F.collect_list("embedding")).alias("query_vectors"))
    blocks = blocks.join(F.broadcast(shards), "dim").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    # A shard's graph, then the blocks of queries that meet it.
    both = index.withColumn("block", F.lit(-1).cast("long")).unionByName(blocks.select("dim", "shard", "block", "query_ids", "query_vectors"), allowMissingColumns=True)
    parts = max(1, sum(n for _, n in dims))
    both = both.repartition(parts, "dim", "shard").sortWithinPartitions("dim", "shard", "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for row in batch.to_pandas().itertuples():
                if row.block < 0:
                    held = Shard(row, k)
                else:
                    q, v, s = held.search(np.asarray(row.query_ids, dtype=np.int64), np.asarray(row.query_vectors, dtype=np.float64).reshape(-1, row.dim))
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], names=["query_id", "vec_id", "score"])

    hits = map_texts(both, search, "query_id long, vec_id long, score double")
    # An id has its best score only; the ranks then are of the shards' best.
    best = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_ann(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"))
