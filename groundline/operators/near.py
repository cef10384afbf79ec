"""Vector search by an inverted file: lists of near vectors around centroids, of which a query reads only the nearest few.

Lists are kept as blocks of packed vectors, so that a list of any size is spread over rows and tasks, and a block meets a block of queries
in one multiplication. All distances are exact, in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import bounded_batches
from .search import best_per_query, matrix, nearest_rows

#: Vectors that centroids are fitted on at most, about; lists at most; lists that a query reads; vectors of a block; queries of a block; distances to
#: centres that a task holds at once, about.
SAMPLE, LISTS, PROBES, BLOCK, QUERIES, ROUTED = 20_000, 4096, 8, 4096, 256, 1 << 16


def centroids_of(vectors: DataFrame, lists: int, seed: int = 1) -> DataFrame:
    """(list, vector): the centres of k-means on a sample of about SAMPLE vectors, fitted on Spark."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if lists < 2:  # any centre will do
        return vectors.limit(1).select(F.lit(0).alias("list"), F.col("vector").cast("array<double>").alias("vector"))
    every = max(1, vectors.count() // SAMPLE)
    sample = vectors.where(F.pmod(F.xxhash64("passage_id"), F.lit(every)) == 0)
    model = KMeans(k=lists, seed=seed, maxIter=5, initMode="random", featuresCol="v").fit(sample.select(array_to_vector(F.col("vector").cast("array<double>")).alias("v")))
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return vectors.sparkSession.createDataFrame(rows, "list int, vector array<double>")


def _nearest_lists(vectors: DataFrame, centroids: DataFrame, key: str, n: int) -> DataFrame:
    """vectors(key, vector) with a row for each of the n nearest centroids. There are LISTS centroids at most, which go to every task."""
    held = vectors.sparkSession.sparkContext.broadcast(np.array([r.vector for r in centroids.orderBy("list").collect()]))
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = held.value
        most = min(n, len(centres))
        for batch in batches:
            step = max(1, ROUTED // len(centres))  # neither the distances to all centres nor the rows that go out grow with the number of lists
            for part in (batch.slice(at, step) for at in range(0, batch.num_rows, step)):
                v = matrix(part.column(1))
                gap = (centres * centres).sum(1) - 2 * v @ centres.T
                near = np.argpartition(gap, most - 1, axis=1)[:, :most].ravel()
                rows = pa.array(np.repeat(np.arange(len(v)), most))
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), pa.array(near, pa.int32()), part.column(1).take(rows)], names=[key, "list", "vector"])

    return vectors.select(key, F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, f"{key} {kind}, list int, vector array<double>")


def vector_index(vectors: DataFrame, lists: int | None = None) -> tuple[DataFrame, DataFrame]:
    """vectors(passage_id, vector) of one dimension -> centroids(list, vector), blocks(list, ids, vectors).

    Every vector is in the list of its nearest centroid. There are about as many lists as vectors in a list, LISTS at most, and
    one where a block holds all. Rows whose id or vector is null
    take no part; no vectors give no lists.
    """
    some = vectors.where("passage_id is not null and vector is not null")
    n = some.count()
    if not n:
        spark = vectors.sparkSession
        return spark.createDataFrame([], "list int, vector array<double>"), spark.createDataFrame([], "list int, ids array<string>, vectors array<array<double>>")
    centroids = centroids_of(some, lists or (min(LISTS, round(n**0.5)) if n > BLOCK else 1))
    placed = _nearest_lists(some, centroids, "passage_id", 1)
    # A list is dealt into as many blocks as it needs by a hash; sizes are counted first.
    sizes = placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_n"))
    dealt = placed.join(F.broadcast(sizes), "list").withColumn("_b", F.pmod(F.xxhash64("passage_id"), F.col("_n")))
    packed = dealt.groupBy("list", "_b").agg(F.collect_list(F.struct("passage_id", "vector")).alias("r"))
    return centroids, packed.select("list", F.col("r.passage_id").alias("ids"), F.col("r.vector").alias("vectors"))


def vector_search(queries: DataFrame, centroids: DataFrame, blocks: DataFrame, k: int, probes: int | None = PROBES) -> DataFrame:
    """queries(query_id, vector) -> query_id, passage_id, distance, rank: the k nearest by L2 distance of the vectors in each query's `probes` nearest lists.

    None reads all lists, which is exact. Ties go to the smaller passage_id. Queries meet a list in blocks, each block of vectors gives its k best
    of a query, and these merge by rank. Queries whose id or vector is null have no result.
    """
    some = queries.where("query_id is not null and vector is not null").select("query_id", "vector")
    lists = centroids.count()
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, passage_id {blocks.schema['ids'].dataType.elementType.simpleString()}, distance double"
    if not lists:
        return best_per_query(queries.sparkSession.createDataFrame([], schema), F.col("distance").asc(), k)
    routed = _nearest_lists(some, centroids, "query_id", lists if probes is None else min(probes, lists))
    per_list = routed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("_n"))
    dealt = routed.join(F.broadcast(per_list), "list").withColumn("_b", F.pmod(F.xxhash64("query_id"), F.col("_n")))
    asked = dealt.groupBy("list", "_b").agg(F.collect_list("query_id").alias("queries"), F.collect_list("vector").alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own_queries, own_asked, ids, vectors = (batch.column(c)[row].values for c in range(4))
                q, v = matrix(own_asked), matrix(vectors)
                order = np.asarray(pa.compute.sort_indices(ids))  # ties by id
                ids, v = ids.take(pa.array(order)), v[order]
                for at in range(0, len(q), QUERIES):
                    rows, cols, d = nearest_rows(q[at : at + QUERIES], v, k)
                    yield pa.RecordBatch.from_arrays([own_queries.take(pa.array(rows + at)), ids.take(pa.array(cols)), pa.array(d)], names=["query_id", "passage_id", "distance"])

    bounded_batches(queries.sparkSession)
    met = blocks.join(asked, "list").select("queries", "asked", "ids", "vectors").mapInArrow(run, schema)
    return best_per_query(met, F.col("distance").asc(), k)
