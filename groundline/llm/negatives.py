"""Hard negatives: integer inner products of anchors and all rows by Strassen multiplication, then mergeable heaps.

1. Vectors become integers. Anchors are broadcast in groups of a bounded size; every other row meets each group once a pass, in tiles,
   without a shuffle.
2. A tile of products is one Strassen recursion on 64-bit integers: odd sides are padded with zeros, sums are exact, and seven half-sized
   products stand for eight. Sums wrap modulo 2**64, so a product is right wherever it fits 64 bits.
3. First pass: the best rows of each anchor's label, a heap an anchor in each task; heaps merge by rank, first within groups of tasks.
4. Second pass: for each anchor and positive a heap of the best other-label rows whose score lies in the positive's window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts, spool, table

#: Anchors of one broadcast at most, on average, and of one tile; rows of one tile.
GROUP, ANCHORS, ROWS = 1 << 14, 512, 4096
#: A side from which on halving no longer pays.
LEAF = 64
#: Heaps of as many groups of tasks are merged before those of all.
GROUPS_OF_TASKS = 64


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of 64-bit integers by Strassen's recursion."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= LEAF // 2:
        return a @ b
    pad = lambda x: np.pad(x, [(0, s & 1) for s in x.shape])
    a, b = pad(a), pad(b)
    h, i, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    p1 = product(a11 + a22, b11 + b22)
    p2 = product(a21 + a22, b11)
    p3 = product(a11, b12 - b22)
    p4 = product(a22, b21 - b11)
    p5 = product(a11 + a12, b22)
    p6 = product(a21 - a11, b11 + b12)
    p7 = product(a12 - a22, b21 + b22)
    return np.block([[p1 + p4 - p5 + p7, p3 + p5], [p2 + p4, p1 - p2 + p3 + p6]])[:m, :n]


def integers(vector: Column) -> Column:
    """floor(256 * x) of each component, in double; null where the vector is or a component is null, not finite or beyond 64 bits."""
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * 256))
    ok = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < 2.0**54, F.lit(False)))
    return F.when(F.coalesce(ok, F.lit(False)), scaled)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of lists as one matrix; shorter lists are filled with zeros."""
    sizes = np.asarray(column.value_lengths()).astype(np.int64)
    out = np.zeros((len(column), width), dtype=np.int64)
    at = np.repeat(np.cumsum(sizes) - sizes, sizes)
    flat = np.asarray(column.flatten()).astype(np.int64)
    place = np.arange(len(flat)) - at
    keep = place < width
    out[np.repeat(np.arange(len(column)), sizes)[keep], place[keep]] = flat[keep]
    return out


class Heaps:
    """The k best (score, id, row) of each of n lists: higher scores first, then lower ids. Two heaps of one list merge into one."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores = np.full((n, k), np.iinfo(np.int64).min)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        self.full = np.zeros((n, k), dtype=bool)

    def add(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Candidates, each for one list."""
        last = self.scores[lists, -1]
        may = ~self.full[lists, -1] | (scores > last) | (scores == last) & (ids < self.ids[lists, -1])
        lists, scores, ids = lists[may], scores[may], ids[may]
        if not len(lists):
            return
        own = np.unique(lists)
        held = self.full[own]
        row = np.repeat(own, self.k).reshape(held.shape)[held]
        lists, scores, ids = np.concatenate([row, lists]), np.concatenate([self.scores[own][held], scores]), np.concatenate([self.ids[own][held], ids])
        order = np.lexsort((ids, -1 - scores, lists))
        lists, scores, ids = lists[order], scores[order], ids[order]
        first = np.concatenate(([0], np.flatnonzero(lists[1:] != lists[:-1]) + 1))
        rank = np.arange(len(lists)) - np.repeat(first, np.diff(np.append(first, len(lists))))
        top = rank < self.k
        self.scores[lists[top], rank[top]], self.ids[lists[top], rank[top]], self.full[lists[top], rank[top]] = scores[top], ids[top], True

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lists, place = np.nonzero(self.full)
        return lists, self.scores[lists, place], self.ids[lists, place]


def _tiles(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, integer vectors) of ROWS rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield np.asarray(part.column(0)), np.asarray(part.column(1)), _matrix(part.column(2), width)


def _merged(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best rows (score, other) of each key over all tasks' heaps, with their rank."""
    order = [F.desc("score"), F.col("other")]
    some = found.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(GROUPS_OF_TASKS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))).where(F.col("rank") <= k).drop("_part")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def _pass(rows: DataFrame, width: int, run: Callable, schema: str) -> DataFrame:
    return map_texts(rows.select("id", "label", "v"), run, schema)


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """rows(id, label, vector) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score (scores are integer inner products).

    Rows for which `anchors` holds are anchors; an anchor's positives are the best rows of its label, a pair's negatives the best
    of other labels for which low% of the positive's score <= score <= high% of it; ties go to smaller ids. Rows with a null id or label, or a vector
    that `integers` refuses take no part. Shorter vectors count as if filled with zeros. Repeated rows count once each as candidates, but a row never is
    a candidate of an anchor with its own id, and anchors of one id are one (least label and vector). Fewer rows than asked: all. Empty tables
    give an empty result. Products beyond 64 bits wrap.
    """
    given = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), integers(F.col("vector")).alias("v"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    given = given.where("id is not null and label is not null and v is not null")
    asking = given.where("asks").groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")
    asking = spool(asking.withColumn("width", F.size("v")), "anchors")
    size = asking.agg(F.count(F.lit(1)).alias("n"), F.max("width").alias("width")).first()
    empty = rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not size.n:
        return empty
    width, groups = int(size.width), max(1, -(-size.n // GROUP))
    out = None
    for group in range(groups):
        own = asking.where(F.pmod(F.xxhash64("id"), F.lit(groups)) == group).toArrow().sort_by("id")
        if own.num_rows:
            found = _of_group(given, own, width, positives, negatives, low, high)
            out = found if out is None else out.unionAll(found)
    return out


def _of_group(rows: DataFrame, own: pa.Table, width: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """hard_negatives of the anchors `own`, of which there are about GROUP at most."""
    context = rows.sparkSession.sparkContext
    column = own["v"].combine_chunks()
    ids, labels, matrix = own["id"].to_numpy(), own["label"].to_numpy(), _matrix(column, width)
    held = context.broadcast((ids, labels, matrix))

    def best_of_label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, matrix = held.value
        heaps = Heaps(len(ids), positives)
        for other, label, v in _tiles(batches, width):
            for at in range(0, len(ids), ANCHORS):
                a, b = np.nonzero((labels[at : at + ANCHORS, None] == label[None, :]) & (ids[at : at + ANCHORS, None] != other[None, :]))
                scores = product(matrix[at : at + ANCHORS], np.ascontiguousarray(v.T))
                heaps.add(a + at, scores[a, b], other[b])
        at, scores, other = heaps.rows()
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[at], scores, other)], names=["anchor_id", "score", "other"])

    best = _merged(_pass(rows, width, best_of_label, "anchor_id long, score long, other long"), ["anchor_id"], positives)
    # At most `positives` rows an anchor, so as bounded as the anchors.
    pairs = best.select("anchor_id", "score", "other", F.col("rank").alias("place")).toArrow()
    order = np.lexsort((pairs["place"].to_numpy(), pairs["anchor_id"].to_numpy()))
    wanted = context.broadcast(tuple(pairs[c].to_numpy()[order] for c in ("anchor_id", "score", "other", "place")))

    def best_in_window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, matrix = held.value
        anchor, score, positive, place = wanted.value
        row = np.searchsorted(ids, anchor)
        # The whole numbers between the two shares of each positive's score.
        least, most = [-(-low * s // 100) for s in score.tolist()], [high * s // 100 for s in score.tolist()]
        heaps = Heaps(len(anchor), negatives)
        for other, label, v in _tiles(batches, width):
            for at in range(0, len(ids), ANCHORS):
                pair = np.flatnonzero((row >= at) & (row < at + ANCHORS))
                if not len(pair):
                    continue
                scores = product(matrix[at : at + ANCHORS], np.ascontiguousarray(v.T))
                for p in pair.tolist():
                    mine = scores[row[p] - at]
                    b = np.flatnonzero((mine >= least[p]) & (mine <= most[p]) & (label != labels[row[p]]) & (other != anchor[p]))
                    heaps.add(np.full(len(b), p), mine[b], other[b])
        at, scores, other = heaps.rows()
        columns = (anchor[at], place[at], positive[at], score[at], scores, other)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["anchor_id", "place", "positive_id", "positive_score", "score", "other"])

    found = _pass(rows, width, best_in_window, "anchor_id long, place int, positive_id long, positive_score long, score long, other long")
    merged = _merged(found, ["anchor_id", "place"], negatives)
    return merged.select("anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of the embeddings whose number 100 divides; every seventh row has a shifted label."""
    e = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(e.select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector")), F.col("id") % 100 == 0)
