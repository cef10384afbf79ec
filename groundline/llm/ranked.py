"""Ranked lexical search over all documents by a hybrid of term-at-a-time and document-at-a-time evaluation.

1. One scan of the texts writes an index of segments, each of some thousand documents: the postings of the terms that queries may
   hold, and the documents' lengths. Segments are cut where the documents are read, so no text and no posting is shuffled.
2. Counts over all segments give the number of documents, their lengths and the document frequencies: all scores are whole numbers.
3. In a segment a query's short lists are summed first, term at a time, into accumulators. These then are one more sorted list with an upper bound.
   It and the long lists are walked document at a time, a run of documents a step: lists whose bounds together can't reach
   the k-th best score give no candidates (MaxScore) and are only looked up for candidates that can still reach it.
4. Each task keeps the k best documents of a query over its segments; the tasks' lists merge by rank.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts, spool, table
from .decontam import bitmap, in_bitmap
from .text_hash import ALNUM, word_hashes

#: Documents of a segment, and of one step of the walk through it. Lists of at most a SHORT-th of a segment's documents are summed term at a time.
SEGMENT, STEP, SHORT = 8192, 1024, 32
#: Queries and distinct terms of one broadcast, on average. Bytes of text that are cut into words at once.
QUERIES, TERMS, BYTES = 1024, 1 << 18, 1 << 20
#: The lists of as many groups of tasks are merged before those of all.
GROUPS_OF_TASKS = 64


def _pieces(texts: pa.Array) -> Iterator[tuple[list[int], list[bytes]]]:
    """(row, bytes) of texts in runs of about BYTES; longer texts come in pieces that end between words."""
    rows: list[int] = []
    run: list[bytes] = []
    held = 0
    for i, x in enumerate(texts.cast(pa.large_binary())):
        text = x.as_py() or b""
        if len(text) > BYTES:
            text = text.translate(ALNUM)
        while text:
            end = len(text)
            if end > BYTES:
                end = text.find(b" ", BYTES)
                end = len(text) if end < 0 else end
            rows.append(i)
            run.append(text[:end])
            held += end
            text = text[end:]
            if held >= BYTES:
                yield rows, run
                rows, run, held = [], [], 0
    if run:
        yield rows, run


def _counted(texts: pa.Array, wanted) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of terms of each text; hash, row and count of each term of a text that `wanted` lets through, by hash, then row)."""
    n = np.zeros(len(texts), dtype=np.int64)
    hashes, owners, counts = [], [], []
    for rows, run in _pieces(texts):
        h, piece, *_ = word_hashes(run)
        own = np.asarray(rows)[piece]
        n += np.bincount(own, minlength=len(n))
        keep = wanted(h)
        for x, y in zip((hashes, owners, counts), _summed(h[keep], own[keep], np.ones(int(keep.sum()), dtype=np.int64))):
            x.append(y)
    none = np.zeros(0, dtype=np.int64)
    return n, *_summed(*(np.concatenate(x) if x else none for x in (hashes, owners, counts)))


def _summed(h: np.ndarray, own: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((own, h))
    h, own = h[order].view(np.uint64), own[order]
    first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (own[1:] != own[:-1])))) if len(h) else np.zeros(0, dtype=np.int64)
    return h[first], own[first], np.add.reduceat(counts[order], first) if len(first) else counts


def terms_of(items: DataFrame, key: str) -> DataFrame:
    """items(key, text) -> (key, term, times): the hashes of each text's terms. Null texts have none."""
    kind = items.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, h, own, times = _counted(batch.column(1), lambda h: np.ones(len(h), dtype=bool))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), pa.array(h.view(np.int64)), pa.array(times)], names=["key", "term", "times"])

    return map_texts(items.select(key, "text"), run, f"{key} {kind}, term bigint, times bigint")


def _lists(values: np.ndarray, ends: list[int], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def search_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """docs(doc_id, text), terms(term) -> segments (docs, n, terms, sizes, at, tf) with the postings of these terms, or nearly only these.

    docs and n are the ids and numbers of terms of a segment's documents; texts without terms are left out. terms ascend, sizes are the lengths of their
    lists, which stand in at (places in docs) and tf one after the other. The terms are known to tasks by a bitmap of fixed size.
    """
    held = docs.sparkSession.sparkContext.broadcast(bitmap(terms.select(F.col("term").alias("gram"))))

    def packed(ids: pa.Array, n: np.ndarray, h: np.ndarray, at: np.ndarray, tf: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((at, h))
        h, at, tf = h[order], at[order], tf[order]
        known, first = np.unique(h, return_index=True)
        sizes = np.diff(np.append(first, len(h)))
        row = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), _lists(n, [0, len(n)], pa.int64()), _lists(known.view(np.int64), [0, len(known)], pa.int64()), _lists(sizes, [0, len(sizes)], pa.int32()), _lists(at, [0, len(at)], pa.int32()), _lists(tf, [0, len(tf)], pa.int64())]
        return pa.RecordBatch.from_arrays(row, names=["docs", "n", "terms", "sizes", "at", "tf"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []
        filled = 0

        def segment() -> pa.RecordBatch:
            return packed(pa.concat_arrays([x[0] for x in parts]), *(np.concatenate([x[k] for x in parts]) for k in range(1, 5)))

        for batch in batches:
            n, h, own, tf = _counted(batch.column(1), lambda h: in_bitmap(held.value, h))
            some = np.flatnonzero(n)
            place = np.cumsum(n > 0) - 1
            parts.append((batch.column(0).take(pa.array(some)).cast(pa.int64()), n[some], h, place[own] + filled, tf))
            filled += len(some)
            if filled >= SEGMENT:
                yield segment()
                parts, filled = [], 0
        if filled:
            yield segment()

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "docs array<bigint>, n array<bigint>, terms array<bigint>, sizes array<int>, at array<int>, tf array<bigint>")


class Postings(NamedTuple):
    """A sorted list of documents with what each adds to the score; no one adds more than bound."""

    at: np.ndarray
    adds: np.ndarray
    bound: int


def summed(lists: list[Postings]) -> list[Postings]:
    """Term at a time: the lists' sums as one list; none where there are no lists."""
    if len(lists) < 2:
        return lists
    at, adds = np.concatenate([x.at for x in lists]), np.concatenate([x.adds for x in lists])
    order = np.argsort(at, kind="stable")
    at, adds = at[order], adds[order]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    sums = np.add.reduceat(adds, first)
    return [Postings(at[first], sums, int(sums.max()))]


class Best:
    """The k best (score, document) of a query: higher scores, then lower ids, ids that are null last."""

    def __init__(self, k: int):
        self.k = k
        self.score = self.null = self.id = np.zeros(0, dtype=np.int64)

    @property
    def least(self) -> int:
        """The score from which on a document can be among the k best."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        score, null, ids = np.concatenate([self.score, score]), np.concatenate([self.null, null]), np.concatenate([self.id, ids])
        top = np.lexsort((ids, null, -score))[: self.k]
        self.score, self.null, self.id = score[top], null[top], ids[top]


def walk(lists: list[Postings], n_docs: int, best: Best, null: np.ndarray, ids: np.ndarray) -> int:
    """Document at a time: offers `best` all documents that can be among the k best; returns how many were scored."""
    lists = sorted(lists, key=lambda x: x.bound)
    upto = np.cumsum([x.bound for x in lists]).tolist()
    cuts = [np.searchsorted(x.at, np.arange(0, n_docs + STEP, STEP)) for x in lists]
    scored = 0
    for step in range(-(-n_docs // STEP)):
        least = best.least
        if upto[-1] < least:
            break
        # Lists whose bounds together stay under the k-th best score give no candidates.
        passive = next(i for i, b in enumerate(upto) if b >= least)
        base = step * STEP
        score, seen = np.zeros(STEP, dtype=np.int64), np.zeros(STEP, dtype=bool)
        for x, cut in zip(lists[passive:], cuts[passive:]):
            at = x.at[cut[step] : cut[step + 1]] - base
            score[at] += x.adds[cut[step] : cut[step + 1]]
            seen[at] = True
        alive = np.flatnonzero(seen & (score + (upto[passive - 1] if passive else 0) >= least))
        scored += len(alive)
        for i in range(passive - 1, -1, -1):
            if not len(alive):
                break
            own = lists[i].at[cuts[i][step] : cuts[i][step + 1]]
            place = np.searchsorted(own, alive + base)
            hit = place < len(own)
            hit[hit] = own[place[hit]] == alive[hit] + base
            score[alive[hit]] += lists[i].adds[cuts[i][step] + place[hit]]
            alive = alive[score[alive] + (upto[i - 1] if i else 0) >= least]
        alive = alive[score[alive] >= least]
        if len(alive):
            best.add(score[alive], null[alive + base], ids[alive + base])
    return scored


def weight(n: int, df: int) -> int:
    """A term's weight: floor(1000 ln((2 n + 2) / (2 df + 1)))."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _best_of(index: DataFrame, asked: list, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """asked(item, term, times, df) rows of a bounded number of queries -> (item, doc_id, score): each task's k best."""
    terms = np.array(sorted({r.term for r in asked}), dtype=np.int64)
    spot = {t: i for i, t in enumerate(terms.tolist())}
    weights = np.zeros(len(terms), dtype=np.int64)
    queries: dict[int, list[tuple[int, int]]] = {}
    for r in asked:
        weights[spot[r.term]] = weight(n_docs, r.df)
        queries.setdefault(r.item, []).append((spot[r.term], r.times))
    held = index.sparkSession.sparkContext.broadcast((terms, weights, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weights, queries = held.value
        best = {q: Best(k) for q in queries}
        for batch in batches:
            for row in range(batch.num_rows):
                docs, n, own, sizes, at, tf = (batch.column(c)[row].values for c in range(6))
                null, ids = np.asarray(docs.is_null()).astype(np.int64), np.asarray(docs.fill_null(0))
                n, own, sizes, at, tf = map(np.asarray, (n, own, sizes, at, tf))
                m = 75 + 25 * n * n_docs // n_terms
                ends = np.cumsum(sizes)
                own_order = np.argsort(own, kind="stable")  # terms ascend as unsigned numbers
                place = np.minimum(np.searchsorted(own, terms, sorter=own_order), max(len(own) - 1, 0))
                place = own_order[place] if len(own) else place
                there = own[place] == terms if len(own) else np.zeros(len(terms), dtype=bool)
                lists: dict[int, Postings] = {}
                for i in np.flatnonzero(there).tolist():
                    a, b = ends[place[i]] - sizes[place[i]], ends[place[i]]
                    adds = weights[i] * (1_000_000_000 * tf[a:b] // (1000 * tf[a:b] + 12 * m[at[a:b]]))
                    lists[i] = Postings(at[a:b], adds, int(adds.max()))
                for q, wanted in queries.items():
                    found = [(x if times == 1 else Postings(x.at, x.adds * times, x.bound * times)) for i, times in wanted if (x := lists.get(i))]
                    few = [x for x in found if len(x.at) * SHORT <= len(ids)]
                    found = [*summed(few), *(x for x in found if len(x.at) * SHORT > len(ids))]
                    if found:
                        walk(found, len(ids), best[q], null, ids)
        for q, x in best.items():
            if len(x.score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x.score), q)), pa.array(x.id, mask=x.null > 0), pa.array(x.score)], names=["item", "doc_id", "score"])

    return map_texts(index, run, "item long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> item_id, rank (from 1), doc_id, score: each item's k best documents of score above 0.

    Terms are runs of ASCII letters, ASCII digits and all other non-ASCII characters, A-Z lower-cased, told apart by 64-bit hashes. A term of weight w
    adds w * (10**9 tf div (1000 tf + 12 m)) for each of its places in the item, m = 75 + 25 n N div L. Null and empty texts have no terms, match nothing and
    don't count. Ties go to lower doc_ids, null ones last; repeated documents are documents, repeated items (equal id and text) are one. Fewer
    documents: all. Empty tables give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    items = spool(items.select("item_id", "text").distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    asked = spool(terms_of(items.select("item", "text"), "item"), "terms")
    index = spool(search_index(docs, asked.select("term").distinct()), "segments")
    total = index.agg(F.sum(F.size("docs")).alias("docs"), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, b: a + b)).alias("terms")).first()
    lists = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.sizes").alias("df"))
    known = spool(asked.join(lists.groupBy("term").agg(F.sum("df").alias("df")), "term"), "asked")
    size = known.agg(F.count(F.lit(1)).alias("terms"), F.count_distinct("item").alias("items")).first()
    blocks = max(1, -(-size.items // QUERIES), -(-size.terms // TERMS))
    found = None
    for block in range(blocks if size.terms else 0):  # the stated queries in blocks of a bounded size
        own = known.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()
        if own:
            best = _best_of(index, own, int(total.docs), int(total.terms), k)
            found = best if found is None else found.unionAll(best)
    if found is None:
        kind = items.schema["item_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    found = found.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(GROUPS_OF_TASKS)))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "_part").orderBy(*order))).where(F.col("rank") <= k)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return found.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op11_ranked(spark, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score of each benchmark item's 20 best documents."""
    return ranked_search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
