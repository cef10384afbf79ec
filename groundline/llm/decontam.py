"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words.

1. One scan of the texts keeps the runs of two to four words (by the item's length) whose hash passes a bitmap of all those of the benchmark. The bitmap has a
   fixed size, so it is broadcast whatever the benchmark's size; what wrongly passes falls out in the equi-join.
2. Every run of words that a text shares with an item is a seed, however many texts hold it.
3. Each text is aligned with each such item around its seeds' diagonals. A text is contaminated where the best
   local alignment scores at least `threshold` of the item's words (match 1, mismatch and gap -1). Windows that hold
   fewer of the item's words than that can't score it and are not aligned.

The work depends on the text alone, so texts are keyed by a digest and exact copies are scored once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, spool, table
from .text_hash import grams, slices, word_hashes

THRESHOLD = 0.6
#: Words of a seed for items of at least so many words. Of an item of n words with e of them changed n - 1 - (e + 1) (k - 1) - e k-grams or more are left
#: whole, and at the threshold e is a fifth of n at most, so an edited copy that scores it shares a seed.
SEED_WORDS = {20: 4, 8: 3, 3: 2, 1: 1}
#: The bitmap's size: 2**BITS bits, 2 MB, for two probes a hash.
BITS = 24


def seed_words(words: np.ndarray) -> np.ndarray:
    """The length of the seeds of items with so many words."""
    return np.select([words >= least for least in SEED_WORDS], list(SEED_WORDS.values()), 0)


def text_grams(rows: DataFrame, key: str) -> DataFrame:
    """rows(key, text) -> (key, gram, at, n): hashes of the runs of n lower-cased words of each text (n by `seed_words`) and their first word."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(pc.utf8_lower(batch.column(1))):
                words, text, *_ = word_hashes(texts)
                begin = np.searchsorted(text, np.arange(len(texts) + 1))
                length = seed_words(np.diff(begin))
                found = [(np.zeros(0, dtype=np.uint64), *[np.zeros(0, dtype=np.int64)] * 3)]
                for n in sorted(set(SEED_WORDS.values())):
                    gram, whole = grams(words, text, n)
                    at = np.flatnonzero(whole & (length[text[: len(gram)]] == n))
                    found.append((gram[at], text[at], at - begin[text[at]], np.full(len(at), n)))
                h, own, place, n = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + own)), pa.array(h.view(np.int64)), pa.array(place, pa.int32()), pa.array(n, pa.int32())], names=["key", "gram", "at", "n"])

    return map_texts(rows.select(key, "text"), run, f"key {kind}, gram bigint, at int, n int")


def bitmap(grams_: DataFrame) -> np.ndarray:
    """2**BITS bits in which each gram has set two; aggregated on Spark, of one size always."""
    # Spark numbers a bitmap's bits from 1.
    bits = F.explode(F.array(*[F.shiftrightunsigned("gram", by).bitwiseAND(F.lit((1 << BITS) - 1).cast("long")) + 1 for by in (0, 64 - BITS)])).alias("bit")
    parts = grams_.select(bits).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    out = np.zeros(1 << (BITS - 3), dtype=np.uint8)
    for p in parts:
        b = np.frombuffer(bytes(p.bits), dtype=np.uint8)
        out[(p.bucket - 1) * len(b) :][: len(b)] = b
    return out


def in_bitmap(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes a bitmap lets through."""
    ok = np.ones(len(h), dtype=bool)
    for by in (0, 64 - BITS):
        b = (h >> np.uint64(by)) & np.uint64((1 << BITS) - 1)
        ok &= (bits[(b >> np.uint64(3)).astype(np.int64)] >> (b & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return ok


def scan(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs(digest, text) -> (digest, text, hits array<struct<gram, at>>) of the texts with any benchmark n-gram, or nearly so."""
    held = docs.sparkSession.sparkContext.broadcast(bitmap(items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value

        for batch in batches:
            for first, texts in slices(pc.utf8_lower(batch.column(1))):
                words, text, *_ = word_hashes(texts)
                begin = np.searchsorted(text, np.arange(len(texts) + 1))
                found = []
                for n in lengths:
                    gram, whole = grams(words, text, n)
                    at = np.flatnonzero(whole & in_bitmap(bits, gram)) if len(gram) else np.zeros(0, dtype=np.int64)
                    found.append((text[at], gram[at], at - begin[text[at]]))
                own, gram, at = (np.concatenate(x) for x in zip(*found))
                order = np.argsort(own, kind="stable")
                own, gram, at = own[order], gram[order], at[order]
                rows, starts = np.unique(own, return_index=True)
                if not len(rows):
                    continue
                hits = pa.ListArray.from_arrays(pa.array(np.append(starts, len(own)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(gram.view(np.int64)), pa.array(at, pa.int32())], names=["gram", "at"]))
                take = pa.array(first + rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), hits], names=["digest", "text", "hits"])

    lengths = sorted(r.n for r in items.select("n").distinct().collect())  # four at most
    if not lengths:
        return docs.sparkSession.createDataFrame([], "digest binary, text string, hits array<struct<gram: bigint, at: int>>")
    return map_texts(docs.select("digest", "text"), run, "digest binary, text string, hits array<struct<gram: bigint, at: int>>")


def local_alignment(a: np.ndarray, b: np.ndarray) -> int:
    """Best Smith-Waterman score of two word sequences (match 1, mismatch and gap -1), a row of the matrix at a time."""
    best, row, steps = 0, np.zeros(len(b) + 1, dtype=np.int64), np.arange(len(b) + 1)
    for x in a:
        new = np.zeros_like(row)
        new[1:] = np.maximum(0, np.maximum(row[:-1] + np.where(b == x, 1, -1), row[1:] - 1))
        new = np.maximum.accumulate(new + steps) - steps  # gaps along the row
        row = np.maximum(new, 0)
        best = max(best, int(row.max()))
    return best


def align(pairs: DataFrame, threshold: float) -> DataFrame:
    """pairs(digest, text, item_id, item, at array<int> of diagonals) -> (digest, item_id, score): share of the item's words.

    The score is 0 where no window holds `threshold` of the item's words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            scores = []
            for text, item, diagonals in zip(*(x.column(c).to_pylist() for c in ("text", "item", "at"))):
                a, b = (word_hashes([t.as_py().encode()])[0] for t in pc.utf8_lower(pa.array([text, item])))
                # Seeds within an item's length of each other share a window of the text.
                best, end, spans = 0, None, []
                for d in sorted(diagonals):
                    lo, hi = max(0, d - len(b)), d + 2 * len(b)
                    if end is not None and lo <= end:
                        spans[-1][1] = end = hi
                    else:
                        spans.append([lo, end := hi])
                for lo, hi in spans:
                    if np.isin(b, a[lo:hi]).sum() < threshold * len(b) - 1e-9:  # an alignment matches each word once at most
                        continue
                    best = max(best, local_alignment(b, a[lo:hi]))
                scores.append(best / len(b))
            # Ids pass as they are: in pandas a null would turn the others into doubles.
            yield pa.RecordBatch.from_arrays([x.column("digest"), x.column("item_id"), pa.array(scores, pa.float64())], names=["digest", "item_id", "score"])

    return map_texts(pairs.select("digest", "text", "item_id", "item", "at"), run, f"digest binary, item_id {pairs.schema['item_id'].dataType.simpleString()}, score double")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(digest, item_id, score) of each distinct text of docs(text) and benchmark item (item_id, text) that align well.

    digest is the SHA-256 of the text. Texts and items that are null or have no word match nothing; repeated items are
    items, repeated item_ids each count; null item_ids are kept. An empty table on either side gives an empty result.
    """
    items = benchmark.where("text is not null").select("item_id", F.col("text").alias("item"), F.sha2("text", 256).alias("item_key")).dropDuplicates(["item_id", "item_key"])
    items = spool(items, "items")
    index = spool(text_grams(items.select("item_key", F.col("item").alias("text")).dropDuplicates(["item_key"]), "item_key"), "grams")
    keyed = docs.where("text is not null").select(F.unhex(F.sha2("text", 256)).alias("digest"), "text")
    hits = spool(scan(keyed, index), "hits")
    flat = hits.select("digest", F.explode("hits").alias("h")).select("digest", "h.gram", "h.at").distinct()
    pairs = flat.alias("h").join(index.alias("i"), "gram").select("digest", F.col("i.key").alias("item_key"), (F.col("h.at") - F.col("i.at")).alias("diagonal"))
    pairs = spool(pairs, "pairs")
    seeds = pairs.groupBy("digest", "item_key").agg(F.collect_set("diagonal").alias("at"))
    texts = hits.select("digest", "text").dropDuplicates(["digest"])
    joined = seeds.join(items, "item_key").join(texts, "digest").select("digest", "text", "item_id", "item", "at")
    return align(joined, threshold).where(F.col("score") >= threshold)


def op10_decontam(spark, sf_dir: str) -> DataFrame:
    """doc_id, item_id, score of every document and benchmark item that it holds a copy or edited copy of."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    ids = docs.where("text is not null").select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))
    return ids.join(found, "digest").select("doc_id", "item_id", F.round("score", 6).alias("score")).distinct()
