"""Mixing sources to target weights, in blocks of words.

Each source's words, its documents one after the other, are cut into blocks of fixed length, and a source's target gives its
number of slots. Output shards have equally many slots; how many of them each source has in a shard is a multinomial
draw, given that the draws of all shards add up to the sources' slots. (Such a draw is a multivariate hypergeometric one; halving the
shards again and again lets any task draw its own shards.) The k-th slot of a source takes the block that a keyed
pseudorandom permutation of the source's block numbers gives for k; after each pass over all blocks a new permutation
begins, so no block is taken twice more often than another. The last slot is cut short where the target ends. Slots
and blocks meet in an equi-join on (source, block).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, running_start, spool, table
from .text_hash import SPACED, mixed, slices

BLOCK_WORDS = 64
#: Slots of an output shard on average.
SHARD_SLOTS = 8192


def word_counts(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """docs plus size long, the number of `[^\\x20\\x09-\\x0D]+` in text; null texts have 0. The text itself is dropped unless kept."""
    kept = [c for c in docs.columns if (c != "text" or keep_text) and c != "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(t.translate(SPACED).split()) for _, run in slices(batch.column("text")) for t in run]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sizes, pa.int64())], names=[*kept, "size"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return map_texts(docs.select(*dict.fromkeys([*kept, "text"])), run, f"{fields}, size bigint")


def targets(sources: pd.DataFrame, weights: list[float], share: float, most_epochs: float) -> pd.DataFrame:
    """sources(source, size) -> the same in order of code points, null last, with weight and target.

    Weights repeat in that order and share `share` of all sizes. A target above `most_epochs` times its source's size
    stops there and the excess is shared again among the others by weight, until none is above.
    """
    named = sources[sources["source"].notna()]
    ordered = pd.concat([named.loc[sorted(named.index, key=lambda i: named.at[i, "source"])], sources[sources["source"].isna()]]).reset_index(drop=True)
    ordered["weight"] = [float(weights[i % len(weights)]) for i in range(len(ordered))]
    most = ordered["size"].to_numpy(dtype=float) * most_epochs
    total, w = share * float(ordered["size"].sum()), ordered["weight"].to_numpy()
    target, full = np.zeros(len(ordered)), np.zeros(len(ordered), dtype=bool)
    while not full.all():
        rest = total - most[full].sum()
        target = np.where(full, most, rest * w / w[~full].sum())
        over = ~full & (target > most)
        if not over.any():
            break
        full |= over
    else:
        target = most
    ordered["target"] = target
    return ordered


def permuted(k: np.ndarray, n: np.ndarray, key: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Images (or originals) of k under keyed pseudorandom permutations of 0 to n - 1: Feistel rounds with cycle walking."""
    k, n, key = (np.asarray(x).astype(np.uint64) for x in (k, n, key))
    half = np.zeros(len(k), dtype=np.uint64)
    while (short := (np.uint64(1) << (half * np.uint64(2))) < n).any():
        half += short.astype(np.uint64)
    mask, out, todo = (np.uint64(1) << half) - np.uint64(1), k.copy(), n > 1

    def scrambled(x: np.ndarray, r: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed(x + key[todo] + np.uint64(r + 1) * np.uint64(0x9E3779B97F4A7C15)) & mask[todo]

    while todo.any():
        left, right = out[todo] >> half[todo], out[todo] & mask[todo]
        for r in range(3, -1, -1) if inverse else range(4):
            left, right = (right ^ scrambled(left, r), left) if inverse else (right, left ^ scrambled(right, r))
        out[todo] = (left << half[todo]) | right
        todo &= out >= n
    return out.astype(np.int64)


def pass_key(code: np.ndarray, epoch: np.ndarray, seed: int) -> np.ndarray:
    return mixed((code.astype(np.uint64) << np.uint64(32)) + epoch.astype(np.uint64) + np.uint64(seed))


def words_before(code: np.ndarray, k: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Words that a source's slots before the k-th hold. Only the last block of a source is short."""
    n = -(-size // BLOCK_WORDS)
    epoch, at, last = k // n, k % n, size - (n - 1) * BLOCK_WORDS
    short_at = permuted(n - 1, n, pass_key(code, epoch, seed), inverse=True)
    return k * BLOCK_WORDS - (BLOCK_WORDS - last) * (epoch + (short_at < at))


def slot_blocks(code: np.ndarray, k: np.ndarray, size: np.ndarray, words: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(block of the k-th slot of a source, words of it that the slot takes)."""
    n = -(-size // BLOCK_WORDS)
    block = permuted(k % n, n, pass_key(code, k // n, seed))
    last = size - (n - 1) * BLOCK_WORDS
    return block, np.clip(words - words_before(code, k, size, seed), 0, np.where(block == n - 1, last, BLOCK_WORDS))


def slots_of(code: int, size: int, words: int, seed: int) -> int:
    """How many slots a source needs for its target of `words`."""
    if not words:
        return 0
    one = lambda x: np.array([x], dtype=np.int64)
    low, high = 1, -(-words // BLOCK_WORDS) + words // size + 2  # the least number of slots that hold the target
    while low < high:
        half = (low + high) // 2
        if words_before(one(code), one(half), one(size), seed)[0] >= words:
            high = half
        else:
            low = half + 1
    return low


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of `sample` draws without return are good, by one law at every size: numpy's generator stops at a thousand million, beyond it the law is inverted."""
    total = good + bad
    if total < 10**9:
        return int(rng.hypergeometric(good, bad, sample))
    return hypergeometric_quantile(rng.random(), good, bad, sample)


def hypergeometric_quantile(u: float, good: int, bad: int, sample: int) -> int:
    """The inverse of the hypergeometric law: chances over the mode's, by ratios of neighbours, out to where they can't count."""
    low, high = max(0, sample - bad), min(sample, good)
    mode = min(high, max(low, (sample + 1) * (good + 1) // (good + bad + 2)))

    def tail(step: int) -> np.ndarray:
        """Chances of mode + step, mode + 2 step, ... over the mode's, until the rest is nothing."""
        out, at, logs = [np.zeros(0)], mode, np.zeros(1)
        while logs[-1] > -60:
            k = np.arange(at, at + step * (1 << 16), step)
            k = k[(k < high) if step > 0 else (k > low)].astype(np.float64)
            if not len(k):
                break
            if step > 0:
                ratio = (good - k) * (sample - k) / ((k + 1) * (bad - sample + k + 1))
            else:
                ratio = k * (bad - sample + k) / ((good - k + 1) * (sample - k + 1))
            logs = logs[-1] + np.cumsum(np.log(ratio))
            out.append(np.exp(logs))
            at += step * len(k)
        return np.concatenate(out)

    below, above = tail(-1), tail(1)
    chances = np.concatenate([below[::-1], [1.0], above])
    sums = np.cumsum(chances)
    return int(mode - len(below) + min(np.searchsorted(sums, u * sums[-1], side="right"), len(chances) - 1))


class ShardDraws:
    """The sources' slots in each output shard of `length` slots (the last has the rest)."""

    def __init__(self, slots: list[int], length: int, seed: int):
        self.slots, self.length, self.seed = slots, length, seed
        self.total = sum(slots)
        self.shards = -(-self.total // length)
        self.halves: dict[tuple[int, int], list[int]] = {}

    def _first_half(self, low: int, half: int, high: int, counts: list[int]) -> list[int]:
        """What shards low to half have of the `counts` of shards low to high."""
        if (low, high) not in self.halves:
            if len(self.halves) > 4096:
                self.halves.clear()
            rng, out = np.random.default_rng([self.seed, low, high]), []
            left, rest = (half - low) * self.length, sum(counts)
            for n in counts:
                out.append(hypergeometric(rng, n, rest - n, left))
                left, rest = left - out[-1], rest - n
            self.halves[low, high] = out
        return self.halves[low, high]

    def shard(self, number: int) -> tuple[list[int], list[int]]:
        """(first slot of each source in the shard, slots of each source in it)."""
        low, high, first, counts = 0, self.shards, [0] * len(self.slots), self.slots
        while high - low > 1:
            half = (low + high) // 2
            lower = self._first_half(low, half, high, counts)
            if number < half:
                counts, high = lower, half
            else:
                first, counts, low = [a + b for a, b in zip(first, lower)], [a - b for a, b in zip(counts, lower)], half
        return first, counts


def _sources(rows: DataFrame, weights: list[float], share: float, most_epochs: float, seed: int) -> list[tuple]:
    """(code, source, size, target, words, slots) of each source, a line each on the driver."""
    known = targets(rows.groupBy("source").agg(F.sum("size").alias("size")).toPandas(), weights, share, most_epochs)
    lines = []
    for i, (name, size, target) in enumerate(zip(known["source"], known["size"], known["target"])):
        words = round(float(target))
        lines.append((i, None if pd.isna(name) else name, int(size), float(target), words, slots_of(i, int(size), words, seed)))
    return lines


def drawn_slots(spark: SparkSession, lines: list[tuple], shard_slots: int, seed: int) -> DataFrame:
    """(shard, slot, code, block, take): what every slot of every output shard takes. A shard's sources are mixed by a permutation of its slots."""
    draws = ShardDraws([x[5] for x in lines], shard_slots, seed)
    size, words = (np.array([x[i] for x in lines], dtype=np.int64) for i in (2, 4))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"].tolist():
                first, counts = (np.array(x, dtype=np.int64) for x in draws.shard(shard))
                n = int(counts.sum())
                code = np.repeat(np.arange(len(counts)), counts)
                k = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts) + first[code]
                block, take = slot_blocks(code, k, size[code], words[code], seed)
                slot = permuted(np.arange(n), np.full(n, n), pass_key(np.full(n, len(counts)), np.full(n, shard), seed))
                yield pd.DataFrame({"shard": np.full(n, shard), "slot": slot, "code": code.astype(np.int32), "block": block, "take": take})

    # Shards are dealt out before their slots are unrolled.
    parts = min(max(1, draws.shards), max(spark.sparkContext.defaultParallelism, -(-draws.shards // 64)))
    return spark.range(0, draws.shards, 1, parts).mapInPandas(run, "shard long, slot long, code int, block long, take long")


def _placed(rows: DataFrame, lines: list[tuple], seed: int) -> DataFrame:
    """rows with code, source_size, target and start, the word of its source at which each row begins."""
    sources = rows.sparkSession.createDataFrame([x[:4] for x in lines], "code int, source string, source_size long, target double")
    coded = rows.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.*", "code", "source_size", "target")
    return spool(running_start(coded, ["code"], "size", [F.col("doc_id"), F.col("size")], F.xxhash64(F.lit(seed), "doc_id", "size")), "placed")


def _pieces(placed: DataFrame) -> DataFrame:
    """What each row has of each block of its source: words lo to hi of it."""
    end, edge = F.col("start") + F.col("size"), F.col("block") * BLOCK_WORDS
    pieces = placed.where("size > 0").select("code", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / BLOCK_WORDS), F.floor((end - 1) / BLOCK_WORDS))).alias("block"))
    return pieces.select("code", "block", "start", (F.greatest("start", edge) - edge).alias("lo"), (F.least(end, edge + BLOCK_WORDS) - edge).alias("hi"))


def mix_sources(docs: DataFrame, weights: list[float], share: float = 1.0, most_epochs: float = 3.0, shard_slots: int = SHARD_SLOTS, seed: int = 7) -> DataFrame:
    """docs(doc_id, source, text, ...) -> its columns but text, with size, source_size, target, start and taken of each row.

    taken counts the words that the mix takes, first_shard and last_shard name the output shards between which they are (null
    where none is taken), start is the row's first word in its source. taken sums to the rounded target in each source and is at most
    ceil(most_epochs) times a row's size. Null sources are one source, texts of no words take nothing, repeated rows are
    rows. Reruns agree: order in a source is by a hash of doc_id and size. An empty table gives an empty result. Sources
    are few (a line each on the driver).
    """
    rows = spool(word_counts(docs), "sizes")
    lines = _sources(rows, weights, share, most_epochs, seed)
    placed = _placed(rows, lines, seed)
    slots = drawn_slots(docs.sparkSession, lines, shard_slots, seed)
    # Spark can't foresee how many rows the slots unroll to and would broadcast them, so the join is a merge by hint.
    met = _pieces(placed).join(slots.hint("merge"), ["code", "block"]).where("take > lo")
    got = met.groupBy("code", "start").agg(F.sum(F.least("hi", "take") - F.col("lo")).alias("got"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"))
    same = (F.col("p.code") == F.col("g.code")) & (F.col("p.start") == F.col("g.start")) & (F.col("p.size") > 0)
    own = ("size", "source_size", "target", "start", "taken", "first_shard", "last_shard")
    kept = [f"p.`{c}`" for c in docs.columns if c not in ("text", *own)]
    return placed.alias("p").join(got.alias("g"), same, "left").select(*kept, "p.size", "p.source_size", "p.target", "p.start", F.coalesce("g.got", F.lit(0)).cast("long").alias("taken"), "g.first_shard", "g.last_shard")


def mixed_blocks(docs: DataFrame, weights: list[float], share: float = 1.0, most_epochs: float = 3.0, shard_slots: int = SHARD_SLOTS, seed: int = 7) -> DataFrame:
    """docs(doc_id, source, text) -> shard, slot, source, text: the mix itself, a row for each slot of each output shard.

    text has the slot's words, joined by spaces. What mix_sources counts is what these rows hold.
    """
    rows = spool(word_counts(docs.select("doc_id", "source", "text"), keep_text=True), "sizes")
    lines = _sources(rows, weights, share, most_epochs, seed)
    placed = _placed(rows, lines, seed).where("size > 0")
    words = F.filter(F.split("text", "[ \t-\r]+"), lambda w: w != "")
    edge = F.col("block") * BLOCK_WORDS
    blocks = placed.select("code", "start", "size", words.alias("words"), F.explode(F.sequence(F.floor(F.col("start") / BLOCK_WORDS), F.floor((F.col("start") + F.col("size") - 1) / BLOCK_WORDS))).alias("block"))
    lo = F.greatest("start", edge)
    parts = blocks.select("code", "block", F.struct((lo - edge).alias("lo"), F.slice("words", (lo - F.col("start") + 1).cast("int"), (F.least(F.col("start") + F.col("size"), edge + BLOCK_WORDS) - lo).cast("int")).alias("words")).alias("part"))
    whole = parts.groupBy("code", "block").agg(F.flatten(F.transform(F.sort_array(F.collect_list("part")), lambda p: p["words"])).alias("words"))
    slots = drawn_slots(docs.sparkSession, lines, shard_slots, seed)
    names = docs.sparkSession.createDataFrame([x[:2] for x in lines], "code int, source string")
    return whole.join(slots.hint("merge"), ["code", "block"]).join(names, "code").select("shard", "slot", "source", F.concat_ws(" ", F.slice("words", F.lit(1), F.col("take").cast("int"))).alias("text"))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs, [5.0, 2.0, 1.0]).select("doc_id", "size", "source_size", "target", "taken", "source", "first_shard", "last_shard")
