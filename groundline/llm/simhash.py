"""SimHash near-duplicate groups by multi-index hashing.

A fingerprint of `64 * words` bits is cut into segments. Two fingerprints that differ in at most
`segments * (radius + 1) - 1` bits have a segment within `radius`, so looking up every value of the
small Hamming ball (radius 0 or 1) around each segment in the table of segments finds all of them;
complete distances are then verified. For larger distances the same search finds most links.

Equal fingerprints are one row from the start, and the table's side is packed into blocks: rows that
share a segment value. Each block is joined up inside itself first, and a lookup then links to each
joined part of a block once. A group of thousands of near copies so gives links in proportion to its
rows, not to its pairs, and yet no group is left unjoined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_size, map_texts, merging, spool
from .components import connected_components
from .decontam import bitmap, in_bitmap
from .text_hash import SPACED, grams, mixed, powers, slices, word_hashes

#: Rows of a segment value that one block holds at most; a hotter value has more blocks.
BLOCK = 1024


def shingles(text: bytes, n: int) -> list[bytes]:
    """Space-joined runs of n words, repeats included; fewer words: the whole sequence; none: no shingle."""
    words = text.translate(SPACED).split(b" ")
    joined = b" ".join(w for w in words if w)
    if not joined:
        return []
    space = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    if len(space) < n:
        return [joined]
    starts = [0, *(space[: len(space) - n + 2] + 1).tolist()]
    ends = [*space[n - 1 :].tolist(), len(joined)]
    return [joined[a:b] for a, b in zip(starts, ends)]


def shingle_hashes(text: bytes, n: int) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.array([h(s, 42) for s in shingles(text, n)], dtype="<u8")


def fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """`words` 64-bit words; bit i is set where over half of the hashes have it. Words after the first use remixed hashes."""
    out = np.zeros(words, dtype="<u8")
    for k in range(words if len(hashes) else 0):
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(hashes), 1 << 14):
            h = np.ascontiguousarray(hashes[at : at + (1 << 14)])
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0]
        hashes = mixed(hashes + np.uint64(0x9E3779B97F4A7C15))
    return out


def fingerprints(docs: DataFrame, key: str, shingle: int, words: int) -> DataFrame:
    """(key, fp array<long>) for each row of docs(key, text); null and empty texts have fingerprint zero."""
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [fingerprint(shingle_hashes(x.as_py() or b"", shingle), words) for x in batch.column(1).cast(pa.large_binary())]
            flat = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, dtype=np.int64)
            at = pa.array(np.arange(0, len(flat) + 1, words, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, pa.array(flat))], names=["key", "fp"])

    return map_texts(docs.select(key, "text"), run, f"key {key_type}, fp array<bigint>")


def _slots(prints: DataFrame, words: int, segments: int, radius: int) -> DataFrame:
    """prints with slot and check: a row for each segment and each value within `radius` bits of it, tagged by the segment's number.

    check is a word of the fingerprint in which the segment isn't (the only one, where there is one).
    Each 64-bit word is cut into segments / words parts. What differs from row to row is a folded constant, so that the generated
    code stays small.
    """
    per = segments // words
    cuts = [round(64 * i / per) for i in range(per + 1)]
    looks = [(w, a, b - a, w * per + i, flip) for w in range(words) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) for flip in [0, *(1 << bit for bit in range(b - a) if radius)]]
    long = lambda x: F.lit(x).cast("long")
    constant = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(a).alias("a"), long((1 << bits) - 1).alias("mask"), long(number << 40).alias("tag"), long(flip).alias("flip")) for w, a, bits, number, flip in looks])
    value = F.call_function("shiftrightunsigned", F.get("fp", F.col("_s.w")), F.col("_s.a")).bitwiseAND(F.col("_s.mask")).bitwiseXOR(F.col("_s.flip"))
    return prints.select("*", F.explode(constant).alias("_s")).withColumns({"slot": F.col("_s.tag") + value, "check": F.get("fp", (F.col("_s.w") + 1) % words)}).drop("_s")


def distance(a: Column, b: Column, words: int) -> Column:
    return sum((F.bit_count(a[w].bitwiseXOR(b[w])) for w in range(words)), F.lit(0))


def _join_blocks(blocks: DataFrame, words: int, most: int) -> DataFrame:
    """(slot, fps, ids, parts): parts[i] is the least id that i is joined to by links inside its own block."""

    def parts_of(fps: np.ndarray, ids: np.ndarray) -> np.ndarray:
        root = np.arange(len(ids))
        near = np.zeros((len(ids), len(ids)), dtype=np.int64)
        for w in range(words):
            near += np.bitwise_count(fps[:, None, w] ^ fps[None, :, w])
        near = near <= most
        while True:  # least label among neighbours, then labels of labels
            low = np.where(near, root[None, :], len(ids)).min(1)
            low = low[low]
            if (low == root).all():
                return ids[root]
            root = low

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = batch.column(2), []
            flat = np.asarray(batch.column(1).flatten().flatten()).view(np.uint64).reshape(-1, words)
            sizes = np.asarray(ids.value_lengths())
            at = 0
            all_ids = np.asarray(ids.flatten())
            for n in sizes.tolist():
                own = all_ids[at : at + n]
                if n > 1:
                    order = np.argsort(own, kind="stable")
                    back = np.empty(n, dtype=np.int64)
                    back[order] = parts_of(flat[at : at + n][order], own[order])
                    own = back
                parts.append(own)
                at += n
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            flat_parts = pa.array(np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids, pa.ListArray.from_arrays(offsets, flat_parts)], names=["slot", "fps", "ids", "parts"])

    return blocks.select("slot", "fps", "ids").mapInArrow(run, "slot bigint, fps array<array<bigint>>, ids array<bigint>, parts array<bigint>")


def _blocks(prints: DataFrame, words: int, segments: int) -> DataFrame:
    """(slot, fps, ids): fingerprints that share a segment value, in blocks dealt by a hash so that none outgrows memory."""
    rows = _slots(prints.select("id", "fp"), words, segments, 0)
    counts = rows.groupBy("slot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("n")).where("n > 1")
    salted = rows.join(counts, "slot", "left").withColumn("salt", F.when(F.col("n") > 1, F.pmod(F.xxhash64("id"), F.col("n"))).otherwise(F.lit(0)))
    grouped = salted.groupBy("slot", "salt").agg(F.collect_list(F.struct("fp", "id")).alias("rows"))
    return grouped.select("slot", F.col("rows.fp").alias("fps"), F.col("rows.id").alias("ids"))


def near_links(prints: DataFrame, words: int, segments: int, radius: int, most: int) -> DataFrame:
    """prints(id, fp), distinct -> links (a, b) whose components are those of all found pairs within `most` bits."""
    if radius not in (0, 1) or segments % words:
        raise ValueError("radius is 0 or 1, and each 64-bit word has equally many segments")
    blocks = spool(_join_blocks(_blocks(prints, words, segments), words, most), "blocks")
    inside = blocks.where(F.size("ids") > 1).select(F.explode(F.arrays_zip("ids", "parts")).alias("x")).select(F.col("x.ids").alias("a"), F.col("x.parts").alias("b")).where("a != b")
    probes = merging(_slots(prints.select("id", "fp"), words, segments, radius))
    # Complete distances are verified in the join's own condition, so that only blocks with a near fingerprint come out.
    near = lambda x: (distance(x["fps"], F.col("p.fp"), words) <= most) & (x["parts"] != F.col("p.id"))
    entries = F.arrays_zip("t.fps", "t.parts")
    found = probes.alias("p").join(blocks.alias("t"), (F.col("p.slot") == F.col("t.slot")) & F.exists(entries, near))
    # What a fingerprint's probes find hangs on the least part of all, the other parts too: links of parts repeat from one fingerprint to the next, a
    # link of each fingerprint with each part it finds would not. There are some parts for each of its slots' blocks.
    each = found.select(F.col("p.id").alias("id"), F.explode(F.array_distinct(F.transform(F.filter(entries, near), lambda x: x["parts"]))).alias("part"))
    parts = each.groupBy("id").agg(F.array_sort(F.collect_set("part")).alias("parts"))
    link = F.transform("parts", lambda x: F.struct(F.when(x == F.get("parts", F.lit(0)), F.col("id")).otherwise(x).alias("a"), F.get("parts", F.lit(0)).alias("b")))
    return inside.unionAll(parts.select(F.inline(link)).distinct())


def simhash_groups(docs: DataFrame, key: str = "doc_id", shingle: int = 4, words: int = 1, segments: int = 3, radius: int = 1, most_bits: int = 4) -> DataFrame:
    """One row per row of docs(key, text): key, fp array<long>, component (least key reachable by links of near fingerprints).

    Lower-cases A-Z, splits at ASCII white space, hashes each `shingle` of words with XXH64 (seed 42). Null, empty and
    blank texts have fingerprint zero and link like any other. Rows of equal texts, repeated rows and rows whose key is
    null stay apart as rows but share a fingerprint; null keys never name a component unless no other key is in it.
    An empty table gives an empty result; other columns are ignored.
    """
    prints = spool(fingerprints(docs, key, shingle, words), "prints")
    distinct = prints.groupBy("fp").agg(F.min("key").alias("least"))
    # A fingerprint of one word is its own id; longer ones get a hash of 64 bits.
    distinct = spool(distinct.select(F.col("fp")[0].alias("id") if words == 1 else F.xxhash64("fp").alias("id"), "fp", "least"), "distinct")
    roots = connected_components(near_links(distinct, words, segments, radius, most_bits))
    distinct = by_size(distinct)
    named = distinct.join(roots, distinct.id == roots.node, "left").select("fp", "least", F.coalesce("root", "id").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    labels = named.join(least, "root").select("fp", "component")
    return merging(prints).join(labels, "fp").select(F.col("key").alias(key), "fp", "component")


#: Of the shingles of about SAMPLED texts the most frequent, at most HOT, come last in the order of shingles. Any order
#: finds the same pairs; this one keeps common lines out of the blocks.
SAMPLED, HOT = 4000, 1 << 15
#: Entries of a shared shingle prefer one of as many centres. Classes of a text's parities that go with each of its entries at most.
CENTRES, SMALL = 4, 2048
#: Shingles of all entries in a tile, about; pairs that a cell may give for each of its entries before it gives these entries.
SHINGLES, PAIRS = 1 << 21, 2
#: Segments of the 64 bits of a set's fingerprint, and the radius around each that is looked up: finds all that differ in at most NEAR_BITS.
NEAR_SEGMENTS, NEAR_RADIUS, NEAR_BITS = 3, 1, 5


def shingle_sets_of(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of its text) of the distinct shingles of each text, by text, then hash.

    Fewer than n words: the whole sequence is one shingle. A text without words has the shingle 0, so that such texts are alike.
    """
    words, text, *_ = word_hashes(texts, SPACED)
    count = np.bincount(text, minlength=len(texts))
    first = np.concatenate(([0], np.cumsum(count)))
    h, whole = grams(words, text, n)
    short = np.flatnonzero(count < n)
    rest = []
    for i in short.tolist():
        own = words[first[i] : first[i + 1]]
        with np.errstate(over="ignore"):
            rest.append(mixed((own * powers(_SHORT, len(own) + 1)[1:]).sum(keepdims=True) + np.uint64(len(own)))[0] if len(own) else np.uint64(0))
    h = np.concatenate([h[whole], np.array(rest, dtype=np.uint64)])
    owner = np.concatenate([text[: len(whole)][whole], short])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], owner[new]


_SHORT = np.uint64(0xA24BAED4963EE407)


def _rows_of(values: np.ndarray, owner: np.ndarray, n: int) -> pa.ListArray:
    """A list of values for each of n owners; owners ascend."""
    ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))


def _unseen(batch: pa.RecordBatch, seen: set) -> pa.RecordBatch:
    """The rows whose key (column 0) this task hasn't met: copies are combined before they are shuffled."""
    keep = []
    for key in batch.column(0).to_pylist():
        keep.append(key not in seen)
        seen.add(key)
    return batch.filter(pa.array(keep, pa.bool_()))


def shingle_sets(docs: DataFrame, shingle: int, key: str = "text_key", wanted: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """docs(key, text) -> key, shingles: the distinct shingle hashes of each key's text, a row for each key that a task meets.

    With `wanted`, only of keys (longs) for which it holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            if wanted:
                batch = batch.filter(pa.array(wanted(np.asarray(batch.column(0)))))
            batch = _unseen(batch, seen)
            for first, texts in slices(batch.column(1)):
                h, owner = shingle_sets_of(texts, shingle)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), _rows_of(h, owner, len(texts))], names=[key, "shingles"])

    return map_texts(docs.select(key, "text"), run, f"{key} {docs.schema[key].dataType.simpleString()}, shingles array<bigint>")


def parities(h: np.ndarray, owner: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit words, their number for each owner): which of an owner's classes hold an odd number of its n shingles h. Owners ascend."""
    words = np.maximum(4, 1 << np.ceil(np.log2(np.maximum(4 * n, 1)) - 6 - 1e-9).clip(0).astype(np.int64))
    first = np.cumsum(words) - words
    place = (first * 64)[owner] + (h & (64 * words[owner] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(place, minlength=64 * int(words.sum())) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64), words


def gaps(first: list[np.ndarray], second: list[np.ndarray]) -> np.ndarray:
    """In how many classes the parities of each of the first and each of the second differ; of unequal lengths the longer is folded."""
    words = min(len(x) for x in [*first, *second])

    def folded(rows: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.bitwise_xor.reduce(x.reshape(-1, words), axis=0) for x in rows])

    a, b = folded(first), folded(second)
    return sum(np.bitwise_count(a[:, None, w] ^ b[None, :, w]).astype(np.int32) for w in range(words))


def _prefixes(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """docs(text_key, text), distinct or not -> (id, n, fp, small, bits, prefix), a row for each distinct text.

    n is the number of distinct shingles, fp their SimHash fingerprint. prefix is the first n - ceil(similarity * n) + 1 of them in one order for all
    texts: two texts that are alike share one of these. bits are the parities of the shingles in 4 to 8 classes a shingle
    (a power of two of them, 256 at least): two sets differ in at least as many shingles as their bits differ. small is bits folded to
    SMALL classes; bits are null where there are no more of them.
    """
    every = -(-docs.count() // SAMPLED)
    sample = docs.where(F.pmod(F.xxhash64("text_key"), F.lit(max(1, every))) == 0)
    counted = shingle_sets(sample, shingle).dropDuplicates(["text_key"]).select(F.explode("shingles").alias("h")).groupBy("h").count().where("count >= 4")
    hot = np.array(sorted((r.h, r["count"]) for r in counted.orderBy(F.desc("count"), "h").limit(HOT).collect()), dtype=np.int64).reshape(-1, 2)
    held = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = held.value[:, 0], held.value[:, 1]
        seen: set = set()
        for batch in batches:
            batch = _unseen(batch, seen)
            for first, texts in slices(batch.column(1)):
                h, owner = shingle_sets_of(texts, shingle)
                n = np.bincount(owner, minlength=len(texts))
                bits, sizes = parities(h, owner, n)
                rank = np.zeros(len(h), dtype=np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h.view(np.int64)), len(known) - 1)
                    rank = np.where(known[at] == h.view(np.int64), times[at], 0)
                order = np.lexsort((h.view(np.int64), rank, owner))
                place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
                front = place < (n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1)[owner]
                own = np.split(bits, np.cumsum(sizes)[:-1])
                prints = np.concatenate([fingerprint(x, 1) for x in np.split(h, np.cumsum(n)[:-1])]).view(np.int64)
                small = [np.bitwise_xor.reduce(x.reshape(-1, min(len(x), SMALL // 64)), axis=0) for x in own]
                longs = pa.list_(pa.int64())
                columns = [pa.array(n, pa.int32()), pa.array(prints), pa.array(small, longs), pa.array([x if len(x) > SMALL // 64 else None for x in own], longs), _rows_of(h[order][front], owner[front], len(texts))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), *columns], names=["text_key", "n", "fp", "small", "bits", "prefix"])

    rows = map_texts(docs.select("text_key", "text"), run, "text_key binary, n int, fp bigint, small array<bigint>, bits array<bigint>, prefix array<bigint>")
    return rows.dropDuplicates(["text_key"]).withColumn("id", F.xxhash64("text_key"))


def _shared(texts: DataFrame) -> DataFrame:
    """texts(id, prefix) -> (slot, m, centre, id): the entries of each prefix shingle that m > 1 texts have.

    Counts and centres are partial aggregates, so that no task holds all entries of a shingle. The centre of a slot is its entry that comes
    first in one of CENTRES orders.
    """
    entries = texts.select("id", F.explode("prefix").alias("slot"))
    orders = np.random.default_rng(9).integers(-(2**63), 2**63, CENTRES)
    order = F.get(F.array(*[F.lit(int(x)) for x in orders]), F.pmod("slot", F.lit(CENTRES)).cast("int"))
    slots = entries.groupBy("slot").agg(F.count(F.lit(1)).alias("m"), F.min(F.col("id").bitwiseXOR(order)).alias("least")).where("m > 1")
    slots = spool(slots.select("slot", "m", F.col("least").bitwiseXOR(order).alias("centre")), "slots")
    # A bitmap of fixed size keeps most shingles of one text out of the shuffle; the join is exact.
    held = texts.sparkSession.sparkContext.broadcast(bitmap(slots.select(F.col("slot").alias("gram"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, size = batch.column(1).flatten(), np.asarray(batch.column(1).value_lengths())
            keep = in_bitmap(held.value, np.asarray(flat).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(batch.column(0)).repeat(size)[keep]), flat.filter(pa.array(keep))], names=["id", "slot"])

    return merging(map_texts(texts.select("id", "prefix"), run, "id bigint, slot bigint")).join(slots, "slot").select("slot", "m", "centre", "id")


def _cross_pairs(entries: DataFrame, similarity: float) -> DataFrame:
    """entries(slot, id, n, small, root) -> (a, b, cell, root, tile, least): what of each slot has to be compared on the sets.

    A row with b is a pair of two roots that sizes and parities let be alike. All pairs are looked at. A slot of many entries or shingles is dealt into
    tiles, each pair of which is one cell. A cell with more than PAIRS such pairs an entry gives no pairs but its entries that are in one (b is null)
    and the least of these: so rows grow with the entries, not with the pairs of a family whose texts are all nearly alike.
    """
    most = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, cells = np.asarray(batch.column(1).value_lengths()), np.asarray(batch.column(0))
            fields = batch.column(1).flatten()
            ids, n, root, tile = (np.asarray(fields.field(c)) for c in ("id", "n", "root", "tile"))
            lists = fields.field("small")
            flat, ends = np.asarray(lists.flatten()).view(np.uint64), np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths()))))
            at, pairs, members = 0, [], []
            for cell, size in zip(cells.tolist(), sizes.tolist()):
                own = np.arange(at, at + size)
                at += size
                two = tile[own].min() != tile[own].max()
                words = np.diff(ends)[own]
                found = []
                for w in np.unique(words).tolist():  # sets that can be alike have as long parities or twice as long ones
                    first, second = own[words == w], own[(words == w) | (words == 2 * w)]
                    gap = gaps(*([flat[ends[i] : ends[i + 1]] for i in x.tolist()] for x in (first, second)))
                    a, b = n[first][:, None], n[second][None, :]
                    ok = (root[first][:, None] != root[second][None, :]) & (gap <= most * (a + b) + 1e-9) & (np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-9)
                    if two:
                        ok &= tile[first][:, None] != tile[second][None, :]
                    ok &= (words[first - own[0]][:, None] != words[second - own[0]][None, :]) | (ids[first][:, None] < ids[second][None, :])
                    i, j = np.nonzero(ok)
                    found.append(np.stack([first[i], second[j]]))
                found = np.concatenate(found, axis=1)
                if found.shape[1] <= PAIRS * size:
                    pairs.append(np.concatenate([np.sort(ids[found], axis=0), np.full((1, found.shape[1]), cell)]))
                else:
                    met = np.unique(found)
                    members.append(np.stack([ids[met], np.full(len(met), cell), root[met], tile[met], np.full(len(met), ids[met].min())]))
            a, b, cell = np.concatenate(pairs, axis=1) if pairs else np.zeros((3, 0), dtype=np.int64)
            none = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([*map(pa.array, (a, b, cell)), none, none, none], names=names)
            for own in members:
                yield pa.RecordBatch.from_arrays([pa.array(own[0]), pa.nulls(own.shape[1], pa.int64()), *map(pa.array, own[1:])], names=names)

    names = ["a", "b", "cell", "root", "tile", "least"]
    tiles = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / SHINGLES))
    mixed_ = entries.groupBy("slot").agg(F.min("root").alias("low"), F.max("root").alias("high"), tiles.alias("tiles")).where("low != high").select("slot", "tiles")
    dealt = entries.join(mixed_, "slot").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")))
    dealt = dealt.select("slot", "id", "n", "small", "root", "tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other"))
    cell = F.xxhash64("slot", F.least("tile", "other"), F.greatest("tile", "other")).alias("cell")
    cells = dealt.groupBy(cell).agg(F.collect_list(F.struct("id", "n", "small", "root", "tile")).alias("e"))
    cells = cells.where(F.array_min("e.root") != F.array_max("e.root"))
    return map_texts(cells.select("cell", "e"), run, "a bigint, b bigint, cell bigint, root bigint, tile bigint, least bigint")


def _families(members: DataFrame, texts: DataFrame) -> DataFrame:
    """members(a, root, least) -> (slot, id, n, small, root): entries whose slots hold all members of each cell, a text once a slot; small are all its parities.

    Cells of one least text, and those that share a text with others of a lesser one, become one slot. So a text of a family meets
    the others once and not for each shingle that they share.
    """
    entries = members.select("a", "root", "least").distinct().withColumn("near", F.min("least").over(Window.partitionBy("a")))
    entries = by_size(spool(entries, "near"))
    slots = entries.groupBy("least").agg(F.min("near").alias("slot"))
    entries = entries.join(slots, "least").select("slot", F.col("a").alias("id"), "root").distinct()
    return entries.join(merging(texts.select("id", "n", F.coalesce("bits", "small").alias("small"))), "id")


def _in_cells(pairs: DataFrame, values: DataFrame, same: Callable[[tuple, tuple], bool], forest: bool) -> DataFrame:
    """The pairs (a, b, cell) for which `same` holds of the values (id, n, x array<bigint>) of a and b.

    The values of a cell's texts meet once, however many pairs it has. With `forest` a pair that a cell's links join already
    is left out: the components are those of all.
    """
    ids = pairs.select("cell", F.explode(F.array("a", "b")).alias("id")).distinct()
    met = ids.join(merging(values), "id").groupBy("cell").agg(F.collect_list(F.struct("id", "n", "x")).alias("e"))
    asked = pairs.groupBy("cell").agg(F.collect_list(F.struct("a", "b")).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for cell, entries, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                fields = entries.values
                known = {i: (n, np.asarray(x.values)) for i, n, x in zip(fields.field("id").to_pylist(), fields.field("n").to_pylist(), fields.field("x"))}
                root: dict[int, int] = {}

                def top(x: int) -> int:
                    while x in root:
                        x = root[x]
                    return x

                for a, b in sorted(zip(own.values.field("a").to_pylist(), own.values.field("b").to_pylist())):
                    i, j = (top(a), top(b)) if forest else (0, 1)
                    if i != j and same(known[a], known[b]):
                        found.append((a, b, cell))
                        if forest:
                            root[max(i, j)] = min(i, j)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(3)], names=["a", "b", "cell"])

    return map_texts(met.join(merging(asked), "cell").select("cell", "e", "p"), run, "a bigint, b bigint, cell bigint")


def joins(ids: np.ndarray, root: np.ndarray, tile: np.ndarray, n: np.ndarray, flat: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links of alike sets that join the roots as all pairs of two roots (and of two tiles, where there are two) would; flat are the n shingles of each id."""
    _, place = np.unique(flat, return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(n)[:-1]))
    label = np.unique(root, return_inverse=True)[1]
    two = tile.min() != tile.max()
    has = np.zeros(place.max() + 1, dtype=bool)
    found = []
    for i in range(len(ids) - 1):
        rest = slice(i + 1, None)
        asked = (label[rest] != label[i]) & (np.minimum(n[rest], n[i]) >= similarity * np.maximum(n[rest], n[i]) - 1e-9)
        if two:
            asked &= tile[rest] != tile[i]
        if not asked.any():
            continue
        has[own := place[starts[i] : starts[i] + n[i]]] = True
        shared = np.add.reduceat(has[place[starts[i + 1] :]], starts[rest] - starts[i + 1], dtype=np.int64)
        has[own] = False
        alike = np.flatnonzero(asked & (shared >= similarity * (n[rest] + n[i] - shared) - 1e-9)) + i + 1
        if len(alike):
            labels, first = np.unique(label[alike], return_index=True)
            found += [(int(ids[i]), int(ids[j])) for j in alike[first]]
            label[np.isin(label, labels)] = label[i]
    return found


def _inside(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """members(id, cell, root, tile), sets(id, n, x) -> links (a, b) whose components with the roots are those of all alike pairs inside the cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entries in batch.column(0):
                fields = entries.values
                ids, root, tile, n = (np.asarray(fields.field(c)) for c in ("id", "root", "tile", "n"))
                found = np.array(joins(ids, root, tile, n, np.asarray(fields.field("x").flatten()), similarity), dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, k]) for k in range(2)], names=["a", "b"])

    met = members.join(merging(sets), "id").groupBy("cell").agg(F.collect_list(F.struct("id", "root", "tile", "n", "x")).alias("e"))
    return map_texts(met.select("e"), run, "a bigint, b bigint")


def _fitting(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b, cell) that sizes and all parities let be alike."""
    most = (1 - similarity) / (1 + similarity)

    def fits(a: tuple, b: tuple) -> bool:
        if min(a[0], b[0]) < similarity * max(a[0], b[0]) - 1e-9:
            return False
        return bool(gaps([a[1].view(np.uint64)], [b[1].view(np.uint64)])[0, 0] <= most * (a[0] + b[0]) + 1e-9)

    return _in_cells(pairs, texts.select("id", "n", F.coalesce("bits", "small").alias("x")), fits, False)


def _alike(pairs: DataFrame, docs: DataFrame, shingle: int, similarity: float, members: DataFrame | None = None) -> DataFrame:
    """Links (a, b) whose components are those of the pairs (a, b, cell) with a Jaccard similarity of at least `similarity`.

    With members(id, cell, root, tile) also of all such pairs of two roots inside a cell of theirs.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    wanted = spool((wanted if members is None else wanted.unionAll(members.select("id"))).distinct(), "wanted")
    # A bitmap of fixed size keeps most other texts out of the shuffle; the join is exact.
    held = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.col("id").alias("gram"))))
    sets = shingle_sets(docs.select(F.xxhash64("text_key").alias("id"), "text"), shingle, "id", lambda ids: in_bitmap(held.value, ids.view(np.uint64)))
    sets = sets.join(by_size(wanted), "id", "left_semi").dropDuplicates(["id"]).select("id", F.size("shingles").alias("n"), F.col("shingles").alias("x"))

    def alike(a: tuple, b: tuple) -> bool:
        shared = len(np.intersect1d(a[1], b[1], assume_unique=True))
        return shared >= similarity * (a[0] + b[0] - shared) - 1e-9

    if members is None:
        return spool(_in_cells(pairs, sets, alike, True).select("a", "b"), "alike")
    sets = spool(sets, "sets")
    return spool(_in_cells(pairs, sets, alike, True).select("a", "b").unionAll(_inside(members, sets, similarity)), "alike")


def _near_prints(texts: DataFrame) -> DataFrame:
    """texts(id, fp) -> pairs (a, b, cell): by multi-index hashing, texts of equal fingerprints, and a text of each of two near ones."""
    prints = by_size(spool(texts.groupBy("fp").agg(F.min("id").alias("least")), "prints"))
    links = near_links(prints.select(F.col("fp").alias("id"), F.array("fp").alias("fp")), 1, NEAR_SEGMENTS, NEAR_RADIUS, NEAR_BITS)
    for x in "ab":
        links = links.join(prints.select(F.col("fp").alias(x), F.col("least").alias(f"id_{x}")), x)
    equal = texts.join(prints, "fp").select("id", "least").where("id != least")
    pairs = links.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).unionAll(equal.select(F.least("id", "least"), F.greatest("id", "least")))
    return pairs.select("a", "b", F.xxhash64("a", "b").alias("cell"))


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(links)


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(row_key, keep): one row for each distinct (doc_id, text) of docs; keep marks the least doc_id of each group.

    Groups are the components of all pairs of texts whose sets of distinct shingles have a Jaccard similarity of at least
    `similarity`; every link is verified on the sets (of 64-bit hashes). SimHash fingerprints of the sets say first, by multi-index hashing, which texts
    can be alike. Few of all such pairs are within NEAR_BITS (a seventh of the bits differ at 0.8), so a prefix join of shingles, which misses none, finds
    the rest: texts that share a shingle are compared with one of a few centres; then all pairs of three or more that these links leave in two groups,
    one by one, or, where they are many for their texts, where the sets of the texts meet.
    Null texts count as empty; a null doc_id is kept only where its group has no other. row_key is xxhash64(doc_id, text_key), text_key the
    MD5 of the text.
    """
    docs = docs.select(*row_keys(), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = spool(_prefixes(docs.select("text_key", "text"), shingle, similarity), "texts")
    entries = spool(_shared(texts), "entries")
    cell = F.xxhash64("slot", F.pmod(F.xxhash64("id"), F.ceil(F.col("m") / BLOCK)))
    stars = entries.where("id != centre").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b"), cell.alias("cell"))
    first = _near_prints(texts.select("id", "fp")).unionAll(stars).groupBy("a", "b").agg(F.min("cell").alias("cell"))
    first = by_size(spool(_fitting(first, texts, similarity), "first"))
    roots = by_size(spool(connected_components(_alike(first, docs, shingle, similarity)), "roots"))
    rooted = texts.select("id", "n", "small").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    # Two entries of one slot are a centre and its partner, so they have been compared.
    crowded = merging(entries.where("m > 2").select("slot", "id")).join(rooted, "id")
    crossed = spool(_cross_pairs(crowded, similarity), "crossed")
    pairs, members = crossed.where("b is not null"), crossed.where("b is null")
    if not members.isEmpty():
        again = spool(_cross_pairs(_families(members, texts), similarity), "again")
        pairs, members = pairs.unionAll(again.where("b is not null")), again.where("b is null")
    pairs = pairs.groupBy("a", "b").agg(F.min("cell").alias("cell"))
    pairs = spool(_fitting(pairs.join(first.select("a", "b"), ["a", "b"], "left_anti"), texts, similarity), "fitting")
    members = members.select(F.col("a").alias("id"), "cell", "root", "tile")
    groups = connected_components(_joined(roots, _alike(pairs, docs, shingle, similarity, None if members.isEmpty() else members)))
    rows = docs.select("row_key", "doc_id", F.xxhash64("text_key").alias("id")).join(groups.withColumnRenamed("node", "id"), "id", "left")
    rows = rows.select(F.coalesce("root", "id").alias("group"), "row_key", F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row_key").alias("order"))
    least = rows.groupBy("group").agg(F.min("order").alias("first"))
    return rows.join(least, "group").select("row_key", (F.col("order") == F.col("first")).alias("keep")).distinct()


def row_keys() -> list[Column]:
    text_key = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    return [F.xxhash64("doc_id", text_key).alias("row_key"), text_key.alias("text_key")]


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    from .common import table

    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex(F.col("fp")[0])), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
