"""Sharding along a Hilbert curve over metadata dimensions, in DataFrame functions only.

Each dimension is quantised to `bits` bits, the cells are numbered along the Hilbert curve (Skilling,
"Programming the Hilbert curve", 2004), rows are ordered by their cell and the order is cut into runs
whose row counts differ by at most one. Neighbouring rows are near each other in every dimension, so
the minima and maxima of each file prune on each of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spool, table

#: Rows that one hash bucket of a curve cell holds on average at most; a hot cell is cut into more buckets.
ROWS_PER_BUCKET = 1024


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row however often `use` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Position of a cell along the curve; axes are longs of 0 to 2**bits - 1."""
    n, long = len(axes), lambda x: F.lit(x).cast("long")
    x = F.array(*[a.cast("long") for a in axes])
    levels = [1 << b for b in range(bits - 1, 0, -1)]
    if levels:
        steps = F.array(*[F.struct(long(q).alias("q"), F.lit(i).alias("i")) for q in levels for i in range(n)])

        def turn(state: Column, s: Column) -> Column:
            low, own = s["q"] - 1, F.get(state, s["i"])
            swapped = F.get(state, F.lit(0)).bitwiseXOR(own).bitwiseAND(low)
            flip = own.bitwiseAND(s["q"]) != 0
            # What the first axis is changed by, and what axis i (if it isn't the first) is changed by.
            change = F.when(flip, F.array(low, long(0))).otherwise(F.array(swapped, swapped))
            return _let(change, lambda c: F.transform(state, lambda v, j: v.bitwiseXOR(F.when(j == 0, c[0]).when(j == s["i"], c[1]).otherwise(long(0)))))

        x = F.aggregate(steps, x, turn)
    # Gray code: each axis is the exclusive or of those up to it; then one correction for all.
    def gray(x: Column) -> Column:
        return F.transform(x, lambda _, j: F.aggregate(F.slice(x, 1, j + 1), long(0), lambda a, b: a.bitwiseXOR(b)))

    def corrected(g: Column) -> Column:
        fix = long(0)
        for q in levels:
            fix = fix.bitwiseXOR(F.when(F.get(g, F.lit(n - 1)).bitwiseAND(long(q)) != 0, long(q - 1)).otherwise(long(0)))
        return _let(fix, lambda f: F.transform(g, lambda v: v.bitwiseXOR(f)))

    places = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(b).alias("b")) for b in range(bits - 1, -1, -1) for i in range(n)])
    interleaved = lambda v: F.aggregate(places, long(0), lambda out, p: out * 2 + long(1).bitwiseAND(F.call_function("shiftright", F.get(v, p["i"]), p["b"])))
    return _let(_let(_let(x, gray), corrected), interleaved)


def quantised(docs: DataFrame, values: dict[str, Column], bits: int) -> dict[str, Column]:
    """Codes 1 to 2**bits - 1 by quantiles of each dimension's distinct values, 0 for null.

    Numbers are cut by percentiles, strings by the ranks of their whole values; both are aggregates over all rows, and only
    2**bits - 2 cuts a dimension come to the driver.
    """
    parts = 2**bits - 1
    codes = {}
    for name, value in values.items():
        distinct = docs.select(value.alias("v")).where("v is not null").distinct()
        if dict(distinct.dtypes)["v"] == "string":
            cuts = _string_cuts(spool(distinct, "values"), parts)
        else:
            splits = distinct.agg(F.percentile_approx("v", [i / parts for i in range(1, parts)], 10000).alias("s")).first()
            cuts = sorted(set((splits and splits.s) or []))
        over = F.aggregate(F.array(*[F.lit(c) for c in cuts]), F.lit(1).cast("long"), lambda n, c: n + (value > c).cast("long")) if cuts else F.lit(1).cast("long")
        codes[name] = F.coalesce(F.when(value.isNotNull(), over), F.lit(0).cast("long"))
    return codes


def _string_cuts(distinct: DataFrame, parts: int) -> list[str]:
    """Up to parts - 1 of the distinct strings v that cut them into runs of about equal number, in their order.

    The strings are sorted in ranges; a line for each range comes to the driver, and then the cuts by their ranks.
    """
    place = F.monotonically_increasing_id()  # the range in the upper bits, the place in it in the lower 33
    ranked = distinct.repartitionByRange("v").sortWithinPartitions("v")
    ranked = spool(ranked.select("v", F.call_function("shiftright", place, F.lit(33)).alias("range"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("i")), "ranks")
    before, wanted = 0, []
    counts = sorted(tuple(r) for r in ranked.groupBy("range").count().collect())
    total = sum(n for _, n in counts)
    ranks = {-(-i * total // parts) - 1 for i in range(1, parts)}  # a cut is the last string of its run
    for part, n in counts:
        wanted += [(part, r - before) for r in ranks if before <= r < before + n]
        before += n
    if not wanted:
        return []
    return sorted(r.v for r in ranked.where(F.struct("range", "i").isin([F.struct(F.lit(p).cast("long"), F.lit(i).cast("long")) for p, i in wanted])).select("v").collect())


def hilbert_shards(docs: DataFrame, dimensions: dict[str, Column], shards: int, spread: Column, tie: list[Column], bits: int = 6) -> DataFrame:
    """docs with shard int and slot long: runs of the Hilbert order over `dimensions` (numbers or strings).

    Row counts of the shards differ by at most one and slots run from 0 without gaps. In one cell rows stand by the
    hash `spread`'s bucket, then `tie`. Null dimensions have a code of their own. Repeated rows are rows; which of two equal
    rows stands first makes no difference. Columns of docs named shard or slot give way to these. An empty table gives an
    empty result.
    """
    if len(dimensions) * bits > 18:
        raise ValueError("at most 18 bits in all: the table of cells is broadcast and so has at most 2**18 rows")
    codes = quantised(docs, dimensions, bits)
    # A row is one value beside the helper columns, so that no name clashes.
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")])
    keyed = docs.select(kept.alias("row"), hilbert_index(list(codes.values()), bits).alias("cell"), spread.alias("spread"), F.struct(*tie, spread).alias("tie"))
    whole = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = keyed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    cells = spool(cells.select("cell", F.ceil(F.col("n") / ROWS_PER_BUCKET).alias("buckets"), F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("first"), F.sum("n").over(Window.partitionBy()).alias("rows")), "cells")
    dealt = keyed.join(F.broadcast(cells), "cell").withColumn("bucket", F.pmod("spread", "buckets"))
    within = Window.partitionBy("cell").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("cell", "bucket").agg(F.count(F.lit(1)).alias("m"))
    starts = spool(starts.select("cell", "bucket", F.coalesce(F.sum("m").over(within), F.lit(0)).alias("before")), "buckets")
    order = Window.partitionBy("cell", "bucket").orderBy("tie")
    ranked = dealt.withColumn("r", F.row_number().over(order)).join(starts, ["cell", "bucket"]).withColumn("rank", F.col("first") + F.col("before") + F.col("r") - 1)
    placed = ranked.withColumn("shard", F.expr(f"({shards} * rank) div rows").cast("int"))
    slot = F.col("rank") - F.ceil(F.col("shard").cast("long") * F.col("rows") / F.lit(shards))
    return placed.select("row.*", "shard", slot.cast("long").alias("slot"))


def document_dimensions() -> dict[str, Column]:
    """Source, language and length on a scale of quarter powers of two."""
    return {
        "source": F.col("source"),
        "lang": F.col("lang"),
        "length": F.floor(F.log2(F.coalesce(F.octet_length("text"), F.lit(0)) + 1) * 4),
    }


def op4_hilbert(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), *[d.alias(f"d_{n}") for n, d in document_dimensions().items()])
    narrow = spool(narrow, "narrow")
    placed = hilbert_shards(narrow, {n: F.col(n) for n in narrow.columns if n.startswith("d_")}, 40, F.xxhash64("text_crc32", "doc_id"), [F.col("doc_id"), F.col("text_crc32")])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
