"""The corpus pipeline: documents through five training-data operators, one after the other.

A stage takes (spark, docs, sf_dir) and returns the rows it keeps, with the columns of documents; the last adds
the shard and slot of each row. Extra columns of documents pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.llm.common import fresh, merging, spool, table
from groundline.llm.decontam import contaminated
from groundline.llm.hilbert import document_dimensions, hilbert_shards
from groundline.llm.mixing import mix_sources
from groundline.llm.quality import fit_quality, score_quality
from groundline.llm.simhash import near_duplicates, row_keys

#: Weights of the sources by code point, repeating; the mix has as many words as what comes in.
WEIGHTS = [5.0, 2.0, 1.0]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose co-trained quality score is at least a half.

    Null and empty texts are scored as texts without words, null metadata as a value of its own; repeated rows stay or go
    together; without usable labels every row stays. Other columns pass through, whatever their names.
    """
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    names = [fresh(docs, n) for n in ("content", "metadata", "score")]
    return score_quality(docs, model, whole=True, names=names).where(F.col(names[2]) >= 0.5).select(*docs.columns)


def _whole(docs: DataFrame) -> Column:
    """A row of docs as one value, so that no helper column can clash with the columns of docs."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of near copies (Jaccard 0.8 of 5-word shingles, linked).

    Null texts count as empty, and all texts without words are copies of each other. Of rows with equal doc_id and text one
    stays; a null doc_id only where its group has no other. Other columns pass through, whatever their names.
    """
    keys = near_duplicates(docs).where("keep").select("row_key")
    kept = docs.select(_whole(docs), row_keys()[0]).join(keys, "row_key", "left_semi")
    return kept.dropDuplicates(["row_key"]).select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy or edited copy of a benchmark item.

    Null and empty texts hold none; null or empty items are in no text. Repeated rows stay or go together; other columns
    pass through, whatever their names.
    """
    found = spool(contaminated(docs, table(spark, sf_dir, "benchmark")).select("digest").distinct(), "contaminated")
    return docs.select(_whole(docs), F.unhex(F.sha2("text", 256)).alias("digest")).join(found, "digest", "left_anti").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words: whole times, and once more with the chance of the rest.

    The chance is a hash of the row, so reruns agree. Texts of no words (null ones too) weigh nothing and stay once; null sources are one
    source; repeated rows are rows. Other columns pass through, whatever their names.
    """
    key = F.xxhash64("doc_id", "source", "text").alias("key")
    taken = mix_sources(docs.select("doc_id", "source", "text", key), WEIGHTS)
    times = F.col("taken") / F.col("size")
    whole = F.floor(times) + (F.pmod(F.xxhash64(F.lit("mix"), "key"), F.lit(1 << 20)) / float(1 << 20) < times - F.floor(times)).cast("long")
    # Equal rows share a key; each gets the mean of theirs.
    copies = taken.withColumn("n", F.when(F.col("size") == 0, F.lit(1)).otherwise(whole)).groupBy("key").agg(F.round(F.avg("n")).cast("int").alias("n"))
    joined = merging(docs.select(_whole(docs), key)).join(copies.where("n > 0"), "key")
    return joined.select("row", F.explode(F.array_repeat(F.lit(0), F.col("n")))).select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with shard (0 to 39) and slot, in runs along a Hilbert curve over source, language and length.

    Null dimensions have a code of their own; repeated rows are rows. Columns of docs named shard or slot give way to these.
    """
    return hilbert_shards(docs, document_dimensions(), 40, F.xxhash64("doc_id", "text"), [F.col("doc_id")])


STAGES = [("quality classifier", quality), ("near-dedup by shingles", near_dedup), ("benchmark decontamination", decontaminate), ("mixing sources", mix), ("sharding", shard)]

#: SQL can't express the stages; tests/llm/test_pipeline.py holds them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are written as Parquet and reread by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = spool(docs, f"stage{k}")
    return docs
