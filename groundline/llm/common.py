"""Shared helpers: tables in the shared folder, keys, ordered running totals."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a folder of our own only where it is unset and Spark runs on this machine alone."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _own[app]


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as Parquet into the shared folder and read it back.

    Cuts lineage and survives lost executors. The table is deleted when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/groundline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended; the folder's owner clears it
        pass


#: Rows of a table of a few numbers that a join may broadcast, where Spark takes it to be small enough.
BROADCAST_ROWS = 1 << 18


def merging(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, whose joins shuffle and sort and broadcast neither side; with `rows` only from so many rows on.

    Spark takes a table's size from its compressed files, and rows that an explode or a task makes of one row don't count at all, so that what it
    broadcasts can be a hundred times as large and fill the driver.
    """
    return df.hint("merge") if rows is None or rows > BROADCAST_ROWS else df


def by_size(spooled: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, `merging` where it has more than BROADCAST_ROWS (a count from its footers)."""
    return merging(spooled, spooled.count())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_texts(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """rows.mapInArrow with batches of at most 1000 rows and 8 MB, because texts can be long.

    The session's limits are set to these and stay so (a lower number of rows is kept).
    """
    conf = rows.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return rows.mapInArrow(run, schema)


def row_buckets(df: DataFrame, groups: list[str], spread: Column, rows_per_bucket: int, name: str = "bucket") -> DataFrame:
    """Add `bucket`: within each group, a number below ceil(rows / rows_per_bucket) chosen by the hash `spread`.

    A hot group is cut into as many buckets as it needs; nothing is dropped. `df` should be a spooled
    (narrow) table because it is read twice.
    """
    counts = df.groupBy(*groups).agg(F.ceil(F.count(F.lit(1)) / rows_per_bucket).alias("_n"))
    left, right = df.alias("l"), counts.alias("r")
    same = [F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in groups]
    return left.join(right, same).select("l.*", F.pmod(spread, F.col("r._n")).alias(name))


def running_start(df: DataFrame, groups: list[str], size: str, order: list[Column], spread: Column, rows_per_bucket: int = 1024, name: str = "start") -> DataFrame:
    """Add `start`: the sum of `size` over the rows before this one in its group.

    The order is (bucket, *order), where the buckets are a hash partition of the group, so no task
    ever holds more than about one bucket; bucket totals are summed in two levels in the same way.
    """
    dealt = row_buckets(df, groups, spread, rows_per_bucket)
    totals = dealt.groupBy(*groups, "bucket").agg(F.sum(size).alias("_t")).withColumn("_super", F.floor(F.col("bucket") / 1024))
    upper = totals.groupBy(*groups, "_super").agg(F.sum("_t").alias("_s"))
    before = lambda what, w: F.coalesce(F.sum(what).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    upper = upper.withColumn("_s0", before("_s", Window.partitionBy(*groups).orderBy("_super"))).drop("_s")
    totals = totals.withColumn("_b0", before("_t", Window.partitionBy(*groups, "_super").orderBy("bucket"))).drop("_t")
    same = lambda on: [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in on]
    starts = totals.alias("a").join(upper.alias("b"), same([*groups, "_super"])).select(*[F.col(f"a.{c}") for c in [*groups, "bucket"]], (F.col("_b0") + F.col("_s0")).alias("_start"))
    within = dealt.withColumn("_in", before(size, Window.partitionBy(*groups, "bucket").orderBy(*order)))
    return within.alias("a").join(starts.alias("b"), same([*groups, "bucket"])).select("a.*", (F.col("a._in") + F.col("b._start")).cast("long").alias(name)).drop("_in", "bucket")
