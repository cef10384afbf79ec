"""Tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder (spark.checkpoint.dir), or in one of our own where that is unset and Spark runs on this machine alone."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return f"{named.rstrip('/')}/groundline/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """df written once as Parquet, with the writer's options, and read back: it cuts lineage and outlives lost executors.

    The table is deleted when the `scratch` around it ends, or else when the driver's process does.
    """
    path = shared_path(df.sparkSession, name)
    scopes = getattr(_own, "scopes", None)
    if scopes:
        scopes[-1].append(path)
    else:
        atexit.register(_drop, df.sparkSession, path)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_own = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What this thread writes with `written` in here is deleted at the end: for work whose results are stored elsewhere by then, like a micro-batch."""
    scopes = _own.__dict__.setdefault("scopes", [])
    scopes.append([])
    try:
        yield
    finally:
        for path in scopes.pop():
            _drop(spark, path)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended; the folder's owner clears it
        pass


def bounded_batches(spark: SparkSession, most_bytes: int = 64 << 20) -> None:
    """Rows reach Python in batches of at most so many bytes, or single ones: for rows that hold archives or blocks of vectors. The session keeps the limit."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most_bytes))
