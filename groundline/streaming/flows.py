"""The service's event flows as Structured Streaming jobs. Each works on any streaming DataFrame; `drain` runs one to the end."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators import metrics
from ..operators.files import upsert_records
from ..sources.tables import scratch, shared_path


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start in here keep their state in RocksDB: arbitrary state needs it, and large state fits on disk."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drain(stream: DataFrame, name: str, mode: str = "append", key: list[str] | None = None) -> DataFrame:
    """Run a stream over what there is now and return what it wrote.

    append: all rows; complete and update: the latest row of each key, taken from the micro-batch that wrote it last.
    """
    spark = stream.sparkSession
    out = shared_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/rows/n={number}")  # a repeated batch replaces itself

    with rocksdb_state(spark):
        stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{out}/state").foreachBatch(write).start().awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("_batch", IntegerType())])).parquet(f"{out}/rows/n=*")
    if mode == "complete":
        last = rows.agg(F.max("_batch")).first()[0]
        rows = rows.where(F.col("_batch") == F.lit(-1 if last is None else last))
    elif mode == "update":
        rows = rows.groupBy(*key).agg(F.max_by(F.struct(*stream.columns), "_batch").alias("r")).select("r.*")
        return rows
    return rows.drop("_batch")


def read_files(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """A Parquet file or folder as a stream of its files. The pattern lets Spark take a single file too."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path}*")


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """Events as a stream; their ts becomes a timestamp with a zone, as watermarks need."""
    return read_files(spark, path, files_per_trigger).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_dedupe_deliveries(deliveries: DataFrame, key: str = "upload_id", delay: str = "60 days") -> DataFrame:
    """Each delivery once; redeliveries within the delay are dropped, and state older than it."""
    return deliveries.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def stream_red_metrics(requests: DataFrame, width: str = "1 minute", delay: str = "10 minutes", exact: bool = False) -> DataFrame:
    """Request metrics per tumbling window; rows later than the delay are dropped."""
    return metrics.red_metrics(requests.withWatermark("ts", delay), F.window("ts", width), exact=exact).withColumn("window_start", F.col("window.start")).drop("window")


def stream_call_metrics(calls: DataFrame, width: str = "10 minutes", slide: str = "5 minutes", delay: str = "10 minutes", exact: bool = False) -> DataFrame:
    """Model-call metrics per sliding window and op."""
    return metrics.call_metrics(calls.withWatermark("ts", delay), F.window("ts", width, slide), exact=exact).withColumn("window_start", F.col("window.start")).drop("window")


def stream_ask_sessions(asks: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Bursts of an owner's asks: a session ends when `gap` passes without one."""
    grouped = asks.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "owner_id").agg(F.count(F.lit(1)).alias("asks"))
    return grouped.select("owner_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "asks")


def _ms(duration: str) -> int:
    """Milliseconds of a number and a unit, as in "30 days"."""
    return int(pd.Timedelta(duration).total_seconds() * 1000)


def stream_lifecycle_state(updates: DataFrame, terminal: tuple[str, ...] = ("done", "failed"), delay: str = "10 minutes", ttl: str = "30 days") -> DataFrame:
    """updates(id, us, event_id, status): after each batch, the state of the ids seen in it; a terminal state stays.

    State is one short row an id and is dropped `ttl` of event time after the id's last update. Rows are folded as they come; the result does not
    depend on their order in a batch. Of a batch's terminal rows the first by (us, event_id) counts; one that comes in a later batch is not taken back.
    Updates later than `delay` are dropped.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    keep_ms = _ms(ttl)

    class Latest(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.held = handle.getValueState("held", "us long, event_id long, status string, forget long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
            *before, forget = self.held.get() if self.held.exists() else (None, 0)
            best = tuple(before) if forget else None
            ended, last, final = best is not None and best[2] in terminal, 0, None
            for x in rows:
                last = max(last, int(x["us"].max()) // 1000)
                if ended:
                    continue
                order = x.sort_values(["us", "event_id"])
                for part, first in ((order, False), (order[order["status"].isin(terminal)], True)):
                    if not len(part):
                        continue
                    row = part.iloc[0 if first else -1]
                    one = int(row["us"]), int(row["event_id"]), row["status"]
                    if first:
                        final = one if final is None else min(final, one)
                    elif best is None or one[:2] > best[:2]:
                        best = one
            best = final or best
            later = max(forget, last + keep_ms)
            if later != forget:
                if forget:
                    self.handle.deleteTimer(forget)
                self.handle.registerTimer(later)
            self.held.update((*best, later))
            yield pd.DataFrame({"id": [key[0]], "us": [best[0]], "event_id": [best[1]], "status": [best[2]]})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
            self.held.clear()
            return iter(())

        def close(self) -> None:
            pass

    timed = updates.select("id", "us", "event_id", "status", F.timestamp_micros("us").alias("ts")).withWatermark("ts", delay)
    return timed.groupBy("id").transformWithStateInPandas(statefulProcessor=Latest(), outputStructType="id long, us long, event_id long, status string", outputMode="Update", timeMode="EventTime")


def stream_dead_letters(deliveries: DataFrame, most: int = 5, delay: str = "10 minutes", retention: str = "14 days") -> DataFrame:
    """deliveries(upload_id, ts, failed) -> (upload_id, failures), once for each upload whose failed deliveries reach `most`.

    For the append mode. Each upload has one small row of state and one timer: `retention` of event time after its last failed delivery it is forgotten.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    keep_ms = _ms(retention)

    class Letters(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.held = handle.getValueState("held", "failures long, forget long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
            before, forget = self.held.get() if self.held.exists() else (0, 0)
            failures, last = before, 0
            for x in rows:
                failures += len(x)
                last = max(last, int(x["ts"].max().value // 1_000_000))
            later = max(forget, last + keep_ms)
            if later != forget:
                if forget:
                    self.handle.deleteTimer(forget)
                self.handle.registerTimer(later)
            self.held.update((failures, later))
            if before < most <= failures:
                yield pd.DataFrame({"upload_id": [key[0]], "failures": [most]})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
            self.held.clear()
            return iter(())

        def close(self) -> None:
            pass

    failed = deliveries.where("failed").select("upload_id", "ts").withWatermark("ts", delay)
    kind = deliveries.schema["upload_id"].dataType.simpleString()
    return failed.groupBy("upload_id").transformWithStateInPandas(statefulProcessor=Letters(), outputStructType=f"upload_id {kind}, failures long", outputMode="Append", timeMode="EventTime")


def stream_into(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Start a query that hands each micro-batch to `each`: ingesting (jobs.ingest and upsert), checks (jobs.check), index syncs.

    `each` must be safe to repeat, as a batch is handed over again after a failure, and have stored what it gives when it returns: tables that it wrote on
    the way are deleted then. Without `every` it ends with what there is now.
    """

    def step(batch: DataFrame, number: int) -> None:
        with scratch(batch.sparkSession):
            each(batch, number)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.trigger(**trigger).option("checkpointLocation", checkpoint).foreachBatch(step).start()


class VersionedTable:
    """A table of whole records at `root`, dealt by a hash of its keys into buckets; a version rewrites only the buckets that its changes touch.

    A version is a manifest that names the folder of each bucket, written last and renamed into place, so a version is there whole or not at all and the
    table outlives its process. A batch that is handed over again starts from the version before it, which is why two versions are kept; folders
    that neither names are deleted. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: list[str], version: list[str], buckets: int = 64):
        self.spark, self.root, self.schema, self.keys, self.version, self.buckets = spark, root, schema, keys, version, buckets
        self.files = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: object):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *map(str, parts)]))

    def _names(self, *parts: object) -> list[str]:
        path = self._path(*parts)
        return sorted(f.getPath().getName() for f in self.files.listStatus(path)) if self.files.exists(path) else []

    def versions(self) -> list[int]:
        """Numbers of the complete versions, ascending."""
        return sorted(int(n[2:]) for n in self._names("manifest") if n.startswith("v=") and n[2:].isdigit())

    def manifest(self, version: int | None) -> dict[int, int]:
        """The version that wrote each bucket, as of a version; empty for none."""
        if version is None:
            return {}
        text = self.spark.read.text(f"{self.root}/manifest/v={version}").first()[0]
        return {int(b): int(v) for b, v in json.loads(text).items()}

    def _before(self, number: int | None) -> int | None:
        known = [n for n in self.versions() if number is None or n < number]
        return known[-1] if known else None

    def _rows(self, places: dict[int, int]) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/data/v={v}/bucket={b}" for b, v in sorted(places.items())])

    def read(self, before: int | None = None) -> DataFrame:
        """The latest complete version, or the latest before a number."""
        return self._rows(self.manifest(self._before(before)))

    def upsert(self, changes: DataFrame, number: int) -> None:
        """Version `number`: the version before it with the changes; the greatest record of each key wins."""
        old = self.manifest(self._before(number))
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("bucket")
        named = changes.select(*self.spark.createDataFrame([], self.schema).columns)
        touched = {r.bucket for r in named.select(bucket).distinct().collect()}  # `buckets` at most
        merged = upsert_records(self._rows({b: v for b, v in old.items() if b in touched}), named, self.keys, self.version)
        merged.select("*", bucket).repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/v={number}")
        self._commit(number, old | dict.fromkeys(touched, number))
        self._clean()

    def _commit(self, number: int, places: dict[int, int]) -> None:
        temporary, final = self._path("manifest", f"_v={number}"), self._path("manifest", f"v={number}")
        out = self.files.create(temporary, True)
        out.write(bytearray(json.dumps(places).encode()))
        out.close()
        self.files.delete(final, False)
        if not self.files.rename(temporary, final):
            raise OSError(f"version {number} of {self.root} could not be put in place")

    def _clean(self) -> None:
        known = self.versions()
        for n in known[:-2]:
            self.files.delete(self._path("manifest", f"v={n}"), False)
        used = {(v, b) for n in known[-2:] for b, v in self.manifest(n).items()}
        for v in self._names("data"):
            folders = [b for b in self._names("data", v) if b.startswith("bucket=")]
            gone = [b for b in folders if (int(v[2:]), int(b[7:])) not in used]
            for b in gone:
                self.files.delete(self._path("data", v, b), True)
            if len(gone) == len(folders):
                self.files.delete(self._path("data", v), True)


def stream_ingest(uploads: DataFrame, pending: DataFrame, records: VersionedTable, texts: VersionedTable, settled: VersionedTable, as_of: str, checkpoint: str, every: str | None = None):
    """Ingests the uploads of each micro-batch: uploads(upload_id, content, size) as a stream, for instance `io.stream_uploads`.

    records(id, owner_id, name, content_type, size, status, created_at), texts(file_id, file_name, owner_id, text) and settled(upload_id, batch) hold what came of
    them. Uploads that an earlier batch settled change nothing, and a batch that is handed over again gives what it gave.
    """
    from ..plans import jobs

    def each(batch: DataFrame, number: int) -> None:
        known = settled.read(before=number).select(F.col("upload_id").alias("id"))
        got = jobs.ingest(batch, pending.join(known, "id", "left_anti"), as_of)
        files_ = got.files.select("id", "owner_id", "name", "content_type", "size", "status", "created_at")
        lost = got.failed.select("id", "owner_id", "name", "content_type", F.lit(None).cast("long").alias("size"), "status", "created_at")
        records.upsert(files_.unionByName(lost), number)
        texts.upsert(got.kb_source, number)
        done = got.settled.unionByName(got.failed.select(F.col("id").alias("upload_id")))
        settled.upsert(done.withColumn("batch", F.lit(number).cast("long")), number)

    return stream_into(uploads, each, checkpoint, every)


def isolated(each: Callable[[DataFrame], DataFrame], failed: Callable[[DataFrame, str], DataFrame], key: str) -> Callable[[DataFrame], DataFrame]:
    """`each`, written, but a row that makes it fail gives its `failed` row alone: a batch that raises is halved by a hash of `key` until it works or is one key.

    Good rows are computed as often as a bad one is among them, so bad ones should be rare; for n rows and b bad ones it takes about b * log2(n) more runs.
    """
    from ..sources.tables import written

    def run(batch: DataFrame) -> DataFrame:
        try:
            return written(each(batch), "isolated")
        except Exception as e:  # whatever went wrong is recorded on the rows that it goes wrong with
            ends = batch.agg(F.min(F.xxhash64(key)).alias("low"), F.max(F.xxhash64(key)).alias("high")).first()
            if ends.low is None or ends.low == ends.high:
                return failed(batch, f"{type(e).__name__}: {str(e).splitlines()[0][:200]}")
            middle = (ends.low + ends.high) // 2
            return run(batch.where(F.xxhash64(key) <= middle)).unionByName(run(batch.where(F.xxhash64(key) > middle)))

    return run
