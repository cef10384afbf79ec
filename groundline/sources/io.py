"""Reading uploads, events, archives and golden cases; writing metric lines and knowledge sources."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ..operators.files import ENTRIES_CAP, ENTRY_CAP, TOTAL_CAP
from ..operators.metrics import metric_lines
from .tables import bounded_batches

MESSAGE = "struct<Records: array<struct<eventSource: string, body: string>>>"
OBJECT_EVENT = "struct<Records: array<struct<s3: struct<object: struct<key: string, size: bigint>>>>>"
GOLDEN_CASE = "name string, query string, owner string, files array<struct<id: string, name: string, meta: map<string, string>>>, script struct<calls: array<struct<tool: string, input: string>>, final: string>, expect struct<fileIds: array<string>, answerContains: array<string>>"


def read_uploads(spark: SparkSession, path: str, contents: bool = True) -> DataFrame:
    """path, length and modificationTime of each object, and its bytes; without `contents` no bytes are read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return df if contents else df.select("path", "length", "modificationTime")


def stream_uploads(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """The objects under a folder as a stream of uploads: upload_id (the last part of the path, or `name` of a folder upload_id=name), size, content."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    df = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return df.select(upload_id_of(F.col("path")).alias("upload_id"), F.col("length").alias("size"), "content")


def upload_id_of(path: Column) -> Column:
    folder = F.regexp_extract(path, "/upload_id=([^/]*)/[^/]*$", 1)
    return F.url_decode(F.when(folder != "", folder).otherwise(F.element_at(F.split(path, "/"), -1)))


def parse_upload_events(messages: DataFrame) -> DataFrame:
    """messages(raw) -> upload_key, real_size of each record: both JSON layers decoded, keys unescaped. Malformed layers give no row."""
    outer = messages.select("*", F.explode(F.from_json("raw", MESSAGE)["Records"]).alias("_m"))
    inner = outer.select("*", F.explode(F.from_json("_m.body", OBJECT_EVENT)["Records"]).alias("_r"))
    key = F.url_decode(F.col("_r.s3.object.key"))
    return inner.select(*[c for c in messages.columns if c != "raw"], key.alias("upload_key"), F.col("_r.s3.object.size").alias("real_size"))


def classify_event(raw: Column) -> Column:
    """What a raw event is; the first match wins."""
    source = F.get_json_object(raw, "$.Records[0].eventSource")
    return (
        F.when(source == "aws:sqs", "upload_queue")
        .when(F.get_json_object(raw, "$.Records[0].s3.object.key").isNotNull(), "upload")
        .when(F.get_json_object(raw, "$.source") == "aws.events", "schedule")
        .when(F.get_json_object(raw, "$.checkId").isNotNull(), "check")
        .otherwise("request")
    )


def entries_of(content: bytes) -> Iterator[tuple[int, str, bytes]]:
    """(place, path, bytes) of the usable entries of a zip within the caps, one at a time; ValueError where it can't be opened.

    An entry that can't be read or that is larger than it says is left out; what counts is the bytes that were read.
    """
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except (zipfile.BadZipFile, TypeError, NotImplementedError, EOFError, OSError, ValueError) as e:
        raise ValueError(str(e)) from e
    kept = total = 0
    with archive:
        for pos, entry in enumerate(archive.infolist()):
            name = entry.filename.rsplit("/", 1)[-1]
            unusable = entry.is_dir() or not entry.file_size or entry.filename.startswith("__MACOSX/") or name == ".DS_Store" or name.startswith("._") or name.lower().endswith(".zip")
            if unusable:
                continue
            try:
                with archive.open(entry) as f:
                    data = f.read(ENTRY_CAP + 1)
            except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError, OSError, zlib.error):
                continue
            if len(data) > ENTRY_CAP:
                continue
            total += len(data)
            if kept == ENTRIES_CAP or total > TOTAL_CAP:
                return
            kept += 1
            yield pos, entry.filename, data


@udtf(returnType="pos int, path string, size bigint, content binary, error string")
class UnpackArchive:
    """SQL's `LATERAL unpack_archive(content)`: a row for each usable entry, or one with an error. It holds one archive's entries at a time."""

    def eval(self, content: bytes):
        try:
            for pos, path, data in entries_of(content):
                yield pos, path, len(data), data, None
        except ValueError as e:
            yield None, None, None, None, str(e)


def expand_archives(archives: DataFrame) -> DataFrame:
    """archives(archive_id, content) -> archive_id, pos, path, size, content of usable entries within the caps; error for an unreadable archive.

    One entry is in memory at a time, which a lateral UDTF can't do (`UnpackArchive` is the form for SQL). An unreadable archive gives one row without
    a path. Archives reach a task in batches of 64 MB or single ones: the session's limit is set to that and stays so.
    """
    kind = archives.schema["archive_id"].dataType
    schema = StructType([StructField("archive_id", kind), *StructType.fromDDL("pos int, path string, size bigint, content binary, error string")])
    arrow = [f.type for f in to_arrow_schema(schema)]

    def row(key: pa.Scalar, *values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key.as_py()], arrow[0]), *(pa.array([v], t) for v, t in zip(values, arrow[1:]))], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, content in zip(batch.column(0), batch.column(1)):
                try:
                    for pos, path, data in entries_of(content.as_py()):
                        yield row(key, pos, path, len(data), data, None)
                except ValueError as e:
                    yield row(key, None, None, None, None, str(e))

    bounded_batches(archives.sparkSession)
    return archives.select("archive_id", "content").mapInArrow(run, schema)


def read_golden_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases, one JSON document a file, with the file's name to order them by."""
    return spark.read.schema(GOLDEN_CASE).option("multiLine", "true").json(path).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def write_metric_lines(points: DataFrame, path: str) -> None:
    metric_lines(points).write.text(path)


def write_kb_source(kb_source: DataFrame, name: str, path: str, buckets: int = 32) -> None:
    """The table `name` at `path`: partitioned by owner, so that an owner's retrieval reads its own files only, and bucketed by file within."""
    rows = kb_source.repartition(buckets, "file_id")  # each bucket of an owner is one file
    rows.write.partitionBy("owner_id").bucketBy(buckets, "file_id").sortBy("file_id").option("path", path).mode("overwrite").saveAsTable(name)
