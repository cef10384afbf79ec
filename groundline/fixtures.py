"""How the given tables stand in for the service's records: once as DataFrames, once as SQL for the oracle.

Times are seconds after a fixed epoch, so nothing depends on the clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = 1704067200  # 2024-01-01 UTC
AS_OF = "2024-01-20 00:00:00"
AS_OF_S = 1705708800


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload requests: every document is one; some name or type is missing."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("upl-"), F.col("doc_id").cast("string")).alias("upload_id"),
        F.col("source").alias("owner_id"),
        F.when(F.col("doc_id") % 17 == 3, "").otherwise(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("name"),
        F.when(F.col("doc_id") % 23 == 5, "").otherwise("text/plain").alias("content_type"),
        "doc_id", "lang", "text",
        (F.lit(EPOCH) + F.col("doc_id")).alias("created_s"),
    )


DROPS = f"""drops AS (SELECT 'upl-' || doc_id AS upload_id, source AS owner_id,
 CASE WHEN doc_id % 17 = 3 THEN '' ELSE 'doc_' || doc_id || '.txt' END AS name,
 CASE WHEN doc_id % 23 = 5 THEN '' ELSE 'text/plain' END AS content_type, doc_id, lang, text, {EPOCH} + doc_id AS created_s FROM documents)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per document: id is the document's own (see A1 for records by content)."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("f"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("id"),
        F.col("source").alias("owner_id"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"),
        F.lit("text/plain").alias("content_type"),
        F.octet_length("text").cast("long").alias("size"),
        F.element_at(F.array(*map(F.lit, ["pending", "landed", "ingested", "failed"])), (F.col("doc_id") % 4 + 1).cast("int")).alias("status"),
        F.create_map(F.lit("lang"), F.col("lang")).alias("meta"),
        "doc_id", "text",
        (F.lit(EPOCH) + F.col("doc_id")).alias("created_s"),
    )


FILES = f"""files AS (SELECT 'f' || lpad(doc_id::VARCHAR, 8, '0') AS id, source AS owner_id, 'doc_' || doc_id || '.txt' AS name,
 'text/plain' AS content_type, strlen(text) AS size, ['pending','landed','ingested','failed'][doc_id % 4 + 1] AS status,
 lang, doc_id, text, {EPOCH} + doc_id AS created_s FROM documents)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with epoch milliseconds, the number in props and labels of a request log."""
    e = table(spark, sf_dir, "events")
    n = F.get_json_object("props", "$.k").cast("long")
    method = F.element_at(F.array(*map(F.lit, ["GET", "POST", "PATCH", "DELETE", "BREW"])), (F.col("event_id") % 5 + 1).cast("int"))
    path = F.element_at(F.array(*map(F.lit, ["/files", "/files/abc", "/ask", "/checks/42", "/nowhere", "/calls"])), (F.col("event_id") % 6 + 1).cast("int"))
    code = F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 0, 503).otherwise(404)).otherwise(200)
    return e.select("event_id", F.expr("unix_micros(cast(ts as timestamp))").alias("us"), F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props", n.alias("k"), method.alias("method"), path.alias("path"), code.alias("code"))


EVENTS = """ev AS (SELECT event_id, epoch_us(ts) AS us, ts, user_id, event_type, value, props, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
 ['GET','POST','PATCH','DELETE','BREW'][event_id % 5 + 1] AS method,
 ['/files','/files/abc','/ask','/checks/42','/nowhere','/calls'][event_id % 6 + 1] AS path,
 CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 503 ELSE 404 END ELSE 200 END AS code FROM events)"""

#: Route labels as SQL over ev.
ROUTE_SQL = """CASE WHEN method = 'POST' AND path = '/files' THEN 'POST /files' WHEN method = 'GET' AND path = '/files' THEN 'GET /files'
 WHEN method = 'GET' AND regexp_matches(path, '^/files/[^/]+$') THEN 'GET /files/{id}' WHEN method = 'PATCH' AND regexp_matches(path, '^/files/[^/]+$') THEN 'PATCH /files/{id}'
 WHEN method = 'DELETE' AND regexp_matches(path, '^/files/[^/]+$') THEN 'DELETE /files/{id}' WHEN method = 'POST' AND path = '/ask' THEN 'POST /ask'
 WHEN method = 'GET' AND regexp_matches(path, '^/checks/[^/]+$') THEN 'GET /checks/{id}' WHEN method = 'GET' AND path = '/calls' THEN 'GET /calls' ELSE 'unmatched' END"""
METHOD_SQL = "CASE WHEN method IN ('GET','POST','PUT','PATCH','DELETE','OPTIONS','HEAD') THEN method ELSE 'other' END"


def kb_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searchable text, one row per distinct content: the least document's name."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    first = d.groupBy(F.sha2("text", 256).alias("file_id")).agg(F.min_by(F.struct("text", "source", "doc_id"), "doc_id").alias("r"))
    return first.select("file_id", F.concat(F.lit("doc_"), F.col("r.doc_id").cast("string"), F.lit(".txt")).alias("file_name"), F.col("r.source").alias("owner_id"), "r.doc_id", "r.text")


KB = "kb AS (SELECT sha256(text) AS file_id, 'doc_' || min(doc_id) || '.txt' AS file_name, arg_min(source, doc_id) AS owner_id, min(doc_id) AS doc_id, any_value(text) AS text FROM documents WHERE text IS NOT NULL GROUP BY sha256(text))"

#: Passages as SQL over kb: lines, long ones in windows of 200 words that overlap by 40.
PASSAGES = """lines AS (SELECT file_id, file_name, owner_id, doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM kb),
worded AS (SELECT file_id, file_name, owner_id, doc_id, line, list_filter(regexp_split_to_array(trim(body), '\\s+'), lambda w: w <> '') AS words FROM lines),
windowed AS (SELECT *, unnest(generate_series(0, greatest(0, len(words) - 41), 160)) AS off FROM worded WHERE len(words) > 0),
passages AS (SELECT file_id || ':' || lpad(line::VARCHAR, 6, '0') || ':' || lpad(off::VARCHAR, 6, '0') AS passage_id, file_id, file_name, owner_id, doc_id, line, off,
 array_to_string(words[off + 1 : off + 200], ' ') AS text FROM windowed)"""

POSTINGS = """toks AS (SELECT passage_id, file_id, regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+') AS t FROM passages),
flat AS (SELECT passage_id, file_id, len(t) AS length, unnest(t) AS term FROM toks),
postings AS (SELECT term, passage_id, file_id, length, count(*) AS tf FROM flat GROUP BY ALL),
freq AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
stats AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS mean FROM toks)"""

BM25 = """qterms AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+')) AS term FROM benchmark),
bm AS (SELECT query_id, passage_id, file_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
 FROM qterms JOIN freq USING (term) JOIN postings USING (term), stats GROUP BY ALL)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks and queries: benchmark texts; the owner is a source."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("check_id"), F.col("item_id").alias("query_id"), "text", F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("owner_id"))


def zipped(entries: DataFrame) -> DataFrame:
    """entries(id, path, body) -> (id, content): a zip for each id, packed in tasks."""

    def pack(x):
        import io
        import zipfile

        import pandas as pd

        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            for path, body in sorted(zip(x["path"], x["body"])):
                z.writestr(zipfile.ZipInfo(path), body)
        return pd.DataFrame({"id": [x["id"].iloc[0]], "content": [held.getvalue()]})

    return entries.groupBy("id").applyInPandas(pack, "id string, content binary")
