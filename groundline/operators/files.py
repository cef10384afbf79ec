"""Files: registering, filtering, settling, upserting, listing, deleting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import base_name, content_hash, content_type_for_name, file_key, upload_key

ENTRY_CAP, ENTRIES_CAP, TOTAL_CAP = 64 << 20, 512, 1 << 30


def register_drops(requests: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """requests(id, owner_id, name, content_type, meta) -> pending records, and rejects with a reason."""
    named = (F.coalesce(F.col("name"), F.lit("")) != "") & (F.coalesce(F.col("content_type"), F.lit("")) != "")
    now = F.lit(as_of).cast("timestamp")
    pending = requests.where(named).withColumns({"key": upload_key(F.col("id")), "status": F.lit("pending"), "created_at": now, "updated_at": now})
    return pending, requests.where(~named).withColumn("reason", F.lit("name and contentType are required"))


def apply_patches(files: DataFrame, patches: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """patches(id, owner_id, name, meta) -> files after them (name kept unless given, meta replaced whole), and rejects.

    One patch per id is expected; foreign and unknown ids change nothing.
    """
    empty = F.col("name").isNull() & F.col("meta").isNull()
    reason = F.when(empty, "nothing to update").when(F.col("name") == "", "name must not be empty")
    judged = patches.withColumn("reason", reason)
    good = judged.where("reason is null").select("id", "owner_id", F.col("name").alias("_name"), F.col("meta").alias("_meta"), F.lit(True).alias("_hit"))
    out = files.join(good, ["id", "owner_id"], "left").withColumns({"name": F.coalesce("_name", "name"), "meta": F.coalesce("_meta", "meta"), "updated_at": F.when(F.col("_hit"), F.lit(as_of).cast("timestamp")).otherwise(F.col("updated_at"))})
    return out.drop("_name", "_meta", "_hit"), judged.where("reason is not null")


def is_droppable(path: Column, size: Column) -> Column:
    """False for files that a dropped folder holds for the system only."""
    name = base_name(path)
    return (name != ".DS_Store") & ~name.startswith("._") & (size > 0) & ~F.array_contains(F.split(path, "/"), "__MACOSX")


def is_usable_entry(path: Column, size: Column) -> Column:
    """False for archive entries that are not files of the user's."""
    name = base_name(path)
    return ~path.endswith("/") & (size > 0) & ~path.startswith("__MACOSX/") & (name != ".DS_Store") & ~name.startswith("._") & ~F.lower(path).endswith(".zip")


def cap_archive_entries(entries: DataFrame) -> DataFrame:
    """entries(archive_id, pos, path, size): usable ones within the caps on entry, count and running total, in archive order."""
    order = Window.partitionBy("archive_id").orderBy("pos")
    fit = entries.where(is_usable_entry(F.col("path"), F.col("size")) & (F.col("size") <= ENTRY_CAP))
    fit = fit.withColumns({"_n": F.row_number().over(order), "_total": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    return fit.where((F.col("_n") <= ENTRIES_CAP) & (F.col("_total") <= TOTAL_CAP)).drop("_n", "_total")


def archive_outcome(archives: DataFrame, staged: DataFrame) -> DataFrame:
    """archives(archive_id, readable), staged(archive_id, ...) -> staged count and status; none staged or unreadable fails."""
    counts = staged.groupBy("archive_id").agg(F.count(F.lit(1)).alias("staged"))
    joined = archives.join(counts, "archive_id", "left").withColumn("staged", F.when(F.col("readable"), F.coalesce("staged", F.lit(0))).otherwise(0))
    return joined.select("archive_id", "staged", F.when(F.col("staged") == 0, "failed").otherwise("expanded").alias("status"))


def settle_uploads(events: DataFrame, pending: DataFrame) -> DataFrame:
    """Upload events (upload_id, size) that meet a pending record which has not failed; others are no-ops.

    Redeliveries count once; of such that differ always the same one does.
    """
    others = [c for c in events.columns if c != "upload_id"]
    once = events.groupBy("upload_id").agg(F.max_by(F.struct(*others), F.xxhash64(*others)).alias("_e")).select("upload_id", "_e.*") if others else events.distinct()
    once = once.withColumnRenamed("size", "real_size")
    return once.join(pending.where("status != 'failed'"), once.upload_id == pending.id)


def upsert_records(target: DataFrame, changes: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Whole records by key: the greatest version wins; in a tie the change does."""
    both = target.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    columns = F.struct(*target.columns)
    return both.groupBy(*keys).agg(F.max_by(columns, F.struct(*version, "_new")).alias("r")).select("r.*")


def dedupe_content(files: DataFrame, per_owner: bool = False) -> DataFrame:
    """files(upload_id, owner_id, name, content, created_at) -> one record per content hash, the last writer's, with copies.

    Ties on created_at go to the greater upload_id. With per_owner equal bytes of two owners stay two records.
    """
    hashed = files.withColumn("id", content_hash(F.col("content")))
    keys = ["id", "owner_id"] if per_owner else ["id"]
    last = F.max_by(F.struct("owner_id", "name", "upload_id", "created_at", F.octet_length("content").cast("long").alias("size")), F.struct("created_at", "upload_id"))
    out = hashed.groupBy(*keys).agg(last.alias("r"), F.count(F.lit(1)).alias("copies"))
    return out.select("id", "r.owner_id", "r.name", "r.upload_id", "r.created_at", "r.size", "copies").withColumn("key", file_key(F.col("id")))


def delete_files(files: DataFrame, kb_source: DataFrame, tombstones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files and knowledge sources without the tombstones' (id, owner_id); another owner's tombstone does nothing."""
    gone = files.join(tombstones, ["id", "owner_id"], "left_semi").select(F.col("id").alias("file_id"))
    return files.join(tombstones, ["id", "owner_id"], "left_anti"), kb_source.join(gone, "file_id", "left_anti")


def orphan_kb_sources(kb_source: DataFrame, files: DataFrame) -> DataFrame:
    return kb_source.join(files.select(F.col("id").alias("file_id")), "file_id", "left_anti")


def owner_view(df: DataFrame, owner: str) -> DataFrame:
    return df.where(F.col("owner_id") == owner)


def get_file_view(requests: DataFrame, files: DataFrame) -> DataFrame:
    """requests(request_id, id, owner_id) -> request_id, view: compact JSON, or an error for a missing or foreign file."""
    view = F.to_json(F.struct("id", "name", F.col("content_type").alias("contentType"), "size", "status", "meta"))
    found = files.select("id", "owner_id", view.alias("view"))
    return requests.join(found, ["id", "owner_id"], "left").select("request_id", F.coalesce("view", F.lit('{"error":"file not found"}')).alias("view"))


def advance_status(files: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions(id, from, to): the status changes only where the file is in `from`; one decision per id."""
    moved = files.join(decisions.select("id", F.col("from").alias("_from"), F.col("to").alias("_to")), "id", "left")
    return moved.withColumn("status", F.when(F.col("status") == F.col("_from"), F.col("_to")).otherwise(F.col("status"))).drop("_from", "_to")


def sync_decisions(landed: DataFrame, failed_ids: DataFrame) -> DataFrame:
    """landed(id), failed_ids(id) -> decisions from landed to ingested or failed."""
    failed = failed_ids.select("id").distinct().withColumn("_f", F.lit(True))
    return landed.select("id").join(failed, "id", "left").select("id", F.lit("landed").alias("from"), F.when(F.col("_f"), "failed").otherwise("ingested").alias("to"))


def list_files(files: DataFrame, owner: str, limit: int, cursor: str | None = None) -> DataFrame:
    """A page of the owner's files by id after the cursor, each with the cursor that goes on after it."""
    page = owner_view(files, owner)
    if cursor:
        import base64

        after = base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)).decode()
        page = page.where(F.col("id") > after)
    token = F.regexp_replace(F.translate(F.base64(F.encode("id", "UTF-8")), "+/", "-_"), "=+$", "")
    return page.orderBy("id").limit(limit).withColumn("cursor", token)


def list_by_status(files: DataFrame, status: str, n: int) -> DataFrame:
    return files.where(F.col("status") == status).orderBy("id").limit(n)


def gc_staging(staging: DataFrame, as_of: str) -> DataFrame:
    """Staged objects (key, created_at) that are not older than a day."""
    return staging.where(F.col("created_at") > F.lit(as_of).cast("timestamp") - F.expr("INTERVAL 1 DAY"))


def child_records(entries: DataFrame) -> DataFrame:
    """Archive entries (parent_hash, path, size) as upload records."""
    return entries.withColumn("id", F.sha2(F.concat("parent_hash", F.lit("\0"), "path"), 256)).withColumn("content_type", content_type_for_name(F.col("path")))


def batch_outcome(drops: DataFrame) -> DataFrame:
    """drops(batch, name, ok) -> done, total, uploaded, failed and the failed names' summary."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("name"))))
    out = drops.groupBy("batch").agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("uploaded"), F.count_if(~F.col("ok")).alias("failed"), failed.alias("_names"))
    return out.withColumn("summary", F.when(F.col("failed") == 0, "").otherwise(F.concat(F.col("failed").cast("string"), F.lit(" failed: "), F.array_join("_names", ", ")))).drop("_names")
