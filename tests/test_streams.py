"""Streams: tables by bucket, state that is forgotten, refused and failing tasks, uploads as files."""

import pytest
from pyspark.sql import functions as F

from groundline.plans import jobs
from groundline.sources import io
from groundline.streaming import flows


def files_of(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    make = lambda: flows.VersionedTable(spark, f"{tmp_path}/t", "id string, us long", ["id"], ["us"], buckets=16)
    rows = lambda: sorted((r.id, r.us) for r in make().read().collect())
    make().upsert(spark.range(200).selectExpr("concat('k', id) AS id", "1L AS us"), 0)
    before = files_of(tmp_path / "t")
    change = spark.createDataFrame([("k1", 2)], "id string, us long")
    make().upsert(change, 1)
    kept = files_of(tmp_path / "t")
    assert before.items() <= kept.items()  # nothing of the version before is touched
    assert len(kept) == len(before) + 1  # one bucket was written
    assert dict(rows())["k1"] == 2 and len(rows()) == 200
    make().upsert(change, 1)  # handed over again
    make().upsert(spark.createDataFrame([("k2", 3)], "id string, us long"), 2)
    make().upsert(spark.createDataFrame([("k1", 1), ("new", 1)], "id string, us long"), 3)  # older than what is there
    assert (dict(rows())["k1"], dict(rows())["k2"], len(rows())) == (2, 3, 201) and make().versions() == [2, 3]
    held = {(v, b) for n in (2, 3) for b, v in make().manifest(n).items()}
    assert {(int(p.parent.parent.name[2:]), int(p.parent.name[7:])) for p in (tmp_path / "t" / "data").rglob("*.parquet")} == held  # the rest is gone


def test_an_unfinished_version_is_no_version(spark, tmp_path):
    t = flows.VersionedTable(spark, f"{tmp_path}/t", "id string, us long", ["id"], ["us"], buckets=4)
    t.upsert(spark.createDataFrame([("a", 1)], "id string, us long"), 0)
    t._commit = lambda *a: (_ for _ in ()).throw(OSError("stopped before the manifest"))
    with pytest.raises(OSError, match="stopped"):
        t.upsert(spark.createDataFrame([("a", 9)], "id string, us long"), 1)
    again = flows.VersionedTable(spark, f"{tmp_path}/t", "id string, us long", ["id"], ["us"], buckets=4)
    assert [tuple(r) for r in again.read().collect()] == [("a", 1)]
    again.upsert(spark.createDataFrame([("a", 9)], "id string, us long"), 1)
    assert [tuple(r) for r in again.read().collect()] == [("a", 9)]


def batches(spark, tmp_path, schema, *parts):
    """A stream that reads each part as a micro-batch of its own."""
    import os
    import time

    path = tmp_path / "in"
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/n={k}")
        for f in (path / f"n={k}").glob("*.parquet"):
            os.utime(f, (time.time() - 1000 + k * 10,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


DAY = 86_400_000_000


def test_lifecycle_state_is_forgotten(spark, tmp_path):
    schema = "id long, us long, event_id long, status string"
    stream = batches(spark, tmp_path, schema, [(1, DAY, 1, "running"), (1, DAY, 2, "done"), (1, DAY, 3, "failed"), (2, DAY, 4, "pending")], [(1, DAY + 5, 5, "running"), (9, 20 * DAY, 6, "running")], [(9, 20 * DAY + 1, 7, "running")], [(1, 20 * DAY + 2, 8, "running")])
    got = flows.drain(flows.stream_lifecycle_state(stream, delay="1 second", ttl="10 days"), "lifecycle", "append").collect()
    of_one = [(r.us, r.status) for r in sorted(got, key=lambda r: r.us) if r.id == 1]
    # The first terminal state stays, until ten days have passed without an update: then the id is new.
    assert of_one == [(DAY, "done"), (DAY, "done"), (20 * DAY + 2, "running")]


def test_dead_letters_come_once_and_are_forgotten(spark, tmp_path):
    schema = "upload_id string, us long, failed boolean"
    at = lambda n, us, ok=True: [("u", us + i, ok) for i in range(n)]
    stream = batches(spark, tmp_path, schema, at(3, DAY) + at(4, DAY, False), at(2, DAY + 10), at(4, DAY + 20), [("v", 30 * DAY, True)], [("v", 30 * DAY + 1, True)], at(4, 30 * DAY + 2), at(1, 30 * DAY + 9))
    timed = stream.withColumn("ts", F.timestamp_micros("us"))
    got = [tuple(r) for r in flows.drain(flows.stream_dead_letters(timed, delay="1 second", retention="14 days"), "dead").collect()]
    # Five failures in the first days give one letter, four more none; after two weeks of silence the count begins anew.
    assert got == [("u", 5), ("u", 5)]


def test_tasks_are_refused_expire_and_fail_alone(spark):
    kb = spark.createDataFrame([("f1", "a.txt", "ann", "The fee was paid in May.")], "file_id string, file_name string, owner_id string, text string")
    index, owners = jobs.build_index(kb), kb.select(F.col("file_id").alias("id"), "owner_id")
    text = "The fee was paid in May."
    checks = spark.createDataFrame([(1, "ann", text), (2, "ann", text), (3, "ann", text), (4, "ann", " "), (5, "ann", "poison here."), (6, "ann", "?!")], "id long, owner_id string, text string")
    tasks = spark.createDataFrame([(1, "ann", "2030-01-01"), (1, "ann", "2030-01-01"), (2, "mallory", "2030-01-01"), (3, "ann", "2020-01-01"), (4, "ann", "2030-01-01"), (5, "ann", "2030-01-01"), (6, "ann", None), (7, "ann", None)], "check_id long, owner_id string, deadline string").withColumn("deadline", F.to_timestamp("deadline"))

    def propose(rows, offered):
        return jobs.propose_lexical(rows.withColumn("claim", F.when(F.col("claim").contains("poison"), F.raise_error(F.lit("a model broke"))).otherwise(F.col("claim"))), offered)

    def each(batch):
        rows = jobs.verify(batch, checks, index, owners, "2024-01-01", propose=propose)
        return rows.select("check_id", "status", "reason", "verdict")

    poisoned = spark.createDataFrame([("f2", "b.txt", "ann", "poison here.")], kb.schema)
    index = jobs.build_index(kb.unionAll(poisoned))
    owners = kb.unionAll(poisoned).select(F.col("file_id").alias("id"), "owner_id")
    failed = lambda batch, error: batch.select("check_id", F.lit("failed").alias("status"), F.lit(error).alias("reason"), F.lit(None).cast("string").alias("verdict"))
    got = {r.check_id: (r.status, r.reason, r.verdict) for r in flows.isolated(each, failed, "check_id")(tasks).collect()}
    broken = got.pop(5)
    assert got == {1: ("done", None, "verified"), 2: ("refused", "the check is another owner's", None), 3: ("failed", "the deadline has passed", None), 4: ("failed", "text is required", None), 6: ("done", None, None), 7: ("refused", "no such check", None)}
    assert broken[0] == "failed" and broken[1]


def test_uploads_arrive_as_files(spark, tmp_path):
    for name, text in (("upload_id=u%201", "first"), ("upload_id=u2", "second")):
        (tmp_path / "in" / name).mkdir(parents=True)
        (tmp_path / "in" / name / "part-0.txt").write_text(text)
    (tmp_path / "in" / "plain").write_text("third")
    pending = spark.createDataFrame([(i, "ann", f"{i}.txt", "text/plain", "pending", 1) for i in ("u 1", "u2", "plain")], "id string, owner_id string, name string, content_type string, status string, created_at long")
    make = lambda name, schema, keys, version: flows.VersionedTable(spark, f"{tmp_path}/{name}", schema, keys, version, buckets=4)
    tables = make("r", "id string, owner_id string, name string, content_type string, size long, status string, created_at long", ["id"], ["created_at"]), make("t", "file_id string, file_name string, owner_id string, text string", ["file_id"], ["file_name"]), make("s", "upload_id string, batch long", ["upload_id"], ["batch"])
    run = lambda: flows.stream_ingest(io.stream_uploads(spark, f"{tmp_path}/in", 1), pending, *tables, "2024-01-01", f"{tmp_path}/state").awaitTermination()
    run()
    assert {(r.file_name, r.text) for r in tables[1].read().collect()} == {("u 1.txt", "first"), ("u2.txt", "second"), ("plain.txt", "third")}
    (tmp_path / "in" / "upload_id=u2" / "part-1.txt").write_text("changed later")  # a redelivery of what has settled
    run()
    assert {r.text for r in tables[1].read().collect()} == {"first", "second", "third"} and tables[2].read().count() == 3


def test_what_a_batch_wrote_on_its_way_is_deleted(spark, tmp_path):
    from groundline.sources import tables

    seen = []

    def each(batch, number):
        held = tables.written(batch, "held")
        seen.append(held.inputFiles()[0])
        held.write.mode("overwrite").parquet(f"{tmp_path}/out/n={number}")

    flows.stream_into(batches(spark, tmp_path, "id long", [(1,)], [(2,)]), each, f"{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2 and len(seen) == 2
    from pathlib import Path

    assert not any(Path(f.removeprefix("file://")).exists() for f in seen)
