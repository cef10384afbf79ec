"""What mustn't stop a job or lose rows: repeated keys, odd bytes, restarts, repeated batches."""

from pyspark.sql import functions as F

from groundline.operators import claims, files
from groundline.plans import jobs
from groundline.streaming import flows


def test_rows_of_equal_and_null_keys_are_split_apart(spark):
    df = spark.createDataFrame([(1, "One. Two."), (1, "Alpha beta. Gamma."), (None, "Left \ue000 here. Right."), (2, None), (3, "")], "id long, text string")
    got = claims.split_claims(df, ["id"])
    assert sorted((str(r.id), r.claim_idx, r.claim, r.start, r.end) for r in got.collect()) == sorted(
        [("1", 0, "One.", 0, 4), ("1", 1, "Two.", 5, 9), ("1", 0, "Alpha beta.", 0, 11), ("1", 1, "Gamma.", 12, 18), ("None", 0, "Left \ue000 here.", 0, 14), ("None", 1, "Right.", 15, 21)]
    )


def test_long_texts_have_right_ranges(spark):
    said = [f"Sentence number {i} stands." for i in range(1000)]
    rows = claims.split_claims(spark.createDataFrame([(1, " ".join(said))], "id long, text string"), ["id"]).orderBy("claim_idx").collect()
    assert [r.claim for r in rows] == said and all(" ".join(said)[r.start : r.end] == r.claim for r in rows)


def test_binary_uploads_land_without_stopping_the_job(spark):
    png, text, broken = b"\x89PNG\r\n\x1a\n\xff\x00", "good text é".encode(), b"caf\xe9 \xff"
    uploads = spark.createDataFrame([("u1", png), ("u2", text), ("u3", broken), ("u2", text)], "upload_id string, content binary")
    pending = spark.createDataFrame([(u, "o", n, t, "pending", 1) for u, n, t in (("u1", "a.png", "application/octet-stream"), ("u2", "b.txt", None), ("u3", "c.txt", "text/plain"))], "id string, owner_id string, name string, content_type string, status string, created_at long")
    landed, kb, *_ = jobs.ingest(uploads, pending, "2024-01-01")
    assert {(r.name, r.content_type, r.searchable) for r in landed.collect()} == {("a.png", "image/png", False), ("b.txt", "text/plain", True), ("c.txt", "text/plain", False)}
    assert [(r.file_name, r.text) for r in kb.collect()] == [("b.txt", "good text é")]
    read = jobs.ingest(uploads, pending, "2024-01-01", lambda x: x.select("file_id", F.lit("seen").alias("text"))).kb_source
    assert {(r.file_name, r.text) for r in read.collect()} == {("b.txt", "good text é"), ("a.png", "seen")}


def test_redeliveries_that_differ_settle_alike(spark):
    rows = [("u", 1), ("u", 2), ("u", 3)]
    pending = spark.createDataFrame([("u", "pending")], "id string, status string")
    got = {tuple(r.real_size for r in files.settle_uploads(spark.createDataFrame(rows[i:] + rows[:i], "upload_id string, size long"), pending).collect()) for i in range(3)}
    assert len(got) == 1 and len(next(iter(got))) == 1


def test_versioned_table_outlives_its_process(spark, tmp_path):
    make = lambda: flows.VersionedTable(spark, f"{tmp_path}/t", "id string, us long", ["id"], ["us"])
    change = lambda *rows: spark.createDataFrame(list(rows), "id string, us long")
    rows = lambda: sorted((r.id, r.us) for r in make().read().collect())
    assert rows() == []
    make().upsert(change(("a", 1), ("b", 1)), 0)
    make().upsert(change(("c", 1)), 1)
    assert rows() == [("a", 1), ("b", 1), ("c", 1)]
    make().upsert(change(("c", 1), ("a", 2)), 1)  # handed over again
    make().upsert(change(("d", 1)), 2)
    assert rows() == [("a", 2), ("b", 1), ("c", 1), ("d", 1)] and make().versions() == [1, 2]
