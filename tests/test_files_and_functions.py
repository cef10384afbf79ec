"""Files, archives, metrics and scalar functions on small fixtures."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from groundline.functions import text as fn
from groundline.operators import answers, files, metrics, search
from groundline.plans import jobs
from groundline.sources import io as sources


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lit(x):
    return F.lit(x)


def test_scalars(spark):
    assert value(spark, fn.truncate_utf8(lit("aé"), 2)) == "a"
    assert value(spark, fn.truncate_utf8(lit("a😀b"), 4)) == "a"
    assert value(spark, fn.truncate_utf8(lit("a😀b"), 5)) == "a😀"
    assert value(spark, fn.truncate_utf8(lit("abc"), 9)) == "abc"
    assert value(spark, fn.normalize_for_match(lit('  "The  FEE,\n paid."'))) == "the fee, paid"
    assert value(spark, fn.search_text(lit("a.txt"), F.create_map(lit("vendor"), lit("V"), lit("amount"), lit("5")))) == "a.txt\namount: 5\nvendor: V"
    assert value(spark, fn.failed_file_ids(F.array(lit("[Files: s3://b/kb/aa, s3://b/kb/bb.metadata.json]"), lit("again s3://b/kb/aa")))) == ["aa", "bb"]
    assert value(spark, fn.file_tag(lit("x.jpeg"))) == "JPEG" and value(spark, fn.file_tag(lit(".env"))) == "FILE"
    assert value(spark, fn.route_label(lit("GET"), lit("/files/9"))) == "GET /files/{id}" and value(spark, fn.route_label(lit("PUT"), lit("/files"))) == "unmatched"
    assert [value(spark, fn.clamp_limit(lit(n), 20, 50)) for n in (-1, 0, 7, 99)] == [20, 20, 7, 50]
    assert value(spark, fn.case_date(F.create_map(lit("date"), lit("2024-02-30")))) is None


@pytest.mark.parametrize(("reply", "answer", "ids"), [('so: {"answer":"x","fileIds":["a"]} end', "x", ["a"]), ("  plain ", "plain", []), ('{"answer":', '{"answer":', []), ('{"answer":"x"}', "x", [])])
def test_parse_answer(spark, reply, answer, ids):
    r = value(spark, fn.parse_answer(lit(reply)))
    assert (r.answer, list(r.file_ids)) == (answer, ids)


def test_parse_findings_fails_closed(spark):
    assert len(value(spark, fn.parse_findings(lit('x [{"fileId":"a","span":"s","relation":"verbatim"}] y')))) == 1
    assert value(spark, fn.parse_findings(lit('[{"fileId":'))) == [] and value(spark, fn.parse_findings(lit("none"))) == []


@pytest.mark.parametrize(("declared", "content", "kind"), [("application/octet-stream", b"\x89PNG\r\n\x1a\n..", "image/png"), (None, b"<!DOCTYPE html><p>", "text/html"), ("", b"plain words", "text/plain"), (None, b"\x00\x01", "application/octet-stream"), ("image/jpeg", b"no", "image/jpeg")])
def test_detect_content_type(spark, declared, content, kind):
    df = spark.createDataFrame([(declared, bytearray(content))], "d string, c binary")
    assert df.select(fn.detect_content_type(F.col("d"), F.col("c")).alias("k")).first().k == kind


def zipped(entries):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name, body in entries:
            z.writestr(name, body)
    return bytearray(held.getvalue())


def test_archives(spark):
    good = zipped([("photo.jpg", "x"), ("docs/", ""), ("docs/note.txt", "words"), ("__MACOSX/photo.jpg", "y"), (".DS_Store", "z"), ("inner.zip", "PK"), ("._a", "b")])
    df = spark.createDataFrame([("a", good), ("b", bytearray(b"PK\x03\x04 no zip")), ("c", None), ("d", zipped([]))], "archive_id string, content binary")
    rows = sources.expand_archives(df).collect()
    assert sorted((r.archive_id, r.path) for r in rows if r.path) == [("a", "docs/note.txt"), ("a", "photo.jpg")]
    assert {r.archive_id for r in rows if r.error} == {"b", "c"}
    staged = sources.expand_archives(df).where("path is not null")
    outcome = files.archive_outcome(spark.createDataFrame([("a", True), ("b", False), ("d", True)], "archive_id string, readable boolean"), staged)
    assert {r.archive_id: (r.staged, r.status) for r in outcome.collect()} == {"a": (2, "expanded"), "b": (0, "failed"), "d": (0, "failed")}


def test_upserts_and_status(spark):
    base = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "id string, v int, name string")
    change = spark.createDataFrame([("a", 2, "new"), ("b", 4, "old"), ("c", 1, "z"), ("a", 2, "new")], "id string, v int, name string")
    assert sorted((r.id, r.name) for r in files.upsert_records(base, change, ["id"], ["v"]).collect()) == [("a", "new"), ("b", "y"), ("c", "z")]
    recs = spark.createDataFrame([("a", "landed"), ("b", "pending"), ("c", "landed")], "id string, status string")
    reasons = spark.createDataFrame([("s3://b/kb/c",)], "reason string")
    assert sorted((r.id, r.status) for r in jobs.sync_landed(recs, reasons).collect()) == [("a", "ingested"), ("b", "pending"), ("c", "failed")]
    assert jobs.sync_landed(recs, reasons, completed=False).where("status = 'landed'").count() == 2


def test_owner_scoping_and_citations(spark):
    have = spark.createDataFrame([("mine", "alice", "m.txt"), ("theirs", "mallory", "t.txt")], "id string, owner_id string, name string")
    hits = spark.createDataFrame([("mine", "alice"), ("theirs", "alice"), ("ghost", "alice")], "file_id string, owner_id string")
    assert [r.file_id for r in search.scope_to_owner(hits, have).collect()] == ["mine"]
    cited = spark.createDataFrame([(1, "alice", ["theirs", "mine", "mine"])], "query_id int, owner_id string, file_ids array<string>")
    assert [(r.pos, r.file_id) for r in answers.load_cited(cited, have).orderBy("pos").collect()] == [(1, "mine"), (2, "mine")]


def test_fields_and_fill(spark):
    forms = spark.createDataFrame([(1, [" a ", "", "b", "c"]), (2, [" "]), (3, ["x"] * 51)], "form_id int, fields array<string>")
    good, bad = answers.validate_fields(forms)
    assert [r.form_id for r in good.collect()] == [1] and sorted(r.form_id for r in bad.collect()) == [2, 3]
    results = spark.createDataFrame([(1, 0, "v", ["s"], None), (1, 1, "w", [], None), (1, 2, None, None, "timeout")], "form_id int, pos int, value string, sources array<string>, error string")
    got = answers.fill_answers(good, results).orderBy("pos").collect()
    assert [(r.field, r.value, r.found, r.error) for r in got] == [("a", "v", True, ""), ("b", "", False, ""), ("c", "", False, "timeout")]


def test_metric_lines_and_states(spark):
    points = spark.createDataFrame([(1, "n", {"b": "2", "a": "1"}, {"c": 1.0}), (2, "n", {}, {})], "ts_ms long, namespace string, dims map<string,string>, metrics map<string,double>")
    assert [r.value for r in metrics.metric_lines(points).collect()] == ['{"timestamp":1,"namespace":"n","dimensions":["a","b"],"labels":{"a":"1","b":"2"},"metrics":{"c":1.0}}']
    updates = spark.createDataFrame([(1, 1, "running"), (1, 2, "done"), (1, 3, "running"), (1, 4, "failed"), (2, 1, "pending"), (2, 2, "running")], "id int, seq int, status string")
    assert sorted((r.id, r.status) for r in metrics.latest_state(updates).collect()) == [(1, "done"), (2, "running")]


def test_model_map_retries_and_traces(spark, monkeypatch):
    def broken(batch):
        raise ValueError("no model")

    asked = spark.createDataFrame([(1, "p")], "id long, prompt string")
    rows = jobs.model_map(asked, broken, "ask", tries=2).orderBy("attempt").collect()
    assert [(r.attempt, r.ok, r.error) for r in rows] == [(1, False, "ValueError: no model"), (2, False, "ValueError: no model")]


@pytest.mark.parametrize("scale", [0.1, 1.0, 50.0])
def test_lsh_finds_nine_neighbours_in_ten(spark, scale):
    import numpy as np

    x = np.random.default_rng(0).normal(size=(300, 16)) * scale
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "passage_id long, vector array<double>")
    queries = df.where("passage_id < 20").withColumnRenamed("passage_id", "query_id")
    exact = {(r.query_id, r.passage_id) for r in search.vector_match(queries, df, 12).collect()}
    near = {(r.query_id, r.passage_id) for r in search.vector_match_lsh(queries, df, 12).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_no_verified_claim_without_its_words(spark):
    kb = spark.createDataFrame([("f1", "a.txt", "alice", "The fee was paid in May. The keys were returned."), ("f2", "b.txt", "bob", "The fee was paid in May.")], "file_id string, file_name string, owner_id string, text string")
    asked = spark.createDataFrame([(1, "alice", "The fee was paid in May. The keys were not returned. Cats fly."), (2, "carol", "The fee was paid in May."), (3, "alice", " ")], "check_id int, owner_id string, text string")
    out = jobs.check(asked, jobs.build_index(kb), kb.select(F.col("file_id").alias("id"), "owner_id"))
    got = {(r.check_id, r.claim_idx): r.verdict for r in out["verdicts"].collect()}
    assert got == {(1, 0): "verified", (1, 1): "disputed", (1, 2): "unsupported", (2, 0): "unsupported"}
    assert [r.check_id for r in out["failed"].collect()] == [3]
