"""Archives inside ingest, lexical search by bounds, the vector index, forms, evals and functions in SQL."""

import io
import json
import random
import zipfile

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from groundline.functions import text as fn
from groundline.functions.sql import register
from groundline.operators import metrics, near, search
from groundline.plans import jobs
from groundline.sources import io as sources

PENDING = "id string, owner_id string, name string, content_type string, status string, created_at long"


def zipped(entries):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name, body in entries:
            z.writestr(zipfile.ZipInfo(name), body)
    return held.getvalue()


def ingest(spark, rows, **more):
    """rows: (upload_id, content, size or None, owner, name, type, created)."""
    uploads = spark.createDataFrame([(r[0], r[1], r[2] or len(r[1])) for r in rows], "upload_id string, content binary, size long")
    pending = spark.createDataFrame([(r[0], r[3], r[4], r[5], "pending", r[6]) for r in {r[0]: r for r in rows}.values()], PENDING)
    return jobs.ingest(uploads, pending, "2024-01-01", **more)


def test_archives_become_files_of_their_own(spark):
    good = zipped([("docs/note.txt", "words"), ("pic.png", b"\x89PNG\r\n\x1a\n"), ("docs/", ""), ("__MACOSX/x.txt", "y"), ("inner.ZIP", "PK"), ("._a", "b"), ("same.txt", "alone")])
    rows = [("z1", good, None, "ann", "a.zip", "application/zip", 5), ("z1", good, None, "ann", "a.zip", "application/zip", 5), ("z2", good, None, "bob", "b.zip", "application/x-zip-compressed", 9), ("t1", b"alone", None, "cid", "t.txt", "text/plain", 7)]
    rows += [("bad", b"PK\x03\x04 broken", None, "ann", "c.zip", "application/zip", 1), ("none", zipped([(".DS_Store", "x")]), None, "ann", "d.zip", "application/zip", 1), ("big", zipped([("x.txt", "hidden")]), fn.ARCHIVE_CAP + 1, "ann", "e.zip", "application/zip", 1)]
    rows += [("doc", good + b"", None, "ann", "f.docx", "application/vnd.ms-word", 1), ("fake", b"not zipped", None, "ann", "g.zip", "application/zip", 1)]
    got = ingest(spark, rows)
    files = {(r.name, r.owner_id, r.content_type, r.copies) for r in got.files.collect()}
    # Equal archives are one, the last settler's; a child settles after what was pending; an office document and a mislabelled file stay whole.
    assert files == {("note.txt", "bob", "text/plain", 1), ("pic.png", "bob", "image/png", 1), ("same.txt", "bob", "text/plain", 2), ("f.docx", "ann", "application/vnd.ms-word", 1), ("g.zip", "ann", "application/zip", 1)}
    assert {(r.file_name, r.text) for r in got.kb_source.collect()} == {("note.txt", "words"), ("same.txt", "alone")}
    assert {(r.id, r.status, r.reason) for r in got.failed.collect()} == {("bad", "failed", "archive could not be opened"), ("none", "failed", "archive holds no file"), ("big", "failed", "archive is too large")}
    assert {r.upload_id for r in got.settled.collect()} == {"z1", "z2", "t1", "doc", "fake"}
    assert ingest(spark, rows[:3], transcribe=lambda x: x.select("file_id", F.lit("seen").alias("text"))).kb_source.where("text = 'seen'").count() == 1


def test_entries_that_cannot_be_read_are_left_out(spark):
    held = bytearray(zipped([("a.txt", "first"), ("b.txt", "second"), ("c.txt", "third")]))
    held[held.index(b"second")] ^= 0xFF  # its checksum is wrong now
    df = spark.createDataFrame([(1, held), (2, bytearray(b"")), (3, None)], "archive_id long, content binary")
    rows = sources.expand_archives(df).collect()
    assert sorted((r.archive_id, r.path) for r in rows if r.path) == [(1, "a.txt"), (1, "c.txt")] and {r.archive_id for r in rows if r.error} == {2, 3}
    register(spark)
    assert sorted((r.archive_id, r.path, r.error is None) for r in spark.sql("SELECT archive_id, e.* FROM {df}, LATERAL unpack_archive(content) e", df=df).collect()) == sorted((r.archive_id, r.path, r.error is None) for r in rows)


def test_last_settler_gives_name_and_type(spark):
    got = ingest(spark, [("u1", b"{}", None, "ann", "a.txt", "text/plain", 1), ("u2", b"{}", None, "bob", "a.json", "application/json", 2)])
    assert [(r.name, r.owner_id, r.content_type, r.copies) for r in got.files.collect()] == [("a.json", "bob", "application/json", 2)]


def test_functions_in_sql(spark):
    register(spark)
    register(spark)  # again
    text = 'Dr. Ünal paid 4.5 euros. "Was it?" he asked, e.g. twice.\nYes'
    rows = spark.createDataFrame([(text,), (None,), ("",), ("Left  here. Right.",)], "text string").selectExpr("text", "split_claims(text) AS c").collect()
    from groundline.operators import claims

    want = {}
    for r in claims.split_claims(spark.createDataFrame([(text,), ("Left  here. Right.",)], "text string"), ["text"]).orderBy("claim_idx").collect():
        want.setdefault(r.text, []).append((r.claim, r.start, r.end))
    assert {r.text: [tuple(x) for x in r.c] for r in rows if r.c} == want and len(want[text]) == 4
    one = spark.range(1).selectExpr("locate_span('aéb', 'b') AS a", "locate_span('abc', '') AS b", "verify_span('aéb', 'éb', 1, 4) AS c", "verify_span('aéb', 'b', 9, 10) AS d", "verbatim_matches('The  fee.', '\"the fee!\"') AS e").first()
    assert (tuple(one.a), one.b, one.c, one.d, one.e) == ((3, 4), None, True, False, True)


@pytest.fixture(scope="module")
def index(spark):
    rng = random.Random(2)
    rare = [f"word{i}" for i in range(400)]
    line = lambda: " ".join(rng.choice(["the", "of", "and", "to"]) if rng.random() < 0.7 else rng.choice(rare) for _ in range(rng.randrange(3, 30)))
    kb = spark.createDataFrame([(f"s3:file{i}", f"f{i}", f"o{i % 3}", "\n".join(line() for _ in range(20))) for i in range(60)], "file_id string, file_name string, owner_id string, text string")
    return jobs.build_index(kb), kb, spark.createDataFrame([(i, f"o{i % 3}", line()) for i in range(20)] + [(50, "o1", "the of and"), (51, "o1", "nothing known"), (52, "o1", None), (53, "o1", "word1 word1")], "query_id long, owner_id string, text string")


@pytest.mark.parametrize("hot", [1 << 20, 200])
def test_bounds_give_the_same_passages(spark, index, monkeypatch, hot):
    index, _, asked = index
    monkeypatch.setattr(search, "HOT", hot)  # common terms are dealt into several keys
    want = search.top_passages(search.lexical_match(asked, index["postings"], index["stats"], index["frequencies"]), 7)
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "rank", "passage_id", "file_id", "score").collect())
    assert all(r[3].startswith("s3:file") for r in rows(want))  # ids with a colon stay whole
    for terms in (1 << 18, 50):  # in one block of queries, and in several
        monkeypatch.setattr(search, "TERMS_PER_BLOCK", terms)
        assert rows(search.lexical_top(asked, index["segments"], index["stats"], index["frequencies"], 7)) == rows(want)
    assert search.lexical_top(asked.where("false"), index["segments"], index["stats"], index["frequencies"], 7).count() == 0
    assert jobs.lexical_search(asked, jobs.build_index(spark.createDataFrame([], "file_id string, file_name string, text string")), 7).count() == 0


def test_common_terms_are_hardly_read():
    rng = np.random.default_rng(3)
    n = 100_000
    lists = []
    for share, top in [(0.8, 0.3), (0.6, 0.4), (0.5, 0.5), (0.001, 6.0), (0.001, 7.0)]:
        at = np.flatnonzero(rng.random(n) < share)
        parts = rng.random(len(at)) * top
        lists.append((at, parts, float(parts.max())))
    total = np.zeros(n)
    for at, parts, _ in lists:
        total[at] += parts
    ids = pa.array([f"p{i:06d}" for i in range(n)])
    best = search.Best(20)
    for cut in np.array_split(np.arange(n), 10):  # segments
        own = [(at[(at >= cut[0]) & (at <= cut[-1])] - cut[0], parts[(at >= cut[0]) & (at <= cut[-1])], bound) for at, parts, bound in lists]
        best.add(search.best_scores(own, len(cut), best), ids.slice(int(cut[0]), len(cut)), ids.slice(int(cut[0]), len(cut)))
    want = sorted(zip((-np.round(total, 6)).tolist(), ids.to_pylist()))[:20]
    assert [r[:2] for r in best.rows] == want
    assert best.counted < sum(len(x[0]) for x in lists) / 5  # the first segment reads all, the others next to nothing of the common terms


def test_owner_scope_before_and_after_the_limit(spark, index):
    index, kb, asked = index
    owners = kb.select(F.col("file_id").alias("id"), "owner_id", F.col("file_name").alias("name"))
    pre = jobs.find_owned(asked, index, owners, 5).join(owners.select(F.col("id").alias("file_id"), F.col("owner_id").alias("has")), "file_id").join(asked.select("query_id", "owner_id"), "query_id")
    rows = pre.collect()
    assert all(r.has == r.owner_id for r in rows) and sum(r.query_id == 3 for r in rows) == 5
    post = search.scope_to_owner(jobs.lexical_search(asked, index, 5).join(asked.select("query_id", "owner_id"), "query_id"), owners)
    assert post.count() < len(rows)


def test_vector_index_finds_nine_neighbours_in_ten(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 16)) * 2
    x = np.concatenate([centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 16)), rng.normal(size=(1000, 16))])
    df = spark.createDataFrame([(f"p{i:05d}", v.tolist()) for i, v in enumerate(x)] + [("same", x[0].tolist()), ("none", None)], "passage_id string, vector array<double>").repartition(4)
    queries = spark.createDataFrame([(i, x[i * 80].tolist()) for i in range(50)] + [(99, None)], "query_id long, vector array<double>")
    centroids, lists = near.vector_index(df, 60)
    centroids, lists = centroids.persist(), lists.persist()
    assert lists.select(F.explode("ids")).count() == 4001 and lists.agg(F.max(F.size("ids"))).first()[0] <= near.BLOCK
    exact = {(r.query_id, r.passage_id): r.distance for r in near.vector_search(queries, centroids, lists, 12, None).collect()}
    brute = {(i, p): d for i in range(50) for d, p in sorted((float(np.sqrt(((v - x[i * 80]) ** 2).sum())), p) for p, v in [*((f"p{j:05d}", v) for j, v in enumerate(x)), ("same", x[0])])[:12]}
    assert exact.keys() == brute.keys() and all(abs(exact[k] - brute[k]) < 1e-9 for k in brute)
    some = {(r.query_id, r.passage_id) for r in near.vector_search(queries, centroids, lists, 12).collect()}
    assert len(some & brute.keys()) >= 0.9 * len(brute)
    empty = near.vector_index(df.where("false"))
    assert near.vector_search(queries, *empty, 12).count() == 0


def test_hybrid_ask_finds_what_words_miss(spark):
    kb = spark.createDataFrame([("f1", "a.txt", "ann", "alpha beta"), ("f2", "b.txt", "ann", "gamma delta")], "file_id string, file_name string, owner_id string, text string")
    vectors = spark.createDataFrame([("f1:000000:000000", [1.0, 0.0]), ("f2:000000:000000", [0.0, 1.0])], "passage_id string, vector array<double>")
    index, owners = jobs.build_index(kb, vectors), kb.select(F.col("file_id").alias("id"), "owner_id", F.col("file_name").alias("name"))
    asked = spark.createDataFrame([(1, "ann", "unheard words"), (2, "eve", "alpha")], "query_id long, owner_id string, text string")
    embed = lambda q: q.select("query_id", F.array(F.lit(0.1), F.lit(0.9)).alias("vector"))

    def model(batch):
        return pd.DataFrame({"id": batch["id"], "reply": [json.dumps({"answer": "x", "fileIds": [h["fileId"] for h in json.loads(p)]}) for p in batch["prompt"]], "input_tokens": 1, "output_tokens": 1})

    said, cited = jobs.ask(asked, index, owners, jobs.by_model(model, "ask", lambda df: F.col("passages")), embed=embed)
    assert [(r.query_id, r.file_id) for r in cited.orderBy("pos").collect()] == [(1, "f2"), (1, "f1")]
    assert {r.query_id: list(r.file_ids) for r in said.collect()} == {1: ["f2", "f1"], 2: []}
    assert jobs.ask(asked, index, owners, jobs.by_model(model, "ask", lambda df: F.col("passages")))[1].count() == 0


def test_a_failed_field_fails_no_other(spark):
    kb = spark.createDataFrame([("f1", "a.txt", "ann", "the rent is forty")], "file_id string, file_name string, owner_id string, text string")
    owners = kb.select(F.col("file_id").alias("id"), "owner_id", F.col("file_name").alias("name"))
    forms = spark.createDataFrame([(1, "ann", ["rent", " ", "broken", "missing"]), (2, "ann", [""])], "form_id long, owner_id string, fields array<string>")

    def model(batch):
        if (batch["prompt"] == "broken").any():
            raise RuntimeError("no answer to this")
        ids = [["f1"] if p == "rent" else [] for p in batch["prompt"]]
        return pd.DataFrame({"id": batch["id"], "reply": [json.dumps({"answer": f"about {p}", "fileIds": i}) for p, i in zip(batch["prompt"], ids)], "input_tokens": 1, "output_tokens": 1})

    rows, bad = jobs.fill(forms, jobs.build_index(kb), owners, jobs.by_model(model, "fill", lambda df: F.col("text"), tries=1))
    got = [(r.pos, r.field, r.value, r.found, r.error, list(r.sources)) for r in rows.orderBy("pos").collect()]
    assert got == [(0, "rent", "about rent", True, "", ["f1"]), (1, "broken", "", False, "RuntimeError: no answer to this", []), (2, "missing", "", False, "", [])]
    assert [r.form_id for r in bad.collect()] == [2]


def test_evals_read_files_and_fail_wrong_citations(spark, tmp_path):
    def case(name, cites, says):
        final = json.dumps({"answer": says, "fileIds": cites})
        return {"name": name, "query": "When was the fuel bought?", "owner": "ann", "files": [{"id": "f1", "name": "receipt.txt", "meta": {"about": "fuel"}}], "script": {"calls": [], "final": final}, "expect": {"fileIds": ["f1"], "answerContains": ["Monday"]}}

    for c in (case("right", ["f1"], "On Monday."), case("wrong", ["f2"], "On Monday."), case("silent", ["f1"], "I don't know.")):
        (tmp_path / f"{c['name']}.json").write_text(json.dumps(c, indent=1))
    got = jobs.run_evals(sources.read_golden_cases(spark, str(tmp_path)))
    assert {r.case: (r.n_expected, r.n_cited, r.passed) for r in got.collect()} == {"right": (1, 1, True), "wrong": (1, 0, False), "silent": (1, 1, False)}


def test_percentile_sketches_are_near_exact_ones(spark):
    log = spark.range(5000).selectExpr("'r' AS route", "'GET' AS method", "'2xx' AS status_class", "double(id * 7919 % 5000) AS ms", "id % 10 = 0 AS failed")
    one, other = metrics.red_metrics(log, exact=True).first(), metrics.red_metrics(log).first()
    assert (one.p50_ms, one.p95_ms) == (2499.5, 4749.05) and abs(other.p50_ms - one.p50_ms) <= 1 and abs(other.p95_ms - one.p95_ms) <= 1


def test_sources_by_owner_and_bucket(spark, tmp_path):
    kb = spark.range(200).selectExpr("concat('f', id) AS file_id", "'n' AS file_name", "concat('o', id % 2) AS owner_id", "'t' AS text")
    sources.write_kb_source(kb, "kb_by_owner", f"{tmp_path}/kb", buckets=4)
    assert spark.table("kb_by_owner").where("owner_id = 'o1'").count() == 100
    folders = sorted(p.name for p in (tmp_path / "kb").iterdir() if p.name.startswith("owner"))
    assert folders == ["owner_id=o0", "owner_id=o1"] and all(len(list((tmp_path / "kb" / f).glob("*.parquet"))) == 4 for f in folders)
    plan = spark.table("kb_by_owner").alias("a").join(spark.table("kb_by_owner").alias("b").hint("merge"), "file_id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


@pytest.mark.parametrize("pairs, added", [(1 << 20, 1 << 20), (500, 300)])
def test_segments_score_many_queries_at_once_as_one_by_one(monkeypatch, pairs, added):
    monkeypatch.setattr(search, "PAIRS", pairs)
    monkeypatch.setattr(search, "ADDED", added)
    rng = np.random.default_rng(5)
    n, terms = 300, 60
    held = [np.flatnonzero(rng.random(n) < 1 / (1 + t)) for t in range(terms)]
    sizes, at = np.array([len(x) for x in held]), np.concatenate(held)
    kept = sizes > 0
    columns = [pa.array([f"p{i:03d}" for i in range(n)]), pa.array(["f"] * n), pa.array(rng.integers(5, 90, n)), pa.array([f"t{t}" for t in np.flatnonzero(kept)]), pa.array(sizes[kept]), pa.array(at), pa.array(rng.integers(1, 5, len(at)))]
    words = [rng.choice(terms + 5, rng.integers(1, 12), replace=False) for _ in range(40)]
    asked = (pa.array(range(40)), pa.array([f"t{t}" for t in range(terms + 5)]), np.concatenate(words), rng.random(sum(map(len, words))) * 5, np.cumsum([len(w) for w in words]), [])
    segment = search.Segment(columns, asked, 40.0)
    got = [b.to_pylist() for b in search._best_of(7)(iter([segment, segment]))]
    for q in range(40):
        best = search.Best(7)
        for _ in range(2):
            best.add(search.best_scores(segment.lists_of(q), n, best), segment.ids, segment.files)
        assert [(r["score"], r["passage_id"]) for b in got for r in b if r["query_id"] == q] == [(-s, p) for s, p, _ in best.rows]


def test_texts_are_split_once_and_passages_stay_where_they_are(spark, index):
    index, kb, asked = index
    plan = search.passages_of(kb)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"split(") == 2  # into lines, into words
    found = jobs.lexical_search(asked, index, 5)
    assert "Exchange hashpartitioning(passage_id" not in found._jdf.queryExecution().executedPlan().toString()


def test_routing_to_many_lists_goes_out_in_small_batches(spark, monkeypatch):
    rng = np.random.default_rng(6)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(50, 4)))], "query_id long, vector array<double>").repartition(1)
    centroids = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(9, 4)))], "list int, vector array<double>")
    rows = lambda: sorted((r.query_id, r.list, tuple(r.vector)) for r in near._nearest_lists(vectors, centroids, "query_id", 3).collect())
    whole = rows()
    monkeypatch.setattr(near, "ROUTED", 20)
    assert rows() == whole and len(whole) == 150


def test_archives_are_packed_once_however_often_ingest_reads_them(spark, monkeypatch):
    from groundline import queries
    from groundline.plans import jobs

    seen = []
    monkeypatch.setattr(jobs, "ingest", lambda uploads, pending, as_of: seen.append(uploads))
    queries._ingested_zips(spark, "/root/testdata/sf0.001")
    assert seen[0].count() and all("/uploads-" in path for path in seen[0].inputFiles())
