"""Splitting, gating, verdicts: each sentence rule, and spans that must fail closed."""

import pytest
from pyspark.sql import functions as F

from groundline.functions import text as fn
from groundline.operators import claims


def split(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return [(r.id, r.claim, r.start, r.end) for r in claims.split_claims(df, ["id"]).orderBy("id", "claim_idx").collect()]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("The fee was paid. Was it late? It was!", ["The fee was paid.", "Was it late?", "It was!"]),
        ("Dr. A. Weber cited cl. 4.1 and s. 9 in Weber v. Holt. It cost $10,000.50 approx. as agreed.", ["Dr. A. Weber cited cl. 4.1 and s. 9 in Weber v. Holt.", "It cost $10,000.50 approx. as agreed."]),
        ("List of dates\nThe lease began in May.", ["List of dates", "The lease began in May."]),
        ("--\n...\nIt was signed.\n**", ["It was signed."]),
        ('She wrote "it cleared." Then she left.', ['She wrote "it cleared."', "Then she left."]),
        ("She paused... Then she paid.", ["She paused...", "Then she paid."]),
        ("They agreed, e.g. in cl. 2, to wait. It rained.", ["They agreed, e.g. in cl. 2, to wait.", "It rained."]),
        ("He paid $400. 12 days later it ended.", ["He paid $400.", "12 days later it ended."]),
        ("She wrote “it cleared.” Then she left.", ["She wrote “it cleared.”", "Then she left."]),
        ("A  mark. Another  one.", ["A  mark.", "Another  one."]),
        ("", []),
    ],
)
def test_split(spark, text, expected):
    got = split(spark, text)
    assert [c for _, c, _, _ in got] == expected
    assert all(text.encode()[a:b].decode() == c for _, c, a, b in got)


def test_split_null_text_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "One. Two.", "y")], "id int, text string, claim string")
    assert [r.claim for r in claims.split_claims(df, ["id"]).orderBy("claim_idx").collect()] == ["One.", "Two."]


@pytest.mark.parametrize("span", ["fee was", "“fee", "fee­was", "fee –", "The ﬁne", "The fee  ", "the fee", "…", "absent"])
def test_look_alike_spans_fail(spark, span):
    df = spark.createDataFrame([("The fee was 5 - paid.", span)], "text string, span string")
    r = df.select(fn.locate_span(F.col("text"), F.col("span")).alias("at"), fn.verify_span(F.col("text"), F.col("span"), F.lit(0), F.lit(3)).alias("ok")).first()
    assert r.at is None and not r.ok


def test_locate_counts_bytes(spark):
    df = spark.createDataFrame([("é ü fee", "fee", 6, 9), ("é ü fee", "fee", 5, 8), ("é", "é", 0, 99), ("é", "é", -1, 1), ("abc", "", 0, 0)], "text string, span string, a int, b int")
    rows = df.select(fn.locate_span(F.col("text"), F.col("span")).alias("at"), fn.verify_span(F.col("text"), F.col("span"), F.col("a"), F.col("b")).alias("ok")).collect()
    assert (rows[0].at.start, rows[0].at.end) == (6, 9)
    assert [r.ok for r in rows[:4]] == [True, False, False, False]
    assert rows[4].at is None


def test_gate_demotes_and_discards(spark):
    cand = spark.createDataFrame([("k", 0, "f", "The fee was paid in May. It was not late.")], "check_id string, claim_idx int, file_id string, candidate_text string")
    rows = [(0, "f", "The fee was paid in May", "verbatim"), (1, "f", "It was not late", "verbatim"), (2, "f", "It was late", "paraphrase"), (3, "ghost", "It", "paraphrase"), (4, "f", "It", "supports"), (5, "f", "", "verbatim")]
    found = spark.createDataFrame([("k", 0, i, f, s, r, "the fee was paid in May!") for i, f, s, r in rows], "check_id string, claim_idx int, idx int, file_id string, span string, relation string, claim string")
    got = claims.gate_findings(claims.match_findings_to_candidates(found, cand)).orderBy("idx").collect()
    assert [(r.idx, r.relation) for r in got] == [(0, "verbatim"), (1, "paraphrase")]


def refs(spark, relations):
    return spark.createDataFrame([("k", 0, i, f"f{i}", r) for i, r in enumerate(relations)], "check_id string, claim_idx int, idx int, file_id string, relation string")


@pytest.mark.parametrize(("relations", "verdict"), [(["verbatim", "contradicts"], "disputed"), (["paraphrase", "verbatim"], "verified"), (["paraphrase"], "review"), ([], "unsupported")])
def test_verdict(spark, relations, verdict):
    rows = spark.createDataFrame([("k", 0, "c")], "check_id string, claim_idx int, claim string")
    assert claims.claim_verdict(rows, refs(spark, relations)).first().verdict == verdict


def test_cap_puts_contradictions_first_only_where_needed(spark):
    many = claims.cap_references(refs(spark, ["verbatim"] * 5 + ["contradicts"])).orderBy("ref_idx").collect()
    assert [r.idx for r in many] == [5, 0, 1, 2, 3]
    few = claims.cap_references(refs(spark, ["verbatim", "contradicts"])).orderBy("ref_idx").collect()
    assert [r.idx for r in few] == [0, 1]


def test_segments_rebuild_the_text(spark):
    text = "é one. Two. Three."
    spans = [(9, 13), (0, 7), (1, 4), (3, 3), (12, 16), (14, 99), (-1, 2)]
    df = spark.createDataFrame([(1, text, spans), (2, "no claims", [])], "check_id int, text string, claims array<struct<start: int, end: int>>")
    got = claims.claim_segments(df).orderBy("check_id", "seg_idx").collect()
    assert "".join(r.segment for r in got if r.check_id == 1) == text
    assert [(r.kind, r.start, r.end) for r in got if r.check_id == 1] == [("claim", 0, 7), ("gap", 7, 9), ("claim", 9, 13), ("gap", 13, 19)]
    assert [(r.kind, r.segment) for r in got if r.check_id == 2] == [("gap", "no claims")]
