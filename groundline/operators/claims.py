"""Claims: splitting texts into sentences, gating proposed spans, verdicts, coverage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import gate_relation, locate_span, parse_findings, slice_bytes, verify_span

#: Dot-ended words that close no sentence (fixed values).
ABBREVIATIONS = ["mr", "mrs", "ms", "dr", "prof", "v", "vs", "no", "cl", "s", "ss", "art", "para", "p", "pp", "approx", "e.g", "i.e", "etc", "cf"]
_S, _E = "\ue000", "\ue001"
MOST_CLAIMS, MOST_CANDIDATES, MOST_REFERENCES = 500, 3, 5


#: Sentence ends: a run of enders; then, of the marked runs, those that close no sentence. Only where a dot is marked are the costlier looks back taken.
RUNS = r"([.!?][.!?\"')\]]*[”’»›]*)"
_DOT = rf"{_S}(\.[^{_E}]*){_E}"
_WORDS = "|".join(a.replace(".", rf"{_S}?\.{_E}?") for a in ABBREVIATIONS)
KEEPS_ON = rf"(?={_S}\.)(?:(?i:(?<=(?:^|[ \t\n(\"]{_E}?)(?:{_WORDS}|[a-z])){_DOT})|(?<=[0-9]){_DOT}(?=[0-9])|{_DOT}(?=[ \t]*\p{{Ll}}))"
#: Marks that a text holds itself become others of the same width.
MARKS, OTHER_MARKS = _S + _E, "\ue010\ue011"


def _marked(text: Column) -> Column:
    """The text with an end mark after each sentence and line."""
    runs = F.regexp_replace(F.translate(text, MARKS, OTHER_MARKS), RUNS, f"{_S}$1{_E}")
    closed = F.regexp_replace(F.regexp_replace(runs, KEEPS_ON, "$1$2$3"), _S, "")
    return F.regexp_replace(closed, "\n", "\n" + _E)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row however often `use` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _starts(sizes: Column) -> Column:
    """For each number of an array the sum of those before it, in chunks, so that long arrays aren't copied for each number."""
    grow = lambda done, n: F.array_append(done, F.element_at(done, F.lit(-1)) + n)
    zero = F.array(F.lit(0).cast("long"))
    chunks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(sizes), F.lit(1)), F.lit(256)), lambda i: F.slice(sizes, i, F.lit(256)))

    def joined(sums: Column) -> Column:
        before = F.aggregate(F.transform(sums, lambda s: F.element_at(s, F.lit(-1))), zero, grow)
        return F.flatten(F.zip_with(sums, F.slice(before, F.lit(1), F.size(sums)), lambda s, base: F.transform(F.slice(s, F.lit(1), F.size(s) - 1), lambda x: x + base)))

    return _let(F.transform(chunks, lambda c: F.aggregate(c, zero, grow)), joined)


def split_claims(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """texts(keys, text) -> keys, claim_idx, claim, start, end: each sentence and its byte range; nothing without a letter or digit.

    Each row is split by itself, so rows of equal or null keys stay apart. Null and empty texts have no claim.
    """
    blank = F.lit(" \t\n\r")
    own = F.col(text)

    def placed(piece: Column, start: Column, marked: Column) -> Column:
        first = start + F.octet_length(piece) - F.octet_length(F.ltrim(piece, blank))
        end = first + F.octet_length(F.btrim(piece, blank))
        # Marks that the text holds itself were changed in the piece.
        claim = F.when(marked, slice_bytes(own, first.cast("int"), end.cast("int"))).otherwise(F.btrim(piece, blank))
        return F.struct(claim.alias("claim"), first.cast("long").alias("start"), end.cast("long").alias("end"), piece.rlike(r"[\p{L}\p{Nd}]").alias("says"))

    def claims_of(pieces: Column, marked: Column) -> Column:
        sizes = F.transform(pieces, lambda p: F.octet_length(p).cast("long"))
        return F.filter(F.zip_with(pieces, _let(sizes, _starts), lambda piece, start: placed(piece, start, marked)), lambda x: x["says"])

    found = _let(F.split(_marked(own), _E), lambda pieces: _let(own.rlike(f"[{_S}{_E}]"), lambda marked: claims_of(pieces, marked)))
    return texts.select(*keys, F.posexplode(found).alias("claim_idx", "_c")).select(*keys, "claim_idx", "_c.claim", "_c.start", "_c.end")


def match_findings_to_candidates(findings: DataFrame, candidates: DataFrame) -> DataFrame:
    """Findings (check_id, claim_idx, idx, file_id, span, relation) of files that were offered for their claim."""
    return findings.join(candidates, ["check_id", "claim_idx", "file_id"])


def gate_findings(matched: DataFrame) -> DataFrame:
    """Matched findings with claim and candidate_text -> references; a span that isn't there or an unknown relation is discarded."""
    at = locate_span(F.col("candidate_text"), F.col("span"))
    placed = matched.withColumn("at", at).withColumn("gated", gate_relation(F.col("relation"), F.col("claim"), F.col("span")))
    sure = verify_span(F.col("candidate_text"), F.col("span"), F.col("at.start"), F.col("at.end"))
    return placed.where(F.col("at").isNotNull() & F.col("gated").isNotNull() & sure).select(
        "check_id", "claim_idx", "idx", "file_id", F.col("span").alias("span_text"), F.col("at.start").alias("start"), F.col("at.end").alias("end"), F.col("gated").alias("relation")
    )


def findings_of_replies(replies: DataFrame) -> DataFrame:
    """replies(check_id, claim_idx, reply) -> one row per finding, in the reply's order."""
    return replies.select("check_id", "claim_idx", F.posexplode(parse_findings(F.col("reply"))).alias("idx", "f")).select("check_id", "claim_idx", "idx", F.col("f.fileId").alias("file_id"), "f.span", "f.relation")


def claim_verdict(claims: DataFrame, references: DataFrame) -> DataFrame:
    """claims(check_id, claim_idx, ...) with verdict and n_refs, from all gated references."""
    weight = F.when(F.col("relation") == "contradicts", 3).when(F.col("relation") == "verbatim", 2).when(F.col("relation") == "paraphrase", 1)
    best = references.groupBy("check_id", "claim_idx").agg(F.max(weight).alias("_w"), F.count(F.lit(1)).alias("_n"))
    verdict = F.when(F.col("_w") == 3, "disputed").when(F.col("_w") == 2, "verified").when(F.col("_w") == 1, "review").otherwise("unsupported")
    return claims.join(best, ["check_id", "claim_idx"], "left").withColumn("verdict", verdict).withColumn("n_refs", F.coalesce("_n", F.lit(0))).drop("_w", "_n")


def cap_references(references: DataFrame, most: int = MOST_REFERENCES) -> DataFrame:
    """At most `most` references per claim: where there are more, contradictions first, then the rest, each in its order."""
    claim = Window.partitionBy("check_id", "claim_idx")
    counted = references.withColumn("_n", F.count(F.lit(1)).over(claim))
    late = F.when(F.col("_n") > most, (F.col("relation") != "contradicts").cast("int")).otherwise(0)
    ranked = counted.withColumn("ref_idx", F.row_number().over(claim.orderBy(late, "idx")) - 1)
    return ranked.where(F.col("ref_idx") < most).drop("_n")


VERDICTS = ["disputed", "verified", "review", "unsupported"]


def verdict_tally(verdicts: DataFrame) -> DataFrame:
    """(check_id, pos, verdict, n): how many claims have each verdict, in fixed order, zeros left out."""
    pos = F.array_position(F.array(*map(F.lit, VERDICTS)), F.col("verdict")) - 1
    return verdicts.groupBy("check_id", "verdict").agg(F.count(F.lit(1)).alias("n")).select("check_id", pos.alias("pos"), "verdict", "n")


def assemble_checks(verdicts: DataFrame, references: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """(check_id, status, claims array<struct<..., references>>): one document per check, claims and references in order.

    Checks of failed(check_id) are failed and have no claims.
    """
    ref = F.struct("ref_idx", "file_id", "span_text", "start", "end", "relation")
    listed = references.groupBy("check_id", "claim_idx").agg(F.sort_array(F.collect_list(ref)).alias("references"))
    none = F.array().cast(listed.schema["references"].dataType)
    full = verdicts.join(listed, ["check_id", "claim_idx"], "left").withColumn("references", F.coalesce("references", none))
    claim = F.struct("claim_idx", "claim", "start", "end", "verdict", "references")
    done = full.groupBy("check_id").agg(F.sort_array(F.collect_list(claim)).alias("claims")).select("check_id", F.lit("done").alias("status"), "claims")
    if failed is None:
        return done
    lost = failed.select("check_id").distinct()
    empty = F.array().cast(done.schema["claims"].dataType)
    return done.join(lost, "check_id", "left_anti").unionByName(lost.select("check_id", F.lit("failed").alias("status"), empty.alias("claims")))


def grounding_coverage(verdicts: DataFrame) -> DataFrame:
    """Claims and their text bytes by verdict, per owner and check and rolled up (null: all of a level)."""
    out = verdicts.rollup("owner_id", "check_id").agg(
        *[F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in VERDICTS],
        F.sum(F.col("end") - F.col("start")).alias("claim_bytes"),
        F.coalesce(F.sum(F.when(F.col("verdict") == "verified", F.col("end") - F.col("start"))), F.lit(0)).alias("verified_bytes"),
    )
    return out


def claim_segments(checks: DataFrame) -> DataFrame:
    """checks(check_id, text, claims array<struct<start, end>>) -> check_id, seg_idx, kind (claim or gap), start, end, segment.

    Claims are taken by start; one that is empty, out of range, cuts a character or overlaps an accepted one is skipped.
    """
    raw = F.encode("text", "UTF-8")
    size = F.octet_length("text").cast("long")
    on_edge = lambda at: (at == size) | ~F.substring(F.hex(F.substring(raw, at.cast("int") + 1, 1)), 1, 1).isin("8", "9", "A", "B")
    bounds = "array<struct<start: bigint, end: bigint>>"
    ok = F.filter(F.sort_array(F.transform("claims", lambda c: F.struct(c["start"].cast("long").alias("start"), c["end"].cast("long").alias("end")))), lambda c: (c["start"] >= 0) & (c["end"] > c["start"]) & (c["end"] <= size) & on_edge(c["start"]) & on_edge(c["end"]))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(bounds).alias("out"))
    step = lambda s, c: F.when(c["start"] >= s["at"], F.struct(c["end"].alias("at"), F.concat(s["out"], F.array(c)).alias("out"))).otherwise(s)
    kept = checks.select("check_id", "text", size.alias("size"), F.aggregate(ok, start, step)["out"].alias("kept"))
    end_before = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(F.col("kept"), i - 1)["end"])
    runs = F.flatten(F.transform(F.concat("kept", F.array(F.struct(F.col("size").alias("start"), F.col("size").alias("end")))), lambda c, i: F.array(F.struct(F.lit("gap").alias("kind"), end_before(i).alias("start"), c["start"].alias("end")), F.struct(F.lit("claim").alias("kind"), c["start"].alias("start"), c["end"].alias("end")))))
    full = F.filter(runs, lambda r: r["end"] > r["start"])
    return kept.select("check_id", "text", F.posexplode(full).alias("seg_idx", "r")).select("check_id", "seg_idx", "r.kind", "r.start", "r.end", slice_bytes(F.col("text"), F.col("r.start"), F.col("r.end")).alias("segment"))
