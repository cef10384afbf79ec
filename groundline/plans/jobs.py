"""The user-level jobs: ingesting, indexing, searching, asking, filling, checking, evaluating."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import archive_over_cap, base_name, child_upload_id, content_hash, content_type_for_name, detect_content_type, failed_file_ids, file_key, has_archive_magic, is_archive_type, needs_transcription, parse_answer, search_text, sidecar_json, tokens, verbatim_matches
from ..operators import answers, claims, files, near, search
from ..sources import io
from ..sources.tables import written

#: Types other than text/* whose bytes are texts (fixed values).
TEXT_TYPES = ["application/json", "application/xml"]
MODEL_TRIES, BACKOFF_S, MOST_BACKOFF_S = 4, 0.5, 8.0


class Ingested(NamedTuple):
    """files: landed records by content; kb_source: their searchable texts; failed: archives that gave no file; settled: upload ids that are done."""

    files: DataFrame
    kb_source: DataFrame
    failed: DataFrame
    settled: DataFrame


def _seen(uploads: DataFrame) -> DataFrame:
    """What ingest needs to know of each upload's bytes: all but upload_id, size and content is read from them once, and no bytes go on."""
    content = F.col("content")
    size = F.col("size").cast("long") if "size" in uploads.columns else F.octet_length("content").cast("long")
    return uploads.select("upload_id", size.alias("size"), content_hash(content).alias("hash"), F.octet_length(content).cast("long").alias("bytes"), detect_content_type(F.lit(None).cast("string"), content).alias("sniffed"), has_archive_magic(content).alias("magic"), F.is_valid_utf8(content.cast("string")).alias("utf8"))


def _once(seen: DataFrame) -> DataFrame:
    """One delivery of each upload, of such that differ always the same."""
    rest = F.struct(*[c for c in seen.columns if c != "upload_id"])
    return seen.groupBy("upload_id").agg(F.max_by(rest, F.struct("hash", "size")).alias("r")).select("upload_id", "r.*")


def ingest(uploads: DataFrame, pending: DataFrame, as_of: str, transcribe: Callable[[DataFrame], DataFrame] | None = None) -> Ingested:
    """uploads(upload_id, content[, size]), pending(id, owner_id, name, content_type, status, created_at) -> Ingested.

    Redelivered uploads and those without an open pending record change nothing. Equal bytes are one file, the last settler's with its declared
    type, or what the bytes show. size is the object's real size (as `read_uploads` and events give it); an archive beyond the cap fails by it
    without its bytes being unpacked, and `uploads` are filtered on size first, so that a source that pushes filters down doesn't load
    larger objects unless one of them is no archive. Archives are expanded into child uploads, whose ids come from the archive's hash and the entry's path, and
    these settle like any other at as_of for the archive's owner; an archive itself is never a file. One that is too large, can't be opened
    or holds no file fails. Texts in UTF-8 are searchable; images and PDFs are where `transcribe`, (file_id, content_type, content) ->
    (file_id, text), gives them a text. Others land without a knowledge source (searchable is false), and no upload's bytes can stop the job.
    Contents are hashed where they are read; only those of archives and of searchable files move, once.
    """
    now = F.lit(as_of).cast("timestamp")
    if "size" not in uploads.columns:
        uploads = uploads.withColumn("size", F.octet_length("content").cast("long"))
    open_ = pending.where("status != 'failed'").select(F.col("id").alias("upload_id"), "owner_id", "name", "content_type", F.col("created_at"))
    zipped = is_archive_type(F.col("content_type"))
    large = uploads.where(archive_over_cap(F.col("size")))
    over = large.select("upload_id").distinct().join(open_.where(zipped), "upload_id")
    loaded = uploads.where(~archive_over_cap(F.col("size"))).unionByName(large.join(open_.where(~zipped | zipped.isNull()), "upload_id", "left_semi").select(*uploads.columns))

    settled = written(_once(_seen(loaded)).join(open_, "upload_id"), "settled")
    packed = zipped & F.col("magic")
    direct = settled.where(~packed | packed.isNull())
    archives = settled.where(packed)

    # Equal archives are expanded once, for the last settler's owner.
    last = archives.groupBy("hash").agg(F.max_by(F.struct("owner_id", "upload_id"), F.struct("created_at", "upload_id")).alias("r")).select("hash", "r.*")
    bytes_of = loaded.select("upload_id", content_hash(F.col("content")).alias("hash"), "content").join(last, ["upload_id", "hash"]).dropDuplicates(["hash"])
    entries = written(io.expand_archives(bytes_of.select(F.col("hash").alias("archive_id"), "content")), "entries")
    staged = entries.where("path is not null").join(last.select(F.col("hash").alias("archive_id"), "owner_id"), "archive_id")
    children = staged.select(child_upload_id(F.col("archive_id"), F.col("path")).alias("upload_id"), "size", "content", "owner_id", base_name(F.col("path")).alias("name"), content_type_for_name(F.col("path")).alias("content_type"))
    born = _once(_seen(children)).join(children.select("upload_id", "owner_id", "name", "content_type").dropDuplicates(["upload_id"]), "upload_id")

    # Whoever settles last gives a file its record. Children settle at as_of, after all that was pending before.
    both = direct.withColumn("late", F.lit(0)).unionByName(born.withColumns({"late": F.lit(1), "created_at": F.lit(None).cast(settled.schema["created_at"].dataType)}))
    specific = F.when(~F.col("content_type").isin("", "application/octet-stream"), F.col("content_type"))
    record = F.struct("owner_id", "name", "upload_id", "created_at", "late", F.coalesce(specific, "sniffed").alias("content_type"), "bytes", "utf8")
    landed = both.groupBy(F.col("hash").alias("id")).agg(F.max_by(record, F.struct("late", "created_at", "upload_id")).alias("r"), F.count(F.lit(1)).alias("copies")).select("id", "r.*", "copies")
    landed = written(landed, "landed")

    kind = F.col("content_type")
    plain = (kind.startswith("text/") | kind.isin(*TEXT_TYPES)) & F.col("utf8")
    wanted = landed.where(plain | needs_transcription(kind) if transcribe else plain).select("id", "upload_id", "content_type")
    bodies = loaded.select("upload_id", "content").unionByName(children.select("upload_id", "content")).join(wanted, "upload_id").where(content_hash(F.col("content")) == F.col("id"))
    bodies = bodies.dropDuplicates(["upload_id"]).select(F.col("id").alias("file_id"), "content_type", "content")
    texts = bodies.where(~needs_transcription(kind)).select("file_id", F.col("content").cast("string").alias("text"))
    if transcribe:
        texts = written(texts.unionByName(transcribe(bodies.where(needs_transcription(kind))).select("file_id", "text")), "texts")
        landed = landed.join(texts.select(F.col("file_id").alias("id"), F.lit(True).alias("searchable")), "id", "left").withColumn("searchable", F.coalesce("searchable", F.lit(False)))
    else:
        landed = landed.withColumn("searchable", F.coalesce(plain, F.lit(False)))
    landed = landed.withColumns({"size": F.col("bytes"), "created_at": F.when(F.col("late") == 1, now.cast(settled.schema["created_at"].dataType)).otherwise(F.col("created_at")), "key": file_key(F.col("id")), "status": F.lit("landed"), "updated_at": now})
    kb = landed.select(F.col("id").alias("file_id"), F.col("name").alias("file_name"), "owner_id", sidecar_json(F.col("id"), F.col("name")).alias("sidecar")).join(texts, "file_id")

    outcome = files.archive_outcome(archives.select(F.col("hash").alias("archive_id"), F.lit(True).alias("readable")).distinct(), staged)
    broken = entries.where("error is not null").select("archive_id").distinct().withColumn("broken", F.lit(True))
    empty = outcome.where("status = 'failed'").join(broken, "archive_id", "left").select(F.col("archive_id").alias("hash"), F.when(F.col("broken"), "archive could not be opened").otherwise("archive holds no file").alias("reason"))
    lost = archives.join(empty, "hash").select("upload_id", "owner_id", "name", "content_type", "created_at", "reason")
    lost = lost.unionByName(over.select("upload_id", "owner_id", "name", "content_type", "created_at", F.lit("archive is too large").alias("reason")))
    failed = lost.withColumnRenamed("upload_id", "id").withColumns({"status": F.lit("failed"), "updated_at": now})
    done = settled.select("upload_id").join(lost.select("upload_id"), "upload_id", "left_anti")
    names = ["id", "owner_id", "key", "name", "content_type", "size", "status", "searchable", "copies", "upload_id", "created_at", "updated_at"]
    return Ingested(landed.select(*names), kb, failed, done)


def lexical_index(passages: DataFrame) -> dict[str, DataFrame]:
    """segments, stats and frequencies of the passages, each written once, and postings; passages that nothing else reads need not be written for it."""
    segments = written(search.segments_of(passages), "segments", search.SEGMENT_FILES)
    return {"segments": segments, "postings": search.postings_of(segments), "stats": written(search.stats_of(segments), "stats"), "frequencies": written(search.frequencies_of(segments), "frequencies")}


def build_index(kb_source: DataFrame, vectors: DataFrame | None = None) -> dict[str, DataFrame]:
    """passages, segments, stats and frequencies, each written once, so that searches don't cut and count the texts again; postings are the segments as rows.

    With vectors(passage_id, vector) also their inverted-file index: `centroids` and `lists` (see `near.vector_index`).
    """
    passages = written(search.passages_of(kb_source), "passages")
    index = {"passages": passages} | lexical_index(passages)
    if vectors is not None:
        centroids, lists = near.vector_index(written(vectors, "vectors"))
        index |= {"centroids": written(centroids, "centroids"), "lists": written(lists, "lists")}
    return index


def _written_hits(hits: DataFrame) -> DataFrame:
    """hits as a table: Spark knows its size then, and doesn't shuffle all passages to give some of them their texts."""
    return written(hits, "hits")


def _best_passages(queries: DataFrame, index: dict[str, DataFrame], k: int) -> DataFrame:
    return search.lexical_top(queries, index["segments"], index["stats"], index["frequencies"], k)


def lexical_search(queries: DataFrame, index: dict[str, DataFrame], k: int) -> DataFrame:
    """The k best passages of each query by BM25, with their texts."""
    return _written_hits(_best_passages(queries, index, k)).join(index["passages"].select("passage_id", "file_name", "text"), "passage_id")


def hybrid_search(queries: DataFrame, index: dict[str, DataFrame], query_vectors: DataFrame, k: int, depth: int = 50, probes: int | None = near.PROBES) -> DataFrame:
    """BM25 and vector rankings of `depth` each, fused: query_id, rank, passage_id, file_id, file_name, text, score.

    query_vectors(query_id, vector); a query without one has the lexical half only. `probes` lists of the vector index are searched for each query,
    None all of them, which is exact.
    """
    lexical = _best_passages(queries, index, depth)
    vector = near.vector_search(query_vectors, index["centroids"], index["lists"], depth, probes)
    return _written_hits(search.fuse(lexical, vector, k)).join(index["passages"], "passage_id").select("query_id", "rank", "passage_id", "file_id", "file_name", "text", "score")


def find_owned(queries: DataFrame, index: dict[str, DataFrame], owners: DataFrame, k: int) -> DataFrame:
    """The k best passages by BM25 among those that the query's owner has: foreign ones don't use up the limit."""
    return _written_hits(search.owned_top(queries, index["segments"], index["stats"], index["frequencies"], owners, k)).join(index["passages"].select("passage_id", "file_name", "text"), "passage_id")


def find(queries: DataFrame, index: dict[str, DataFrame], k: int, embed: Callable[[DataFrame], DataFrame] | None, probes: int | None = near.PROBES) -> DataFrame:
    """Hybrid search where there is `embed`, (query_id, text) -> (query_id, vector), and the index has vectors; else by BM25 alone."""
    if embed is None or "lists" not in index:
        return lexical_search(queries, index, k)
    return hybrid_search(queries, index, embed(queries.select("query_id", "text")), k, probes=probes)


def owned_candidates(hits: DataFrame, requests: DataFrame, owners: DataFrame, most: int = claims.MOST_CANDIDATES) -> DataFrame:
    """hits merged by file, foreign files dropped after retrieval, the first `most` kept: query_id, file_id, text, pos."""
    merged = search.merge_passages_by_file(hits).join(requests.select("query_id", "owner_id"), "query_id")
    return search.limit_candidates(search.scope_to_owner(merged, owners), most)


_NEGATION = ["not", "no", "never", "none", "nor"]


def propose_lexical(claim_rows: DataFrame, candidates: DataFrame, overlap: float = 0.6) -> DataFrame:
    """A stand-in for a model's proposals: claim_rows(check_id, claim_idx, claim), candidates(check_id, claim_idx, file_id, candidate_text).

    Each sentence of a candidate that restates the claim is verbatim; one that shares at least `overlap` of its distinct words
    is a paraphrase, or contradicts where just one of the two holds a negation. Findings stand by file and sentence.
    """
    texts = candidates.select("file_id", F.col("candidate_text").alias("text"), "check_id", F.col("claim_idx").alias("own_idx"), "pos")
    split = claims.split_claims(texts, ["check_id", "own_idx", "file_id", "pos"])
    sentences = split.select("check_id", F.col("own_idx").alias("_claim"), "file_id", "pos", F.col("claim_idx").alias("sentence"), F.col("claim").alias("span"))
    both = claim_rows.withColumnRenamed("claim_idx", "_claim").join(sentences, ["check_id", "_claim"])
    mine, theirs = F.array_distinct(tokens(F.col("claim"))), F.array_distinct(tokens(F.col("span")))
    shared = F.size(F.array_intersect(mine, theirs)) / F.size(mine)
    negated = lambda t: F.arrays_overlap(t, F.array(*map(F.lit, _NEGATION)))
    relation = F.when(verbatim_matches(F.col("claim"), F.col("span")), "verbatim").when(shared >= overlap, F.when(negated(mine) != negated(theirs), "contradicts").otherwise("paraphrase"))
    found = both.withColumn("relation", relation).where("relation is not null")
    idx = F.col("pos").cast("long") * 1_000_000 + F.col("sentence")
    return found.select("check_id", F.col("_claim").alias("claim_idx"), idx.alias("idx"), "file_id", "span", "relation")


def check(requests: DataFrame, index: dict[str, DataFrame], owners: DataFrame, propose: Callable[[DataFrame, DataFrame], DataFrame] = propose_lexical, k: int = 12, embed: Callable[[DataFrame], DataFrame] | None = None, probes: int | None = near.PROBES) -> dict[str, DataFrame]:
    """requests(check_id, owner_id, text) -> claims with verdicts, capped references, failed checks.

    The verdict is of all gated references, the cap comes after. Checks of blank or overlong text or of more than
    500 claims fail. A reference's span stands in its candidate's text byte for byte. Candidates come from `find`; with `embed` it is hybrid.
    """
    valid, bad = answers.validate_checks(requests)
    rows = claims.split_claims(valid.select("check_id", "text"), ["check_id"])
    many = rows.groupBy("check_id").count().where(F.col("count") > claims.MOST_CLAIMS).select("check_id")
    rows = written(rows.join(many, "check_id", "left_anti"), "claims")
    asked = rows.join(requests.select("check_id", "owner_id"), "check_id").select(F.struct("check_id", "claim_idx").alias("query_id"), F.col("claim").alias("text"), "owner_id")
    hits = find(asked, index, k, embed, probes)
    offered = owned_candidates(hits, asked, owners).select("query_id.check_id", "query_id.claim_idx", "file_id", F.col("text").alias("candidate_text"), "pos")
    offered = written(offered, "candidates")
    matched = claims.match_findings_to_candidates(propose(rows, offered), offered.drop("pos"))
    references = written(claims.gate_findings(matched.join(rows.select("check_id", "claim_idx", "claim"), ["check_id", "claim_idx"])), "references")
    failed = bad.select("check_id", "reason").unionByName(many.select("check_id", F.lit("too many claims").alias("reason")))
    return {"verdicts": claims.claim_verdict(rows, references), "references": claims.cap_references(references), "failed": failed}


def model_map(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], op: str, model: str = "scripted", tries: int = MODEL_TRIES, partitions: int | None = None) -> DataFrame:
    """Batches of df(id, prompt) through `fn`, which returns id, reply, input_tokens, output_tokens -> one row per attempt.

    A batch that raises is tried again, with full jitter; every attempt is a row (ok, error, attempt). If it never works, its halves are tried
    once each, and so on, so that a prompt which a model can't take fails alone. The last attempt's rows carry the replies.
    `partitions` bounds how many batches run at once.
    """

    def attempt(batch: pd.DataFrame, number: int) -> pd.DataFrame:
        base = pd.DataFrame({"id": batch["id"], "op": op, "model": model, "prompt": batch["prompt"], "attempt": number})
        try:
            got = batch[["id"]].merge(fn(batch).drop_duplicates("id"), on="id", how="left")
            there = got["reply"].notna().to_numpy()
            counts = {c: got[c].fillna(0).astype(int).to_numpy() for c in ("input_tokens", "output_tokens")}
            return base.assign(reply=got["reply"].to_numpy(), **counts, ok=there, error=np.where(there, None, "no reply"))
        except Exception as e:  # the model is the caller's; any failure of it is a failed attempt
            return base.assign(reply=None, input_tokens=0, output_tokens=0, ok=False, error=f"{type(e).__name__}: {e}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            waiting = [(batch.reset_index(drop=True), 1, tries)]
            while waiting:
                part, number, left = waiting.pop(0)
                out = attempt(part, number)
                yield out
                if out["ok"].any() or not len(part):
                    continue
                if left > 1:
                    time.sleep(random.uniform(0, min(MOST_BACKOFF_S, BACKOFF_S * 2 ** (number - 1))))
                    waiting.append((part, number + 1, left - 1))
                elif len(part) > 1:
                    half = len(part) // 2
                    waiting += [(part.iloc[:half].reset_index(drop=True), number + 1, 1), (part.iloc[half:].reset_index(drop=True), number + 1, 1)]

    kind = df.schema["id"].dataType.simpleString()
    spread = df.select("id", "prompt").repartition(partitions) if partitions else df.select("id", "prompt")
    return spread.mapInPandas(run, f"id {kind}, op string, model string, prompt string, attempt int, reply string, input_tokens long, output_tokens long, ok boolean, error string")


def ask(requests: DataFrame, index: dict[str, DataFrame], owners: DataFrame, replies: Callable[[DataFrame], DataFrame], k: int = 20, embed: Callable[[DataFrame], DataFrame] | None = None, probes: int | None = near.PROBES, scope: str = "post") -> tuple[DataFrame, DataFrame]:
    """requests(query_id, owner_id, text) -> answers(query_id, owner_id, answer, file_ids, error) and their cited files that the owner has.

    `replies` maps (query_id, owner_id, text, passages) to (query_id, reply[, error]): a model by `by_model` or a table of scripted replies. A query
    whose reply failed has an error and no answer. scope "post" drops foreign passages after the limit, "pre" before it (BM25 alone).
    """
    hits = find_owned(requests, index, owners, k) if scope == "pre" else find(requests, index, k, embed, probes)
    hits = hits.join(requests.select("query_id", "owner_id"), "query_id")
    seen = answers.passages_json(search.scope_to_owner(hits, owners))
    prompts = requests.join(seen, "query_id", "left").withColumn("passages", F.coalesce("passages", F.lit("[]")))
    said = replies(prompts)
    if "error" not in said.columns:
        said = said.withColumn("error", F.lit(None).cast("string"))
    said = written(said.select("query_id", "reply", "error"), "replies")  # a model is asked once, however often its replies are read
    parsed = said.select("query_id", F.when(F.col("error").isNull(), parse_answer(F.col("reply"))).alias("a"), "error").join(requests.select("query_id", "owner_id"), "query_id")
    out = parsed.select("query_id", "owner_id", "a.answer", "a.file_ids", "error")
    return out, answers.load_cited(out, owners)


def by_model(fn: Callable[[pd.DataFrame], pd.DataFrame], op: str, prompt: Callable[[DataFrame], Column], **more) -> Callable[[DataFrame], DataFrame]:
    """`replies` for `ask` and `fill` by a model: prompt(df) is the text of a row; the last attempt's reply stands, or its error."""

    def replies(prompts: DataFrame) -> DataFrame:
        key = F.to_json(F.struct("query_id"))
        trace = model_map(prompts.select(key.alias("id"), prompt(prompts).alias("prompt")), fn, op, **more)
        last = trace.groupBy("id").agg(F.max_by(F.struct("reply", "error"), F.struct("ok", "attempt")).alias("r"))
        error = F.when(F.col("r.reply").isNull(), F.coalesce("r.error", F.lit("no reply")))
        return prompts.select("query_id", key.alias("id")).join(last, "id").select("query_id", "r.reply", error.alias("error"))

    return replies


def fill(forms: DataFrame, index: dict[str, DataFrame], owners: DataFrame, replies: Callable[[DataFrame], DataFrame], k: int = 20, embed: Callable[[DataFrame], DataFrame] | None = None, probes: int | None = near.PROBES) -> tuple[DataFrame, DataFrame]:
    """forms(form_id, owner_id, fields) -> a row per field in the form's order, and rejected forms.

    Every field is a question of its own to `ask`; rows are form_id, pos, field, value, found, error, sources (ids of the cited files that the owner has, in
    citation order). A field without such a source has no value; one whose reply failed has an error, which is no miss, and fails no other field.
    """
    good, bad = answers.validate_fields(forms)
    good = written(good.select("form_id", "owner_id", "fields"), "forms")
    asked = good.select(F.posexplode("fields").alias("pos", "text"), "form_id", "owner_id").select(F.struct("form_id", "pos").alias("query_id"), "owner_id", "text")
    said, cited = ask(asked, index, owners, replies, k, embed, probes)
    listed = cited.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "file_id"))), lambda x: x["file_id"]).alias("sources"))
    none = F.array().cast("array<string>")
    results = said.join(listed, "query_id", "left").select("query_id.form_id", "query_id.pos", F.col("answer").alias("value"), F.coalesce("sources", none).alias("sources"), "error")
    rows = answers.fill_answers(good, results)
    return rows.join(results.select("form_id", "pos", "sources"), ["form_id", "pos"], "left").withColumn("sources", F.coalesce("sources", none)), bad


def run_evals(cases: DataFrame, replies: Callable[[DataFrame], DataFrame] | None = None, k: int = 20) -> DataFrame:
    """Golden cases (`io.read_golden_cases`) -> case, n_expected, n_cited, passed.

    Each case's files are seeded as its owner's, in a world of their own, and its query goes through `ask` with the case's scripted final reply, or with
    `replies`. It passes where all expected files are among the cited ones that the owner has and the answer holds all expected texts.
    """
    owner = F.to_json(F.struct("name", "owner"))  # cases don't see each other's files
    own = F.concat_ws("/", "name", "file.id")
    files_ = cases.select("name", owner.alias("owner_id"), F.explode("files").alias("file")).select(own.alias("file_id"), F.col("file.name").alias("file_name"), "owner_id", search_text(F.col("file.name"), F.coalesce(F.col("file.meta"), F.create_map().cast("map<string,string>"))).alias("text"))
    files_ = written(files_, "seeds")
    asked = cases.select(F.col("name").alias("query_id"), owner.alias("owner_id"), F.col("query").alias("text"), F.col("script.final").alias("final"))

    def scripted(prompts: DataFrame) -> DataFrame:
        return prompts.select("query_id", F.coalesce("final", F.lit("")).alias("reply"))

    said, _ = ask(asked, build_index(files_), files_.select(F.col("file_id").alias("id"), "owner_id", F.col("file_name").alias("name")), replies or scripted, k)
    # Replies name a case's files by their own ids.
    named = said.withColumn("file_ids", F.transform("file_ids", lambda i: F.concat_ws("/", "query_id", i)))
    held = files_.select(F.col("file_id").alias("id"), "owner_id", F.col("file_name").alias("name"))
    cited = answers.load_cited(named, held).groupBy("query_id").agg(F.collect_list(F.expr("substring(file_id, length(query_id) + 2)")).alias("cited"))
    given = said.join(cited, "query_id", "left").select(F.col("query_id").alias("case"), "answer", F.coalesce("cited", F.array().cast("array<string>")).alias("cited"))
    none = F.array().cast("array<string>")
    expected = cases.select(F.col("name").alias("case"), F.coalesce("expect.fileIds", none).alias("expected_ids"), F.coalesce("expect.answerContains", none).alias("contains"))
    return answers.eval_report(expected, given)


def verify(tasks: DataFrame, checks: DataFrame, index: dict[str, DataFrame], owners: DataFrame, as_of: str, **more) -> DataFrame:
    """tasks(check_id, owner_id, deadline), checks(id, owner_id, text) -> check_id, status, reason, claim_idx, verdict, n_refs: a row per claim, or one of a failed check.

    A task for a check that isn't there or is another owner's is refused: no row of the check changes, its row has the status refused. A task
    whose deadline has passed at as_of, and a check that `check` refuses, fail with a reason. A check without claims is done with a row without verdict.
    `more` goes to `check`.
    """
    held = checks.select(F.col("id").alias("check_id"), F.col("owner_id").alias("_owner"), "text", F.lit(True).alias("_there"))
    joined = tasks.dropDuplicates(["check_id", "owner_id"]).join(held, "check_id", "left")
    refused = F.when(F.col("_there").isNull(), "no such check").when(~F.col("owner_id").eqNullSafe(F.col("_owner")), "the check is another owner's")
    late = F.when(F.col("deadline") <= F.lit(as_of).cast("timestamp"), "the deadline has passed")
    judged = written(joined.withColumns({"refused": refused, "late": late}), "tasks")
    run = judged.where("refused is null and late is null").select("check_id", "owner_id", "text")
    out = check(run, index, owners, **more)
    none = [F.lit(None).cast("int").alias("claim_idx"), F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("long").alias("n_refs")]
    say = lambda status, reason: [F.lit(status).alias("status"), reason.alias("reason")]
    nothing = F.lit(None).cast("string")
    verdicts = written(out["verdicts"].select("check_id", *say("done", nothing), "claim_idx", "verdict", "n_refs"), "verdicts")
    failed = out["failed"].select("check_id", *say("failed", F.col("reason")), *none)
    idle = run.select("check_id").join(verdicts, "check_id", "left_anti").join(failed, "check_id", "left_anti").select("check_id", *say("done", nothing), *none)
    stopped = judged.where("refused is not null or late is not null").select("check_id", F.when(F.col("refused").isNotNull(), "refused").otherwise("failed").alias("status"), F.coalesce("refused", "late").alias("reason"), *none)
    return verdicts.unionByName(failed).unionByName(idle).unionByName(stopped)


def sync_landed(records: DataFrame, reasons: DataFrame, completed: bool = True, batch: int = 100) -> DataFrame:
    """records after an index run: up to `batch` landed files become ingested, or failed where a reason names them."""
    if not completed:
        return records
    landed = files.list_by_status(records, "landed", batch)
    failed = reasons.select(F.explode(failed_file_ids(F.array("reason"))).alias("id"))
    return files.advance_status(records, files.sync_decisions(landed, failed))


def tool_loop(conversations: DataFrame, step: Callable[[DataFrame, int], DataFrame], answer_tools: Callable[[DataFrame], DataFrame], most_rounds: int = 6) -> DataFrame:
    """conversations(id, prompt) -> (id, reply, rounds, error): batches of open conversations go through `step` until they answer.

    step(open, round) gives (id, tool, argument, reply); rows with a tool are answered by `answer_tools` (id, result), whose
    result is added to the prompt; a null result is an error fed back. What is open after the last round fails, its tools unrun.
    """
    done, open_rows = None, conversations.select("id", "prompt")
    for n in range(1, most_rounds + 1):
        said = written(step(open_rows, n).join(open_rows, "id"), "round")
        ended = said.where("tool is null").select("id", "reply", F.lit(n).alias("rounds"), F.lit("").alias("error"))
        done = ended if done is None else done.unionByName(ended)
        asked = said.where("tool is not null")
        if n == most_rounds:
            return done.unionByName(asked.select("id", F.lit(None).cast("string").alias("reply"), F.lit(n).alias("rounds"), F.lit("too many rounds").alias("error")))
        result = answer_tools(asked.select("id", "tool", "argument"))
        open_rows = asked.join(result, "id", "left").select("id", F.concat_ws("\n", "prompt", F.coalesce("result", F.lit("error"))).alias("prompt"))
    return done
