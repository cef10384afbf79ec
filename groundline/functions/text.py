"""Column functions over texts, names, replies and keys. All are native expressions; offsets are UTF-8 bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FINDINGS = "array<struct<fileId: string, span: string, relation: string>>"
ANSWER = "struct<answer: string, fileIds: array<string>, _bad: string>"


def text_bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def slice_bytes(text: Column, start: Column, end: Column) -> Column:
    """The text between two byte offsets."""
    return F.decode(F.substring(text_bytes(text), start.cast("int") + 1, (end - start).cast("int")), "UTF-8")


def locate_span(text: Column, span: Column) -> Column:
    """struct<start, end> of the span's first exact occurrence; null where there is none or the span is empty."""
    at = F.instr(text, span)
    start = F.octet_length(F.substring(text, F.lit(1), at - 1))
    return F.when((at > 0) & (F.length(span) > 0), F.struct(start.cast("long").alias("start"), (start + F.octet_length(span)).cast("long").alias("end")))


def verify_span(text: Column, span: Column, start: Column, end: Column) -> Column:
    """True where the bytes from start to end are the span's; a range outside the text is false."""
    inside = (start >= 0) & (end >= start) & (end <= F.octet_length(text))
    same = F.substring(text_bytes(text), start.cast("int") + 1, (end - start).cast("int")) == text_bytes(span)
    return F.coalesce(inside & same, F.lit(False))


def normalize_for_match(text: Column) -> Column:
    """White space collapsed, edge punctuation trimmed, lower case."""
    collapsed = F.trim(F.regexp_replace(text, r"[\s\x{85}\p{Z}]+", " "))
    return F.lower(F.btrim(collapsed, F.lit(" .,;:!?\"'")))


def upper_letters(text: Column) -> Column:
    """Upper case letter by letter: a letter without a capital that comes back (like ß, whose capitals are two letters) stays."""
    back = lambda c: F.lower(F.substring(F.upper(c), 1, 8))  # noqa: E731  # all of it: Spark takes lower(upper(c)) for lower(c), which differ
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.when(back(c) == F.lower(c), F.upper(c)).otherwise(c)), "")


def verbatim_matches(claim: Column, span: Column) -> Column:
    return normalize_for_match(claim) == normalize_for_match(span)


def gate_relation(relation: Column, claim: Column, span: Column) -> Column:
    """The relation that may be stored; null for an unknown one. A verbatim claim that the span doesn't restate is a paraphrase."""
    return F.when((relation == "verbatim") & ~verbatim_matches(claim, span), "paraphrase").when(relation.isin("verbatim", "paraphrase", "contradicts"), relation)


def parse_findings(reply: Column) -> Column:
    """The JSON array between the first `[` and the last `]`; anything malformed is an empty array."""
    return F.coalesce(F.from_json(F.regexp_extract(reply, r"(?s)\[.*\]", 0), FINDINGS), F.array().cast(FINDINGS))


def parse_answer(reply: Column) -> Column:
    """struct<answer, file_ids> of the JSON object between the first `{` and the last `}`, or the trimmed reply without ids."""
    found = F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), ANSWER, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    good = found.isNotNull() & found["_bad"].isNull() & reply.contains("{")
    none = F.array().cast("array<string>")
    trimmed = F.regexp_replace(reply, r"^\s+|\s+$", "")
    return F.struct(F.when(good, F.coalesce(found["answer"], F.lit(""))).otherwise(trimmed).alias("answer"), F.when(good, F.coalesce(found["fileIds"], none)).otherwise(none).alias("file_ids"))


def truncate_utf8(text: Column, most: int) -> Column:
    """At most `most` bytes, never a part of a character."""
    raw = text_bytes(text)
    goes_on = lambda at: F.substring(F.hex(F.substring(raw, at + 1, 1)), 1, 1).isin("8", "9", "A", "B")
    cut = F.lit(most)
    for back in (1, 2, 3):
        cut = F.when((cut == most - back + 1) & goes_on(most - back + 1), F.lit(most - back)).otherwise(cut)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.substring(raw, F.lit(1), F.greatest(cut, F.lit(0))), "UTF-8"))


def search_text(name: Column, meta: Column) -> Column:
    """The name, then `key: value` lines by key."""
    lines = F.transform(F.array_sort(F.map_keys(meta)), lambda k: F.concat(k, F.lit(": "), F.coalesce(F.element_at(meta, k), F.lit(""))))
    return F.concat_ws("\n", name, lines)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def child_upload_id(parent_hash: Column, path: Column) -> Column:
    return F.sha2(F.concat(parent_hash, F.lit("\0"), path), 256)


def file_key(file_id: Column) -> Column:
    return F.concat(F.lit("files/"), file_id)


def upload_key(upload_id: Column) -> Column:
    return F.concat(F.lit("uploads/"), upload_id)


def kb_key(file_id: Column) -> Column:
    return F.concat(F.lit("kb/"), file_id)


def sidecar_key(file_id: Column) -> Column:
    return F.concat(F.lit("kb/"), file_id, F.lit(".metadata.json"))


def id_of_key(key: Column) -> Column:
    """The id in any of the keys above."""
    return F.regexp_replace(F.regexp_replace(key, "^(files|uploads|kb)/", ""), r"\.metadata\.json$", "")


def sidecar_json(file_id: Column, name: Column) -> Column:
    return F.to_json(F.struct(F.struct(file_id.alias("fileId"), name.alias("fileName")).alias("metadataAttributes")))


def failed_file_ids(reasons: Column) -> Column:
    """File ids of the storage addresses in free texts, each once, as they come."""
    found = F.flatten(F.transform(reasons, lambda r: F.regexp_extract_all(r, F.lit(r's3://[^\s,\]"]+'), F.lit(0))))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(F.element_at(F.split(u, "/"), -1), r"\.metadata\.json$", "")))


def status_class(code: Column) -> Column:
    return F.concat(F.floor(code / 100).cast("string"), F.lit("xx"))


def method_label(method: Column) -> Column:
    return F.when(method.isin("GET", "POST", "PUT", "PATCH", "DELETE", "OPTIONS", "HEAD"), method).otherwise("other")


#: Methods and paths that the service knows (fixed values).
ROUTES = {
    "POST /files": "^/files$", "GET /files": "^/files$", "GET /files/{id}": "^/files/[^/]+$", "PATCH /files/{id}": "^/files/[^/]+$",
    "DELETE /files/{id}": "^/files/[^/]+$", "POST /ask": "^/ask$", "POST /fill": "^/fill$", "POST /checks": "^/checks$",
    "GET /checks/{id}": "^/checks/[^/]+$", "GET /calls": "^/calls$", "POST /metrics/time-to-file": "^/metrics/time-to-file$", "GET /health": "^/health$",
}


def route_label(method: Column, path: Column) -> Column:
    label = F
    for name, pattern in ROUTES.items():
        label = label.when((method == name.split()[0]) & path.rlike(pattern), name)
    return label.otherwise("unmatched")


def is_retryable(status: Column) -> Column:
    return status.isin(408, 429) | (status >= 500)


def file_tag(name: Column) -> Column:
    """Up to four upper-case characters of the extension, or FILE."""
    ext = F.regexp_extract(name, r"^.+\.([^.]+)$", 1)
    return F.when(ext == "", "FILE").otherwise(F.upper(F.substring(ext, 1, 4)))


def case_date(meta: Column) -> Column:
    """meta.date as yyyy-MM-dd, or null."""
    return F.to_date(F.try_to_timestamp(F.element_at(meta, F.lit("date")), F.lit("yyyy-MM-dd")))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_ext(path: Column) -> Column:
    """The extension with its dot, in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1))


#: Extensions and media types that archives' entries get (fixed values).
MEDIA_TYPES = {
    ".csv": "text/csv", ".gif": "image/gif", ".htm": "text/html", ".html": "text/html", ".jpeg": "image/jpeg", ".jpg": "image/jpeg",
    ".json": "application/json", ".md": "text/markdown", ".pdf": "application/pdf", ".png": "image/png", ".txt": "text/plain", ".webp": "image/webp",
    ".xml": "text/xml", ".zip": "application/zip",
}


def content_type_for_name(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return F.coalesce(F.element_at(table, file_ext(name)), F.lit("application/octet-stream"))


def needs_transcription(content_type: Column) -> Column:
    return content_type.startswith("image/") | (content_type == "application/pdf")


#: First bytes, in hexadecimal, and the type they show (published file signatures).
MAGIC = {"FFD8FF": "image/jpeg", "89504E470D0A1A0A": "image/png", "474946383761": "image/gif", "474946383961": "image/gif", "25504446": "application/pdf", "504B0304": "application/zip"}


def detect_content_type(declared: Column, content: Column) -> Column:
    """A specific declared type, else what the first bytes show."""
    head = F.hex(F.substring(content, 1, 512))
    sniffed = F
    for magic, kind in MAGIC.items():
        sniffed = sniffed.when(head.startswith(magic), kind)
    sniffed = sniffed.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
    text = F.decode(F.substring(content, 1, 512), "ISO-8859-1")
    sniffed = sniffed.when(F.lower(text).rlike(r"^\s*(<!doctype html|<html|<head|<body)"), "text/html")
    sniffed = sniffed.when(text.rlike(r"[\x00-\x08\x0e-\x1a\x1c-\x1f]"), "application/octet-stream").otherwise("text/plain")
    specific = declared.isNotNull() & ~declared.isin("", "application/octet-stream")
    return F.when(specific, declared).otherwise(sniffed)


ARCHIVE_CAP = 512 << 20


def is_archive_type(content_type: Column) -> Column:
    return content_type.isin("application/zip", "application/x-zip-compressed")


def has_archive_magic(content: Column) -> Column:
    return F.hex(F.substring(content, 1, 4)) == "504B0304"


def is_archive(content_type: Column, content: Column) -> Column:
    return is_archive_type(content_type) & has_archive_magic(content)


def archive_over_cap(size: Column) -> Column:
    return size > ARCHIVE_CAP


def clamp_limit(n: Column, default: int, most: int) -> Column:
    return F.when(n <= 0, F.lit(default)).otherwise(F.least(n, F.lit(most)))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))
