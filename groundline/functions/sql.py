"""The library's functions under their names in SQL: one call, and queries in plain SQL can use them."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _text(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t") + "'"


def _let(value: str, name: str, body: str) -> str:
    """`body`, in which `name` is `value`, computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _split_claims() -> str:
    from ..operators.claims import KEEPS_ON, MARKS, OTHER_MARKS, RUNS

    begin, end = (_text(m) for m in MARKS)
    runs = f"regexp_replace(translate(text, {_text(MARKS)}, {_text(OTHER_MARKS)}), {_text(RUNS)}, concat({begin}, '$1', {end}))"
    pieces = f"split(regexp_replace(regexp_replace(regexp_replace({runs}, {_text(KEEPS_ON)}, '$1$2$3'), {begin}, ''), '\\n', concat('\\n', {end})), {end})"
    # Running sums in chunks, so that long arrays aren't copied for each number.
    grow, zero = "(done, n) -> array_append(done, element_at(done, -1) + n)", "array(bigint(0))"
    chunks = f"transform(sequence(1, greatest(size(sizes), 1), 256), i -> aggregate(slice(sizes, i, 256), {zero}, {grow}))"
    joined = f"flatten(zip_with(sums, slice(aggregate(transform(sums, s -> element_at(s, -1)), {zero}, {grow}), 1, size(sums)), (s, base) -> transform(slice(s, 1, size(s) - 1), x -> x + base)))"
    starts = _let("transform(pieces, p -> bigint(octet_length(p)))", "sizes", _let(chunks, "sums", joined))
    blank = "' \\t\\n\\r'"
    first = f"start + octet_length(piece) - octet_length(ltrim({blank}, piece))"
    placed = f"named_struct('claim', decode(substring(encode(text, 'UTF-8'), int(first) + 1, octet_length(btrim(piece, {blank}))), 'UTF-8'), 'start', bigint(first), 'end', bigint(first + octet_length(btrim(piece, {blank}))))"
    says = "x -> x.claim rlike '[\\\\p{L}\\\\p{Nd}]'"
    return _let(pieces, "pieces", f"filter(zip_with(pieces, {starts}, (piece, start) -> {_let(first, 'first', placed)}), {says})")


def _native() -> dict[str, tuple[str, str, str]]:
    """name -> (parameters, type, body): native expressions, so a query that calls them stays in the JVM."""
    white, edge = _text(r"[\s\x{85}\p{Z}]+"), _text(" .,;:!?\"'")
    inside = "from_byte >= 0 AND to_byte >= from_byte AND to_byte <= octet_length(text)"
    same = "substring(encode(text, 'UTF-8'), int(from_byte) + 1, int(to_byte - from_byte)) = encode(span, 'UTF-8')"
    start = "octet_length(substring(text, 1, instr(text, span) - 1))"
    return {
        "split_claims": ("text STRING", "ARRAY<STRUCT<claim: STRING, start: BIGINT, end: BIGINT>>", _split_claims()),
        "locate_span": ("text STRING, span STRING", "STRUCT<start: BIGINT, end: BIGINT>", f"CASE WHEN instr(text, span) > 0 AND length(span) > 0 THEN named_struct('start', bigint({start}), 'end', bigint({start} + octet_length(span))) END"),
        "verify_span": ("text STRING, span STRING, from_byte BIGINT, to_byte BIGINT", "BOOLEAN", f"coalesce({inside} AND {same}, false)"),
        "normalize_for_match": ("s STRING", "STRING", f"lower(btrim(trim(regexp_replace(s, {white}, ' ')), {edge}))"),
        "verbatim_matches": ("claim STRING, span STRING", "BOOLEAN", "normalize_for_match(claim) = normalize_for_match(span)"),
    }


def register(spark: SparkSession) -> None:
    """Registers split_claims, locate_span, verify_span, normalize_for_match, verbatim_matches and the table function unpack_archive in the session.

    Registering again replaces them. All but unpack_archive are native expressions.
    """
    from ..sources.io import UnpackArchive

    for name, (parameters, kind, body) in _native().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("unpack_archive", UnpackArchive)
