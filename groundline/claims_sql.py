"""Sentence splitting as SQL, for the oracle: the same rules without look-behind, deciding each run from what stands around it."""


def claims_cte(source: str, key: str, out: str, text: str = "text") -> str:
    """CTEs ending in `out`(key, claim_idx, claim, start, end) over source(key, text). Every name starts with `out`."""
    e, s = "chr(57345)", "chr(57344)"
    return f"""{out}_p AS (SELECT {key}, string_split(regexp_replace({text}, '([.!?][.!?"'')\\]]*[”’»›]*)', {s} || '\\1' || {e}, 'g'), {e}) AS parts FROM {source} WHERE {text} IS NOT NULL),
{out}_u AS (SELECT {key}, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM {out}_p),
{out}_v AS (SELECT {key}, i, split_part(part, {s}, 1) AS seg, CASE WHEN contains(part, {s}) THEN split_part(part, {s}, 2) ELSE '' END AS run FROM {out}_u),
{out}_w AS (SELECT *, coalesce(lag(seg || run, 3) OVER k, '') || coalesce(lag(seg || run, 2) OVER k, '') || coalesce(lag(seg || run) OVER k, '') || seg AS before,
 coalesce(lead(seg || run) OVER k, '') || coalesce(lead(seg, 2) OVER k, '') AS after FROM {out}_v WINDOW k AS (PARTITION BY {key} ORDER BY i)),
{out}_x AS (SELECT *, regexp_extract(before, '[^ \\t\\n("]*$') AS word FROM {out}_w),
{out}_y AS (SELECT {key}, i, seg, run, run <> '' AND NOT (left(run, 1) = '.' AND (
  (regexp_matches(before, '[0-9]$') AND regexp_matches(after, '^[0-9]'))
  OR lower(word) IN ('mr','mrs','ms','dr','prof','v','vs','no','cl','s','ss','art','para','p','pp','approx','e.g','i.e','etc','cf')
  OR regexp_matches(word, '^[A-Za-z]$') OR regexp_matches(after, '^[ \\t]*\\p{{Ll}}'))) AS closes FROM {out}_x),
{out}_z AS (SELECT {key}, string_split(string_agg(replace(seg, chr(10), chr(10) || {e}) || run || CASE WHEN closes THEN {e} ELSE '' END, '' ORDER BY i), {e}) AS pieces FROM {out}_y GROUP BY {key}),
{out}_a AS (SELECT {key}, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS pos FROM {out}_z),
{out}_b AS (SELECT *, coalesce(sum(strlen(piece)) OVER (PARTITION BY {key} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM {out}_a),
{out}_c AS (SELECT {key}, pos, trim(piece, ' ' || chr(9) || chr(10) || chr(13)) AS claim, base + strlen(piece) - strlen(ltrim(piece, ' ' || chr(9) || chr(10) || chr(13))) AS start FROM {out}_b WHERE regexp_matches(piece, '[\\p{{L}}\\p{{Nd}}]')),
{out} AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY pos) - 1 AS claim_idx, claim, start::BIGINT AS start, (start + strlen(claim))::BIGINT AS "end" FROM {out}_c)"""
