"""The queries of this package and their SQL, where SQL can express them."""

from .ann import op3_ann
from .chat import op5_chat
from .decontam import op10_decontam
from .hilbert import op4_hilbert
from .html_text import op13_html
from .licenses import op9_licenses
from .mixing import op2_mixing
from .negatives import op12_negatives
from .packing import op7_packing
from .pii import op6_pii
from .quality import op1_quality
from .ranked import op11_ranked
from .simhash import op8_simhash

QUERIES = {
    "op1_quality": op1_quality,
    "op2_mixing": op2_mixing,
    "op3_ann": op3_ann,
    "op4_hilbert": op4_hilbert,
    "op5_chat": op5_chat,
    "op6_pii": op6_pii,
    "op7_packing": op7_packing,
    "op8_simhash": op8_simhash,
    "op9_licenses": op9_licenses,
    "op10_decontam": op10_decontam,
    "op11_ranked": op11_ranked,
    "op12_negatives": op12_negatives,
    "op13_html": op13_html,
}

_CONTROL = "length(regexp_replace({0}, '[^<\\[\\\\]', '', 'g'))"
ORACLES: dict[str, str] = {
    # Each turn has 24 characters of marks, and one more for each <, [ and backslash in its role and text.
    "op5_chat": f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 sum(24 + length(role) + length(text) + {_CONTROL.format("role")} + {_CONTROL.format("text")})::BIGINT AS formatted_chars FROM t GROUP BY conv_id""",
    # Every document is scored for every item, without an index.
    "op11_ranked": """WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents WHERE text IS NOT NULL),
 i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM benchmark WHERE text IS NOT NULL),
 s AS (SELECT count(*)::BIGINT AS n, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0), q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(t) AS term FROM i) GROUP BY ALL),
 p AS (SELECT r, doc_id, term, any_value(n) AS n, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, doc_id, term),
 w AS (SELECT term, floor(1000 * ln((2 * s.n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, s.n),
 f AS (SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * p.n * s.n) // s.l))))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term), s GROUP BY item_id, r, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM f WHERE score > 0) WHERE rank <= 20""",
    "op12_negatives": """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_sum(list_transform(generate_series(1, len(a.v)), lambda i: a.v[i] * b.v[i]))::BIGINT AS score FROM e a, e b WHERE a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
 p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INT AS rank, other AS negative_id, positive_score, score AS negative_score
 FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score QUALIFY rank <= 5""",
    # The given pages mark their article, so its blocks can be cut out by patterns.
    "op13_html": """WITH b AS (SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1), '</?(?:h1|p)>') AS parts FROM pages),
 t AS (SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(replace(replace(regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;', '&'), '[\\s\\x{85}\\p{Z}]+', ' ', 'g'))), lambda x: x <> '') AS kept FROM b)
SELECT page_id, url, array_to_string(kept, chr(10)) AS text, length(array_to_string(kept, chr(10))) AS n_chars FROM t""",
}
