"""DuckDB SQL for the queries that SQL can express, over the whole tables."""

from __future__ import annotations

from .line_quality import FEW_DOCS, MIN_WORDS, MOST_DOCS, MOST_REMOVED, MOST_REPEATED_PERCENT, REPEAT_WINDOW, SHARE

_WORD = r"'[^\x20\x09-\x0D]+'"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _base32(sha1: str) -> str:
    """Base32 of a hex SHA-1: four groups of 40 bits, eight characters each."""
    groups = [f"('0x' || substr({sha1}, {10 * g + 1}, 10))::bigint" for g in range(4)]
    return " || ".join(f"substr('{_BASE32}', 1 + (({g} >> {35 - 5 * k}) & 31)::int, 1)" for g in groups for k in range(8))


LINE_QUALITY = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce("text", '') AS t FROM documents
), w AS (
  SELECT r, regexp_extract_all(t, {_WORD}) AS ws FROM d
), line AS (
  SELECT r, host, t, x, regexp_extract_all({_LOWER.format("x")}, {_WORD}) AS lw
  FROM (SELECT r, host, t, unnest(string_split(t, chr(10))) AS x FROM d)
), full_line AS (
  SELECT r, host, t, x, array_to_string(lw, ' ') AS norm, len(lw) AS n FROM line WHERE len(lw) > 0
), dup AS (
  SELECT r, count(*) - count(DISTINCT x) AS n_dup_lines FROM full_line GROUP BY r
), host_docs AS (
  SELECT host, count(DISTINCT t) AS h FROM d GROUP BY host
), frequent AS (
  SELECT host, norm FROM (SELECT host, norm, count(DISTINCT t) AS n FROM full_line GROUP BY host, norm) JOIN host_docs USING (host)
  WHERE n > {MOST_DOCS} OR (n > {FEW_DOCS} AND n > {SHARE} * h)
), removed AS (
  SELECT r, count(*) AS n_removed_lines, sum(n) AS n_removed_words FROM full_line JOIN frequent USING (host, norm) GROUP BY r
), win AS (
  SELECT r, i, array_to_string(list_slice(ws, i, i + {REPEAT_WINDOW - 1}), ' ') AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - {REPEAT_WINDOW - 2})) AS i FROM w WHERE len(ws) >= {REPEAT_WINDOW})
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1
), rep AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest(range({REPEAT_WINDOW})) AS k) GROUP BY r
), m AS (
  SELECT doc_id, len(ws)::bigint AS n_words, length(array_to_string(ws, ''))::bigint AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols, coalesce(n_dup_lines, 0)::bigint AS n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint AS n_repeat_words, coalesce(n_removed_lines, 0)::bigint AS n_removed_lines,
    coalesce(n_removed_words, 0)::bigint AS n_removed_words
  FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN removed USING (r)
), j AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed FROM m
)
SELECT *, NOT base_failed AND n_removed_words <= {MOST_REMOVED} * n_words AS kept FROM j
"""

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS top, sha1(h) AS x FROM p GROUP BY h)
SELECT page_id, octet_length(encode(h))::bigint AS payload_bytes, {_base32("x")} AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM p JOIN g USING (h)
"""

_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"

LEXICAL_SEARCH = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("text")}, {_TERM}) AS ts FROM documents
), full_doc AS (
  SELECT r, doc_id, ts, len(ts)::bigint AS n FROM d WHERE len(ts) > 0
), total AS (
  SELECT count(*)::bigint AS docs, sum(n)::bigint AS terms FROM full_doc
), posting AS (
  SELECT r, doc_id, n, t, count(*)::bigint AS tf FROM (SELECT r, doc_id, n, unnest(ts) AS t FROM full_doc) GROUP BY ALL
), weight AS (
  SELECT t, floor(1000 * ln((2.0 * docs + 2.0)::double / (2.0 * df + 1.0)::double))::bigint AS w
  FROM (SELECT t, count(*)::bigint AS df FROM posting GROUP BY t), total
), asked AS (
  SELECT DISTINCT q, item_id, t FROM (
    SELECT q, item_id, unnest(regexp_extract_all({_LOWER.format("text")}, {_TERM})) AS t FROM (SELECT row_number() OVER () AS q, item_id, text FROM benchmark))
), scored AS (
  SELECT q, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))))::bigint AS score
  FROM asked JOIN weight USING (t) JOIN posting USING (t), total GROUP BY q, item_id, r, doc_id
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST, r)::int AS "rank" FROM scored WHERE score > 0
)
SELECT item_id, "rank", doc_id, score FROM placed WHERE "rank" <= 10
"""

COLLOCATIONS = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, {_LOWER.format("coalesce(text, '')")} AS t FROM documents
), piece AS (
  SELECT lang, regexp_extract_all(x, '[^\\x20\\x09]+') AS ws
  FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS x FROM d)
), size AS (
  SELECT lang, sum(len(ws))::bigint AS n FROM piece GROUP BY lang
), spot AS (
  SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM piece
), gram AS (
  SELECT lang, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS g, count(*)::bigint AS f
  FROM spot, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(ws) GROUP BY ALL
), cand AS (
  SELECT lang, k, g, f AS a, string_split(g, ' ') AS p FROM gram WHERE k > 1 AND f >= 10
), half AS (
  SELECT lang, k, g, a, j, array_to_string(list_slice(p, 1, j), ' ') AS lg, array_to_string(list_slice(p, j + 1, k), ' ') AS rg
  FROM cand JOIN (SELECT unnest([1, 2]) AS j) x ON j < k
), cut AS (
  SELECT h.lang, h.k, h.g, a, j, lf.f AS l, rt.f AS r, ((1000000::hugeint * a * a) // (lf.f::hugeint * rt.f))::bigint AS score
  FROM half h JOIN gram lf ON lf.lang = h.lang AND lf.g = lg JOIN gram rt ON rt.lang = h.lang AND rt.g = rg
), best AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1
), around AS (
  SELECT lang, q AS g, max(a) AS m FROM (
    SELECT lang, a, unnest([array_to_string(list_slice(p, 1, 2), ' '), array_to_string(list_slice(p, 2, 3), ' ')]) AS q FROM cand WHERE k = 3
  ) GROUP BY ALL
), placed AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g)::int AS "rank", g AS phrase, a, l, r, n, score
  FROM best LEFT JOIN around USING (lang, g) JOIN size USING (lang) WHERE k = 3 OR m IS NULL OR 100 * m < 50 * a
)
SELECT * FROM placed WHERE "rank" <= 2000
"""
