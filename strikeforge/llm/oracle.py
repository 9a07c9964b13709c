"""The operators' results as plain SQL, where SQL can express them."""

from __future__ import annotations

_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_MIX = r"""
WITH sized AS (
  SELECT doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS kind
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5e0, 2e0, 1e0][kind + 1] AS weight, source_size * 3 AS cap FROM totals
), rooms AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place FROM weighed
), levels AS (
  SELECT n.place,
    (SELECT sum(source_size) FROM rooms) - coalesce(sum(r.cap) FILTER (r.place < n.place), 0) AS rest,
    sum(r.weight) FILTER (r.place >= n.place) AS weights
  FROM rooms n, rooms r GROUP BY n.place
), first_that_fits AS (
  SELECT min(place) AS place FROM rooms JOIN levels USING (place)
  WHERE rest * weight <= cap * weights
), targets AS (
  SELECT source, source_size,
    CASE WHEN r.place < f.place THEN cap::DOUBLE
      ELSE l.rest::DOUBLE * weight / l.weights END AS target
  FROM rooms r, first_that_fits f JOIN levels l ON l.place = f.place
), ordered AS (
  SELECT s.*, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS wanted,
    coalesce(sum(size) OVER (
      PARTITION BY s.source ORDER BY md5(concat_ws(':', 42, doc_id, size)), doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, source, size, source_size, target,
  (greatest(least(wanted - before, size), 0)
    + greatest(least(wanted - before - source_size, size), 0)
    + greatest(least(wanted - before - 2 * source_size, size), 0))::BIGINT AS taken
FROM ordered
"""

_LINES = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents
), keyed AS (
  SELECT *, {_LOWER.format(f"trim(line, {_SPACE})")} AS key FROM lines
), held AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT k.*, h.keeper IS NOT NULL AND h.keeper <> doc_id AS dropped
  FROM keyed k LEFT JOIN held h USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

_URLS = f"""
WITH parts AS (
  SELECT page_id, coalesce(url, '') AS url,
    CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT page_id, url, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM parts
), ruled AS (
  SELECT *, CASE
      WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/'
    END AS rule,
    contains(url, '/ads/')
      OR regexp_matches(url, '[^A-Za-z0-9_.%-]track(.|\\n)*\\.gif')
      OR regexp_matches(url, '[^A-Za-z0-9_.%-]casino([^A-Za-z0-9_.%-]|$)')
      OR regexp_matches(url, '\\?page=(.|\\n)*&ref=x([^A-Za-z0-9_.%-]|$)') AS unwanted
  FROM split
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
    WHEN rule IS NOT NULL OR unwanted THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""

_TOP_K = """
WITH whole AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS vector
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(
      list_zip(q.vector, v.vector), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM whole q JOIN whole v ON q.vec_id <> v.vec_id AND len(q.vector) = len(v.vector)
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_REPEATS = """
WITH spelled AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS digits FROM documents
), starts AS (
  SELECT doc_id, digits, unnest(range(0, greatest(length(digits) // 2 - 99, 0))) AS start FROM spelled
), strings AS (
  SELECT doc_id, start, md5(substr(digits, 2 * start + 1, 200)) AS string FROM starts
), gone AS (
  SELECT doc_id, start FROM (
    SELECT *, row_number() OVER (PARTITION BY string ORDER BY doc_id, start) AS nth FROM strings)
  WHERE nth > 1
), marked AS (
  SELECT *, start > lag(start) OVER w + 100 OR lag(start) OVER w IS NULL AS opens
  FROM gone WINDOW w AS (PARTITION BY doc_id ORDER BY start)
), numbered AS (
  SELECT *, count(*) FILTER (opens) OVER (PARTITION BY doc_id ORDER BY start) AS span FROM marked
), spans AS (
  SELECT doc_id, span, min(start) AS first, max(start) + 100 AS past FROM numbered
  GROUP BY doc_id, span
), gaps AS (
  SELECT doc_id, past AS first, lead(first) OVER (PARTITION BY doc_id ORDER BY first) AS past
  FROM spans
  UNION ALL
  SELECT doc_id, 0, (SELECT min(first) FROM spans s WHERE s.doc_id = d.doc_id) FROM spelled d
), kept AS (
  SELECT g.doc_id, string_agg(substr(digits, 2 * first + 1,
      2 * (coalesce(past, length(digits) // 2) - first)), '' ORDER BY first) AS digits
  FROM gaps g JOIN spelled s ON s.doc_id = g.doc_id GROUP BY g.doc_id
)
SELECT s.doc_id, (length(s.digits) // 2)::BIGINT AS n_bytes,
  ((length(s.digits) - length(k.digits)) // 2)::BIGINT AS n_removed,
  (SELECT count(*) FROM spans p WHERE p.doc_id = s.doc_id)::BIGINT AS n_spans,
  sha256(unhex(k.digits)) AS kept_sha256
FROM spelled s JOIN kept k ON k.doc_id = s.doc_id
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_SEARCH = f"""
WITH spelled AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '{_TERM}') AS terms FROM documents
  WHERE text IS NOT NULL
), counted AS (
  SELECT doc_id, terms, len(terms)::BIGINT AS n FROM spelled WHERE len(terms) > 0
), corpus AS (
  SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM counted
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER.format("text")}, '{_TERM}')) AS term
  FROM benchmark
), held AS (
  SELECT doc_id, term, count(*)::BIGINT AS tf
  FROM (SELECT doc_id, unnest(terms) AS term FROM counted)
  WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term
), weighed AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight
  FROM held, corpus GROUP BY term, n_docs
), gained AS (
  SELECT doc_id, term,
    weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))) AS gain
  FROM held JOIN weighed USING (term) JOIN counted USING (doc_id), corpus
), scored AS (
  SELECT item_id, doc_id, sum(gain)::BIGINT AS score FROM asked JOIN gained USING (term)
  GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, doc_id, score,
    row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

_PASSAGES = r"""
WITH spelled AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), places AS (
  SELECT doc_id, words, unnest(range(len(words))) AS place FROM spelled
), windows AS (
  SELECT doc_id, place, CASE WHEN place + 50 <= len(words)
    THEN md5(array_to_string(words[place + 1 : place + 50], ' ')) END AS passage
  FROM places
), firsts AS (
  SELECT passage, min(doc_id) AS first FROM windows WHERE passage IS NOT NULL GROUP BY passage
), marked AS (
  SELECT w.doc_id, place, coalesce(max(CASE WHEN first < w.doc_id THEN place END)
    OVER (PARTITION BY w.doc_id ORDER BY place) > place - 50, false) AS gone
  FROM windows w LEFT JOIN firsts USING (passage)
), kept AS (
  SELECT m.doc_id, count(*) FILTER (gone)::BIGINT AS n_removed,
    string_agg(words[place + 1], ' ' ORDER BY place) FILTER (NOT gone) AS kept
  FROM marked m JOIN spelled s ON s.doc_id = m.doc_id GROUP BY m.doc_id
)
SELECT s.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM spelled s LEFT JOIN kept k ON k.doc_id = s.doc_id
"""

ORACLE_SQL = {
    "op1_mix_sources": _MIX,
    "op3_line_dedup": _LINES,
    "op4_url_filter": _URLS,
    "op5_top_k": _TOP_K,
    "op9_remove_repeats": _REPEATS,
    "op11_lexical_search": _SEARCH,
    "op12_remove_passages": _PASSAGES,
}
