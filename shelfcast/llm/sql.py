"""SQL counterparts of the queries that SQL can state, by the definitions of their results rather than by their methods."""

from __future__ import annotations

from shelfcast.llm import line_dedup

# Every window of 100 bytes as 200 hexadecimal digits; covered bytes are those within a window that also starts earlier.
REPEATED_STRINGS = """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
windows AS (
    SELECT doc_id, i, substr(h, CAST(2 * i + 1 AS BIGINT), 200) AS w FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM texts WHERE n >= 100)),
later AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1),
-- A run of removed bytes ends where the next later window begins past the end of all before it.
marked AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 1 ELSE 0 END AS fresh FROM later),
numbered AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM marked),
spans AS (SELECT doc_id, min(i) AS b, max(i) + 100 AS e FROM numbered GROUP BY doc_id, span),
-- What stays: before the first run, between runs, after the last one.
kept AS (
    SELECT t.doc_id, coalesce(lag(s.e) OVER o, 0) AS b, s.b AS e FROM texts t JOIN spans s USING (doc_id) WINDOW o AS (PARTITION BY t.doc_id ORDER BY s.b)
    UNION ALL SELECT t.doc_id, coalesce(max(s.e), 0), any_value(t.n) FROM texts t LEFT JOIN spans s USING (doc_id) GROUP BY t.doc_id),
joined AS (
    SELECT k.doc_id, string_agg(substr(t.h, CAST(2 * k.b + 1 AS BIGINT), CAST(2 * (k.e - k.b) AS BIGINT)), '' ORDER BY k.b) AS h
    FROM kept k JOIN texts t USING (doc_id) GROUP BY k.doc_id),
removed AS (SELECT doc_id, CAST(sum(e - b) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT t.doc_id, t.n AS n_bytes, coalesce(r.n_removed, 0) AS n_removed, coalesce(r.n_spans, 0) AS n_spans, sha256(unhex(j.h)) AS kept_sha256
FROM texts t JOIN joined j USING (doc_id) LEFT JOIN removed r USING (doc_id)
"""

NEAR_VECTORS = """
WITH RECURSIVE given AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
real AS (
    SELECT vec_id, v FROM given
    WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM real a JOIN real b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
reached AS (SELECT vec_id AS a, vec_id AS b FROM real UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
components AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT g.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.component_id, g.vec_id) AS component_id, coalesce(c.component_id, g.vec_id) = g.vec_id AS kept
FROM given g LEFT JOIN components c USING (vec_id) LEFT JOIN counts n USING (vec_id)
"""

PHRASES = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
        unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
cut AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
runs AS (
    SELECT lang, array_to_string(words[i + 1 : i + k], ' ') AS phrase, k
    FROM (SELECT lang, words, k, unnest(range(0, len(words) - k + 1)) AS i FROM cut, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(words) >= k)),
f AS (SELECT lang, phrase, k, count(*) AS n FROM runs GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, phrase, k, n AS a, string_split(phrase, ' ') AS words FROM f WHERE k > 1 AND n >= 30),
parts AS (
    SELECT lang, phrase, a, c, array_to_string(words[1 : c], ' ') AS first, array_to_string(words[c + 1 : k], ' ') AS rest
    FROM (SELECT *, unnest(range(1, k)) AS c FROM candidates)),
scores AS (
    SELECT p.lang, p.phrase, p.a, p.c, x.n AS l, y.n AS r, CAST(CAST(p.a AS HUGEINT) * 2000000 // (x.n + y.n) AS BIGINT) AS score
    FROM parts p JOIN f x ON x.lang = p.lang AND x.phrase = p.first JOIN f y ON y.lang = p.lang AND y.phrase = p.rest),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inner_parts AS (
    SELECT DISTINCT lang, a, array_to_string(words[i : i + m - 1], ' ') AS phrase
    FROM (SELECT lang, a, words, k, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM candidates))),
dropped AS (SELECT DISTINCT l.lang, l.phrase FROM lowest l JOIN inner_parts i ON i.lang = l.lang AND i.phrase = l.phrase AND CAST(i.a AS HUGEINT) * 100 >= CAST(l.a AS HUGEINT) * 80),
ranked AS (
    SELECT l.*, row_number() OVER (PARTITION BY l.lang ORDER BY l.score DESC, l.a DESC, l.phrase) AS rank
    FROM lowest l ANTI JOIN dropped d ON d.lang = l.lang AND d.phrase = l.phrase)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""

# The pages of the table have one article each, with no boilerplate inside, and these references only.
MAIN_TEXT = r"""
WITH articles AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS article FROM pages),
plain AS (SELECT page_id, url, regexp_replace(regexp_replace(article, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS text FROM articles),
decoded AS (SELECT page_id, url, regexp_replace(replace(replace(replace(text, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') AS text FROM plain),
trimmed AS (SELECT page_id, url, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM decoded)
SELECT page_id, url, text, length(text) AS n_chars FROM trimmed
"""

STATEMENTS = {
    "op4_repeated_strings": REPEATED_STRINGS,
    "op7_line_dedup": line_dedup.SQL,
    "op10_near_vectors": NEAR_VECTORS,
    "op11_phrases": PHRASES,
    "op12_main_text": MAIN_TEXT,
}
