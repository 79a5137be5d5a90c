"""DuckDB SQL of the queries that SQL can express, stated directly: all pairs, recursion, whole lists."""

from __future__ import annotations

from .source_mix import WEIGHTS

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
  AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.vec_id) AS n_links, least(v.vec_id, coalesce(least_of.b, v.vec_id)) AS component_id,
  v.vec_id = least(v.vec_id, coalesce(least_of.b, v.vec_id)) AS kept
FROM v LEFT JOIN least_of ON least_of.a = v.vec_id"""

_CYCLE = "[" + ", ".join(map(str, WEIGHTS)) + "]"
MIX = f"""
WITH d AS (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")}) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS r FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2 * source_size AS cap, {_CYCLE}[(row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(WEIGHTS)} + 1] AS weight,
  row_number() OVER (ORDER BY source IS NULL, source) AS nth FROM s),
l AS (SELECT x.*, (SELECT CAST(150 * sum(source_size) AS BIGINT) FROM s) - 100 * coalesce((SELECT CAST(sum(cap) AS BIGINT) FROM w y
    WHERE y.cap / y.weight < x.cap / x.weight OR (y.cap / y.weight = x.cap / x.weight AND y.nth < x.nth)), 0) AS pool,
  (SELECT CAST(sum(weight) AS BIGINT) FROM w y WHERE y.cap / y.weight > x.cap / x.weight OR (y.cap / y.weight = x.cap / x.weight AND y.nth >= x.nth)) AS rest FROM w x),
level AS (SELECT min_by(pool / (100 * rest), (cap / weight) * 1.0) AS level FROM l WHERE pool / (100 * rest) * weight <= cap),
t AS (SELECT source, source_size, coalesce(least(weight * (SELECT level FROM level), CAST(cap AS DOUBLE)), CAST(cap AS DOUBLE)) AS target FROM w),
p AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs,
  CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY r, d.doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, epochs * size + part AS taken, epochs, part FROM (
  SELECT *, greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - before)) AS part FROM p) q"""

QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {_WORDS.format('text')} AS words FROM d),
grams AS (SELECT n, i, list_slice(words, i, i + 7) AS g FROM (SELECT n, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) > 8) q),
twice AS (SELECT n, i FROM (SELECT n, i, count(*) OVER (PARTITION BY n, g) AS c FROM grams) q WHERE c > 1),
covered AS (SELECT n, count(DISTINCT p) AS n_repeat_words FROM (SELECT n, unnest(range(i, i + 8)) AS p FROM twice) q GROUP BY n),
lines AS (SELECT n, host, raw, i, array_to_string({_WORDS.format(_LOWER.format('raw'))}, ' ') AS line, len({_WORDS.format('raw')}) AS words FROM (
  SELECT n, host, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d) q WHERE len({_WORDS.format('raw')}) > 0),
prints AS (SELECT n, list(line ORDER BY i) AS print FROM lines GROUP BY n UNION ALL SELECT n, [] FROM d WHERE n NOT IN (SELECT n FROM lines)),
hosts AS (SELECT host, count(DISTINCT print) AS n_host FROM d JOIN prints USING (n) GROUP BY host),
common AS (SELECT host, line FROM lines JOIN prints USING (n) JOIN hosts USING (host) GROUP BY host, line, n_host
  HAVING count(DISTINCT print) > 10 AND 100 * count(DISTINCT print) > 2 * n_host),
lost AS (SELECT n, sum(words) AS n_common_words, list_sort(list_distinct(list(line))) AS held FROM lines JOIN common USING (host, line) GROUP BY n),
same AS (SELECT n, count(*) - count(DISTINCT raw) AS n_dup_lines FROM lines GROUP BY n),
q AS (SELECT n, doc_id, host, held, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(n_common_words, 0) AS BIGINT) AS n_common_words
  FROM w LEFT JOIN covered USING (n) LEFT JOIN lost USING (n) LEFT JOIN same USING (n)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, 100 * (n_words - n_common_words) >= 20 * n_words AS enough FROM q),
spared AS (SELECT host, held, min(doc_id) AS least FROM v WHERE NOT base_failed AND NOT enough GROUP BY host, held)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_common_words, base_failed,
  NOT base_failed AND (enough OR coalesce(doc_id = least, FALSE)) AS kept FROM v LEFT JOIN spared USING (host, held)"""

#: For the layout of the given pages: an article of headings and paragraphs.
PAGES = r"""
WITH b AS (SELECT page_id, i, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]+>', '', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS block FROM (
  SELECT page_id, unnest(parts) AS x, generate_subscripts(parts, 1) AS i FROM (
    SELECT page_id, string_split_regex(replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<br>', ' '), '</?(?:p|h1)[^>]*>') AS parts FROM pages) q) q2),
t AS (SELECT page_id, string_agg(block, chr(10) || chr(10) ORDER BY i) AS text FROM b WHERE block <> '' GROUP BY page_id)
SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars FROM pages LEFT JOIN t USING (page_id)"""

SEARCH = f"""
WITH t AS (SELECT n, doc_id, unnest(ts) AS term, len(ts) AS n_terms FROM (SELECT row_number() OVER () AS n, doc_id,
    regexp_extract_all({_LOWER.format('text')}, '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+') AS ts FROM documents) q),
c AS (SELECT count(DISTINCT n) AS docs, count(*) AS terms FROM t),
f AS (SELECT term, count(DISTINCT n) AS df FROM t GROUP BY term),
tf AS (SELECT n, doc_id, term, n_terms, count(*) AS tf FROM t GROUP BY ALL),
i AS (SELECT item_id, unnest(regexp_extract_all({_LOWER.format('text')}, '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term FROM benchmark),
a AS (SELECT item_id, term, count(*) AS asked FROM i GROUP BY ALL),
s AS (SELECT item_id, n, doc_id, CAST(sum(asked * CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT)
    * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n_terms * docs) // terms))))) AS BIGINT) AS score
  FROM a JOIN tf USING (term) JOIN f USING (term), c GROUP BY item_id, n, doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) q WHERE rank <= 20"""

ORACLES: dict[str, str] = {"op1_embedding_near_dedup": EMBEDDINGS, "op2_source_mix": MIX, "op5_quality_rules": QUALITY, "op6_html_extraction": PAGES,
                           "op13_ranked_search": SEARCH}
