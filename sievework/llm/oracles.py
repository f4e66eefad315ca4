"""SQL that gives the same rows as the registered queries, where SQL can express them.

Not here: packing and token counts (tokenizers), language id and quality (learned
models), quality rules (sketches) and the Jaccard join (components); tests hold those
against brute force.
"""

from __future__ import annotations

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

DECONTAMINATION = rf"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS x FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT item, least(10, len(x)) AS size, x, unnest(range(1, greatest(len(x) - 9, 1) + 1)) AS s FROM item WHERE len(x) > 0),
wanted AS (SELECT DISTINCT item, size, array_to_string(x[s : s + size - 1], ' ') AS k FROM iw),
doc AS (SELECT doc_id, {_WORDS} AS x FROM documents),
dw AS (SELECT doc_id, size, array_to_string(x[s : s + size - 1], ' ') AS k, s
       FROM (SELECT doc_id, x, size, unnest(range(1, len(x) - size + 2)) AS s FROM doc, (SELECT DISTINCT size FROM wanted))),
hits AS (SELECT dw.doc_id, dw.s, dw.size, wanted.item FROM dw JOIN wanted USING (size, k)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(x) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

SUBSTRINGS = r"""
WITH doc AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS x FROM documents),
win AS (SELECT doc_id, s, array_to_string(x[s : s + 19], ' ') AS k FROM (SELECT doc_id, x, unnest(range(1, len(x) - 18)) AS s FROM doc)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, rank() OVER (PARTITION BY k ORDER BY doc_id, s) AS nth FROM win) WHERE nth > 1),
word AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS w FROM doc),
marked AS (SELECT word.*, coalesce(max(later.s) OVER (PARTITION BY word.doc_id ORDER BY i) >= i - 19, false) AS gone
           FROM word LEFT JOIN later ON word.doc_id = later.doc_id AND word.i = later.s),
left_over AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM marked GROUP BY doc_id)
SELECT doc_id, CAST(len(x) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM doc LEFT JOIN left_over USING (doc_id)
"""

LINES = r"""
WITH line AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
full_line AS (SELECT *, lead(line) OVER w AS line2, lead(i) OVER w AS i2 FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]') WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
later AS (SELECT doc_id, i, i2 FROM (SELECT *, rank() OVER (PARTITION BY line, line2 ORDER BY doc_id, i) AS nth FROM full_line WHERE i2 IS NOT NULL) WHERE nth > 1),
kept AS (SELECT * FROM line WHERE NOT EXISTS (SELECT 1 FROM later WHERE later.doc_id = line.doc_id AND line.i BETWEEN later.i AND later.i2))
SELECT d.doc_id, d.n_lines, d.n_lines - count(kept.i) AS n_removed, sha256(coalesce(string_agg(kept.line, chr(10) ORDER BY kept.i), '')) AS kept_sha256
FROM (SELECT doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines FROM documents) d LEFT JOIN kept USING (doc_id)
GROUP BY d.doc_id, d.n_lines
"""

_TWO = "array_to_string(list_slice(string_split(host, '.'), -2, -1), '.')"
_COUNTRY = "length(list_extract(string_split(host, '.'), -1)) = 2 AND list_extract(string_split(host, '.'), -2) IN ('ac', 'co', 'com', 'edu', 'gob', 'gov', 'mil', 'ne', 'net', 'or', 'org')"


def _strength(groups: str) -> str:
    """The prior's strength from the spread of bad rates between groups, within 1 and 100."""
    rho = "(s / (rate * (1 - rate)) - (c - 1)) / (n - nn / n - (c - 1))"
    return f"""(SELECT CASE WHEN c IS NULL OR c < 2 OR NOT (rate > 0 AND rate < 1) OR n - nn / n - (c - 1) <= 0 OR {rho} <= 0 THEN 100.0 ELSE least(100.0, greatest(1.0, 1 / ({rho}) - 1)) END
    FROM (SELECT CAST(count(*) AS DOUBLE) AS c, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(n * n) AS DOUBLE) AS nn, sum(pow(k - rate * n, 2) / n) AS s, any_value(rate) AS rate FROM {groups}, whole WHERE n > 0))"""


URLS = rf"""
WITH page AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
bad AS (SELECT page_id, max(CASE WHEN coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0 THEN 1 ELSE 0 END) AS bad
        FROM (SELECT page_id, try_cast(nullif(regexp_extract(path, '^/[^/]*/([0-9]{{1,18}})', 1), '') AS BIGINT) AS doc_id FROM page) JOIN labels USING (doc_id) WHERE page_id IS NOT NULL GROUP BY page_id),
hosts AS (SELECT *, CASE WHEN {_COUNTRY} THEN array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') ELSE {_TWO} END AS domain,
                 CASE WHEN {_COUNTRY} THEN {_TWO} ELSE list_extract(string_split(host, '.'), -1) END AS suffix
          FROM (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k FROM page LEFT JOIN bad USING (page_id) WHERE host <> '' GROUP BY host)),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
tops AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL),
whole AS (SELECT CASE WHEN sum(n) > 0 THEN CAST(sum(k) AS DOUBLE) / sum(n) ELSE 0.0 END AS rate FROM tops),
m AS (SELECT rate, {_strength("tops")} AS m1, {_strength("domains")} AS m2, {_strength("hosts")} AS m3 FROM whole),
top2 AS (SELECT suffix, (m1 * rate + k) / (m1 + n) AS prior FROM tops, m),
domain2 AS (SELECT domain, (m2 * prior + k) / (m2 + n) AS prior FROM domains JOIN top2 USING (suffix), m),
beta AS (SELECT host, m3 * prior + k AS a, m3 * (1 - prior) + n - k AS b FROM hosts JOIN domain2 USING (domain), m),
blocked AS (SELECT host FROM beta WHERE a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > (SELECT rate FROM whole)),
rule(verdict, rule, of_host, of_path) AS (VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'), ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')),
fits AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
         FROM page JOIN rule ON (host = of_host OR suffix(host, '.' || of_host)) AND starts_with(path, of_path) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN blocked.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM page LEFT JOIN fits USING (page_id) LEFT JOIN blocked USING (host)
"""

FILTER_AUDIT = r"""
WITH doc AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
mark AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
fail AS (
  SELECT doc_id, part,
    CASE WHEN len(w) < 100 THEN 1 ELSE 0 END AS a, CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 1 ELSE 0 END AS b,
    CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 1 ELSE 0 END AS c, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 1 ELSE 0 END AS d,
    CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 1 ELSE 0 END AS e
  FROM doc),
code AS (SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM fail LEFT JOIN mark USING (doc_id) GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT v.x || w.x || x.x || y.x || z.x AS filter_order, [v.bit, w.bit, x.bit, y.bit, z.bit] AS bits
  FROM letter v, letter w, letter x, letter y, letter z WHERE (v.bit | w.bit | x.bit | y.bit | z.bit) = 31),
steps AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1 : step - 1]), 0)::INT AS before FROM orders, (SELECT unnest(range(1, 6))::INT AS step)),
told AS (
  SELECT part, filter_order, step, bit,
    sum(n) FILTER (mask & (before | bit) = 0) AS kept, sum(n) FILTER (mask & before = 0 AND mask & bit <> 0) AS removed,
    sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
    sum(good) FILTER (mask & before = 0 AND mask & bit <> 0) AS good_lost, sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0) AS toxic_lost
  FROM code, steps GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM told
"""

COLLOCATIONS = r"""
WITH piece AS (
  SELECT lang, row_number() OVER () AS piece, x FROM (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS x FROM documents)),
word AS (SELECT lang, piece, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM (SELECT lang, piece, regexp_extract_all(x, '[^\x20\x09]+') AS x FROM piece)),
total AS (SELECT lang, count(*) AS n FROM word GROUP BY lang),
run AS (SELECT lang, w AS w1, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3, lead(w, 3) OVER p AS w4 FROM word WINDOW p AS (PARTITION BY piece ORDER BY i)),
gram AS (
  SELECT lang, [w1] AS g, count(*) AS f FROM run GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, [w1, w2], count(*) FROM run WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, [w1, w2, w3], count(*) FROM run WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, [w1, w2, w3, w4], count(*) FROM run WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30),
cut AS (SELECT lang, g, f AS a, k, g[1 : k] AS g1, g[k + 1 : ] AS g2 FROM (SELECT *, unnest(range(1, len(g))) AS k FROM gram WHERE len(g) > 1)),
scored AS (
  SELECT c.lang, c.g, c.a, x.f AS l, y.f AS r, 2000000::HUGEINT * c.a // (x.f + y.f)::HUGEINT AS score, c.k
  FROM cut c JOIN gram x ON x.lang = c.lang AND x.g = c.g1 JOIN gram y ON y.lang = c.lang AND y.g = c.g2),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
held AS (SELECT lang, f, n, g, unnest(range(1, len(g) - n + 2)) AS i FROM (SELECT *, unnest(range(2, len(g))) AS n FROM gram WHERE len(g) > 2)),
longer AS (SELECT lang, g[i : i + n - 1] AS g, max(f) AS f FROM held GROUP BY ALL),
left_over AS (SELECT b.* FROM best b LEFT JOIN longer USING (lang, g) WHERE longer.f IS NULL OR 100::HUGEINT * longer.f < 80::HUGEINT * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(g, ' '))) AS rank FROM left_over)
SELECT lang, rank, array_to_string(g, ' ') AS phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
