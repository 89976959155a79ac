"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .url_filter import TWO_LABEL_SUFFIXES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLDED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_WORD = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _strength(source: str, n: str, bad: str, name: str) -> str:
    """The prior strength of a level's groups, by moments (see `url_filter`)."""
    return f"""
{name}_sum AS (SELECT sum({n}) AS n, sum({bad}) AS s, sum({n} * {n}) AS n2, sum({bad} * {bad} / CAST({n} AS DOUBLE)) AS s2, count(*) AS k FROM {source} WHERE {n} > 0),
{name}_k AS (SELECT CASE WHEN coalesce(k, 0) = 0 THEN 0.0 ELSE CAST(s AS DOUBLE) / n END AS p,
  CASE WHEN coalesce(k, 0) = 0 THEN 1.0 WHEN s = 0 OR s = n OR n - CAST(n2 AS DOUBLE) / n - (k - 1) <= 0 THEN 1000.0
  ELSE 1 / least(0.5, greatest(1 / 1001.0, ((s2 - n * (CAST(s AS DOUBLE) / n) ** 2) / ((CAST(s AS DOUBLE) / n) * (1 - CAST(s AS DOUBLE) / n)) - (k - 1)) / (n - CAST(n2 AS DOUBLE) / n - (k - 1)))) - 1 END AS k FROM {name}_sum)"""


OP1 = rf"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
l AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY 1),
b AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM p),
g AS (SELECT name, sum(coalesce(n, 0)) AS n, sum(coalesce(bad, 0)) AS bad, list_reverse(string_split(name, '.')) AS x,
  regexp_matches(name, '^([0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}$') OR starts_with(name, '[') AS address FROM b LEFT JOIN l ON doc_id = page_id GROUP BY name),
k AS (SELECT *, CASE WHEN array_to_string(list_reverse(x[1:2]), '.') IN {TWO_LABEL_SUFFIXES} THEN 2 ELSE 1 END AS k FROM g),
h AS (SELECT name, n, bad, CASE WHEN address THEN name ELSE array_to_string(list_reverse(x[1:k]), '.') END AS suffix,
  CASE WHEN address THEN name ELSE array_to_string(list_reverse(x[1:k + 1]), '.') END AS domain FROM k),
d AS (SELECT domain, suffix, sum(n) AS dn, sum(bad) AS dbad FROM h GROUP BY 1, 2),
s AS (SELECT suffix, sum(dn) AS sn, sum(dbad) AS sbad FROM d GROUP BY 1),
{_strength("s", "sn", "sbad", "ss")}, {_strength("d", "dn", "dbad", "dd")}, {_strength("h", "n", "bad", "hh")},
sm AS (SELECT suffix, (sbad + ss_k.k * ss_k.p) / (sn + ss_k.k) AS m FROM s, ss_k),
dm AS (SELECT domain, (dbad + dd_k.k * sm.m) / (dn + dd_k.k) AS m FROM d JOIN sm USING (suffix), dd_k),
hm AS (SELECT name, (bad + hh_k.k * dm.m) / (n + hh_k.k) AS m, n + hh_k.k AS total FROM h JOIN dm USING (domain), hh_k),
r AS (SELECT b.*, m, m - 1.645 * sqrt(m * (1 - m) / (total + 1)) AS bound,
  CASE WHEN (host = 'example.net' OR suffix_net) AND starts_with(path, '/en/') THEN 'example.net/en/'
       WHEN (host = 'example.com' OR suffix_com) AND starts_with(path, '/de/') THEN 'example.com/de/'
       WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
       WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM (SELECT *, ends_with(host, '.example.net') AS suffix_net, ends_with(host, '.example.com') AS suffix_com FROM b) b JOIN hm USING (name))
SELECT page_id, host, path, rule, CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow'
  ELSE CASE WHEN bound > 0.3 THEN 'block' ELSE 'allow' END END AS verdict, round(m, 9) AS bad_mean, round(bound, 9) AS bad_bound FROM r
"""

OP5 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '{_WORD}') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b, root FROM r JOIN both_ways ON a = node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY 1)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM s JOIN c ON c.node = s.doc_id
"""

OP6 = rf"""
WITH i AS (SELECT item_id, regexp_extract_all({_FOLDED}, '{_ALNUM}') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS x FROM i WHERE len(w) > 0),
d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '{_ALNUM}') AS w FROM documents),
dw AS (SELECT doc_id, size, place, array_to_string(w[place:place + size - 1], ' ') AS x FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS place FROM d, (SELECT DISTINCT size FROM p))),
m AS (SELECT dw.doc_id, dw.place, dw.size, p.item_id FROM dw JOIN p USING (size, x)),
hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(place, place + size)) AS k FROM m) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP7 = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(22 + len(role) + len(regexp_extract_all(role, '[<\[\\]')) + len(text) + len(regexp_extract_all(text, '[<\[\\]'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY 1
"""

OP10 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
x AS (SELECT doc_id, place, array_to_string(w[place:place + 49], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS place FROM d)),
f AS (SELECT doc_id, place, min(doc_id) OVER (PARTITION BY x) < doc_id AS again FROM x),
gone AS (SELECT DISTINCT doc_id, unnest(range(place, place + 50)) AS k FROM f WHERE again),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d),
kept AS (SELECT words.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS t FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

ORACLES = {
    "op1_url_filter": OP1,
    "op5_ngram_jaccard_join": OP5,
    "op6_benchmark_decontamination": OP6,
    "op7_chat_format": OP7,
    "op10_substring_dedup": OP10,
}
