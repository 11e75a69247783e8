"""DuckDB SQL for the operators' queries, over the tables as views."""

from __future__ import annotations

from .licenses import NOTICES, PHRASES
from .quality import BOILERPLATE, MARKS

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORD = r"'[^\x20\x09-\x0D]+'"

LINE_DEDUP = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, {_LOW.format(f"trim(line, {_SPACES})")} AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key),
v AS (SELECT k.*, coalesce(k.doc_id <> o.owner, false) AS gone FROM k LEFT JOIN o USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM v GROUP BY doc_id"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, {_WORD}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT i.a, i.b FROM i JOIN n p ON p.doc_id = i.a JOIN n q ON q.doc_id = i.b WHERE 100 * common >= 80 * (p.n + q.n - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)"""


def url_filter(rules: list[tuple[str, str]], rounds: int = 10, damping: float = 0.85) -> str:
    rows = ", ".join(f"('{said}', '{rule}', '{rule.split('/', 1)[0]}', '/{rule.split('/', 1)[1]}')" for said, rule in rules)
    space = r"[\t-\r ]*"
    link = rf"""\b(?:[hH][rR][eE][fF]|[sS][rR][cC]){space}={space}["'']?{space}(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#"''\t-\r <>]+)"""
    return f"""
WITH RECURSIVE rules(said, rule, top, start) AS (VALUES {rows}),
p AS (SELECT row_number() OVER () AS r, page_id, html, {_LOW.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
f AS (SELECT r, arg_max(rule, (length(rule), said, rule)) AS rule, arg_max(said, (length(rule), said, rule)) AS said
  FROM p JOIN rules ON (host = top OR ends_with(host, '.' || top)) AND starts_with(path, start) GROUP BY r),
j AS (SELECT p.*, f.rule, f.said FROM p LEFT JOIN f USING (r)),
h AS (SELECT host, count(*) AS n, count(*) FILTER (said = 'allow') AS allow, count(*) FILTER (said = 'block') AS block FROM j WHERE host <> '' GROUP BY host),
m AS (SELECT 'trust' AS kind, host, allow AS mass FROM h WHERE allow * 2 > n UNION ALL SELECT 'distrust', host, block FROM h WHERE block * 2 > n),
seeds AS MATERIALIZED (SELECT kind, host, mass / sum(mass) OVER (PARTITION BY kind) AS mass FROM m),
e AS (SELECT host AS src, {_LOW.format(f"unnest(regexp_extract_all(html, '{link}', 1))")} AS dst FROM p WHERE host <> ''),
w AS (SELECT src, dst, count(*) AS w FROM e WHERE src <> dst GROUP BY ALL),
ways AS (SELECT 'trust' AS kind, src, dst, w FROM w UNION ALL SELECT 'distrust', dst, src, w FROM w),
edges AS MATERIALIZED (SELECT kind, src, dst, w / sum(w) OVER (PARTITION BY kind, src) AS share FROM ways),
terms AS (SELECT 0 AS k, kind, host, mass::DOUBLE AS term FROM seeds UNION ALL
  SELECT k + 1, kind, dst, {damping} * sum(part) FROM (
    SELECT t.k, t.kind, e.dst, t.term * e.share AS part FROM terms t JOIN edges e ON e.kind = t.kind AND e.src = t.host WHERE t.k < {rounds}) GROUP BY ALL),
ranks AS (SELECT kind, host, sum(CASE WHEN k = {rounds} THEN 1 ELSE {1 - damping} END * term) AS rank FROM terms GROUP BY ALL),
score AS (SELECT host, coalesce(sum(rank) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(rank) FILTER (kind = 'distrust'), 0) AS distrust FROM ranks GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(said, CASE WHEN distrust > trust THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN score USING (host)"""


QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
x AS (SELECT row_number() OVER () AS r, doc_id, line, regexp_extract_all(line, {_WORD}) AS w, lower(line) AS low FROM l),
lg AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM x WHERE len(w) > 64),
lc AS (SELECT r, count(DISTINCT p) AS covered FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT r, i FROM lg QUALIFY count(*) OVER (PARTITION BY r, g) > 1)) GROUP BY r),
y AS (SELECT x.*, coalesce(covered, 0) AS covered FROM x LEFT JOIN lc USING (r)),
bad AS (SELECT doc_id, line, len(w) AS n, len(w) >= 12 AND NOT regexp_matches(line, '[.!?:;,…。]')
{"".join(f" OR (length(line) - length(translate(line, '{m}', '')) >= 4 AND 16 * (length(line) - length(translate(line, '{m}', ''))) >= length(line))" for m in MARKS.values())}
{"".join(f" OR contains(low, '{b}')" for b in BOILERPLATE)}
 OR len(w) >= 8 AND len(list_distinct(w)) * 3 <= len(w) AND (len(w) <= 64
  OR 3 * list_sum(list_transform(range((len(w) - 1) // 64 + 1), lambda k: len(list_distinct(w[64 * k + 1:64 * k + 64])))) <= len(w)
  OR 3 * covered >= 2 * len(w)) AS failed FROM y WHERE len(w) > 0),
b AS (SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines, (count(*) FILTER (failed))::BIGINT AS n_failed_lines,
  coalesce(sum(n) FILTER (failed), 0)::BIGINT AS n_lost_words FROM bad GROUP BY doc_id),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM d WHERE len(w) > 2),
again AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
t AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
  coalesce(n_failed_lines, 0)::BIGINT AS n_failed_lines, coalesce(n_lost_words, 0)::BIGINT AS n_lost_words FROM d LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM t)
SELECT *, NOT base_failed AND 100 * n_lost_words <= 50 * n_words AS kept FROM v"""


def license_scan(agree: int = 3) -> str:
    posts = ", ".join(f"('{w}', {k}, {i})" for k, (_, text, _) in enumerate(NOTICES) for i, w in enumerate(text.split()))
    notes = ", ".join(f"({k}, '{label}', '{key}', {f' {text} '.index(f' {key} ') and len(text[: text.index(key)].split())})" for k, (label, text, key) in enumerate(NOTICES))
    names = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
    return f"""
WITH posts(word, k, i) AS (VALUES {posts}), notes(k, label, key, place) AS (VALUES {notes}), names(phrase, label, n) AS (VALUES {names}),
d AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
u AS MATERIALIZED (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
base AS (SELECT u.doc_id, p, label FROM u JOIN names ON word = string_split(phrase, ' ')[1] JOIN d USING (doc_id) WHERE array_to_string(d.w[p + 1:p + n], ' ') = phrase),
bs AS (SELECT doc_id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
held AS (SELECT word, count(DISTINCT doc_id) AS n FROM u SEMI JOIN posts USING (word) GROUP BY word),
idf AS (SELECT word, ln(((SELECT count(*) FROM documents) + 1) / (coalesce(n, 0) + 1)) + 1 AS idf FROM (SELECT DISTINCT word FROM posts) LEFT JOIN held USING (word)),
top AS (SELECT doc_id, word, count(*) OVER (PARTITION BY doc_id) AS n FROM (SELECT DISTINCT doc_id, word FROM u SEMI JOIN posts USING (word))),
votes AS (SELECT u.doc_id, posts.k, u.p - posts.i AS i FROM u JOIN top USING (doc_id, word) JOIN posts USING (word) WHERE top.n >= {agree} GROUP BY ALL HAVING count(*) >= {agree}),
seen AS (SELECT v.doc_id, v.k, v.i, label FROM votes v JOIN notes USING (k) JOIN d USING (doc_id)
  WHERE v.i + place >= 0 AND array_to_string(d.w[v.i + place + 1:v.i + place + len(string_split(key, ' '))], ' ') = key),
whole AS (SELECT k, sum(idf ORDER BY word) AS whole FROM (SELECT DISTINCT k, word FROM posts) JOIN idf USING (word) GROUP BY k),
got AS (SELECT s.doc_id, s.k, s.i, sum(idf ORDER BY word) AS got FROM (SELECT DISTINCT s.doc_id, s.k, s.i, u.word FROM seen s JOIN u ON u.doc_id = s.doc_id AND u.p >= greatest(s.i, 0) AND u.p < greatest(s.i, 0) + 40
  SEMI JOIN posts ON posts.k = s.k AND posts.word = u.word) s JOIN idf USING (word) GROUP BY ALL),
best AS (SELECT doc_id, max(round(least(got / whole, 1.0), 9)) AS best FROM got JOIN whole USING (k) GROUP BY doc_id),
named AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION ALL SELECT doc_id, label FROM seen) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, (CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END)::DOUBLE AS score
FROM d LEFT JOIN bs USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN best USING (doc_id)"""
