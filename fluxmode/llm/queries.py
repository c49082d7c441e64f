"""The registered queries of the training-data operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontamination, exact_dedup, infill, langid, licenses, near_dedup, packing, pii, quality, secrets, substring_dedup, turns, urls
from .common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), TOKENIZER))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.removals(table(spark, sf_dir, "documents")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scores(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(table(spark, sf_dir, "documents"))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digest(infill.transform(table(spark, sf_dir, "documents")))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def op13_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.digest(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_language": op3_language,
    "op4_pii": op4_pii,
    "op5_decontamination": op5_decontamination,
    "op6_url_filter": op6_url_filter,
    "op7_secrets": op7_secrets,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_quality": op9_quality,
    "op10_minhash": op10_minhash,
    "op11_infill": op11_infill,
    "op12_licenses": op12_licenses,
    "op13_turns": op13_turns,
}

_SQL2 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
WINDOW w AS (PARTITION BY norm)
"""

_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

_SQL5 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS gram, least(len(w), 13) AS k
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
o AS (SELECT p.doc_id, p.i, g.k, g.item_id FROM (SELECT DISTINCT k FROM g) s JOIN p ON p.i + s.k - 1 <= len(p.w)
      JOIN g ON g.k = s.k AND g.gram = array_to_string(p.w[p.i:p.i + s.k - 1], ' ')),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM o) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""

_SQL8 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, i, hash(w[i:i + 19]) AS h, w[i:i + 19] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(g, ' ') ORDER BY doc_id, i) AS n FROM s) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM r),
l AS (SELECT doc_id, list(j) AS js FROM c GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN js IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(js, k)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN l USING (doc_id)
"""

def _resolving(name: str, source: str) -> str:
    """Common tables that end in `name` (page, url, target): the targets of source (page, url, against, target) as absolute addresses."""
    return rf"""
asked_{name} AS (SELECT page, url, replace(target, '&amp;', '&') AS target, regexp_extract(against, '^([^:/?#]+)://', 1) AS scheme,
  translate(regexp_extract(substr(against, instr(against, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(against, instr(against, '://') + 3), '(?s)^[^/?#]*(/[^?#]*)', 1) AS path FROM {source} WHERE target <> ''),
based_{name} AS (SELECT *, scheme || '://' || host AS site, CASE WHEN path = '' THEN '/' ELSE path END AS own, regexp_extract(target, '(?s)^[^?#]*', 0) AS name, regexp_extract(target, '(?s)^[^?#]*(.*)', 1) AS tail FROM asked_{name}),
{name} AS (SELECT page, url, CASE WHEN regexp_matches(target, '(?i)^[a-z][a-z0-9+.-]*://') THEN target WHEN starts_with(target, '//') THEN scheme || ':' || target WHEN starts_with(target, '/') THEN site || target
  WHEN starts_with(target, '?') THEN site || own || target WHEN NOT regexp_matches(target, '(?i)^(#|[a-z][a-z0-9+.-]*:)')
  THEN site || array_to_string(list_reduce(list_transform(string_split(regexp_replace(regexp_replace(own, '[^/]*$', '') || name, '/(\.\.?)$', '/\1/'), '/'), lambda x: [x]),
    lambda acc, x: CASE WHEN x[1] = '.' THEN acc WHEN x[1] = '..' THEN acc[1:greatest(1, len(acc) - 1)] ELSE list_concat(acc, x) END), '/') || tail END AS target FROM based_{name})"""


_VALUE = r"""(?:"[^"]*"|''[^'']*''|[^\s>"''][^\s>]*)"""
_BODY = rf"(?:[^>=]|=\s*{_VALUE})*(?:=\s*)?"
_MARKUP = rf"(?is)<!--(?:-?>|.*?(?:--!?>|\z))|" + "|".join(rf"<{x}(?:[\s/]{_BODY})?>.*?(?:</{x}[\s/>]|\z)" for x in urls._TEXT.split("|")) + rf"|</?[a-z]{_BODY}>|</?[a-z].*"
_NAMES, _VALUES = (rf"""regexp_extract_all(body, '([^\s=>/"'']+)(?:\s*=\s*({_VALUE}))?', {k})""" for k in (1, 2))


def _value(name: str) -> str:
    return rf"""trim(regexp_replace(regexp_replace(vals[list_position(names, '{name}')], '^["'']|["'']$', '', 'g'), '[\t\r\n]', ' ', 'g'))"""


_SQL6 = rf"""
WITH RECURSIVE held AS (SELECT row_number() OVER () AS page, url, html FROM (SELECT DISTINCT url, html FROM pages WHERE instr(url, '://') > 0 AND (contains(lower(html), 'canonical') OR contains(lower(html), 'http-equiv')))),
markup AS (SELECT page, url, unnest(regexp_extract_all(html, '{_MARKUP}')) AS t, generate_subscripts(regexp_extract_all(html, '{_MARKUP}'), 1) AS i FROM held),
bodies AS (SELECT page, url, i, lower(regexp_extract(t, '(?i)^<([a-z]+)', 1)) AS tag, regexp_replace(t, '(?i)^<[a-z]+', '') AS body FROM markup WHERE regexp_matches(t, '(?is)^<(link|meta|base)[\s/].*>$')),
tags AS (SELECT page, url, i, tag, list_transform({_NAMES}, lambda x: lower(x)) AS names, {_VALUES} AS vals FROM bodies),
bases AS (SELECT page, any_value(url) AS url, any_value(url) AS against, arg_min({_value("href")}, i) AS target FROM tags WHERE tag = 'base' AND list_contains(names, 'href') GROUP BY page),{_resolving("bases_at", "bases")},
said AS (SELECT page, url, {_value("href")} AS target FROM tags WHERE tag = 'link' AND list_contains(regexp_split_to_array(lower({_value("rel")}), '\s+'), 'canonical')
  UNION SELECT page, url, trim(regexp_extract(regexp_replace(regexp_replace({_value("content")}, '^\s*[\d.]*\s*[;,]?\s*', ''), '(?i)^url\s*=\s*', ''), '(?s)^["'']?([^"'']+)', 1)) FROM tags WHERE tag = 'meta' AND lower({_value("http-equiv")}) = 'refresh'),
found AS (SELECT s.page, s.url, coalesce(b.target, s.url) AS against, s.target FROM said s LEFT JOIN bases_at b USING (page)),{_resolving("resolved", "found")},
urls AS (SELECT url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM (SELECT url FROM pages UNION SELECT target FROM resolved WHERE target IS NOT NULL)),
parts AS (SELECT url, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(rest, '(?s)^[^/?#]*(/[^?#]*)', 1), '') AS path,
  regexp_extract(rest, '(?s)^[^/?#]*([^#]*)', 1) AS tail FROM urls),
rules(v, h, s) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fits AS (SELECT url, arg_max(h || s, length(h || s)) AS rule, arg_max(v, length(h || s)) AS verdict FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY 1),
known AS (SELECT p.url, host, path, rule, verdict, host || CASE WHEN tail = '' OR starts_with(tail, '?') THEN '/' ELSE '' END || tail AS address FROM parts p LEFT JOIN fits f ON p.url IS NOT DISTINCT FROM f.url),
link AS (SELECT DISTINCT x.address AS a, y.address AS b FROM resolved r JOIN known x ON x.url = r.url JOIN known y ON y.url = r.target WHERE x.address <> y.address),
both_ AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
cc(node, label) USING KEY (node) AS (SELECT DISTINCT a, a FROM both_ UNION SELECT e.b, min(cc.label) FROM cc JOIN both_ e ON e.a = cc.node JOIN recurring.cc AS had ON had.node = e.b WHERE cc.label < had.label GROUP BY e.b),
spread AS (SELECT label, min(verdict) AS verdict FROM cc JOIN known ON address = node GROUP BY 1)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(k.verdict, s.verdict, 'allow') AS verdict FROM pages p LEFT JOIN known k ON p.url IS NOT DISTINCT FROM k.url LEFT JOIN cc ON node = address LEFT JOIN spread s USING (label)
"""

_SQL11 = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, [CAST('0x' || substr(d, 8 * k + 1, 8) AS BIGINT) for k in range(4)] AS h FROM t),
c AS (SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS i, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS j,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[:i], '') AS p, array_to_string(u[i + 1:j], '') AS m, array_to_string(u[j + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""

_SQL12 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
tw AS (SELECT t, label, phrase, string_split(x, ' ') AS tw, CASE WHEN phrase THEN len(string_split(x, ' ')) ELSE least({licenses.K}, len(string_split(x, ' '))) END AS k
  FROM (VALUES {", ".join(f"({i}, '{label}', {i < len(licenses.PHRASES)}, '{text}')" for i, (label, text) in enumerate((*licenses.PHRASES, *licenses.NOTICES)))}) AS v(t, label, phrase, x)),
tg AS (SELECT *, array_to_string(tw[tpos + 1:tpos + k], ' ') AS gram FROM (SELECT t, label, phrase, tw, len(tw) AS m, k, unnest(range(len(tw) - k + 1)) AS tpos FROM tw)),
p AS (SELECT rid, w, unnest(range(len(w))) AS i FROM d),
v AS (SELECT rid, t, label, phrase, m, tg.k, i - tpos AS g, tpos FROM (SELECT DISTINCT k FROM tg) s JOIN p ON i + s.k <= len(w) JOIN tg ON tg.k = s.k AND gram = array_to_string(w[i + 1:i + s.k], ' ')),
a AS (SELECT DISTINCT rid, t, label, m, g FROM v WHERE NOT phrase),
c AS (SELECT a.rid, a.t, a.label, a.m, a.g, least(count(DISTINCT x.tpos + j), count(DISTINCT x.g + x.tpos + j)) AS n, min(x.g + x.tpos + j) AS start, max(x.g + x.tpos + j) + 1 AS stop
  FROM a JOIN (SELECT *, unnest(range(k)) AS j FROM v) x ON x.rid = a.rid AND x.t = a.t AND x.g BETWEEN a.g AND a.g + {licenses.BAND} GROUP BY ALL),
f AS (SELECT *, struct_pack(n := n, d := -g) = max(struct_pack(n := n, d := -g)) OVER (PARTITION BY rid, t ORDER BY g RANGE BETWEEN {licenses.BAND} PRECEDING AND {licenses.BAND} FOLLOWING) AS best
  FROM c WHERE n >= m * CAST({licenses.FOUND} AS DOUBLE)),
s AS (SELECT rid, label, n / m AS score, stop > coalesce(max(stop) OVER (PARTITION BY rid ORDER BY start, stop DESC, n / m DESC, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS kept FROM f WHERE best),
e AS (SELECT rid, label, true AS base, g AS start, 1.0 AS score FROM v WHERE phrase UNION ALL SELECT rid, label, false, NULL, score FROM s WHERE kept)
SELECT any_value(doc_id) AS doc_id, CAST(any_value(len(w)) AS BIGINT) AS n_words, count(*) FILTER (base) AS n_base, min(start) AS first_word, max(start) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, CAST(coalesce(max(score), 0) AS DOUBLE) AS score
FROM d LEFT JOIN e USING (rid) GROUP BY rid
"""

_SQL13 = r"""
WITH RECURSIVE places AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS place FROM conversations),
kinds AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, [CAST(unicode(x) AS BIGINT) for x in string_split(place, '')]),
  lambda a, x: list_reduce(list_prepend(xor(a, x), [CAST(0 AS BIGINT) for z in range(8)]), lambda b, z: xor(b >> 1, 3988292384 * (b & 1))))) % 20 AS kind FROM places),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM kinds WHERE kind <> 0),
held AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
  left(role, 1) AS initial, right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS final FROM damaged),
rows_ AS (SELECT conv_id, turn, role, text, pos, initial, CASE WHEN final = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
  lead(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS following FROM held),
moves(state, initial, after) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
brought(state, role, after) AS (VALUES (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)),
inserted(state, after, n, cost, edits, lines) AS (SELECT s, s, 0, 0, '', CAST([] AS VARCHAR[]) FROM unnest(range(4)) AS x(s) UNION ALL
  SELECT i.state, b.after, n + 1, cost + 2, edits || 'I', list_append(lines, b.role || ':') FROM inserted i JOIN brought b ON b.state = i.after WHERE n < 3),
each(state, after, fault, initial, cost, edits, role) AS (
  SELECT s, s, f, i, 3, 'D', CAST(NULL AS VARCHAR) FROM unnest(range(4)) AS x(s), unnest(['none', 'truncated', 'blank', 'duplicate']) AS y(f), (SELECT DISTINCT initial AS i FROM rows_) UNION ALL
  SELECT state, after, f, initial, CAST(f = 'truncated' AS INT), 'K', CAST(NULL AS VARCHAR) FROM moves, unnest(['none', 'truncated']) AS y(f) UNION ALL
  SELECT state, after, f, i, 2 + CAST(f = 'truncated' AS INT), 'R', role FROM brought, unnest(['none', 'truncated']) AS y(f), (SELECT DISTINCT initial AS i FROM rows_)),
steps AS (SELECT i.state, e.after, e.fault, e.initial, i.cost + e.cost AS cost, i.edits || e.edits AS edits, i.lines, e.role, e.edits AS edit FROM inserted i JOIN each e ON e.state = i.after),
walk(conv_id, pos, state, cost, audit, lines) AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, 0, '', CAST([] AS VARCHAR[]) FROM rows_ UNION ALL
  SELECT conv_id, pos, after, best.cost, best.audit, best.lines FROM (
    SELECT w.conv_id, r.pos, s.after, min(struct_pack(cost := w.cost + s.cost, audit := w.audit || s.edits, lines := list_concat(w.lines, s.lines, CASE s.edit WHEN 'D' THEN CAST([] AS VARCHAR[]) ELSE [coalesce(s.role, r.role) || ':' || r.text] END))) AS best
    FROM walk w JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.pos = w.pos + 1 JOIN steps s ON s.state = w.state AND s.fault = r.fault AND s.initial = r.initial GROUP BY ALL)),
ends AS (SELECT w.conv_id, min(struct_pack(cost := w.cost + i.cost, audit := w.audit || i.edits, lines := list_concat(w.lines, i.lines))) AS best
  FROM walk w JOIN (SELECT conv_id, max(pos) AS n FROM rows_ GROUP BY 1) m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.n = w.pos JOIN inserted i ON i.state = w.state AND i.after IN (0, 3) GROUP BY 1),
told AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (following IS NOT NULL AND initial || following NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY 1)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""

ORACLES = {"op11_infill": _SQL11, "op12_licenses": _SQL12, "op13_turns": _SQL13, "op6_url_filter": _SQL6, "op8_substring_dedup": _SQL8, "op2_exact_dedup": _SQL2, "op5_decontamination": _SQL5}
