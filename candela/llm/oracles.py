"""SQL equivalents, for DuckDB.  Queries that SQL has no form for are held against plain Python in the tests."""

EXACT = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""


def _found(kind: str, place: int, pattern: str, group: int, least: int) -> str:
    """Spans of one rule: matches and the gaps between them, and their lengths added up."""
    p = pattern.replace("'", "''")
    return f"""
{kind}_m AS (
  SELECT doc_id, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS h, regexp_split_to_array(t, '{p}') AS g
  FROM d WHERE regexp_matches(t, '{p}')),
{kind}_u AS (
  SELECT doc_id, unnest(range(1, len(m) + 1)) AS i, m, h, g FROM {kind}_m),
{kind}_s AS (
  SELECT doc_id, {place} AS place, length(h[i]) AS size, length(m[i]) AS width,
         CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a
  FROM {kind}_u),
{kind}_f AS (SELECT doc_id, place, a, a + width AS b FROM {kind}_s WHERE size >= {least})"""


SECRETS = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),"
    + _found("assign", 0, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12) + ","
    + _found("access", 1, "AKIA[A-Z0-9]+", 0, 18) + ","
    + _found("hex", 2, "[0-9a-f]{16,}", 0, 16)
    + """,
f AS (SELECT * FROM assign_f UNION ALL SELECT * FROM access_f UNION ALL SELECT * FROM hex_f),
s AS (
  SELECT doc_id, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex,
         string_agg(['assign', 'access', 'hex'][place + 1] || ':' || a || ':' || b, ',' ORDER BY a, place) AS spans
  FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(d.t) AS blob
FROM d LEFT JOIN s ON d.doc_id = s.doc_id
"""
)

URLS = r"""
WITH RECURSIVE u AS (
  SELECT page_id, coalesce(html, '') AS html,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
         list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'),
           lambda p: p != '' AND NOT regexp_matches(p, '^(utm_[a-z_]+|gclid|fbclid|ref|ref_src)(=.*)?$'))) AS query
  FROM pages),
-- the tables have whole links only; the operator also takes relative ones
l AS (
  SELECT page_id, host, path, query, unnest([
    regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
    regexp_extract(html, '(?is)<link\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)["'']?[^>]*\brel\s*=\s*["'']?canonical\b', 1),
    regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*\bcontent\s*=\s*["'']?\s*\d+\s*[;,]\s*url\s*=\s*["'']?([^"''\s>]+)', 1)]) AS raw
  FROM u WHERE host != '' OR path != ''),
t AS (
  SELECT DISTINCT host || (CASE WHEN path = '' THEN '/' ELSE path END) || (CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END) AS a,
         replace(raw, '&amp;', '&') AS link
  FROM l WHERE regexp_matches(raw, '^[A-Za-z][A-Za-z0-9+.-]*://')),
e AS (
  SELECT a, translate(regexp_extract(link, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
         || coalesce(nullif(regexp_extract(link, '(?s)^.*?://[^/?#]*([^?#]*)', 1), ''), '/')
         || (CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END) AS b
  FROM (SELECT *, list_sort(list_filter(string_split(regexp_extract(link, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'),
          lambda p: p != '' AND NOT regexp_matches(p, '^(utm_[a-z_]+|gclid|fbclid|ref|ref_src)(=.*)?$'))) AS q FROM t)),
n AS (SELECT a, b FROM e WHERE a != b UNION SELECT b, a FROM e WHERE a != b),
reach AS (SELECT DISTINCT a, a AS b FROM n UNION SELECT reach.a, n.b FROM reach JOIN n ON reach.b = n.a),
rules(verdict, rhost, rpath) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
known AS (
  SELECT DISTINCT a AS address, string_split(a, '/')[1] AS host, regexp_extract(a, '(?s)^[^/?]*([^?]*)', 1) AS path FROM n),
named AS (
  SELECT k.address, arg_max(r.verdict, length(rhost || rpath)) AS verdict
  FROM known k JOIN rules r ON (k.host = rhost OR ends_with(k.host, '.' || rhost)) AND starts_with(k.path, rpath) GROUP BY 1),
fate AS (
  SELECT reach.a AS address, min(reach.b) AS alias_root, coalesce(bool_or(named.verdict = 'block'), false) AS blocked
  FROM reach LEFT JOIN named ON reach.b = named.address GROUP BY 1),
own AS (
  SELECT u.page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM u JOIN rules ON (u.host = rhost OR ends_with(u.host, '.' || rhost)) AND starts_with(u.path, rpath) GROUP BY 1)
SELECT u.page_id, u.host, u.path, own.rule,
       coalesce(own.verdict, CASE WHEN fate.blocked THEN 'block' ELSE 'allow' END) AS verdict, fate.alias_root
FROM u LEFT JOIN own ON u.page_id = own.page_id
LEFT JOIN fate ON fate.address = u.host || (CASE WHEN u.path = '' THEN '/' ELSE u.path END)
  || (CASE WHEN len(u.query) > 0 THEN '?' || array_to_string(u.query, '&') ELSE '' END)
"""

JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x != '') AS words
  FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(words) - 3, 1) + 1), lambda k: array_to_string(words[k:k + 3], ' ')))) AS shingle
  FROM w WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id != y.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.size + y.size - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
SELECT w.doc_id, coalesce(n.size, 0) AS n_shingles, r.component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = w.doc_id
"""

FILL_MIDDLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (
  SELECT doc_id, t, length(t) AS n, ('0x' || h[1:8])::BIGINT % (length(t) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (length(t) + 1) AS c2,
         ('0x' || h[17:24])::BIGINT % 100 AS p, ('0x' || h[25:32])::BIGINT % 100 AS q
  FROM d),
c AS (
  SELECT doc_id, t, n, least(c1, c2) AS a, greatest(c1, c2) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR p >= 90 THEN 'plain'
              WHEN q < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM r),
o AS (
  SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN a END AS prefix_chars, CASE WHEN form != 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM o
"""

ORACLES: dict[str, str] = {
    "op1_exact_dedup": EXACT, "op2_secret_scans": SECRETS, "op9_url_filters": URLS, "op11_jaccard_join": JACCARD,
    "op13_fill_middle": FILL_MIDDLE,
}
