"""Queries of the operators on pages, and the id files."""

from __future__ import annotations

from parley.llm import lineblock, planes, urls
from parley.llm.registry import query, table

RULES = [
    urls.Rule("allow", "org", "/"),
    urls.Rule("block", "example.org", "/es/"),
    urls.Rule("block", "example.org", "/en/1"),
    urls.Rule("allow", "com", "/fr/"),
    urls.Rule("block", "com", "/de/"),
]


@query("op2_bit_planes")
def op2_bit_planes(spark, folder):
    import public_tokenizers

    docs = table(spark, folder, "documents")
    return planes.token_shards(docs, public_tokenizers.path("word_bpe_49k.json"), vocab_size=49_408, end_id=1)


URL_PARTS = r"""
  named AS (
    SELECT page_id, url, html,
           CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
    FROM pages),
  parts AS (
    SELECT page_id, url, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail
    FROM named),
  rules(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
           ('allow', 'com', '/fr/'), ('block', 'com', '/de/'))"""
URL_SQL = rf"""
WITH RECURSIVE {URL_PARTS},
  tags AS (
    SELECT host, path, host || tail AS src, unnest(regexp_extract_all(regexp_replace(html, '<!--.*?-->|<script\b.*?</script\s*>', ' ', 'gis'), '<(?:link|meta)\b[^>]*>', 0, 'i')) AS tag
    FROM parts WHERE host <> ''),
  links AS (
    SELECT host, path, src, replace(CASE
        WHEN regexp_matches(tag, '^<link\b[^>]*\brel\s*=\s*["'']?\s*canonical\b', 'i') THEN regexp_extract(tag, '\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1, 'i')
        WHEN regexp_matches(tag, '^<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?\s*refresh\b', 'i') THEN regexp_extract(tag, '\burl\s*=\s*["'']?\s*([^"''\s>]+)', 1, 'i') END, '&amp;', '&') AS dst
    FROM tags),
  whole AS (
    SELECT src, CASE
        WHEN regexp_matches(dst, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN substr(dst, instr(dst, '://') + 3)
        WHEN starts_with(dst, '//') THEN substr(dst, 3)
        WHEN starts_with(dst, '/') THEN host || dst
        WHEN regexp_matches(dst, '^[?#]') THEN host || path || dst
        ELSE host || CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '^.*/') END || dst END AS rest
    FROM links WHERE dst <> ''),
  edges AS (
    SELECT src, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS dst
    FROM whole),
  sides AS (SELECT src AS a, dst AS b FROM edges WHERE dst <> '' UNION SELECT dst, src FROM edges WHERE dst <> ''),
  reach AS (SELECT a, a AS b FROM sides UNION SELECT r.a, s.b FROM reach r JOIN sides s ON r.b = s.a),
  blocked AS (
    SELECT DISTINCT b FROM (
      SELECT b, (SELECT max_by(u.verdict, length(u.host || u.path)) FROM rules u
                 WHERE (regexp_extract(b, '^[^/?#]*') = u.host OR ends_with(regexp_extract(b, '^[^/?#]*'), '.' || u.host))
                   AND starts_with(regexp_extract(b, '^[^/?#]*([^?#]*)', 1), u.path)) AS v
      FROM (SELECT DISTINCT b FROM reach)) WHERE v = 'block'),
  bad AS (SELECT DISTINCT a AS node FROM reach JOIN blocked USING (b)),
  comps AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a),
  fits AS (
    SELECT p.page_id, p.url, max_by(u.host || u.path, length(u.host || u.path)) AS rule, max_by(u.verdict, length(u.host || u.path)) AS verdict
    FROM parts p JOIN rules u ON (p.host = u.host OR ends_with(p.host, '.' || u.host)) AND starts_with(p.path, u.path)
    GROUP BY ALL)
SELECT p.page_id, coalesce(p.host, '') AS host, coalesce(p.path, '') AS path, f.rule,
       coalesce(f.verdict, CASE WHEN bad.node IS NOT NULL THEN 'block' END, 'allow') AS verdict, comps.component
FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id AND p.url = f.url
     LEFT JOIN bad ON p.host <> '' AND bad.node = p.host || p.tail
     LEFT JOIN comps ON p.host <> '' AND comps.node = p.host || p.tail"""


@query("op5_redirect_equivalence", URL_SQL)
def op5_redirect_equivalence(spark, folder):
    return urls.url_verdicts(table(spark, folder, "pages"), RULES)


# The pages of the tables mark their article; this is what it holds, put in SQL.
PAGE_SQL = r"""
WITH blocks AS (
  SELECT page_id, url, string_split(regexp_replace(regexp_replace(
      regexp_extract(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<article[^>]*>(.*?)(</article>|$)', 1, 's'),
      '\s+', ' ', 'g'), '</?(p|h1|h2|h3|div|section|ul|ol|li|blockquote|pre|table|tr|td)\b[^>]*>', chr(10), 'g'), chr(10)) AS parts
  FROM pages),
clean AS (
  SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(
      replace(replace(replace(replace(replace(regexp_replace(regexp_replace(x, '<br[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g'),
        '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') AS parts
  FROM blocks)
SELECT page_id, url, coalesce(array_to_string(parts, chr(10)), '') AS text, length(coalesce(array_to_string(parts, chr(10)), '')) AS n_chars FROM clean"""


@query("op6_line_block", PAGE_SQL)
def op6_line_block(spark, folder):
    return lineblock.extract(table(spark, folder, "pages"))
