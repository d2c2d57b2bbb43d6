"""Queries of the operators that compare documents."""

from __future__ import annotations

from parley.llm import decontaminate, fuzzylines, jaccard, recompress
from parley.llm.registry import query, table

REPEAT_SQL = r"""
WITH listed AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
places AS (SELECT doc_id, len(words) AS n, words, unnest(range(1, len(words) - 18)) AS i FROM listed),
windows AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 19), ' ') AS w FROM places),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM ranked WHERE k > 1),
words AS (SELECT doc_id, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS p FROM listed),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT l.doc_id, len(l.words)::BIGINT AS n_words, len(l.words) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM listed l LEFT JOIN kept k USING (doc_id)"""


@query("op3_recompression", REPEAT_SQL)
def op3_recompression(spark, folder):
    return recompress.drop_repeats(table(spark, folder, "documents"), window=20, with_text=False)


JACCARD_SQL = r"""
WITH RECURSIVE listed AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
places AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, CASE WHEN len(words) > 0 THEN 1 ELSE 0 END) + 1)) AS i FROM listed),
shingles AS (SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + 3), ' ') AS s FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
linked AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
links AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comps AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(c, doc_id)) AS component_id
FROM listed LEFT JOIN sizes USING (doc_id) LEFT JOIN comps ON a = doc_id"""


@query("op4_voronoi_jaccard", JACCARD_SQL)
def op4_voronoi_jaccard(spark, folder):
    return jaccard.join(table(spark, folder, "documents"), length=4, percent=85).select("doc_id", "n_shingles", "component_id")


@query("op7_fuzzy_lines")
def op7_fuzzy_lines(spark, folder):
    return fuzzylines.drop_similar_lines(table(spark, folder, "documents").select("doc_id", "text"))


@query("op1_latent_semantic")
def op1_latent_semantic(spark, folder):
    found = decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("doc", "tie")
