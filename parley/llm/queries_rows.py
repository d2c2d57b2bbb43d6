"""Queries of the operators that take one document or vector at a time."""

from __future__ import annotations

from parley.llm import packing, pq, rules
from parley.llm.registry import query, table


@query("op8_best_fit")
def op8_best_fit(spark, folder):
    return packing.pack(table(spark, folder, "documents"))


@query("op10_rule_ensemble")
def op10_rule_ensemble(spark, folder):
    return rules.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


# Fewer than a thousand vectors are compared there, pair by pair.
VECTOR_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) > 0),
unit AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM good),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM unit a, unit b WHERE a.vec_id <> b.vec_id AND list_dot_product(a.u, b.u) >= 0.95),
reach AS (SELECT a, a AS b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comps AS (SELECT a, min(b) AS component FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN comps c ON c.a = vec_id LEFT JOIN degree d ON d.a = vec_id"""


@query("op9_product_quantisation", VECTOR_SQL)
def op9_product_quantisation(spark, folder):
    return pq.near_duplicates(table(spark, folder, "embeddings"))
