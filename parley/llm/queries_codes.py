"""Queries of the operators on tokenizers, language models and vector codes."""

from __future__ import annotations

from parley.llm import codebooks, spans, suffixtree
from parley.llm.registry import query, table


def _codebook_sql(parts: int = 4, width: int = 16, entries: int = 256, rounds: int = 4) -> str:
    """The same rounds one after another; every part meets its whole codebook."""
    steps = [
        """good AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v, row_number() OVER (ORDER BY vec_id) AS place
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"p AS (SELECT place, part, v[part * {width} + 1 : part * {width} + {width}] AS v FROM good, range({parts}) r(part))",
        f"c0 AS (SELECT part, place - 1 AS entry, v FROM p WHERE place <= {entries})",
    ]
    for k in range(rounds + 1):
        far = "list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        steps.append(f"""a{k} AS MATERIALIZED (SELECT place, part, min(struct_pack(d := d, entry := entry)) AS best
  FROM (SELECT p.place, p.part, c.entry, {far} AS d FROM p JOIN c{k} c USING (part)) GROUP BY ALL)""")
        if k < rounds:
            steps.append(f"""m{k} AS (SELECT part, entry, list(floor(s / n)::BIGINT ORDER BY pos) AS v FROM (
  SELECT part, best.entry AS entry, pos, sum(v[pos])::DOUBLE AS s, count(*)::DOUBLE AS n FROM a{k} JOIN p USING (place, part), range(1, {width} + 1) r(pos) GROUP BY ALL) GROUP BY ALL)""")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m USING (part, entry))")
    return f"""WITH {", ".join(steps)},
done AS (SELECT place, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY place),
book AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS h FROM c{rounds}),
given AS (SELECT vec_id, label, code, error FROM done JOIN good USING (place))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM given, book"""


@query("op13_adaptive_bounds", _codebook_sql())
def op13_adaptive_bounds(spark, folder):
    return codebooks.encode_vectors(table(spark, folder, "embeddings")).drop("codes")


@query("op12_tokenizer_spans")
def op12_tokenizer_spans(spark, folder):
    import public_tokenizers as files

    return spans.align_tokens(table(spark, folder, "documents"), files.path("byte_bpe_50k.json"), files.path("piece_bpe_32k.model"))


@query("op11_suffix_tree")
def op11_suffix_tree(spark, folder):
    return suffixtree.suffix_tree_scores(table(spark, folder, "documents"))
