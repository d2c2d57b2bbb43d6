"""Roll-ups of predictions, metric logs and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.catalog import inputs as inp
from parley.catalog.masks import _bits
from parley.catalog.registry import query
from parley.catalog.statistics import _rounded
from parley.functions import arrays as ar
from parley.functions import vectors as vc
from parley.operators import evaluate as ev
from parley.operators import vocab as vo
from parley.plans.vocabulary import text_token_freq


@query(
    "masked_accuracy",
    f"""WITH {inp.PREDICTIONS}, {inp.DOC_FREQ}, d AS (SELECT token_id FROM freq ORDER BY freq DESC, token_id LIMIT 1024)
    SELECT k, round(sum((pred = target)::int * loss_mask * (d.token_id IS NOT NULL)::int) / (sum(loss_mask) + 1e-6) + 1e-12, 9) AS accuracy
    FROM pred LEFT JOIN d ON d.token_id = target GROUP BY k""",
)
def _(spark, sf):
    freq = text_token_freq(inp.documents(spark, sf, "text"), vocab_size=inp.VOCAB)
    t2d = vo.t2d_mask(spark, vo.draft_vocab(freq, 1024).drop("r"), inp.VOCAB)
    rows = vo.supervised_in_draft(inp.predictions(spark, sf).drop("top_ids"), t2d, inp.VOCAB)
    found = ev.masked_accuracy(rows, position_mask="position_mask")
    return found.withColumn("accuracy", inp.rounded("accuracy", 9))


@query(
    "topk_accuracy",
    f"""WITH {inp.PREDICTIONS}, h AS (SELECT *, list_position(top_ids, target) AS hit FROM pred),
      c AS (SELECT sum((pred = target)::int * loss_mask)::bigint AS correct, sum(loss_mask)::bigint AS total,
        count(*) FILTER (loss_mask = 1 AND hit = 1) AS top1, count(*) FILTER (loss_mask = 1 AND hit BETWEEN 1 AND 2) AS top2,
        count(*) FILTER (loss_mask = 1 AND hit BETWEEN 1 AND 3) AS top3 FROM h)
    SELECT *, round(correct / (total + 1e-5) + 1e-9, 6) AS acc, round(top1 / (total + 1e-5) + 1e-9, 6) AS top1_acc,
      round(top2 / (total + 1e-5) + 1e-9, 6) AS top2_acc, round(top3 / (total + 1e-5) + 1e-9, 6) AS top3_acc FROM c""",
)
def _(spark, sf):
    return _rounded(ev.topk_accuracy(inp.predictions(spark, sf)))


@query(
    "discounted_loss",
    f"WITH {inp.METRICS} SELECT epoch, step, round(sum(pow(0.8, k) * loss) + 1e-9, 6) AS total_loss FROM metrics GROUP BY 1, 2",
)
def _(spark, sf):
    return _rounded(ev.discounted_loss(inp.metrics(spark, sf)))


@query(
    "epoch_rollup",
    f"""WITH {inp.METRICS}, r AS (SELECT epoch, k, rank, avg(loss) AS loss, avg(acc) AS acc FROM metrics GROUP BY ALL)
    SELECT 'rank0' AS mode, epoch, k, round(loss + 1e-9, 6) AS loss, round(acc + 1e-9, 6) AS acc FROM r WHERE rank = 0
    UNION ALL SELECT 'rank_means', epoch, k, round(avg(loss) + 1e-9, 6), round(avg(acc) + 1e-9, 6) FROM r GROUP BY epoch, k
    UNION ALL SELECT 'pooled', epoch, k, round(avg(loss) + 1e-9, 6), round(avg(acc) + 1e-9, 6) FROM metrics GROUP BY epoch, k""",
)
def _(spark, sf):
    log = inp.metrics(spark, sf)
    out = None
    for mode in ("rank0", "rank_means", "pooled"):
        rows = _rounded(ev.epoch_rollup(log, mode)).withColumn("mode", F.lit(mode))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "shift_zero_fill",
    f"""WITH {inp.EXAMPLES} SELECT "index", {inp.text_sql("list_concat(ids[2:], [0])")} AS next_ids,
      {inp.text_sql("list_concat([0], ids[:-2])")} AS previous_ids,
      array_to_string(list_concat(mask[4:], [0, 0, 0]), '') AS mask3 FROM ex""",
)
def _(spark, sf):
    df = inp.examples(spark, sf)
    return df.select(
        "index",
        inp.joined(ar.shift_zero_fill(F.col("input_ids"))).alias("next_ids"),
        inp.joined(ar.shift_zero_fill(F.col("input_ids"), left=True)).alias("previous_ids"),
        _bits(ar.shift_zero_fill(F.col("loss_mask"), 3)).alias("mask3"),
    )



@query(
    "prediction_views",
    f"""WITH {inp.EXAMPLES}, v AS (SELECT *, unnest(range(4))::int AS k FROM ex)
    SELECT "index", k, {inp.text_sql("list_resize(ids[k + 1:], seq_len, 0)")} AS ids,
      array_to_string(list_resize(mask[k + 1:], seq_len, 0), '') AS mask FROM v""",
)
def _(spark, sf):
    views = ev.prediction_views(inp.examples(spark, sf), 4, ("input_ids", "loss_mask"))
    return views.select("index", "k", inp.joined(F.col("input_ids")).alias("ids"), _bits(F.col("loss_mask")).alias("mask"))


@query(
    "concat_layers",
    """WITH l AS (SELECT vec_id, label, layer, [(x * m)::float for x in embedding] AS v FROM embeddings
        CROSS JOIN (VALUES (2, 1), (16, 2), (29, 3), (32, 4)) t(layer, m))
    SELECT label::bigint AS "index", vec_id AS position,
      len(flatten(list(v ORDER BY layer) FILTER (layer <> 32)))::int AS width,
      round(list_sum(flatten(list(v ORDER BY layer) FILTER (layer <> 32)))::double + 1e-6, 3) AS total,
      round(flatten(list(v ORDER BY layer) FILTER (layer <> 32))[65]::double + 1e-7, 4) AS first_of_second,
      round(flatten(list(v ORDER BY layer) FILTER (layer <> 32))[192]::double + 1e-7, 4) AS last,
      round(any_value(v[1]) FILTER (layer = 32)::double + 1e-7, 4) AS last_state FROM l GROUP BY 1, 2""",
)
def _(spark, sf):
    df = ev.concat_layers(inp.layer_vectors(spark, sf))
    states = F.col("states").cast("array<double>")
    return df.select(
        "index",
        "position",
        F.size("states").alias("width"),
        inp.rounded(F.aggregate(states, F.lit(0.0), lambda a, x: a + x), 3).alias("total"),
        inp.rounded(states[64], 4).alias("first_of_second"),
        inp.rounded(states[191], 4).alias("last"),
        inp.rounded(F.col("last_state")[0].cast("double"), 4).alias("last_state"),
    )


@query(
    "uniform_noise",
    """WITH n AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::double AS x,
        len(embedding) AS width FROM embeddings)
    SELECT vec_id, i, round(x + (('0x' || substr(md5('7:' || vec_id || ':' || i), 1, 8))::bigint / 4294967296.0 - 0.5)
      * 0.2::double * 512 / width + 1e-9, 6) AS x FROM n""",
)
def _(spark, sf):
    vec = vc.uniform_noise(F.col("embedding"), F.col("vec_id"), std=0.2, seed=7)
    rows = inp.table(spark, sf, "embeddings").select("vec_id", F.posexplode(vec).alias("i", "x"))
    return rows.select("vec_id", F.col("i").cast("long").alias("i"), inp.rounded("x", 6).alias("x"))


def _vector_pairs(spark, sf):
    """Each vector against itself doubled and turned by one place; supervised when the label is even."""
    shifted = F.transform(ar.shift_zero_fill(F.col("embedding"), 1, zero=F.lit(0.0).cast("float")), lambda x: x * 2)
    return inp.table(spark, sf, "embeddings").select(
        "label",
        "vec_id",
        F.col("embedding").cast("array<double>").alias("a"),
        shifted.cast("array<double>").alias("b"),
        (F.col("vec_id") % 2).cast("int").alias("mask"),
    )


PAIRS = """pairs AS (SELECT label, vec_id, [x::double for x in embedding] AS a,
  [(x * 2)::double for x in list_concat(embedding[2:], [0::float])] AS b, (vec_id % 2)::int AS mask FROM embeddings)"""


@query(
    "smooth_l1",
    f"""WITH {PAIRS}, d AS (SELECT label, vec_id, mask, abs(unnest(a) - unnest(b)) AS d FROM pairs),
      v AS (SELECT label, vec_id, any_value(mask) AS mask, avg(CASE WHEN d < 1 THEN 0.5 * d * d ELSE d - 0.5 END) AS l
        FROM d GROUP BY 1, 2)
    SELECT label, round(sum(mask * l) / count(*) + 1e-9, 6) AS vloss FROM v GROUP BY label""",
)
def _(spark, sf):
    return _rounded(ev.smooth_l1(_vector_pairs(spark, sf), "a", "b", "mask", by=("label",)))


SOFT = """e AS (SELECT label, vec_id, mask, unnest({a}) AS x, unnest({b}) AS y FROM pairs),
s AS (SELECT *, exp(y) / sum(exp(y)) OVER w AS p, x - ln(sum(exp(x)) OVER w) AS logp FROM e WINDOW w AS (PARTITION BY vec_id)),
v AS (SELECT label, vec_id, any_value(mask) AS mask, -sum(p * logp) AS l FROM s GROUP BY 1, 2)"""


@query(
    "soft_cross_entropy",
    f"WITH {PAIRS}, {SOFT.format(a='a', b='b')} SELECT label, round(sum(mask * l) / count(*) + 1e-9, 6) AS ploss FROM v GROUP BY label",
)
def _(spark, sf):
    return _rounded(ev.soft_cross_entropy(_vector_pairs(spark, sf), "a", "b", "mask", by=("label",)))


@query(
    "soft_cross_entropy_draft",
    f"""WITH {PAIRS}, {SOFT.format(a='a[1:4]', b='[b[1], b[6], b[18], b[64]]')}
    SELECT label, round(sum(mask * l) / count(*) + 1e-9, 6) AS ploss FROM v GROUP BY label""",
)
def _(spark, sf):
    rows = _vector_pairs(spark, sf).withColumn("a", F.slice("a", 1, 4))
    return _rounded(ev.soft_cross_entropy(rows, "a", "b", "mask", draft=[0, 5, 17, 63], by=("label",)))
