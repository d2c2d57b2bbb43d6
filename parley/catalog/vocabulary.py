"""Token counts, draft vocabularies and the lookups that use them."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.catalog import inputs as inp
from parley.catalog.masks import _quoted, _render_sql, mask_sql
from parley.catalog.registry import query
from parley.catalog.storage import DRAFT
from parley.functions import tokens as tk
from parley.operators import batches as bt
from parley.operators import vocab as vo
from parley.operators.normalise import nest_turns
from parley.plans.vocabulary import chat_token_freq, draft_vocabulary, supervised_token_freq, text_token_freq
from parley.session import materialise

SIZES = (256, 1024)


def _freq(spark, sf):
    return text_token_freq(inp.documents(spark, sf, "text"), vocab_size=inp.VOCAB)


@query("token_freq_all", f"WITH {inp.DOC_FREQ} SELECT * FROM freq")
def _(spark, sf):
    docs = inp.documents(spark, sf, "text")
    return vo.token_freq_all(docs, tk.tokenise(F.col("text"), inp.VOCAB))


@query("text_token_freq", f"WITH {inp.DOC_FREQ} SELECT * FROM freq")
def _(spark, sf):
    return _freq(spark, sf)


@query("token_freq_supervised", f"WITH {inp.TOKENS} SELECT token_id, count(*) AS freq FROM tok WHERE m = 1 GROUP BY 1")
def _(spark, sf):
    return vo.token_freq_supervised(inp.examples(spark, sf))


@query(
    "token_totals",
    f"WITH {inp.DOC_FREQ} SELECT sum(freq)::bigint AS total_tokens, count(*) AS distinct_tokens FROM freq",
)
def _(spark, sf):
    return vo.token_totals(_freq(spark, sf))


@query("freq_order", f"WITH {inp.DOC_FREQ} SELECT *, row_number() OVER (ORDER BY freq DESC, token_id) - 1 AS pos FROM freq")
def _(spark, sf):
    return inp.in_order(vo.freq_order(_freq(spark, sf)))


# The text of a token id: its first word in sorted order.
NAMES = f"names AS (SELECT {inp.token_sql('w')} AS token_id, min(w) AS token FROM doc_words GROUP BY 1)"


def _names(spark, sf, vocab_size=inp.VOCAB):
    # The smallest of many strings is found by sorting, so only distinct words get there.
    words = inp.documents(spark, sf, "text").select(F.explode(tk.words(F.col("text"))).alias("w")).distinct()
    ids = words.select("w", tk.token_id(F.col("w"), vocab_size).alias("token_id"))
    return ids.groupBy("token_id").agg(F.min("w").alias("token"))


@query(
    "token_top_share",
    f"""WITH {inp.DOC_FREQ}, {NAMES}, top AS (
      SELECT token_id, freq, row_number() OVER (ORDER BY freq DESC, token_id)::int AS rank,
             round(freq * 100.0 / (SELECT sum(freq) FROM freq) + 1e-9, 6) AS percent FROM freq)
    SELECT top.*, token FROM top JOIN names USING (token_id) WHERE rank <= 10""",
)
def _(spark, sf):
    top = vo.token_top_share(_freq(spark, sf), 10, _names(spark, sf))
    return top.withColumn("percent", inp.rounded("percent", 6))


@query("draft_vocab", f"WITH {DRAFT} SELECT r, token_id, freq, rank, injected FROM draft")
def _(spark, sf):
    return vo.draft_vocab(_freq(spark, sf), SIZES, inp.EOS)


@query(
    "draft_coverage",
    f"""WITH {DRAFT} SELECT r, count(*) AS tokens, sum(coalesce(freq, 0))::bigint AS covered,
      round(sum(coalesce(freq, 0)) / (SELECT sum(freq) FROM freq) + 1e-12, 9) AS coverage FROM draft GROUP BY r""",
)
def _(spark, sf):
    found = vo.draft_coverage(_freq(spark, sf), SIZES, inp.EOS)
    return found.withColumn("coverage", inp.rounded("coverage", 9))


@query(
    "draft_coverage_injected",
    f"""WITH {DRAFT} SELECT r, count(*) AS tokens, sum(f.freq)::bigint AS covered,
      round(sum(f.freq) / (SELECT sum(freq) FROM freq) + 1e-12, 9) AS coverage
    FROM draft JOIN freq f USING (token_id) GROUP BY r""",
)
def _(spark, sf):
    found = vo.draft_coverage(_freq(spark, sf), SIZES, inp.EOS, include_injected=True)
    return found.withColumn("coverage", inp.rounded("coverage", 9))


@query("d2t_offsets", f"""WITH {DRAFT} SELECT r, draft_id, token_id, token_id - draft_id AS "offset" FROM d2t""")
def _(spark, sf):
    return vo.d2t_offsets(vo.draft_vocab(_freq(spark, sf), SIZES, inp.EOS))


@query(
    "t2d_mask",
    f"""WITH {DRAFT}, v AS (SELECT unnest(range({inp.VOCAB}))::int AS token_id)
    SELECT s.r, v.token_id, d.token_id IS NOT NULL AS in_draft
    FROM v CROSS JOIN sizes s LEFT JOIN draft d ON d.r = s.r AND d.token_id = v.token_id""",
)
def _(spark, sf):
    return draft_vocabulary(_freq(spark, sf), SIZES, inp.VOCAB, inp.EOS).t2d


@query(
    "eos_member",
    f"WITH {DRAFT} SELECT {inp.EOS} AS eos, bool_or(token_id = {inp.EOS}) AS included FROM ranked WHERE rank <= 256",
)
def _(spark, sf):
    return vo.eos_member(vo.top_tokens(_freq(spark, sf), 256), inp.EOS)


@query(
    "eos_members",
    f"""WITH {DRAFT}, asked AS (SELECT unnest([{inp.EOS}, 7, 100, -1, {inp.VOCAB}])::int AS token_id)
    SELECT a.token_id, d.token_id IS NOT NULL AS included FROM asked a LEFT JOIN (SELECT token_id FROM draft WHERE r = 256) d ON d.token_id = a.token_id""",
)
def _(spark, sf):
    bits = vo.draft_bitmap(vo.draft_vocab(_freq(spark, sf), 256, inp.EOS), inp.VOCAB)
    return vo.members(bits, [inp.EOS, 7, 100, -1, inp.VOCAB], inp.VOCAB)


@query(
    "supervised_in_draft_arrays",
    f"""WITH {inp.EXAMPLES}, {inp.DOC_FREQ}, top AS (SELECT token_id FROM freq ORDER BY freq DESC, token_id LIMIT 256)
    SELECT "index", array_to_string(list_transform(list_zip(ids, mask), lambda z: CASE WHEN list_contains(t.l, z[1]) THEN z[2] ELSE 0 END), '') AS mask
    FROM ex, (SELECT list(token_id) AS l FROM top) t""",
)
def _(spark, sf):
    draft = vo.draft_vocab(_freq(spark, sf), 256)
    out = vo.array_in_draft(inp.examples(spark, sf), draft, inp.VOCAB)
    return out.select("index", F.array_join(F.transform("position_mask", lambda m: m.cast("string")), "").alias("mask"))


@query(
    "supervised_in_draft",
    f"""WITH {inp.TURN_WORDS}, t AS (SELECT conv_id, turn, i, {inp.token_sql('w')} AS target,
        (role = 'assistant')::int AS loss_mask FROM turn_words),
      {DRAFT}, d AS (SELECT token_id FROM draft WHERE r = 256)
    SELECT conv_id, turn, i::int AS i, target, loss_mask, CASE WHEN d.token_id IS NULL THEN 0 ELSE loss_mask END AS position_mask
    FROM t LEFT JOIN d ON d.token_id = t.target""",
)
def _(spark, sf):
    t2d = vo.t2d_mask(spark, vo.draft_vocab(_freq(spark, sf), 256, inp.EOS).drop("r"), inp.VOCAB)
    rows = inp.token_rows(spark, sf)
    tokens = rows.withColumn("loss_mask", (F.col("role") == "assistant").cast("int")).drop("role")
    return vo.supervised_in_draft(tokens, t2d, inp.VOCAB)


@query(
    "draft_to_target",
    f"""WITH {inp.TURN_WORDS}, t AS (SELECT conv_id, turn, i, {inp.token_sql('w')} % 512 AS draft_id FROM turn_words),
      {DRAFT}, m AS (SELECT draft_id, token_id FROM d2t WHERE r = 256)
    SELECT conv_id, turn, i::int AS i, draft_id, token_id FROM t LEFT JOIN m USING (draft_id)""",
)
def _(spark, sf):
    d2t = vo.d2t_offsets(vo.draft_vocab(_freq(spark, sf), 256, inp.EOS).drop("r"))
    guesses = inp.token_rows(spark, sf).select("conv_id", "turn", "i", (F.col("target") % 512).alias("draft_id"))
    return vo.draft_to_target(guesses, d2t, 256)


@query(
    "vocab_map_diff",
    f"""WITH {inp.TURN_WORDS}, {inp.DOC_FREQ},
      a AS (SELECT token_id, row_number() OVER (ORDER BY token_id) - 1 AS draft_id FROM
            (SELECT token_id FROM freq ORDER BY freq DESC, token_id LIMIT 256)),
      cf AS (SELECT {inp.token_sql('w')} AS token_id, count(*) AS freq FROM turn_words GROUP BY 1),
      b AS (SELECT token_id, row_number() OVER (ORDER BY token_id) - 1 AS draft_id FROM
            (SELECT token_id FROM cf ORDER BY freq DESC, token_id LIMIT 256)),
      d AS (SELECT abs((a.token_id - a.draft_id) - (b.token_id - b.draft_id)) AS off FROM a JOIN b USING (draft_id)),
      v AS (SELECT unnest(range({inp.VOCAB})) AS token_id),
      t AS (SELECT (v.token_id IN (SELECT token_id FROM a)) AS x, (v.token_id IN (SELECT token_id FROM b)) AS y FROM v)
    SELECT 'd2t' AS "table", 256::bigint AS size_a, 256::bigint AS size_b, max(off) = 0 AS equal,
      count(*) FILTER (off <> 0) AS differing, max(off)::bigint AS max_diff, round(avg(off) + 1e-9, 6) AS mean_diff FROM d
    UNION ALL SELECT 't2d', {inp.VOCAB}, {inp.VOCAB}, bool_and(x = y), count(*) FILTER (x <> y),
      max((x <> y)::int), round(avg((x <> y)::int) + 1e-9, 6) FROM t""",
)
def _(spark, sf):
    one = vo.draft_vocab(_freq(spark, sf), 256).drop("r")
    tokens = inp.token_rows(spark, sf).groupBy(F.col("target").alias("token_id"))
    two = vo.draft_vocab(tokens.agg(F.count(F.lit(1)).alias("freq")), 256).drop("r")
    # Both drafts are used twice, so the few rows of each are written once.
    one, two = materialise(one, "draft"), materialise(two, "draft")
    offsets = vo.vocab_map_diff(vo.d2t_offsets(one), vo.d2t_offsets(two))
    flags = vo.vocab_map_diff(vo.t2d_mask(spark, one, inp.VOCAB), vo.t2d_mask(spark, two, inp.VOCAB))
    both = offsets.withColumn("table", F.lit("d2t")).unionByName(flags.withColumn("table", F.lit("t2d")))
    return both.withColumn("mean_diff", inp.rounded("mean_diff", 6))


@query(
    "decode_tokens",
    f"""WITH {inp.TURN_WORDS}, t AS (SELECT conv_id, turn, i, {inp.token_sql('w', 65536)} AS token_id FROM turn_words),
      {inp.DOC_WORDS}, names AS (SELECT {inp.token_sql('w', 65536)} AS token_id, min(w) AS token FROM doc_words GROUP BY 1)
    SELECT conv_id, string_agg(coalesce(token, '<token_' || token_id || '>'), ' ' ORDER BY turn, i) AS text
    FROM t LEFT JOIN names USING (token_id) GROUP BY conv_id""",
)
def _(spark, sf):
    ids = F.flatten(F.transform("turns", lambda t: tk.tokenise(t["value"], 65536)))
    chats = inp.conversations(spark, sf).select("conv_id", ids.alias("input_ids"))
    return vo.decode_tokens(chats, _names(spark, sf, 65536), "conv_id", 65536, sep=" ")


# ------------------------------------------------------- whole flows on chats


def _chat_records(spark, sf):
    """Conversations as records; a role no template knows stands in for a template that fails."""
    rows = inp.table(spark, sf, "conversations").withColumn("role", F.regexp_replace("role", "^system$", "tool"))
    roles = nest_turns(rows, role="role", text="content")
    # Four in five records are lists of messages, the rest plain text.
    plain = F.col("conv_id") % 5 == 0
    joined = F.array_join(F.transform("messages", lambda m: m["content"]), " ")
    return roles.select("conv_id", F.when(~plain, F.col("messages")).alias("messages"), F.when(plain, joined).alias("text"))


# Rendered where every role has a template, else joined; one message alone is nothing.
CHAT_TEXTS = f"""{inp.TURNS}, chats AS (
  SELECT conv_id, conv_id % 5 = 0 AS plain, count(*) AS n, bool_and(role IN ('user', 'assistant')) AS known,
    string_agg(text, ' ' ORDER BY pos) AS joined, string_agg(CASE role WHEN 'assistant' THEN ' ' ELSE '' END || text, ' ' ORDER BY pos) AS spaced,
    '<|begin_of_text|>' || string_agg('<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10)
      || CASE role WHEN 'assistant' THEN ' ' ELSE '' END || text || '<|eot_id|>', '' ORDER BY pos) AS form
  FROM turns GROUP BY conv_id),
texts AS (SELECT CASE WHEN plain THEN joined WHEN n < 2 THEN NULL WHEN known THEN form ELSE spaced END AS text,
  NOT plain AND n >= 2 AND NOT known AS fallback FROM chats),
chat_words AS (SELECT unnest(regexp_extract_all(text, '{inp.WORD}')) AS w FROM texts),
chat_freq AS (SELECT {inp.token_sql('w')} AS token_id, count(*) AS freq FROM chat_words GROUP BY 1)"""


@query("chat_token_freq", f"WITH {CHAT_TEXTS} SELECT * FROM chat_freq")
def _(spark, sf):
    return chat_token_freq(_chat_records(spark, sf).drop("conv_id"), "llama").freq


@query(
    "chat_token_report",
    f"""WITH {CHAT_TEXTS} SELECT count(*) AS records, count(*) FILTER (text IS NULL) AS empty,
      count(*) FILTER (fallback) AS fallback, 0::bigint AS failed FROM texts""",
)
def _(spark, sf):
    return chat_token_freq(_chat_records(spark, sf).drop("conv_id"), "llama").report


@query(
    "chat_draft_map",
    f"""WITH {CHAT_TEXTS}, top AS (SELECT token_id FROM chat_freq ORDER BY freq DESC, token_id LIMIT 256)
    SELECT 256 AS r, (row_number() OVER (ORDER BY token_id) - 1)::int AS draft_id, token_id,
      (token_id - row_number() OVER (ORDER BY token_id) + 1)::int AS "offset" FROM top""",
)
def _(spark, sf):
    freq = chat_token_freq(_chat_records(spark, sf).drop("conv_id"), "llama").freq
    return draft_vocabulary(freq, 256, inp.VOCAB).d2t


def failing_factory(vocab_size: int = inp.VOCAB):
    """A tokeniser that refuses texts whose length is a multiple of seven."""

    def factory():
        import hashlib

        def encode(text: str) -> list[int]:
            if len(text) % 7 == 0:
                raise ValueError("a length of sevens")
            return [int(hashlib.md5(w.encode()).hexdigest()[:6], 16) % vocab_size for w in text.split()]

        return encode

    return factory


@query(
    "chat_token_failures",
    f"""WITH {CHAT_TEXTS} SELECT count(*) AS records, count(*) FILTER (text IS NULL) AS empty,
      count(*) FILTER (fallback) AS fallback, count(*) FILTER (length(text) % 7 = 0) AS failed,
      (SELECT coalesce(sum(len(regexp_extract_all(text, '{inp.WORD}'))), 0)::bigint FROM texts WHERE length(text) % 7 <> 0) AS tokens FROM texts""",
)
def _(spark, sf):
    counted = chat_token_freq(_chat_records(spark, sf).drop("conv_id"), "llama", encode=bt.pluggable_tokeniser(failing_factory()))
    tokens = counted.freq.agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("t")).scalar()
    return counted.report.withColumn("tokens", tokens)


LEGACY = f"""chat0 AS (
  SELECT conv_id, turn, role, text FROM conversations WHERE role <> 'system'
  UNION ALL SELECT DISTINCT conv_id, -1, 'system', '{inp.SYSTEM}' FROM conversations WHERE role <> 'system'),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM chat0),
good AS (SELECT conv_id FROM numbered GROUP BY conv_id HAVING bool_and(pos = 0 OR role = CASE WHEN pos % 2 = 1 THEN 'user' ELSE 'assistant' END)),
turns AS (SELECT conv_id, pos, role, text FROM numbered JOIN good USING (conv_id)),
rendered AS (SELECT conv_id, {_render_sql('llama')} AS text FROM turns GROUP BY conv_id),
pieces AS (SELECT conv_id, text, string_split(text, {_quoted(tk.SEPARATORS['llama']['user'])}) AS p FROM rendered),
glued AS (SELECT conv_id, CASE WHEN len(p) > 1 THEN list_concat([p[1] || {_quoted(tk.SEPARATORS['llama']['user'])} || p[2]], p[3:]) END AS parts FROM pieces),
parts AS (SELECT conv_id, generate_subscripts(parts, 1) - 1 AS i, unnest(parts) AS part FROM glued),
state AS (SELECT *, part = '' OR len(string_split(part, {_quoted(tk.SEPARATORS['llama']['assistant'])})) <> 2 AS bad FROM parts),
usable AS (SELECT conv_id, i, part FROM (SELECT *, max(bad::int) OVER (PARTITION BY conv_id ORDER BY i) AS past FROM state) WHERE past = 0),
counts AS (SELECT conv_id, i, len(regexp_extract_all(part, '{inp.WORD}')) AS t, len(regexp_extract_all(
  string_split(part, {_quoted(tk.SEPARATORS['llama']['assistant'])})[1] || {_quoted(tk.SEPARATORS['llama']['assistant'])}, '{inp.WORD}')) - 1 AS k FROM usable),
ids AS (SELECT conv_id, regexp_extract_all(text, '{inp.WORD}')[1:2048] AS ws FROM rendered),
lens AS (SELECT conv_id, len(ws) AS L FROM ids), {mask_sql('llama', 'counts')}"""


@query(
    "supervised_chat_freq",
    f"""WITH {LEGACY}, w AS (SELECT unnest(ws) AS w, unnest(string_split(mask, '')) AS m FROM ids JOIN masks USING (conv_id))
    SELECT {inp.token_sql('w')} AS token_id, count(*) AS freq FROM w WHERE m = '1' GROUP BY 1""",
)
def _(spark, sf):
    return supervised_token_freq(inp.sharegpt(spark, sf), "conv_id", "llama", 2048, system=inp.SYSTEM).freq


@query(
    "supervised_chat_report",
    f"""WITH {LEGACY} SELECT (SELECT count(DISTINCT conv_id) FROM conversations) AS records,
      (SELECT count(DISTINCT conv_id) FROM conversations) - (SELECT count(*) FROM good) AS empty, 0::bigint AS fallback, 0::bigint AS failed""",
)
def _(spark, sf):
    return supervised_token_freq(inp.sharegpt(spark, sf), "conv_id", "llama", 2048, system=inp.SYSTEM).report
