"""Families, rendering, tokenising, splitting, loss masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.catalog import inputs as inp
from parley.catalog.registry import query
from parley.functions import masks as mk
from parley.functions import tokens as tk
from parley.functions import turns as tn
from parley.operators.normalise import nest_turns
from parley.plans.training import chat_examples

# ------------------------------------------------------------------ families


@query(
    "family_of",
    """SELECT page_id, url, CASE WHEN lower(p) LIKE '%deepseek%' THEN 'deepseek' WHEN lower(p) LIKE '%qwen%' THEN 'qwen'
      WHEN lower(p) LIKE '%llama%' THEN 'llama' ELSE 'generic' END AS family
    FROM (SELECT page_id, url, CASE length(url) % 5 WHEN 0 THEN url || '/DeepSeek-R1-Distill-Llama-8B'
      WHEN 1 THEN url || '/Qwen2.5-7B' WHEN 2 THEN url || '/Llama-3.1-8B' WHEN 3 THEN url || '/llama-qwen' ELSE url END AS p
      FROM pages)""",
)
def _(spark, sf):
    tails = ["/DeepSeek-R1-Distill-Llama-8B", "/Qwen2.5-7B", "/Llama-3.1-8B", "/llama-qwen", ""]
    tail = F.get(F.array(*[F.lit(t) for t in tails]), F.length("url") % 5)
    pages = inp.table(spark, sf, "pages")
    return pages.select("page_id", "url", tk.family_of(F.concat("url", tail)).alias("family"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


FAMILY_ROWS = ", ".join(
    f"('{f}', {_quoted(tk.SEPARATORS[f]['user'])}, {_quoted(tk.SEPARATORS[f]['assistant'])})" for f in tk.FAMILIES
)


@query(
    "family_separators",
    f"""WITH f(family, sep_user, sep_assistant) AS (VALUES {FAMILY_ROWS})
    SELECT conv_id, f.* FROM (SELECT conv_id, ['deepseek', 'qwen', 'llama', 'generic'][(count(*) % 4 + 1)::int] AS family
      FROM conversations GROUP BY conv_id) JOIN f USING (family)""",
)
def _(spark, sf):
    names = F.array(*[F.lit(f) for f in tk.FAMILIES])
    sizes = inp.table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    picked = sizes.select("conv_id", F.get(names, (F.col("n") % 4).cast("int")).alias("family"))
    return picked.join(F.broadcast(tk.family_separators(spark)), "family")


# ----------------------------------------------------------------- rendering


def _render_sql(family: str, text: str = "text") -> str:
    form = tk.TEMPLATES[family]
    cases = " ".join(
        f"WHEN '{r}' THEN {_quoted(form['open'][r])} || {text} || {_quoted(form['close'][r])}" for r in form["open"]
    )
    return f"{_quoted(form['start'])} || string_agg(CASE role {cases} END, '' ORDER BY pos)"


RENDERED = f"""{inp.TURNS}, rendered AS (
  {' UNION ALL '.join(f"SELECT '{f}' AS family, conv_id, {_render_sql(f)} AS text FROM turns GROUP BY conv_id" for f in tk.FAMILIES)})"""


@query("render_chat", f"WITH {RENDERED} SELECT * FROM rendered")
def _(spark, sf):
    families = F.explode(F.array(*[F.lit(f) for f in tk.FAMILIES]))
    chats = inp.conversations(spark, sf).withColumn("family", families)
    return chats.select("family", "conv_id", tk.render_chat(F.col("turns"), F.col("family")).alias("text"))


@query(
    "tokenise",
    f"""SELECT doc_id, {inp.text_sql(f"[{inp.token_sql('w')} for w in regexp_extract_all(text, '{inp.WORD}')]")} AS ids
    FROM documents""",
)
def _(spark, sf):
    docs = inp.documents(spark, sf, "doc_id", "text")
    return docs.select("doc_id", inp.joined(tk.tokenise(F.col("text"), inp.VOCAB)).alias("ids"))


@query("truncate_ids", f'WITH {inp.EXAMPLES} SELECT "index", {inp.text_sql("ids[1:100]")} AS ids FROM ex')
def _(spark, sf):
    ex = inp.examples(spark, sf)
    return ex.select("index", inp.joined(tk.truncate_ids(F.col("input_ids"), 100)).alias("ids"))


# ----------------------------------------------------- splitting into turns

USER, ASSISTANT = (_quoted(tk.SEPARATORS["qwen"][r]) for r in ("user", "assistant"))

# Rendered conversations with a system turn in front of those that have none, so
# that the first user separator is always there. Parts are numbered from 0.
PREPARED = f"""chat0 AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT conv_id, -1, 'system', '{inp.SYSTEM}' FROM conversations GROUP BY conv_id HAVING arg_min(role, turn) <> 'system'),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role, text FROM chat0),
rendered AS (SELECT conv_id, {_render_sql('qwen')} AS text FROM turns GROUP BY conv_id),
pieces AS (SELECT conv_id, text, string_split(text, {USER}) AS p FROM rendered),
glued AS (SELECT conv_id, text, CASE WHEN len(p) > 1 THEN list_concat([p[1] || {USER} || p[2]], p[3:]) END AS parts FROM pieces),
parts AS (SELECT conv_id, generate_subscripts(parts, 1) - 1 AS i, unnest(parts) AS part FROM glued)"""


def _prepared(spark, sf):
    turns = F.col("conversations")
    framed = F.when(turns[0]["from"] == "system", turns).otherwise(tn.prepend_system(turns, inp.SYSTEM))
    return inp.openthoughts(spark, sf).select("conv_id", framed.alias("turns"))


def _parts(spark, sf):
    text = tk.render_chat(F.col("turns"), "qwen")
    return _prepared(spark, sf).select("conv_id", tk.split_turns(text, tk.SEPARATORS["qwen"]["user"]).alias("parts"))


@query("split_turns", f"WITH {PREPARED} SELECT conv_id, i, part FROM parts")
def _(spark, sf):
    rows = _parts(spark, sf).select("conv_id", F.posexplode("parts").alias("i", "part"))
    return rows.withColumn("i", F.col("i").cast("long"))


# A part that holds the letter sequence "qz" is broken on purpose: it gets a second assistant separator.
GOOD = f"""broken AS (SELECT conv_id, i, CASE WHEN i > 0 AND length(part) % 3 = 0 THEN part || {ASSISTANT} ELSE part END AS part
    FROM parts),
  state AS (SELECT *, part = '' OR len(string_split(part, {ASSISTANT})) <> 2 AS bad FROM broken),
  good AS (SELECT conv_id, i, part FROM (SELECT *, max(bad::int) OVER (PARTITION BY conv_id ORDER BY i) AS past FROM state)
    WHERE past = 0)"""


@query("valid_turn_prefix", f"WITH {PREPARED}, {GOOD} SELECT conv_id, i, part FROM good")
def _(spark, sf):
    sep = tk.SEPARATORS["qwen"]["assistant"]
    broken = F.transform(
        "parts",
        lambda p, i: F.when((i > 0) & (F.length(p) % 3 == 0), F.concat(p, F.lit(sep))).otherwise(p),
    )
    kept = tk.valid_turn_prefix(broken, sep)
    rows = _parts(spark, sf).select("conv_id", F.posexplode(kept).alias("i", "part"))
    return rows.withColumn("i", F.col("i").cast("long"))


# --------------------------------------------------------------------- masks


def _mask_inputs(spark, sf):
    """(conv_id, L, turn_len, instr_len): words of each question and answer, three more for a separator.

    A system turn in front belongs to the first question.
    """
    rows = inp.table(spark, sf, "conversations")
    chats = nest_turns(rows.withColumn("text", F.size(tk.words(F.col("text"))).cast("string")))
    each = chats.select(
        "conv_id",
        (F.col("conversations")[0]["from"] == "system").alias("framed"),
        F.transform("conversations", lambda t: t["value"].cast("int")).alias("each"),
    )
    first = F.array(F.get("each", F.lit(0)) + F.coalesce(F.get("each", F.lit(1)), F.lit(0)))
    rest = F.slice("each", F.lit(3), F.greatest(F.size("each") - 2, F.lit(0)))
    chats = each.select("conv_id", F.when(F.col("framed"), F.concat(first, rest)).otherwise(F.col("each")).alias("n"))
    pairs = F.ceil(F.size("n") / 2).cast("int")
    lens = chats.select("conv_id", "n", F.sequence(F.lit(0), pairs - 1).alias("at"))
    instr = F.transform("at", lambda i: F.get("n", i * 2) + 3)
    turn = F.transform("at", lambda i: F.get("n", i * 2) + 3 + F.coalesce(F.get("n", i * 2 + 1), F.lit(0)))
    out = lens.select("conv_id", turn.alias("turn_len"), instr.alias("instr_len"))
    length = F.aggregate("turn_len", F.lit(0), lambda a, x: a + x) + F.size("turn_len")
    return out.withColumn("L", length)


MASK_INPUTS = f"""{inp.TURNS}, framed AS (SELECT conv_id, bool_or(role = 'system' AND pos = 0)::int AS f FROM turns GROUP BY conv_id),
wc AS (SELECT conv_id, greatest(pos - f, 0) AS pos, len(regexp_extract_all(text, '{inp.WORD}'))::int AS n FROM turns JOIN framed USING (conv_id)),
mi AS (SELECT conv_id, pos // 2 AS i, sum(n) FILTER (pos % 2 = 0) + 3 AS k, sum(n) + 3 AS t FROM wc GROUP BY 1, 2)"""


def mask_sql(family: str, source: str) -> str:
    """From (conv_id, i, t, k) and lengths (conv_id, L): (conv_id, starts, mask) by the zero ranges of a family."""
    if family == "qwen":
        step, lo, hi = "t + 2", ("0", "c - 2"), ("c + k - 2", "c + k - 1")
    else:
        step, lo, hi = "t + CASE WHEN i = 0 THEN 0 ELSE 3 END", ("c", "c - 3"), ("c + k - 2", "c + k + 1")
    return f"""steps AS (SELECT conv_id, i, t, k, {step} AS step FROM {source}),
starts AS (SELECT *, 1 + coalesce(sum(step) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c
  FROM steps),
zeros AS (SELECT conv_id, list(CASE WHEN i = 0 THEN {lo[0]} ELSE {lo[1]} END ORDER BY i) AS lo,
    list(CASE WHEN i = 0 THEN {hi[0]} ELSE {hi[1]} END ORDER BY i) AS hi,
    list(c::int ORDER BY i) AS c, max(c + step) AS stop FROM starts GROUP BY conv_id),
cells AS (SELECT conv_id, p, (p >= 1 AND p < coalesce(stop, 1) AND NOT coalesce(list_bool_or(
      [p >= lo[j] AND p < hi[j] for j in range(1, len(lo) + 1)]), false))::int AS m
  FROM (SELECT conv_id, L, unnest(range(L::bigint)) AS p FROM lens) LEFT JOIN zeros USING (conv_id)),
masks AS (SELECT conv_id, string_agg(m::varchar, '' ORDER BY p) AS mask FROM cells GROUP BY conv_id)"""


MASK_LENS = "lens AS (SELECT conv_id, sum(t) + count(*) AS L FROM mi GROUP BY conv_id)"


def _bits(mask):
    return F.array_join(F.transform(mask, lambda m: m.cast("string")), "")


@query("loss_mask_qwen", f"WITH {MASK_INPUTS}, {MASK_LENS}, {mask_sql('qwen', 'mi')} SELECT conv_id, mask FROM masks")
def _(spark, sf):
    df = _mask_inputs(spark, sf)
    mask = mk.loss_mask_qwen(F.col("L"), F.col("turn_len"), F.col("instr_len"))
    return df.select("conv_id", _bits(mask).alias("mask"))


@query("loss_mask_llama", f"WITH {MASK_INPUTS}, {MASK_LENS}, {mask_sql('llama', 'mi')} SELECT conv_id, mask FROM masks")
def _(spark, sf):
    df = _mask_inputs(spark, sf)
    mask = mk.loss_mask_llama(F.col("L"), F.col("turn_len"), F.col("instr_len"))
    return df.select("conv_id", _bits(mask).alias("mask"))


@query(
    "loss_mask_legacy",
    f"""WITH {MASK_INPUTS}, less AS (SELECT conv_id, i, t, k - 1 AS k FROM mi), {MASK_LENS}, {mask_sql('llama', 'less')}
    SELECT conv_id, mask FROM masks""",
)
def _(spark, sf):
    df = _mask_inputs(spark, sf)
    mask = mk.loss_mask_legacy(F.col("L"), F.col("turn_len"), F.col("instr_len"))
    return df.select("conv_id", _bits(mask).alias("mask"))


@query(
    "cumulative_turn_start",
    f"""WITH {MASK_INPUTS}, {MASK_LENS}, {mask_sql('llama', 'mi')}
    SELECT conv_id, array_to_string(list_append(c, stop::int), ',') AS starts FROM zeros""",
)
def _(spark, sf):
    df = _mask_inputs(spark, sf)
    starts = mk.cumulative_turn_start(F.col("turn_len"), "llama")
    return df.select("conv_id", inp.joined(starts).alias("starts"))


def _counted(part: str) -> str:
    return f"len(regexp_extract_all({part}, '{inp.WORD}'))"


@query(
    "chat_examples",
    f"""WITH {PREPARED}, state AS (SELECT *, part = '' OR len(string_split(part, {ASSISTANT})) <> 2 AS bad FROM parts),
      good AS (SELECT conv_id, i, part FROM (SELECT *, max(bad::int) OVER (PARTITION BY conv_id ORDER BY i) AS past FROM state)
        WHERE past = 0),
      counts AS (SELECT conv_id, i, {_counted('part')} AS t, {_counted(f"string_split(part, {ASSISTANT})[1] || {ASSISTANT}")} AS k FROM good),
      ids AS (SELECT conv_id, regexp_extract_all(text, '{inp.WORD}')[1:300] AS ws FROM rendered),
      lens AS (SELECT conv_id, len(ws) AS L FROM ids),
      {mask_sql('qwen', 'counts')}
    SELECT conv_id AS "index", L::int AS seq_len, {inp.text_sql(f"[{inp.token_sql('w')} for w in ws]")} AS ids, mask
    FROM ids JOIN lens USING (conv_id) JOIN masks USING (conv_id)""",
)
def _(spark, sf):
    ex = chat_examples(_prepared(spark, sf), "conv_id", "qwen", max_len=300)
    return ex.select(
        "index", "seq_len", inp.joined(F.col("input_ids")).alias("ids"), _bits(F.col("loss_mask")).alias("mask")
    )


@query(
    "zero_last_mask",
    f"""WITH {inp.EXAMPLES} SELECT "index", array_to_string(list_append(mask[:-2], 0), '') AS mask FROM ex""",
)
def _(spark, sf):
    ex = inp.examples(spark, sf)
    return ex.select("index", _bits(mk.zero_last_mask(F.col("loss_mask"))).alias("mask"))


@query(
    "supervised_tokens",
    f"""WITH {inp.TOKENS} SELECT conv_id AS "index", coalesce(string_agg(token_id::varchar, ',' ORDER BY p) FILTER (m = 1), '') AS ids
    FROM tok GROUP BY conv_id""",
)
def _(spark, sf):
    ex = inp.examples(spark, sf)
    return ex.select("index", inp.joined(mk.supervised_tokens(F.col("input_ids"), F.col("loss_mask"))).alias("ids"))
