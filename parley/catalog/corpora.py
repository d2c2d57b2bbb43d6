"""Normalising, filtering, uniting and mixing chat corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.catalog import inputs as inp
from parley.catalog.registry import query
from parley.functions import turns as tn
from parley.functions import tokens as tk
from parley.functions.text import preview_text
from parley.operators import filters as fl
from parley.operators import lengths as ln
from parley.operators import normalise as nm
from parley.operators import order
from parley.plans import mix

_DEFAULT_SYSTEM = "'" + tn.DEFAULT_SYSTEM.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
COERCED = "CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END"

def _mix_sql(cap: str = "") -> str:
    return f"""picked AS (
  SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations)
  ORDER BY md5('42:' || conv_id), conv_id {cap}),
mixed AS (
  SELECT 'sharegpt' AS source, conv_id, turn, {COERCED} AS role, text FROM conversations
  UNION ALL SELECT 'ultrachat', conv_id, turn, {COERCED}, text FROM conversations
  UNION ALL SELECT 'openthoughts', conv_id, turn, role, text FROM conversations
    WHERE conv_id IN (SELECT conv_id FROM picked)),
records AS (SELECT DISTINCT source, conv_id FROM mixed),
placed AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || source || ':' || conv_id), source, conv_id) - 1 AS pos
  FROM records)"""


# Every conversation in three layouts; and the same with the third corpus capped.
MIX, CAPPED_MIX, CAP = _mix_sql(), _mix_sql("LIMIT 60"), 60


@query("norm_sharegpt", f"WITH {inp.TURNS} SELECT conv_id, 'sharegpt' AS source, pos, {COERCED} AS role, text FROM turns")
def _(spark, sf):
    df = nm.norm_sharegpt(inp.sharegpt(spark, sf), "sharegpt", keep=("conv_id",))
    return inp.spread(df, "conversations", "conv_id", "source")


@query("norm_ultrachat", f"WITH {inp.TURNS} SELECT conv_id, 'ultrachat' AS source, pos, {COERCED} AS role, text FROM turns")
def _(spark, sf):
    df = nm.norm_ultrachat(inp.ultrachat(spark, sf), "ultrachat", keep=("conv_id",))
    return inp.spread(df, "conversations", "conv_id", "source")


@query("norm_passthrough", f"WITH {inp.TURNS} SELECT conv_id, 'openthoughts' AS source, pos, role, text FROM turns")
def _(spark, sf):
    df = nm.norm_passthrough(inp.openthoughts(spark, sf), "openthoughts", keep=("conv_id",))
    return inp.spread(df, "conversations", "conv_id", "source")


@query("tag_source", "SELECT doc_id, 'web' AS source FROM documents")
def _(spark, sf):
    return nm.tag_source(inp.table(spark, sf, "documents").select("doc_id"), "web")


@query(
    "dispatch_by_column",
    f"""WITH {inp.TURNS}, {inp.PAIRS}, sizes AS (SELECT conv_id, count(*) AS n FROM turns GROUP BY 1)
    SELECT 'conversations' AS layout, conv_id, 0 AS turn, pos, role,
           CASE WHEN role = 'assistant' THEN ' ' || text ELSE text END AS text
    FROM turns JOIN sizes USING (conv_id) WHERE n >= 2
    UNION ALL SELECT 'messages', conv_id, 0, pos, role, text FROM turns JOIN sizes USING (conv_id) WHERE n > 1
    UNION ALL SELECT 'pairs', conv_id, turn, 0, 'user', prompt FROM pairs WHERE prompt <> '' AND response <> ''
    UNION ALL SELECT 'pairs', conv_id, turn, 1, 'assistant', response FROM pairs WHERE prompt <> '' AND response <> ''""",
)
def _(spark, sf):
    tables = {
        "conversations": inp.conversations(spark, sf).withColumnRenamed("turns", "conversations"),
        "messages": inp.ultrachat(spark, sf),
        "pairs": inp.pairs(spark, sf),
    }
    out = None
    for layout, df in tables.items():
        df = df if layout == "pairs" else df.withColumn("turn", F.lit(0).cast("long"))
        found = nm.dispatch_by_column(df, "llama", keep=("conv_id", "turn"))
        rows = inp.spread(found.withColumn("layout", F.lit(layout)), "turns", "layout", "conv_id", "turn")
        out = rows if out is None else out.unionByName(rows)
    return out


def _every_layout(spark, sf):
    """One table whose records come in four layouts, by what the conversation looks like."""
    def said(role):
        texts = F.transform(F.filter("turns", lambda t: t["from"] == role), lambda t: t["value"])
        return F.when(F.size(texts) > 0, F.array_join(texts, " "))

    base = inp.conversations(spark, sf).withColumns({"prompt": said("user"), "response": said("assistant")})
    size, first = F.size("turns"), F.col("turns")[0]["from"]
    as_messages = F.transform("turns", lambda t: F.struct(t["from"].alias("role"), t["value"].alias("content")))
    form = F.when(first == "system", "conversations").when(size <= 2, "messages").when(size <= 4, "text")
    form = form.when(size <= 6, "pair").otherwise("other")
    marked = base.withColumn("_form", form)

    def only(name, value):
        return F.when(F.col("_form") == name, value)

    return marked.select(
        "conv_id",
        only("conversations", F.col("turns")).alias("conversations"),
        only("messages", as_messages).alias("messages"),
        only("text", F.col("prompt")).alias("text"),
        only("pair", F.col("prompt")).alias("prompt"),
        only("pair", F.col("response")).alias("response"),
    )


@query(
    "dispatch_by_record",
    f"""WITH {inp.TURNS}, shape AS (
      SELECT conv_id, count(*) AS n, arg_min(role, turn) AS first,
             string_agg(text, ' ' ORDER BY turn) FILTER (role = 'user') AS prompt,
             string_agg(text, ' ' ORDER BY turn) FILTER (role = 'assistant') AS response
      FROM conversations GROUP BY 1),
    forms AS (SELECT *, CASE WHEN first = 'system' THEN 'conversations' WHEN n <= 2 THEN 'messages'
      WHEN n <= 4 THEN 'text' WHEN n <= 6 AND response IS NOT NULL THEN 'pair' ELSE 'other' END AS form FROM shape),
    kept AS (SELECT conv_id, string_agg(role || '=' || CASE WHEN role = 'assistant' THEN ' ' ELSE '' END || text, '|'
      ORDER BY pos) FILTER (role <> 'system') AS body FROM turns GROUP BY 1)
    SELECT conv_id, form,
      CASE form WHEN 'conversations' THEN CASE WHEN n >= 2 THEN body END
                WHEN 'messages' THEN CASE WHEN n > 1 THEN body END
                WHEN 'pair' THEN 'user=' || prompt || '|assistant=' || response END AS turns,
      CASE form WHEN 'text' THEN prompt WHEN 'other' THEN '{{}}' END AS text
    FROM forms JOIN kept USING (conv_id)""",
)
def _(spark, sf):
    df = nm.dispatch_by_record(_every_layout(spark, sf), "llama", with_text=True, keep=("conv_id",))
    body = F.array_join(F.transform("turns", lambda t: F.concat_ws("=", t["from"], t["value"])), "|")
    return df.select("conv_id", "form", body.alias("turns"), "text")


@query(
    "role_map",
    f"""WITH {inp.CHAT} SELECT conv_id, pos, role, text FROM chat""",
)
def _(spark, sf):
    df = inp.sharegpt(spark, sf).select("conv_id", tn.role_map(F.col("conversations"), "drop").alias("turns"))
    return inp.spread(df, "turns", "conv_id")


@query(
    "role_map_modes",
    """SELECT conv_id,
      string_agg(CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END, ',' ORDER BY turn) AS coerced,
      coalesce(string_agg(role, ',' ORDER BY turn) FILTER (role <> 'system'), '') AS dropped,
      string_agg(CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END, ',' ORDER BY turn) AS kept,
      CASE WHEN bool_and(role <> 'system') THEN string_agg(role, ',' ORDER BY turn) END AS rejected
    FROM conversations GROUP BY conv_id""",
)
def _(spark, sf):
    def roles(mode):
        return F.array_join(F.transform(tn.role_map(F.col("conversations"), mode), lambda t: t["from"]), ",")

    return inp.sharegpt(spark, sf).select(
        "conv_id",
        roles("coerce").alias("coerced"),
        roles("drop").alias("dropped"),
        roles("keep").alias("kept"),
        roles("reject").alias("rejected"),
    )


@query(
    "roles_by_parity",
    f"""WITH {inp.TURNS} SELECT conv_id, pos, CASE WHEN pos % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, text FROM turns""",
)
def _(spark, sf):
    df = inp.plain_turns(spark, sf).select("conv_id", tn.roles_by_parity(F.col("conversations")).alias("turns"))
    return inp.spread(df, "turns", "conv_id")


def _gappy_messages(spark, sf):
    """Messages with the content of system turns and the role of very short texts missing."""
    return inp.ultrachat(spark, sf).withColumn(
        "messages",
        F.transform(
            "messages",
            lambda m: F.struct(
                F.when(F.length(m["content"]) >= 30, m["role"]).alias("role"),
                F.when(m["role"] != "system", m["content"]).alias("content"),
            ),
        ),
    )


@query(
    "norm_messages",
    """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role, text
    FROM conversations WHERE role <> 'system' AND length(text) >= 30""",
)
def _(spark, sf):
    df = _gappy_messages(spark, sf).select("conv_id", tn.norm_messages(F.col("messages")).alias("turns"))
    return inp.spread(df, "turns", "conv_id")


@query(
    "norm_pair",
    f"""WITH {inp.PAIRS} SELECT conv_id, turn, 0::bigint AS pos, 'user' AS role, prompt AS text FROM pairs
    UNION ALL SELECT conv_id, turn, 1, 'assistant', response FROM pairs""",
)
def _(spark, sf):
    return inp.spread(nm.norm_pair(inp.pairs(spark, sf), keep=("conv_id", "turn")), "turns", "conv_id", "turn")


@query(
    "assistant_prefix",
    f"""WITH {inp.TURNS} SELECT family, conv_id, pos, role,
      CASE WHEN role = 'assistant' AND family = 'llama' THEN ' ' || text ELSE text END AS text
    FROM turns CROSS JOIN (VALUES ('llama'), ('qwen')) f(family)""",
)
def _(spark, sf):
    chat = inp.openthoughts(spark, sf)
    families = F.explode(F.array(F.lit("llama"), F.lit("qwen")))
    df = chat.withColumn("family", families).select(
        "family", "conv_id", tn.assistant_prefix(F.col("conversations"), F.col("family")).alias("turns")
    )
    return inp.spread(df, "turns", "family", "conv_id")


@query(
    "prepend_system",
    f"""WITH {inp.TURNS} SELECT conv_id, pos + 1 AS pos, role, text FROM turns
    UNION ALL SELECT DISTINCT conv_id, 0, 'system', {_DEFAULT_SYSTEM} FROM turns""",
)
def _(spark, sf):
    df = inp.openthoughts(spark, sf).select("conv_id", tn.prepend_system(F.col("conversations")).alias("turns"))
    return inp.spread(df, "turns", "conv_id")


@query(
    "drop_leading_nonuser",
    f"""WITH {inp.TURNS}, kept AS (
      SELECT t.*, f.role AS first FROM turns t JOIN turns f ON f.conv_id = t.conv_id AND f.pos = 0)
    SELECT conv_id, pos - (first <> 'user')::int AS pos, role, text FROM kept
    WHERE first = 'user' OR pos > 0""",
)
def _(spark, sf):
    df = inp.conversations(spark, sf).select("conv_id", tn.drop_leading_nonuser(F.col("turns")).alias("turns"))
    return inp.spread(df, "turns", "conv_id")


@query(
    "extract_text",
    """SELECT 'sharegpt' AS kind, conv_id AS id, string_agg(text, ' ' ORDER BY turn) FILTER (text <> '') AS text
       FROM conversations GROUP BY conv_id
    UNION ALL SELECT 'ultrachat', conv_id, string_agg(text, ' ' ORDER BY turn) FILTER (text <> '')
       FROM conversations GROUP BY conv_id
    UNION ALL SELECT 'openthoughts', conv_id, string_agg(text, ' ' ORDER BY turn) FILTER (text <> '')
       FROM conversations GROUP BY conv_id
    UNION ALL SELECT 'sharegpt', doc_id, text FROM documents""",
)
def _(spark, sf):
    def texts(df, kind, key):
        return df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), nm.extract_text(df, kind).alias("text"))

    return nm.mix_corpora(
        [
            texts(inp.sharegpt(spark, sf), "sharegpt", "conv_id"),
            texts(inp.ultrachat(spark, sf), "ultrachat", "conv_id"),
            texts(inp.openthoughts(spark, sf), "openthoughts", "conv_id"),
            texts(inp.table(spark, sf, "documents").select("doc_id", "text"), "sharegpt", "doc_id"),
        ]
    )


@query("text_item", "SELECT doc_id, text FROM documents")
def _(spark, sf):
    return nm.text_item(inp.table(spark, sf, "documents"), keep=("doc_id",))


@query("drop_input_columns", "SELECT doc_id, length(text)::int AS n FROM documents")
def _(spark, sf):
    df = inp.table(spark, sf, "documents").withColumn("n", F.length("text"))
    return nm.drop_input_columns(df, ["doc_id", "n"])


@query("carry_index", 'SELECT doc_id AS "index", n_chars FROM documents WHERE n_chars > 500')
def _(spark, sf):
    df = nm.carry_index(inp.table(spark, sf, "documents"), "doc_id")
    return df.where("n_chars > 500").select("index", "n_chars")


@query(
    "concat_fallback",
    f"""SELECT conv_id, CASE WHEN bool_and(role IN ('user', 'assistant'))
        THEN string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn)
        ELSE string_agg(text, ' ' ORDER BY turn) END AS text
    FROM conversations GROUP BY conv_id""",
)
def _(spark, sf):
    # A role the template does not know stands in for a template that fails.
    rows = inp.table(spark, sf, "conversations").withColumn("role", F.regexp_replace("role", "^system$", "tool"))
    df = nm.nest_turns(rows)
    turns = F.col("conversations")
    return df.select("conv_id", tn.concat_fallback(tk.render_chat(turns, "qwen"), turns).alias("text"))


@query(
    "min_turns",
    "SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1 HAVING count(*) >= 4",
)
def _(spark, sf):
    df = fl.min_turns(inp.sharegpt(spark, sf), 4)
    return df.select("conv_id", F.size("conversations").cast("long").alias("n"))


@query(
    "min_messages",
    """SELECT conv_id, count(*) FILTER (role <> 'system' AND length(text) >= 30) AS n
    FROM conversations GROUP BY 1 HAVING n >= 2""",
)
def _(spark, sf):
    df = fl.min_messages(_gappy_messages(spark, sf), 2)
    return df.select("conv_id", F.size(tn.norm_messages(F.col("messages"))).cast("long").alias("n"))


@query(
    "nonempty_pair",
    f"WITH {inp.PAIRS} SELECT conv_id, turn, prompt, response FROM pairs WHERE prompt <> '' AND response <> ''",
)
def _(spark, sf):
    return fl.nonempty_pair(inp.pairs(spark, sf))


@query(
    "nonempty_turns",
    """SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id % 5 > 1 GROUP BY 1""",
)
def _(spark, sf):
    # Records without turns: some lists are null and some are empty.
    turns = F.when(F.col("conv_id") % 5 == 0, F.lit(None)).when(F.col("conv_id") % 5 == 1, F.slice("turns", 1, 0)).otherwise(F.col("turns"))
    df = inp.conversations(spark, sf).select("conv_id", turns.alias("conversations"))
    return fl.nonempty_turns(df).select("conv_id", F.size("conversations").cast("long").alias("n"))


@query(
    "role_alternation",
    f"""WITH {inp.TURNS} SELECT conv_id,
      bool_and(role = CASE WHEN pos % 2 = 0 THEN 'user' ELSE 'assistant' END) AS ok, count(*) AS n
    FROM turns GROUP BY 1""",
)
def _(spark, sf):
    good, bad = fl.role_alternation(inp.conversations(spark, sf))
    both = good.withColumn("ok", F.lit(True)).unionByName(bad.withColumn("ok", F.lit(False)))
    return both.select("conv_id", "ok", F.size("turns").cast("long").alias("n"))


@query("mix_corpora", f"WITH {MIX} SELECT source, conv_id, turn, role, text FROM (SELECT source, conv_id, row_number() OVER (PARTITION BY source, conv_id ORDER BY turn) - 1 AS turn, role, text FROM mixed)")
def _(spark, sf):
    mixed = mix.mixed_corpus(inp.corpora(spark, sf), shuffle=False)
    rows = inp.spread(mixed, "conversations", "source", "key")
    return rows.select("source", F.col("key").alias("conv_id"), F.col("pos").alias("turn"), "role", "text")


@query(
    "mixed_corpus",
    f"""WITH {CAPPED_MIX}, t AS (SELECT source, conv_id, count(*) AS n_turns, sum(length(text)) AS n_chars FROM mixed GROUP BY 1, 2)
    SELECT pos, source, conv_id, n_turns, n_chars::bigint AS n_chars FROM placed JOIN t USING (source, conv_id)""",
)
def _(spark, sf):
    mixed = mix.mixed_corpus(inp.corpora(spark, sf, CAP), seed=42, shuffle=False)
    chars = F.aggregate("conversations", F.lit(0).cast("long"), lambda a, t: a + F.length(t["value"]))
    shape = mixed.select(
        "source", "key", F.size("conversations").cast("long").alias("n_turns"), chars.alias("n_chars")
    )
    placed = order.shuffled_position(shape, ("source", "key"), 42)
    return placed.select("pos", "source", F.col("key").alias("conv_id"), "n_turns", "n_chars")


@query("distinct_sources", "SELECT DISTINCT source FROM documents")
def _(spark, sf):
    return nm.distinct_sources(inp.table(spark, sf, "documents"))


@query(
    "source_mix",
    f"""WITH {MIX} SELECT source, count(*) AS "rows", round(count(*) * 100.0 / (SELECT count(*) FROM records) + 1e-9, 6) AS percent
    FROM records GROUP BY source""",
)
def _(spark, sf):
    mixed = mix.mixed_corpus(inp.corpora(spark, sf), shuffle=False)
    return ln.source_mix(mixed).withColumn("percent", inp.rounded("percent", 6))


@query(
    "corpus_sizes",
    f"""WITH {CAPPED_MIX}, whole AS (SELECT DISTINCT source, conv_id FROM
        (SELECT 'sharegpt' AS source, conv_id FROM conversations UNION ALL SELECT 'ultrachat', conv_id FROM conversations
         UNION ALL SELECT 'openthoughts', conv_id FROM conversations))
    SELECT 'input' AS stage, source, count(*) AS "rows" FROM whole GROUP BY 2
    UNION ALL SELECT 'sample', source, count(*) FROM records GROUP BY 2
    UNION ALL SELECT 'mix', 'all', count(*) FROM records""",
)
def _(spark, sf):
    corpora = inp.corpora(spark, sf, CAP)
    whole = nm.mix_corpora(c.df.select(F.lit(c.source).alias("source")) for c in corpora)
    sample = nm.mix_corpora(mix.sampled(c).select(F.lit(c.source).alias("source")) for c in corpora)
    return ln.corpus_sizes({"input": whole, "sample": sample, "mix": sample.drop("source").withColumn("x", F.lit(1))})


@query(
    "first_per_source",
    f"""WITH {MIX}, firsts AS (SELECT source, arg_min(conv_id, pos) AS conv_id FROM placed GROUP BY 1)
    SELECT source, 'key,conversations,source' AS keys, count(*)::int AS n_turns,
           arg_min(m.role, m.turn) AS role, arg_min(m.text, m.turn) AS text
    FROM firsts JOIN mixed m USING (source, conv_id) GROUP BY 1""",
)
def _(spark, sf):
    mixed = mix.mixed_corpus(inp.corpora(spark, sf), shuffle=False)
    first = ln.first_per_source(mixed, F.struct(order.shuffle_key(("source", "key"), 42), "source", "key"))
    return first.select(
        "source", "keys", "n_turns", F.col("first_turn.from").alias("role"), F.col("first_turn.value").alias("text")
    )


@query(
    "turn_preview",
    f"""WITH {inp.TURNS}, n AS (SELECT conv_id, count(*) AS n FROM turns GROUP BY 1)
    SELECT conv_id, pos, role, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS text,
           greatest(n - 3, 0)::int AS more
    FROM turns JOIN n USING (conv_id) WHERE pos < 3""",
)
def _(spark, sf):
    df = ln.preview_turns(inp.conversations(spark, sf), 3, 200, "turns")
    return inp.spread(df, "preview", "conv_id", "more").select("conv_id", "pos", "role", "text", "more")


@query(
    "preview_text",
    "SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS shown FROM documents",
)
def _(spark, sf):
    return inp.table(spark, sf, "documents").select("doc_id", preview_text(F.col("text"), 100).alias("shown"))
