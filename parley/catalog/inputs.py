"""The given tables in the layouts the operators read, and the same shapes in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions import tokens as tk
from parley.operators.normalise import nest_turns
from parley.plans.mix import Corpus
from parley.session import fill_cores

VOCAB = 4096
EOS = 4095
SYSTEM = "You are a careful assistant."


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Columns of the documents, spread for work that is heavy per row."""
    return fill_cores(table(spark, sf, "documents").select(*columns))


def joined(ids: Column) -> Column:
    """An array as text, so that rows compare the same everywhere."""
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")


def rounded(x: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; the small shift keeps exact halves from falling either way."""
    return F.round((F.col(x) if isinstance(x, str) else x) + F.lit(10.0 ** -(digits + 3)), digits)


def spread(df: DataFrame, turns: str, *keys: str) -> DataFrame:
    """One row per turn: keys, pos, role, text."""
    out = df.select(*keys, F.posexplode(turns).alias("pos", "t"))
    return out.select(*keys, F.col("pos").cast("long").alias("pos"), F.col("t.from").alias("role"), F.col("t.value").alias("text"))


def conversations(spark, sf) -> DataFrame:
    """(conv_id, turns) with the roles as they are."""
    return nest_turns(table(spark, sf, "conversations")).withColumnRenamed("conversations", "turns")


def sharegpt(spark, sf) -> DataFrame:
    rows = table(spark, sf, "conversations")
    role = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    return nest_turns(rows.withColumn("role", role))


def ultrachat(spark, sf) -> DataFrame:
    return nest_turns(table(spark, sf, "conversations"), role="role", text="content")


def openthoughts(spark, sf) -> DataFrame:
    return nest_turns(table(spark, sf, "conversations"))


def in_order(df: DataFrame) -> DataFrame:
    """Adds ``pos``, the place at which each row comes out of a sort."""
    from parley.operators.order import global_position

    placed = global_position(df.withColumn("_row", F.monotonically_increasing_id()), "_row")
    return placed.drop("_row")


def plain_turns(spark, sf) -> DataFrame:
    """(conv_id, conversations array<string>)."""
    df = openthoughts(spark, sf)
    return df.select("conv_id", F.transform("conversations", lambda t: t["value"]).alias("conversations"))


def pairs(spark, sf) -> DataFrame:
    """(conv_id, turn, prompt, response): every user turn with an assistant turn right after it."""
    after = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf, "conversations").withColumn("_next", F.lead("role").over(after)).withColumn("response", F.lead("text").over(after))
    return rows.where("role = 'user' AND _next = 'assistant'").select("conv_id", "turn", F.col("text").alias("prompt"), "response")


def corpora(spark, sf, cap: int | None = None) -> list[Corpus]:
    return [
        Corpus("sharegpt", sharegpt(spark, sf), "sharegpt", "conv_id"),
        Corpus("ultrachat", ultrachat(spark, sf), "ultrachat", "conv_id"),
        Corpus("openthoughts", openthoughts(spark, sf), "openthoughts", "conv_id", cap),
    ]


def examples(spark, sf) -> DataFrame:
    """(index, input_ids, loss_mask, seq_len): words of a conversation, supervised on assistant words."""
    df = conversations(spark, sf)
    ids = F.flatten(F.transform("turns", lambda t: tk.tokenise(t["value"], VOCAB)))
    mask = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array_repeat(F.when(t["from"] == "assistant", 1).otherwise(0), F.size(tk.words(t["value"]))),
        )
    )
    out = df.select(F.col("conv_id").alias("index"), ids.alias("input_ids"), mask.alias("loss_mask"))
    return out.withColumn("seq_len", F.size("input_ids"))


def token_rows(spark, sf, table_name: str = "conversations") -> DataFrame:
    """(conv_id, turn, role, i, target): one row per word, straight from the long table."""
    turns = fill_cores(table(spark, sf, table_name).select("conv_id", "turn", "role", "text"))
    rows = turns.select("conv_id", "turn", "role", F.posexplode(tk.words(F.col("text"))).alias("i", "w"))
    return rows.select("conv_id", "turn", "role", "i", tk.token_id(F.col("w"), VOCAB).alias("target"))


def predictions(spark, sf) -> DataFrame:
    """(example, turn, position, k, pred, top_ids, target, loss_mask): right on most positions."""
    rows = token_rows(spark, sf)
    right = F.substring(F.md5(F.concat_ws(":", "conv_id", "turn", "i")), 1, 1).between("0", "b")
    pred = F.when(right, F.col("target")).otherwise((F.col("target") + 1) % VOCAB)
    out = rows.select(
        F.col("conv_id").alias("example"),
        "turn",
        F.col("i").alias("position"),
        (F.col("i") % 7).cast("int").alias("k"),
        pred.cast("int").alias("pred"),
        "target",
        (F.col("role") == "assistant").cast("int").alias("loss_mask"),
    )
    top = F.array(F.col("pred"), (F.col("pred") + 1) % VOCAB, (F.col("pred") + (VOCAB - 1)) % VOCAB)
    return out.withColumn("top_ids", top)


def metrics(spark, sf) -> DataFrame:
    """(epoch, rank, step, k, loss, acc) from the event log."""
    kinds = "case event_type when 'click' then 0 when 'view' then 1 when 'error' then 2 when 'purchase' then 3 else 4 end"
    return table(spark, sf, "events").select(
        F.dayofmonth("ts").alias("epoch"),
        (F.col("user_id") % 4).cast("int").alias("rank"),
        F.floor(F.col("event_id") / 10).alias("step"),
        F.expr(kinds).alias("k"),
        F.col("value").alias("loss"),
        ((F.col("value") % 100) / 100).alias("acc"),
    )


def layer_vectors(spark, sf) -> DataFrame:
    """(index, position, layer, vec): four layers, each a multiple of the embedding."""
    layers = F.array(*[F.struct(F.lit(n).alias("layer"), F.lit(i + 1).alias("m")) for i, n in enumerate((2, 16, 29, 32))])
    rows = table(spark, sf, "embeddings").select("vec_id", "label", "embedding", F.explode(layers).alias("l"))
    return rows.select(
        F.col("label").cast("long").alias("index"),
        F.col("vec_id").alias("position"),
        "l.layer",
        F.transform("embedding", lambda x: (x * F.col("l.m")).cast("float")).alias("vec"),
    )


def file_table(spark, sf) -> DataFrame:
    """(path, name, length): one made-up file name per document."""
    name = F.concat(F.lit("data_"), F.col("doc_id").cast("string"), F.lit(".pt"))
    return table(spark, sf, "documents").select(
        F.concat(F.lit("run/"), name).alias("path"), name.alias("name"), F.col("n_chars").alias("length")
    )


# ---------------------------------------------------------------- the same in SQL

WORD = tk.WORD


def token_sql(word: str, vocab: int = VOCAB) -> str:
    return f"((('0x'||substr(md5({word}),1,6))::int) % {vocab})::int"


# One row per word: (conv_id, turn, role, i, w), i counting from 0 in its turn.
TURN_WORDS = f"""turn_words AS (
  SELECT conv_id, turn, role, generate_subscripts(ws, 1) - 1 AS i, unnest(ws) AS w
  FROM (SELECT conv_id, turn, role, regexp_extract_all(text, '{WORD}') AS ws FROM conversations))"""

# One row per token of an example: (conv_id, p, token_id, m).
TOKENS = f"""{TURN_WORDS}, tok AS (
  SELECT conv_id, turn, role, i, {token_sql('w')} AS token_id, (role = 'assistant')::int AS m,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS p
  FROM turn_words)"""

# One row per example: (index, ids, mask, seq_len) as lists.
EXAMPLES = f"""{TOKENS}, ex AS (
  SELECT conv_id AS "index", list(token_id ORDER BY p) AS ids, list(m ORDER BY p) AS mask, count(*)::int AS seq_len
  FROM tok GROUP BY conv_id)"""

# Turns without system turns, numbered from 0: (conv_id, pos, role, text).
CHAT = """chat AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role, text
  FROM conversations WHERE role <> 'system')"""

# User turns with an assistant turn right after them.
PAIRS = """pairs AS (
  SELECT conv_id, turn, text AS prompt, response FROM (SELECT *, lead(role) OVER w AS follower, lead(text) OVER w AS response
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND follower = 'assistant')"""

# All turns, numbered from 0.
TURNS = """turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role, text FROM conversations)"""

# One row per word of the documents.
DOC_WORDS = f"""doc_words AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '{WORD}')) AS w FROM documents)"""

DOC_FREQ = f"""{DOC_WORDS}, freq AS (
  SELECT {token_sql('w')} AS token_id, count(*) AS freq FROM doc_words GROUP BY 1)"""

PREDICTIONS = f"""{TOKENS}, guess AS (
  SELECT conv_id AS example, turn, i AS position, (i % 7)::int AS k, token_id AS target, m AS loss_mask,
    CASE WHEN substr(md5(concat_ws(':', conv_id, turn, i)),1,1) BETWEEN '0' AND 'b'
         THEN token_id ELSE (token_id + 1) % {VOCAB} END AS pred
  FROM tok), pred AS (
  SELECT *, [pred, (pred + 1) % {VOCAB}, (pred + {VOCAB - 1}) % {VOCAB}] AS top_ids FROM guess)"""

METRICS = """metrics AS (
  SELECT day(ts)::int AS epoch, (user_id % 4)::int AS rank, event_id // 10 AS step,
    CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS k,
    value AS loss, (value % 100) / 100 AS acc
  FROM events)"""


def text_sql(values: str) -> str:
    """A SQL list as text."""
    return f"array_to_string({values}, ',')"
