"""Examples: caps, checks, buckets, alignment, padding, batches, user functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.catalog import inputs as inp
from parley.catalog.masks import PREPARED, _bits, _prepared, _render_sql
from parley.catalog.ordering import FILES, keyed_sql
from parley.catalog.registry import ORACLES, query
from parley.functions import arrays as ar
from parley.functions import tokens as tk
from parley.operators import batches as bt
from parley.operators import examples as ex
from parley.operators import filters as fl
from parley.operators import order
from parley.plans.training import chat_examples, training_batches, training_positions, write_chat_examples
from parley.session import materialise, scratch_path
from parley.sources import checks as ck
from parley.sources import readers as rd
from parley.sources import writers as wr

SHOWN = f"""{inp.text_sql("ids")} AS ids, array_to_string(mask, '') AS mask"""


def _shown(df, *keys):
    return df.select(*keys, inp.joined(F.col("input_ids")).alias("ids"), _bits(F.col("loss_mask")).alias("mask"))


# --------------------------------------------------------------------- caps


@query("length_cap", f'WITH {inp.EXAMPLES} SELECT "index", seq_len FROM ex WHERE seq_len <= 400')
def _(spark, sf):
    return fl.length_cap(inp.examples(spark, sf), 400)[0].select("index", "seq_len")


@query("length_cap_dropped", f"WITH {inp.EXAMPLES} SELECT count(*) FILTER (seq_len > 400) AS dropped FROM ex")
def _(spark, sf):
    return fl.length_cap(inp.examples(spark, sf), 400)[1]


@query("train_length_cap", f'WITH {inp.EXAMPLES} SELECT "index", seq_len FROM ex WHERE seq_len <= 500')
def _(spark, sf):
    return fl.train_length_cap(inp.examples(spark, sf), 500)[0].select("index", "seq_len")


def _gaps(spark, sf):
    """Examples some of which have no ids or no length."""
    n = F.col("seq_len")
    return inp.examples(spark, sf).select("index", F.when(n % 7 != 0, F.col("input_ids")).alias("input_ids"), F.when(n % 5 != 0, n).alias("seq_len"))


@query("train_length_cap_dropped", f"WITH {inp.EXAMPLES} SELECT count(*) FILTER (seq_len > 500 OR seq_len % 7 = 0) AS dropped FROM ex")
def _(spark, sf):
    return fl.train_length_cap(_gaps(spark, sf), 500)[1]


def _written_with_counts(spark, df, rule, schema):
    """Writes what a rule keeps; the counts of the same job and the rows read back."""
    path = scratch_path(spark, "counted")
    kept, counts = fl.observed(df, rule)
    wr.write_corpus(kept, path)
    rows = rd.scan_corpus(spark, path).agg(F.count(F.lit(1)).alias("rows_written")).scalar()
    return fl.observed_row(spark, counts, schema).withColumn("rows_written", rows)


@query(
    "length_cap_written",
    f"""WITH {inp.EXAMPLES} SELECT count(*) FILTER (seq_len > 400 OR seq_len % 5 = 0) AS dropped,
      count(*) FILTER (seq_len <= 400 AND seq_len % 5 <> 0) AS rows_written FROM ex""",
)
def _(spark, sf):
    return _written_with_counts(spark, _gaps(spark, sf), fl.cap_rule(400), "dropped long")


@query(
    "train_length_cap_written",
    f"""WITH {inp.EXAMPLES} SELECT count(*) FILTER (seq_len > 500 OR seq_len % 7 = 0) AS dropped,
      count(*) FILTER (seq_len <= 500 AND seq_len % 7 <> 0) AS rows_written FROM ex""",
)
def _(spark, sf):
    return _written_with_counts(spark, _gaps(spark, sf), fl.train_cap_rule(500), "dropped long")


@query(
    "nonempty_text_written",
    """SELECT count(*) FILTER (doc_id % 3 > 0 AND text <> '') AS valid, count(*) FILTER (doc_id % 3 = 0 OR coalesce(text, '') = '') AS empty,
      count(*) FILTER (doc_id % 3 > 0 AND text <> '') AS rows_written FROM documents""",
)
def _(spark, sf):
    text = F.when(F.col("doc_id") % 6 == 0, F.lit("")).when(F.col("doc_id") % 3 > 0, F.col("text"))
    docs = inp.table(spark, sf, "documents").select("doc_id", text.alias("text"))
    return _written_with_counts(spark, docs, fl.text_rule(), "valid long, empty long")


@query(
    "run_stats_written",
    f"""WITH {inp.EXAMPLES}, k AS (SELECT seq_len, seq_len <= 400 AND seq_len % 5 <> 0 AS kept FROM ex)
    SELECT coalesce(max(seq_len) FILTER (kept), 0) AS max_seq_len, count(*) FILTER (NOT kept) AS dropped_count,
      count(*) FILTER (kept) AS rows_written FROM k""",
)
def _(spark, sf):
    return _written_with_counts(spark, _gaps(spark, sf), ex.run_rule(400), "max_seq_len int, dropped_count long")


@query(
    "run_stats",
    f"""WITH {inp.EXAMPLES} SELECT coalesce(max(seq_len) FILTER (seq_len <= 400), 0) AS max_seq_len,
      count(*) FILTER (seq_len > 400) AS dropped_count FROM ex""",
)
def _(spark, sf):
    return ex.run_stats(inp.examples(spark, sf), 400)


BUCKETED = """b AS (SELECT doc_id, n_chars, CASE WHEN n_chars < 2048 THEN '0K-2K' WHEN n_chars < 4096 THEN '2K-4K'
  WHEN n_chars < 8192 THEN '4K-8K' WHEN n_chars < 16384 THEN '8K-16K' WHEN n_chars < 32768 THEN '16K-32K' END AS bucket
  FROM documents)"""
NAMES = ", ".join(f"'{label}'" for _, _, label in ar.BUCKETS)


@query(
    "run_stats_bucketed",
    f"""WITH {BUCKETED}, k AS (SELECT *, n_chars <= 16384 AND bucket IS NOT NULL AS kept FROM b)
    SELECT name AS bucket, (SELECT coalesce(max(n_chars) FILTER (kept), 0) FROM k) AS max_seq_len,
      (SELECT count(*) FILTER (NOT kept) FROM k) AS dropped_count,
      (SELECT count(*) FROM k WHERE kept AND bucket = name) AS "rows" FROM (SELECT unnest([{NAMES}]) AS name)""",
)
def _(spark, sf):
    docs = inp.table(spark, sf, "documents").select("n_chars")
    stats = ex.run_stats(docs, 16384, ar.BUCKETS, length="n_chars")
    return stats.select("max_seq_len", "dropped_count", F.explode("bucket_stats").alias("bucket", "rows"))


@query("length_bucket", f"WITH {BUCKETED} SELECT doc_id, bucket FROM b")
def _(spark, sf):
    docs = inp.table(spark, sf, "documents")
    return docs.select("doc_id", ar.length_bucket(F.col("n_chars")).alias("bucket"))


@query(
    "bucket_counts",
    f"""WITH {BUCKETED} SELECT name AS bucket, (SELECT count(*) FROM b WHERE bucket = name) AS "rows"
    FROM (SELECT unnest([{NAMES}]) AS name)""",
)
def _(spark, sf):
    return ex.bucket_counts(inp.table(spark, sf, "documents").select("n_chars"), length="n_chars")


DIRS = """dirs AS (SELECT lang, CASE doc_id % 4 WHEN 0 THEN doc_id || 'K-' || n_chars || 'K' WHEN 1 THEN 'x-' || n_chars
  WHEN 2 THEN 'a-b' ELSE 'plain' END AS name FROM documents)"""


def _dirs(spark, sf):
    return inp.table(spark, sf, "documents").select(
        "lang",
        F.expr(
            """CASE doc_id % 4 WHEN 0 THEN concat(doc_id, 'K-', n_chars, 'K') WHEN 1 THEN concat('x-', n_chars)
            WHEN 2 THEN 'a-b' ELSE 'plain' END"""
        ).alias("name"),
    )


LIMITS = f"""{DIRS}, v AS (SELECT name, CASE WHEN name LIKE '%K' THEN 1024 * try_cast(trim(split_part(name, '-', 2), 'K') AS BIGINT)
  WHEN name LIKE '%-%' THEN try_cast(split_part(name, '-', 2) AS BIGINT) END AS v FROM dirs)"""


@query("parse_bucket_max", f"WITH {LIMITS} SELECT coalesce(arg_min(v, name) FILTER (v IS NOT NULL), 2048)::bigint AS max_len FROM v")
def _(spark, sf):
    return ex.parse_bucket_max(_dirs(spark, sf))


@query("parse_bucket_max_largest", f"WITH {LIMITS} SELECT coalesce(max(v), 2048)::bigint AS max_len FROM v")
def _(spark, sf):
    return ex.parse_bucket_max(_dirs(spark, sf), largest=True)


# ------------------------------------------------------------ checks, joins


def _damaged(spark, sf):
    """Examples with some lengths, masks and ids put wrong, told by the example's own length."""
    n = F.col("seq_len")
    return inp.examples(spark, sf).select(
        "index",
        F.when(n % 7 != 0, F.col("input_ids")).alias("input_ids"),
        F.when(n % 7 == 1, ar.tail_of(F.col("loss_mask")))
        .when(n % 7 == 2, F.transform("loss_mask", lambda m: m + 2))
        .otherwise(F.col("loss_mask"))
        .alias("loss_mask"),
        F.when(n % 7 == 3, n + 1).otherwise(n).alias("seq_len"),
    )


DAMAGED = f"""{inp.EXAMPLES}, checked AS (SELECT "index", CASE seq_len % 7 WHEN 0 THEN 'input_ids missing'
  WHEN 1 THEN 'loss_mask has another length' WHEN 2 THEN 'loss_mask holds other values than 0 and 1'
  WHEN 3 THEN 'seq_len is not the number of ids' END AS error FROM ex)"""


@query("integrity_check", f'WITH {DAMAGED} SELECT "index", error IS NULL AS is_valid, error FROM checked')
def _(spark, sf):
    return fl.integrity_check(_damaged(spark, sf))


@query(
    "validation_summary",
    f"""WITH {DAMAGED} SELECT count(*) AS total, count(*) FILTER (error IS NULL) AS valid,
      count(*) FILTER (error IS NOT NULL) AS corrupt FROM checked""",
)
def _(spark, sf):
    return fl.validation_summary(fl.integrity_check(_damaged(spark, sf)))


@query(
    "validation_written",
    f"""WITH {DAMAGED} SELECT count(*) AS total, count(*) FILTER (error IS NULL) AS valid,
      count(*) FILTER (error IS NOT NULL) AS corrupt, count(*) FILTER (error IS NULL) AS rows_written FROM checked""",
)
def _(spark, sf):
    checked = fl.integrity_check(_damaged(spark, sf))
    return _written_with_counts(spark, checked, fl.valid_rule(), "total long, valid long, corrupt long")


@query(
    "remove_listed",
    f"""WITH {FILES} SELECT path, name, length FROM files WHERE path NOT IN
      (SELECT 'run/data_' || doc_id || '.pt' FROM labels WHERE toxic = 1)""",
)
def _(spark, sf):
    bad = inp.table(spark, sf, "labels").where("toxic = 1")
    rejects = bad.select(F.concat(F.lit("run/data_"), F.col("doc_id").cast("string"), F.lit(".pt")).alias("path"))
    return fl.remove_listed(inp.file_table(spark, sf), rejects, "path")


@query("skip_done", "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    docs = inp.table(spark, sf, "documents").select("doc_id", "n_chars")
    return fl.skip_done(docs, inp.table(spark, sf, "labels"), "doc_id")


@query("skip_many_done", "SELECT doc_id, n_chars, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    docs = inp.table(spark, sf, "documents").select("doc_id", "n_chars", "text")
    return fl.skip_many_done(docs, inp.table(spark, sf, "labels"), "doc_id", bits=1 << 18)


@query("skip_written", "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(spark, sf):
    # What lies in the output folder tells what is done.
    path = scratch_path(spark, "outputs")
    made = inp.table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("index"), (F.col("doc_id") % 3).alias("bucket"))
    wr.write_bucketed(made, path)
    docs = inp.table(spark, sf, "documents").select("doc_id", "n_chars")
    return fl.skip_done(docs, ck.written_keys(spark, path).withColumnRenamed("index", "doc_id"), "doc_id")


# ---------------------------------------------------------- align and batch


@query(
    "align_shift",
    f"""WITH {inp.EXAMPLES} SELECT 'offline' AS mode, "index", {inp.text_sql("ids[2:]")} AS ids,
        array_to_string(list_append(mask[:-2], 0), '') AS mask, NULL AS states FROM ex
    UNION ALL SELECT 'online', "index", {inp.text_sql("ids[2:]")}, array_to_string(mask[2:], ''), {inp.text_sql("ids[:-2]")} FROM ex
    UNION ALL SELECT 'older', "index", {inp.text_sql("ids[2:]")}, array_to_string(list_append(mask[:-2], 0), ''),
        {inp.text_sql("ids[2:]")} FROM ex""",
)
def _(spark, sf):
    # The ids themselves stand in for the states, which shift in the same way.
    base = inp.examples(spark, sf).withColumn("states", F.col("input_ids"))
    out = None
    for mode, states in (("offline", None), ("online", "states"), ("older", "target")):
        df = ex.align_shift(base, mode)
        shown = inp.joined(F.col(states)) if states else F.lit(None).cast("string")
        rows = _shown(df.withColumns({"mode": F.lit(mode), "st": shown}), "mode", "index", F.col("st").alias("states"))
        out = rows if out is None else out.unionByName(rows)
    return out


# Eight rows per batch in the order of the index.
BATCHED = f"""{inp.EXAMPLES}, b AS (SELECT *, (row_number() OVER (ORDER BY "index") - 1) // 8 AS batch FROM ex),
m AS (SELECT *, max(seq_len) OVER (PARTITION BY batch) AS n FROM b)"""


def _batched(spark, sf):
    rows = inp.examples(spark, sf)
    placed = order.global_position(rows.select("index"), "index")
    return rows.join(placed.select("index", F.floor(F.col("pos") / 8).alias("batch")), "index")


@query("batch_max_len", f"WITH {BATCHED} SELECT batch, max(seq_len) AS max_len FROM b GROUP BY batch")
def _(spark, sf):
    return ex.batch_max_len(_batched(spark, sf))


@query(
    "pad_ids",
    f"""WITH {BATCHED} SELECT "index", batch, {inp.text_sql("list_resize(ids, n, 0)")} AS ids,
      array_to_string(list_resize(mask, n, 0), '') AS mask FROM m""",
)
def _(spark, sf):
    return _shown(ex.collate(_batched(spark, sf)), "index", "batch")


@query(
    "attention_mask",
    f"""WITH {BATCHED} SELECT "index", repeat('1', seq_len) || repeat('0', n - seq_len) AS attention,
      repeat('1', seq_len + 1) || repeat('0', (SELECT max(n) FROM m w WHERE w.batch = m.batch) - seq_len) AS older FROM m""",
)
def _(spark, sf):
    rows = _batched(spark, sf)
    new = ex.collate(rows).select("index", _bits(F.col("attention_mask")).alias("attention"))
    old = ex.collate(rows, extra=1).select("index", _bits(F.col("attention_mask")).alias("older"))
    return new.join(old, "index")


@query(
    "pad_ids_crop",
    f"""WITH {inp.EXAMPLES} SELECT "index", {inp.text_sql("list_resize(ids, 300, 0)")} AS ids,
      array_to_string(list_resize(mask, 300, 0), '') AS mask FROM ex""",
)
def _(spark, sf):
    return _shown(ex.collate(inp.examples(spark, sf), n=300, overflow="crop"), "index")


def _written(spark, sf):
    """Batches are planned over a written table of examples, so nothing is tokenised twice."""
    path = scratch_path(spark, "examples")
    wr.write_examples(inp.examples(spark, sf), path)
    return rd.scan_examples(spark, path).drop("attention_mask")


@query(
    "training_batches",
    f"""WITH {inp.EXAMPLES}, kept AS (SELECT * FROM ex WHERE seq_len <= 600),
      p AS (SELECT *, row_number() OVER (ORDER BY md5('42:3:' || "index"), "index") - 1 AS p, count(*) OVER () AS n FROM kept),
      w AS (SELECT *, p AS q FROM p UNION ALL SELECT *, p + n FROM p WHERE p + n < ceil(n / 2.0) * 2),
      s AS (SELECT "index", (q % 2)::int AS rank, (q // 2) // 4 AS batch, ((q // 2) % 4)::int AS slot, ids[2:] AS ids,
        list_append(mask[:-2], 0) AS mask, seq_len FROM w),
      m AS (SELECT *, max(seq_len) OVER (PARTITION BY rank, batch) AS width FROM s)
    SELECT "index", rank, batch, slot, {inp.text_sql("list_resize(ids, width, 0)")} AS ids,
      array_to_string(list_resize(mask, width, 0), '') AS mask FROM m""",
)
def _(spark, sf):
    out, _ = training_batches(_written(spark, sf), epoch=3, ranks=2, batch_size=4, seed=42, cap=600)
    return _shown(out, "index", "rank", "batch", "slot")


# The rows that are dealt, with their positions, in the form that the permutation's SQL reads.
DEALT = f"""{inp.EXAMPLES}, kept AS (SELECT * FROM ex WHERE seq_len <= 600),
  stored AS (SELECT "index" AS doc_id, row_number() OVER (ORDER BY "index") - 1 AS pos, count(*) OVER () AS n FROM kept)"""


@query(
    "training_batches_keyed",
    f"""WITH {keyed_sql("42:3", DEALT)}, w AS (SELECT doc_id, q FROM perm UNION ALL SELECT doc_id, q + n FROM perm WHERE q + n < ceil(n / 2.0) * 2),
      s AS (SELECT "index", (q % 2)::int AS rank, (q // 2) // 4 AS batch, ((q // 2) % 4)::int AS slot, ids[2:] AS ids,
        list_append(mask[:-2], 0) AS mask, seq_len FROM w JOIN kept ON "index" = doc_id),
      m AS (SELECT *, max(seq_len) OVER (PARTITION BY rank, batch) AS width FROM s)
    SELECT "index", rank, batch, slot, {inp.text_sql("list_resize(ids, width, 0)")} AS ids,
      array_to_string(list_resize(mask, width, 0), '') AS mask FROM m""",
)
def _(spark, sf):
    examples = _written(spark, sf)
    positions = training_positions(examples, 600)
    out, _ = training_batches(examples, epoch=3, ranks=2, batch_size=4, seed=42, cap=600, positions=positions)
    return _shown(out, "index", "rank", "batch", "slot")


@query("training_batches_dropped", f"WITH {inp.EXAMPLES} SELECT count(*) FILTER (seq_len > 600) AS dropped FROM ex")
def _(spark, sf):
    return training_batches(_written(spark, sf), epoch=3, ranks=2, batch_size=4, seed=42, cap=600)[1]


@query(
    "training_batches_substituted",
    f"""WITH {inp.EXAMPLES}, o AS (SELECT *, row_number() OVER (ORDER BY "index") - 1 AS spot FROM ex),
      u AS (SELECT "index" AS place, coalesce(min(CASE WHEN seq_len <= 600 THEN spot END) OVER (ORDER BY spot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
        min(CASE WHEN seq_len <= 600 THEN spot END) OVER ()) AS used FROM o),
      p AS (SELECT place, o."index", o.ids, o.mask, o.seq_len, row_number() OVER (ORDER BY md5('42:3:' || place), place) - 1 AS p, count(*) OVER () AS n
        FROM u JOIN o ON o.spot = u.used),
      w AS (SELECT *, p AS q FROM p UNION ALL SELECT *, p + n FROM p WHERE p + n < ceil(n / 2.0) * 2),
      s AS (SELECT place, "index", (q % 2)::int AS rank, (q // 2) // 4 AS batch, ((q // 2) % 4)::int AS slot, ids[2:] AS ids,
        list_append(mask[:-2], 0) AS mask, seq_len FROM w),
      m AS (SELECT *, max(seq_len) OVER (PARTITION BY rank, batch) AS width FROM s)
    SELECT place, "index", rank, batch, slot, {inp.text_sql("list_resize(ids, width, 0)")} AS ids,
      array_to_string(list_resize(mask, width, 0), '') AS mask FROM m""",
)
def _(spark, sf):
    out, _ = training_batches(_written(spark, sf), epoch=3, ranks=2, batch_size=4, seed=42, cap=600, substitute=True)
    return _shown(out, "place", "index", "rank", "batch", "slot")


# -------------------------------------------------------------- user functions


# User functions are closures, which travel to the tasks by value.


@query(
    "map_batches",
    "SELECT doc_id, (length(text) - length(replace(text, ' ', '')))::bigint AS blanks FROM documents WHERE length(text) > 100",
)
def _(spark, sf):
    def count_blanks(frame):
        long_ones = frame[frame["text"].str.len() > 100]
        return long_ones[["doc_id"]].assign(blanks=long_ones["text"].str.count(" "))

    docs = inp.documents(spark, sf, "doc_id", "text")
    return bt.map_batches(docs, count_blanks, "doc_id long, blanks long")


# Conversations as records, less those whose number is on the list of labels; up to 700 words each.
_FLOW = f"""chats AS (SELECT conv_id, count(*) AS n, {_render_sql('qwen')} AS text FROM turns GROUP BY conv_id),
  flow AS (SELECT conv_id AS "index", s AS seq_len, CASE WHEN s <= 700 AND s < 2048 THEN '0K-2K' END AS bucket
    FROM (SELECT conv_id, len(regexp_extract_all(text, '{inp.WORD}'))::int AS s FROM chats
      WHERE n >= 2 AND conv_id NOT IN (SELECT doc_id FROM labels)))"""


def _flow(spark, sf):
    records = inp.conversations(spark, sf).withColumnRenamed("turns", "conversations")
    done = inp.table(spark, sf, "labels").select(F.col("doc_id").alias("conv_id"))
    path = scratch_path(spark, "flow")
    return write_chat_examples(records, "conv_id", "qwen", path, max_len=32768, cap=700, done=done)


@query("row_transform", "SELECT doc_id, length(text)::int AS n FROM documents")
def _(spark, sf):
    docs = inp.documents(spark, sf, "doc_id", "text")
    return bt.row_transform(docs, lambda df: df.withColumn("n", F.length("text")).drop("text"))


def word_tokeniser(vocab_size: int = inp.VOCAB):
    """The built-in tokeniser once more, as a factory of objects like any other tokeniser."""

    def factory():
        import hashlib

        def encode(text: str) -> list[int]:
            return [int(hashlib.md5(w.encode()).hexdigest()[:6], 16) % vocab_size for w in text.split()]

        return encode

    return factory


@query(
    "pluggable_tokeniser",
    f"""SELECT doc_id, {inp.text_sql(f"[{inp.token_sql('w')} for w in regexp_extract_all(text, '{inp.WORD}')]")} AS ids
    FROM documents""",
)
def _(spark, sf):
    encode = bt.pluggable_tokeniser(word_tokeniser())
    docs = inp.documents(spark, sf, "doc_id", "text").select("doc_id", encode("text").alias("input_ids"))
    return docs.select("doc_id", inp.joined(F.col("input_ids.ids")).alias("ids"))


@query("chat_examples_plugged", ORACLES["chat_examples"])
def _(spark, sf):
    out = chat_examples(_prepared(spark, sf), "conv_id", "qwen", max_len=300, encode=bt.pluggable_chat_encoder(word_tokeniser()))
    return _shown(out, "index", "seq_len")


# A tokeniser that refuses whole conversations whose length is a multiple of three; parts of one it takes.
@query(
    "chat_examples_failed",
    f"""WITH {PREPARED} SELECT count(*) AS "rows", count(*) FILTER (length(text) % 3 = 0) AS failed,
      count(*) FILTER (length(text) % 3 = 0) AS dropped FROM rendered""",
)
def _(spark, sf):
    def factory():
        def encode(texts: list[str]) -> list[list[int]]:
            if any(t.startswith("<|im_start|>system") and t.count("<|im_end|>") > 1 and len(t) % 3 == 0 and t.endswith("<|im_end|>\n") for t in texts):
                raise ValueError("a length of threes")
            return [list(range(len(t.split()))) for t in texts]

        return encode

    out = chat_examples(_prepared(spark, sf), "conv_id", "qwen", max_len=300, encode=bt.pluggable_chat_encoder(factory, batched=True))
    out = materialise(out.select("index", "seq_len", "error"), "examples")
    failed = bt.split_failed(out)[1].agg(F.count(F.lit(1)).alias("n")).scalar()
    dropped = fl.length_cap(out, 300)[1].select("dropped").scalar()
    return out.agg(F.count(F.lit(1)).alias("rows")).withColumns({"failed": failed, "dropped": dropped})


@query(
    "write_chat_examples",
    f"""WITH {inp.TURNS}, {_FLOW} SELECT "index", seq_len, bucket FROM flow WHERE bucket IS NOT NULL""",
)
def _(spark, sf):
    return _flow(spark, sf).written


@query(
    "write_chat_examples_stats",
    f"""WITH {inp.TURNS}, {_FLOW} SELECT coalesce(max(seq_len) FILTER (bucket IS NOT NULL), 0) AS max_seq_len,
      count(*) FILTER (bucket IS NULL) AS dropped_count FROM flow""",
)
def _(spark, sf):
    return _flow(spark, sf).stats.select("max_seq_len", "dropped_count")


@query(
    "tokenise_words",
    f"SELECT doc_id, len(regexp_extract_all(text, '{inp.WORD}'))::int AS n FROM documents",
)
def _(spark, sf):
    return inp.documents(spark, sf, "doc_id", "text").select("doc_id", F.size(tk.words(F.col("text"))).alias("n"))
