"""Sources and sinks: each query writes to the shared scratch folder and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.catalog import inputs as inp
from parley.catalog.registry import query
from parley.operators import filters as fl
from parley.functions import arrays as ar
from parley.operators import order
from parley.plans import mix
from parley.plans.vocabulary import draft_vocabulary, text_token_freq
from parley.schemas import SHAREGPT
from parley.session import scratch_path
from parley.sources import checks as ck
from parley.sources import readers as rd
from parley.sources import writers as wr

def _sum(name):
    return F.aggregate(name, F.lit(0).cast("long"), lambda a, x: a + x)


@query(
    "scan_json",
    """SELECT form, conv_id::varchar AS id, count(*) AS n_turns, sum(length(text))::bigint AS n_chars,
      count(*) FILTER (role = 'user') AS n_human FROM conversations, (VALUES ('lines'), ('array')) f(form) GROUP BY ALL""",
)
def _(spark, sf):
    path = scratch_path(spark, "json")
    df = inp.sharegpt(spark, sf).select(F.col("conv_id").cast("string").alias("id"), "conversations")
    df.write.json(f"{path}/lines")
    # Files that hold one array each, of a few records.
    packed = df.groupBy(F.pmod(F.xxhash64("id"), F.floor(F.lit(df.count()) / 64) + 1)).agg(F.collect_list(F.struct("id", "conversations")).alias("a"))
    packed.select(F.to_json("a").alias("value")).repartition(8).write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(f"{path}/array")
    back = rd.scan_json(spark, f"{path}/lines", SHAREGPT, multiline=False).withColumn("form", F.lit("lines"))
    back = back.unionByName(rd.scan_json(spark, f"{path}/array", SHAREGPT).withColumn("form", F.lit("array")))
    return back.select(
        "form",
        "id",
        F.size("conversations").cast("long").alias("n_turns"),
        _sum(F.transform("conversations", lambda t: F.length(t["value"]))).alias("n_chars"),
        F.size(F.filter("conversations", lambda t: t["from"] == "human")).cast("long").alias("n_human"),
    )


@query(
    "scan_parquet",
    "SELECT doc_id, lang, CASE WHEN lang = 'en' THEN 'train_sft' ELSE 'test_sft' END AS split FROM documents",
)
def _(spark, sf):
    path = scratch_path(spark, "splits")
    # Two splits side by side, told apart by their file names.
    docs = inp.table(spark, sf, "documents").select("doc_id", "lang")
    docs.where("lang = 'en'").write.parquet(f"{path}/train_sft-0")
    docs.where("lang <> 'en'").write.parquet(f"{path}/test_sft-0")
    train = rd.scan_parquet(spark, path, split="train_sft").withColumn("split", F.lit("train_sft"))
    test = rd.scan_parquet(spark, path, split="test_sft").withColumn("split", F.lit("test_sft"))
    return train.unionByName(test)


@query("scan_first_available", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def _(spark, sf):
    path = scratch_path(spark, "saved")
    wr.write_corpus(inp.table(spark, sf, "documents").select("doc_id", "source"), path)
    back = rd.scan_first_available(spark, [f"{path}/data", path])
    return back.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(
    "write_corpus",
    """WITH r AS (SELECT source, conv_id, n FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1),
      (VALUES ('sharegpt'), ('ultrachat'), ('openthoughts')) s(source))
    SELECT source, conv_id AS key, n AS turns, row_number() OVER (ORDER BY md5('42:' || source || ':' || conv_id), source, conv_id) - 1 AS pos FROM r""",
)
def _(spark, sf):
    path = scratch_path(spark, "corpus")
    wr.write_corpus(mix.mixed_corpus(inp.corpora(spark, sf)), path)
    # The order of the saved corpus is that of its files and of the rows in them.
    rows = rd.scan_corpus(spark, path).select(
        "source", "key", F.size("conversations").cast("long").alias("turns"), "_metadata.file_name", F.monotonically_increasing_id().alias("_row")
    )
    return order.global_position(rows, ["file_name", "_row"]).drop("file_name", "_row")


COERCED = "CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END"


@query(
    "scan_corpus",
    f"""WITH {inp.TURNS} SELECT source, conv_id AS key, pos, CASE WHEN source = 'openthoughts' THEN role ELSE {COERCED} END AS role, text
    FROM turns, (VALUES ('sharegpt'), ('ultrachat'), ('openthoughts')) s(source)""",
)
def _(spark, sf):
    path = scratch_path(spark, "corpus")
    wr.write_corpus(mix.mixed_corpus(inp.corpora(spark, sf)), path)
    return inp.spread(rd.scan_corpus(spark, path), "conversations", "source", "key")


@query("file_manifest", """SELECT lang, count(*) AS "rows", true AS filled, true AS listed FROM documents GROUP BY lang""")
def _(spark, sf):
    # The documents by language; each file is listed, and its rows are counted.
    path = scratch_path(spark, "files")
    inp.table(spark, sf, "documents").select("doc_id", "lang", "n_chars").write.partitionBy("lang").parquet(path)
    files = rd.file_manifest(spark, path, (".parquet",)).withColumn("lang", F.regexp_extract("path", "/lang=([^/]*)/", 1))
    # Names repeat between folders, and the two readers spell the root in different ways.
    place = lambda c: F.regexp_extract(c, "[^/]*/[^/]*$", 0).alias("place")
    rows = spark.read.parquet(path).groupBy(place("_metadata.file_path")).agg(F.count(F.lit(1)).alias("n"))
    joined = files.select("lang", "length", place("path")).join(rows, "place", "full_outer")
    return joined.groupBy("lang").agg(
        F.sum("n").alias("rows"), F.bool_and(F.col("length") > 0).alias("filled"), F.bool_and(F.col("n").isNotNull()).alias("listed")
    )


@query(
    "scan_pretokenised",
    f"""WITH {inp.EXAMPLES}, docs AS (SELECT text, list_sum([{inp.token_sql('x')} for x in ws])::bigint AS id_sum,
        len(ws)::int AS n FROM (SELECT text, regexp_extract_all(text, '{inp.WORD}') AS ws FROM documents))
    SELECT 'ids' AS given, 'id ' || "index" AS text, seq_len AS n, list_sum(ids)::bigint AS id_sum, seq_len::bigint AS attention_sum,
        seq_len::bigint AS mask_sum FROM ex
    UNION ALL SELECT 'text', text, n, coalesce(id_sum, 0), n, n FROM docs""",
)
def _(spark, sf):
    path = scratch_path(spark, "pretokenised")
    # Where there are ids, they are taken and the text is not looked at.
    ids = inp.examples(spark, sf).select("input_ids", F.concat(F.lit("id "), F.col("index").cast("string")).alias("text"))
    texts = inp.table(spark, sf, "documents").select("text")
    ids.write.json(f"{path}/ids")
    texts.write.json(f"{path}/text")
    given = rd.scan_pretokenised(spark, f"{path}/ids").withColumn("given", F.lit("ids"))
    done = given.unionByName(rd.scan_pretokenised(spark, f"{path}/text").withColumn("given", F.lit("text")))
    return done.select(
        "given",
        "text",
        F.size("input_ids").alias("n"),
        _sum("input_ids").alias("id_sum"),
        _sum("attention_mask").alias("attention_sum"),
        _sum("loss_mask").alias("mask_sum"),
    )


@query(
    "scan_examples",
    f"""WITH {inp.EXAMPLES} SELECT "index", seq_len, list_sum(ids)::bigint AS id_sum,
      list_sum(mask)::bigint AS mask_sum, seq_len::bigint AS attention_sum FROM ex""",
)
def _(spark, sf):
    path = scratch_path(spark, "examples")
    wr.write_examples(inp.examples(spark, sf), path)
    back = rd.scan_examples(spark, path)
    return back.select(
        "index",
        "seq_len",
        _sum("input_ids").alias("id_sum"),
        _sum("loss_mask").alias("mask_sum"),
        _sum("attention_mask").alias("attention_sum"),
    )


@query("write_examples", f'WITH {inp.EXAMPLES} SELECT "index", seq_len, {inp.text_sql("ids")} AS ids FROM ex')
def _(spark, sf):
    path = scratch_path(spark, "examples")
    wr.write_examples(inp.examples(spark, sf), path, files=4)
    return spark.read.parquet(path).select("index", "seq_len", inp.joined(F.col("input_ids")).alias("ids"))


BUCKET_SQL = """CASE WHEN n < 2048 THEN '0K-2K' WHEN n < 4096 THEN '2K-4K' WHEN n < 8192 THEN '4K-8K'
  WHEN n < 16384 THEN '8K-16K' WHEN n < 32768 THEN '16K-32K' END"""


@query(
    "write_bucketed",
    f"""WITH b AS (SELECT doc_id, n_chars, {BUCKET_SQL.replace('n <', 'n_chars <')} AS bucket FROM documents)
    SELECT bucket, count(*) AS n, sum(n_chars)::bigint AS n_chars FROM b WHERE bucket IS NOT NULL GROUP BY bucket""",
)
def _(spark, sf):
    path = scratch_path(spark, "bucketed")
    docs = inp.table(spark, sf, "documents").select("doc_id", "n_chars")
    wr.write_bucketed(docs.withColumn("bucket", ar.length_bucket(F.col("n_chars"))), path)
    back = spark.read.schema("doc_id long, n_chars long, bucket string").parquet(path)
    return back.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"))


@query(
    "write_stats",
    f"WITH {inp.EXAMPLES} SELECT max(seq_len)::bigint AS max_seq_len, 0::bigint AS dropped_count FROM ex",
)
def _(spark, sf):
    from parley.operators.examples import run_stats

    path = scratch_path(spark, "stats")
    wr.write_stats(run_stats(inp.examples(spark, sf), 32768), path)
    return spark.read.schema("max_seq_len long, dropped_count long").json(path)


def _map(spark, sf, sizes=(256, 1024)):
    freq = text_token_freq(inp.documents(spark, sf, "text"), vocab_size=inp.VOCAB)
    found = draft_vocabulary(freq, sizes, inp.VOCAB, inp.EOS)
    return found.d2t, found.t2d


# Draft sets of the sizes 256 and 1024 with eos in them.
DRAFT = f"""{inp.DOC_FREQ}, ranked AS (
    SELECT token_id, freq, row_number() OVER (ORDER BY freq DESC, token_id) AS rank FROM freq),
  sizes AS (SELECT unnest([256, 1024]) AS r),
  has AS (SELECT r, bool_or(token_id = {inp.EOS}) AS inside FROM sizes JOIN ranked ON rank <= r GROUP BY r),
  draft AS (
    SELECT r, token_id, freq, rank::int AS rank, false AS injected FROM has JOIN ranked ON rank <= r
    WHERE inside OR rank < r
    UNION ALL SELECT r, {inp.EOS}, NULL, NULL, true FROM has WHERE NOT inside),
  d2t AS (SELECT r, (row_number() OVER (PARTITION BY r ORDER BY token_id) - 1)::int AS draft_id, token_id FROM draft)"""


@query(
    "write_vocab_map",
    f"""WITH {DRAFT} SELECT 'words' AS model, r, draft_id, token_id, token_id - draft_id AS "offset" FROM d2t""",
)
def _(spark, sf):
    path = scratch_path(spark, "vocab")
    d2t, t2d = _map(spark, sf)
    wr.write_vocab_map(d2t, t2d, path, "words")
    back, _, _ = rd.scan_vocab_map(spark, path)
    return back.select("model", "r", "draft_id", "token_id", "offset")


@query(
    "scan_vocab_map",
    f"""WITH {DRAFT} SELECT 'words' AS model, r, count(*) AS d2t_size, min(token_id - draft_id) AS min_offset,
      max(token_id - draft_id) AS max_offset, {inp.VOCAB}::bigint AS t2d_size, count(*) AS t2d_true FROM d2t GROUP BY r""",
)
def _(spark, sf):
    path = scratch_path(spark, "vocab")
    d2t, t2d = _map(spark, sf)
    wr.write_vocab_map(d2t, t2d, path, "words")
    _, _, report = rd.scan_vocab_map(spark, path)
    return report


@query(
    "write_reject_list",
    "SELECT 'run/data_' || doc_id || '.pt' AS path FROM labels WHERE toxic = 1",
)
def _(spark, sf):
    path = scratch_path(spark, "rejects")
    bad = inp.table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    names = bad.select(F.concat(F.lit("run/data_"), F.col("doc_id").cast("string"), F.lit(".pt")).alias("path"))
    wr.write_reject_list(names, path)
    return spark.read.text(path).withColumnRenamed("value", "path")


@query(
    "profile_schema",
    """WITH first AS (SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY conv_id
                      ORDER BY conv_id LIMIT 5)
    SELECT conv_id AS row_conv_id, 'conv_id' AS "column", 'bigint' AS type, conv_id::varchar AS shown, '' AS keys FROM first
    UNION ALL SELECT conv_id, 'conversations', 'array<struct<from:string,value:string>>',
      'list with ' || len(roles) || ' items', 'from,value' FROM first""",
)
def _(spark, sf):
    return rd.profile_schema(inp.sharegpt(spark, sf), n=5, order_by=["conv_id"])


@query(
    "integrity_check_json",
    """SELECT count(*) AS total, count(*) FILTER (quality = 1) AS valid, count(*) FILTER (quality <> 1) AS corrupt
    FROM labels""",
)
def _(spark, sf):
    # Lines that are cut short stand in for files that do not load.
    path = scratch_path(spark, "lines")
    rows = inp.table(spark, sf, "labels")
    whole = F.to_json(F.struct(F.col("doc_id").alias("index"), "quality"))
    line = F.when(F.col("quality") == 1, whole).otherwise(F.expr("substring(x, 1, length(x) - 1)"))
    rows.withColumn("x", whole).select(line.alias("value")).write.text(path)
    back = (
        spark.read.schema("index long, quality int, _corrupt_record string")
        .option("mode", "PERMISSIVE")
        .json(path)
    )
    checked = fl.integrity_check(back, rules=(("quality missing", "quality is not null"),))
    return fl.validation_summary(checked)


FOLDERS = """d AS (SELECT source, lang, count(*) AS n, bool_or(quality = 0 AND toxic = 1) AS broken FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL)"""


def _folders(spark, sf):
    """One file of JSON lines per source and language; a bad document's line is cut short."""
    path = scratch_path(spark, "folders")
    docs = inp.table(spark, sf, "documents").join(inp.table(spark, sf, "labels"), "doc_id", "left")
    whole = F.to_json(F.struct("doc_id", "text"))
    bad = F.coalesce((F.col("quality") == 0) & (F.col("toxic") == 1), F.lit(False))
    lines = docs.select("source", "lang", whole.alias("x"), bad.alias("bad"))
    lines = lines.select("source", "lang", F.when(F.col("bad"), F.expr("substring(x, 1, length(x) - 1)")).otherwise(F.col("x")).alias("value"))
    lines.repartition("source", "lang").write.partitionBy("source", "lang").text(path)
    return path


@query("check_files", f"""WITH {FOLDERS} SELECT source, lang, NOT coalesce(broken, false) AS is_valid, coalesce(broken, false) AS told, CASE WHEN NOT coalesce(broken, false) THEN n END AS "rows" FROM d""")
def _(spark, sf):
    checked = ck.check_files(spark, _folders(spark, sf), "json", (".txt",))
    place = [F.regexp_extract("path", f"/{c}=([^/]*)/", 1).alias(c) for c in ("source", "lang")]
    return checked.select(*place, "is_valid", F.coalesce(F.col("error").startswith("ValueError: line "), F.lit(False)).alias("told"), "rows")


@query("check_files_summary", f"""WITH {FOLDERS} SELECT count(*) AS total, count(*) FILTER (NOT coalesce(broken, false)) AS valid, count(*) FILTER (broken) AS corrupt FROM d""")
def _(spark, sf):
    return fl.validation_summary(ck.check_files(spark, _folders(spark, sf), "json", (".txt",)))
