"""Positions, shuffles, samples, shards, splits and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.catalog import inputs as inp
from parley.catalog.registry import query
from parley.operators import order, stored
from parley.operators.permute import ROUNDS
from parley.session import scratch_path
from parley.sources import writers as wr

LINE = "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS pos FROM lineitem"
KEYS = ["l_orderkey", "l_linenumber"]


def _lines(spark, sf):
    return inp.table(spark, sf, "lineitem").select(*KEYS)


@query("global_position", f"{LINE}")
def _(spark, sf):
    return order.global_position(_lines(spark, sf), KEYS)


SHUFFLED = """placed AS (SELECT event_id, user_id, md5('42:' || event_id) AS h,
  row_number() OVER (ORDER BY md5('42:' || event_id), event_id) - 1 AS pos, count(*) OVER () AS n FROM events)"""


def _events(spark, sf):
    return inp.table(spark, sf, "events").select("event_id", "user_id")


@query("seeded_shuffle", f"WITH {SHUFFLED} SELECT event_id, user_id, pos FROM placed")
def _(spark, sf):
    return inp.in_order(order.seeded_shuffle(_events(spark, sf), "event_id", 42))


@query("shuffled_position", f"WITH {SHUFFLED} SELECT event_id, user_id, pos FROM placed")
def _(spark, sf):
    return order.shuffled_position(_events(spark, sf), "event_id", 42)


@query("cap_sample", f"WITH {SHUFFLED} SELECT event_id, user_id FROM placed WHERE pos < 500")
def _(spark, sf):
    return order.cap_sample(_events(spark, sf), 500, "event_id", 42)


@query("cap_sample_larger", "SELECT event_id, user_id FROM events")
def _(spark, sf):
    return order.cap_sample(_events(spark, sf), 1_000_000_000, "event_id", 42)


@query("ratio_sample", f"WITH {SHUFFLED} SELECT event_id, user_id FROM placed WHERE pos < floor(n * 0.3::double)")
def _(spark, sf):
    return order.ratio_sample(_events(spark, sf), 0.3, "event_id", 42)


@query(
    "slice_by_rank",
    f"""WITH p AS ({LINE}), s AS (SELECT *, floor(count(*) OVER () * 0.05::double) AS s FROM p)
    SELECT k::int AS k, l_orderkey, l_linenumber, pos FROM s JOIN (VALUES (3), (20)) v(k) ON pos >= k * s AND pos < (k + 1) * s""",
)
def _(spark, sf):
    lines = order.positioned(_lines(spark, sf), KEYS)
    third = order.slice_by_rank(lines, 3, 0.05).withColumn("k", F.lit(3))
    rest = order.slice_by_rank(lines, 20, 0.05).withColumn("k", F.lit(20))
    return third.unionByName(rest).drop("n_rows")


@query("round_robin_shard", f"SELECT *, (pos % 7)::int AS shard FROM ({LINE})")
def _(spark, sf):
    return order.round_robin_shard(_lines(spark, sf), 7, KEYS)


@query(
    "train_val_split",
    f"""WITH p AS ({LINE}) SELECT *, CASE WHEN pos < floor(0.95::double * (SELECT count(*) FROM p))
    THEN 'train' ELSE 'val' END AS split FROM p""",
)
def _(spark, sf):
    return order.train_val_split(_lines(spark, sf), KEYS)


# Seven ranks; the last round is filled up from the start.
PLAN = """n AS (SELECT count(*) AS n, (ceil(count(*) / 7.0) * 7)::bigint AS padded FROM events),
p AS (SELECT event_id, row_number() OVER (ORDER BY md5('42:1:' || event_id), event_id) - 1 AS p FROM events),
plan AS (SELECT event_id, 1 AS epoch, (p % 7)::int AS rank, p // 7 AS step FROM p
  UNION ALL SELECT event_id, 1, ((p + n) % 7)::int, (p + n) // 7 FROM p, n WHERE p + n < padded)"""


def _plan(spark, sf):
    return order.epoch_plan(_events(spark, sf).select("event_id"), 1, 7, "event_id", 42)


@query("epoch_plan", f"WITH {PLAN} SELECT * FROM plan")
def _(spark, sf):
    return _plan(spark, sf)


@query(
    "epoch_plan_unshuffled",
    """WITH p AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS p, count(*) OVER () AS n FROM events),
    q AS (SELECT event_id, p FROM p UNION ALL SELECT event_id, p + n FROM p WHERE p + n < ceil(n / 3.0) * 3)
    SELECT event_id, 0 AS epoch, (p % 3)::int AS rank, p // 3 AS step FROM q""",
)
def _(spark, sf):
    return order.epoch_plan(_events(spark, sf).select("event_id"), 0, 3, "event_id", 42, shuffle=False)


# ------------------------------------------------- positions of stored rows

STORED = "stored AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)"


def _stored(spark, sf):
    """The documents saved in order of their length, in several files, and read with their positions."""
    path = scratch_path(spark, "stored")
    docs = inp.table(spark, sf, "documents").select("doc_id", "n_chars")
    wr.write_corpus(docs.repartitionByRange(5, "n_chars", "doc_id").sortWithinPartitions("n_chars", "doc_id"), path)
    return stored.scan_in_order(spark, path)


@query("stored_position", f"WITH {STORED} SELECT doc_id, n_chars, pos, n AS n_rows FROM stored")
def _(spark, sf):
    return _stored(spark, sf)


@query(
    "train_val_split_stored",
    f"WITH {STORED} SELECT doc_id, n_chars, pos, n AS n_rows, CASE WHEN pos < floor(0.95::double * n) THEN 'train' ELSE 'val' END AS split FROM stored",
)
def _(spark, sf):
    return order.train_val_split(_stored(spark, sf))


@query("round_robin_shard_stored", f"WITH {STORED} SELECT doc_id, n_chars, pos, n AS n_rows, (pos % 7)::int AS shard FROM stored")
def _(spark, sf):
    return order.round_robin_shard(_stored(spark, sf), 7)


@query(
    "slice_by_rank_stored",
    f"WITH {STORED} SELECT doc_id, n_chars, pos, n AS n_rows FROM stored WHERE pos >= 3 * floor(n * 0.05::double) AND pos < 4 * floor(n * 0.05::double)",
)
def _(spark, sf):
    return order.slice_by_rank(_stored(spark, sf), 3, 0.05)


@query("drop_every_nth_stored", f"WITH {STORED} SELECT doc_id, n_chars, pos, n AS n_rows FROM stored WHERE (pos + 1) % 3 <> 0")
def _(spark, sf):
    return order.drop_every_nth(_stored(spark, sf), n=3)


# The permutation depends on the number of rows, so its SQL works the halves out in plain SQL as well.
PASSES = 4


def keyed_sql(key: str, stored: str = STORED) -> str:
    """(doc_id, n, q): where each row of ``stored`` stands; goes on for rows that come out at n or above, up to PASSES times."""
    steps = [f"""{stored}, size AS (SELECT max(n) AS n, floor(sqrt(max(n)))::BIGINT AS a FROM stored),
    dims AS (SELECT n, a, (n + a - 1) // a AS b FROM size), x0 AS (SELECT doc_id, pos AS x FROM stored)"""]
    for k in range(PASSES):
        half = [f"x // b AS l, x % b AS r, a, b, n, x FROM x{k}, dims"]
        for turn in range(ROUNDS):
            side = "r" if turn % 2 == 0 else "l"
            value = f"('0x' || substr(md5('{key}:{turn}:' || {side}), 1, 12))::BIGINT"
            new = f"(l + {value}) % a AS l, r" if turn % 2 == 0 else f"l, (r + {value}) % b AS r"
            half.append(f"{new}, a, b, n, x")
        sql = f"SELECT doc_id, {half[0]}"
        for h in half[1:]:
            sql = f"SELECT doc_id, {h} FROM ({sql})"
        keep = "" if k == 0 else "WHEN x < n THEN x "
        steps.append(f"x{k + 1} AS (SELECT doc_id, CASE {keep}WHEN true THEN l * b + r END AS x FROM ({sql}))")
    return ", ".join(steps) + f", perm AS (SELECT doc_id, x AS q, n FROM x{PASSES}, dims)"


KEYED = f"""{keyed_sql("42:2")}, dealt AS (SELECT doc_id, q FROM perm UNION ALL SELECT doc_id, q + n FROM perm WHERE q + n < ceil(n / 7.0) * 7)"""


@query("epoch_plan_keyed", f"WITH {KEYED} SELECT doc_id, 2 AS epoch, (q % 7)::int AS rank, q // 7 AS step FROM dealt")
def _(spark, sf):
    placed = _stored(spark, sf).select("doc_id", "pos")
    return order.epoch_plan_keyed(placed, placed.count(), 2, 7, 42).drop("pos")


VALIDATION = f"""{STORED}, val AS (SELECT doc_id, pos - floor(0.95::double * n)::bigint AS p, n - floor(0.95::double * n)::bigint AS n
  FROM stored WHERE pos >= floor(0.95::double * n)),
w AS (SELECT doc_id, p FROM val UNION ALL SELECT doc_id, p + n FROM val WHERE p + n < ceil(n / 3.0) * 3)"""


@query(
    "validation_plan",
    f"WITH {VALIDATION} SELECT doc_id, (p % 3)::int AS rank, p // 3 AS step, (p // 3) // 8 AS batch, ((p // 3) % 8)::int AS slot FROM w",
)
def _(spark, sf):
    held = order.train_val_split(_stored(spark, sf)).where("split = 'val'")
    first = F.floor(F.col("n_rows") * F.lit(0.95)).cast("long")
    held = held.select("doc_id", (F.col("pos") - first).alias("pos"))
    return order.validation_plan(held, held.count(), 3, 4).drop("pos")


@query(
    "optimiser_steps",
    f"""WITH {KEYED}, s AS (SELECT (q % 7) AS rank, (q // 7) // 4 AS batch FROM dealt)
    SELECT batch // 3 AS opt_step, count(*) AS "rows", count(DISTINCT (rank, batch)) AS batches, count(*) = 84 AS is_full FROM s GROUP BY 1""",
)
def _(spark, sf):
    placed = _stored(spark, sf).select("doc_id", "pos")
    plan = order.epoch_plan_keyed(placed, placed.count(), 2, 7, 42)
    return order.optimiser_steps(order.batch_plan(plan, 4, accumulation=3), 4, 3, 7)


@query("batch_plan", f"WITH {PLAN} SELECT *, step // 4 AS batch, (step % 4)::int AS slot FROM plan")
def _(spark, sf):
    return order.batch_plan(_plan(spark, sf), 4)


@query("resume_from_step", f"WITH {PLAN} SELECT * FROM plan WHERE step >= 100")
def _(spark, sf):
    return order.resume_from_step(_plan(spark, sf), 100)


FILES = "files AS (SELECT 'run/data_' || doc_id || '.pt' AS path, 'data_' || doc_id || '.pt' AS name, n_chars AS length FROM documents)"


@query("name_order", f"WITH {FILES} SELECT path, name, length, row_number() OVER (ORDER BY name) - 1 AS pos FROM files")
def _(spark, sf):
    return inp.in_order(order.name_order(inp.file_table(spark, sf)))


@query(
    "drop_every_nth",
    f"""WITH {FILES} SELECT path, name, length FROM (SELECT *, row_number() OVER (ORDER BY name) AS i FROM files)
    WHERE i % 3 <> 0""",
)
def _(spark, sf):
    return order.drop_every_nth(inp.file_table(spark, sf), "name", 3)


@query(
    "drop_every_nth_preview",
    f"""WITH {FILES} SELECT path, name, length, (SELECT count(*) // 3 FROM files) AS n_dropped
    FROM (SELECT *, row_number() OVER (ORDER BY name) AS i FROM files) WHERE i % 3 = 0 AND i <= 30""",
)
def _(spark, sf):
    return order.drop_every_nth(inp.file_table(spark, sf), "name", 3, preview=True)


@query("limit_samples", "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 50")
def _(spark, sf):
    return order.limit_samples(inp.table(spark, sf, "documents").select("doc_id", "n_chars"), 50, "doc_id")


@query("limit_samples_ties", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY ALL LIMIT 2000")
def _(spark, sf):
    # A small edge, so that the cuts are narrowed more than once.
    rows = inp.table(spark, sf, "lineitem").select(*KEYS, "l_quantity")
    return order.limit_samples(rows, 2000, rows.columns, edge_rows=100, sample_rows=200)


@query(
    "next_valid",
    """WITH p AS (SELECT doc_id, n_chars <= 3000 AS valid, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)
    SELECT doc_id, valid, pos, coalesce(
      min(CASE WHEN valid THEN pos END) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
      min(CASE WHEN valid THEN pos END) OVER ()) AS use_pos FROM p""",
)
def _(spark, sf):
    df = inp.table(spark, sf, "documents").select("doc_id", (F.col("n_chars") <= 3000).alias("valid"))
    return order.next_valid(df, "doc_id", "valid", segment_rows=100)
