"""Length statistics of documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.catalog import inputs as inp
from parley.catalog.registry import query
from parley.functions.text import percent
from parley.operators import filters as fl
from parley.operators import lengths as ln

# (doc_id, source, lang, chars, words, tokens) of every document.
LENGTHS = f"""lengths AS (
  SELECT doc_id, source, lang, text, length(text)::int AS chars,
         len(regexp_extract_all(text, '{inp.WORD}'))::int AS words FROM documents)"""

STATS = """count(*) AS count, min({x})::bigint AS min, max({x})::bigint AS max, round(avg({x}) + 1e-9, 6) AS mean,
  round(median({x})::double + 1e-9, 6) AS median, round(stddev_pop({x}) + 1e-9, 6) AS std, round(quantile_cont({x}, 0.25)::double + 1e-9, 6) AS p25,
  round(quantile_cont({x}, 0.75)::double + 1e-9, 6) AS p75, round(quantile_cont({x}, 0.9)::double + 1e-9, 6) AS p90,
  round(quantile_cont({x}, 0.95)::double + 1e-9, 6) AS p95, round(quantile_cont({x}, 0.99)::double + 1e-9, 6) AS p99"""

# One row per document and unit, with the source as the data set.
UNITS = f"""{LENGTHS}, units AS (
  SELECT source AS dataset, 'chars' AS unit, chars AS x FROM lengths WHERE text <> ''
  UNION ALL SELECT source, 'words', words FROM lengths WHERE text <> ''
  UNION ALL SELECT source, 'tokens', words FROM lengths WHERE text <> '')"""


def _rounded(df):
    names = [name for name, kind in df.dtypes if kind == "double"]
    return df.withColumns({n: inp.rounded(n, 6) for n in names})


def _lengths(spark, sf):
    docs = inp.documents(spark, sf, "doc_id", "source", "lang", "text")
    return ln.text_lengths(docs)


@query("text_lengths", f"WITH {LENGTHS} SELECT doc_id, chars, words, words AS tokens FROM lengths")
def _(spark, sf):
    return _lengths(spark, sf).select("doc_id", "chars", "words", "tokens")


@query("length_stats", f"WITH {LENGTHS} SELECT {STATS.format(x='chars')} FROM lengths")
def _(spark, sf):
    return _rounded(ln.length_stats(_lengths(spark, sf), "chars"))


@query("length_stats_by_lang", f"WITH {LENGTHS} SELECT lang, {STATS.format(x='words')} FROM lengths GROUP BY lang")
def _(spark, sf):
    return _rounded(ln.length_stats(_lengths(spark, sf), "words", by=("lang",)))


@query("length_report", f"WITH {UNITS} SELECT dataset, unit, {STATS.format(x='x')} FROM units GROUP BY ALL")
def _(spark, sf):
    docs = inp.documents(spark, sf, "source", "text")
    return _rounded(ln.length_report(docs, "source"))


@query(
    "summary_table",
    f"""WITH {UNITS} SELECT dataset, unit, count(*) AS count, min(x)::bigint AS min, max(x)::bigint AS max,
      round_even(avg(x), 0)::bigint AS mean, round_even(median(x)::double, 0)::bigint AS median,
      round_even(quantile_cont(x, 0.95)::double, 0)::bigint AS p95
    FROM units GROUP BY dataset, unit""",
)
def _(spark, sf):
    docs = inp.documents(spark, sf, "source", "text")
    return ln.summary_table(ln.length_report(docs, "source"))


@query("length_sketch", "SELECT source, count(*) AS count, min(n_chars)::BIGINT AS min, max(n_chars)::BIGINT AS max, true AS near FROM documents GROUP BY source")
def _(spark, sf):
    # Sketches of sources and languages, merged to sources; each percentile's rank is measured against the rows.
    docs = inp.table(spark, sf, "documents").select("source", "lang", "n_chars")
    fine = ln.length_sketch(docs, "n_chars", ["source", "lang"])
    stats = ln.sketch_stats(ln.merge_sketches(fine, ["source"]), ["source"])
    error = ln.sketch_error(docs, "n_chars", stats, "source")
    return stats.join(error, "source").select("source", "count", "min", "max", (F.col("error") <= 0.02).alias("near"))


@query(
    "length_histogram",
    f"""WITH {LENGTHS}, r AS (SELECT lang, min(chars)::double AS lo, max(chars)::double AS hi, count(*) AS n,
        quantile_cont(chars, 0.95)::double AS p95 FROM lengths GROUP BY lang),
      g AS (SELECT lang, chars, least(floor((chars - lo) / (hi - lo) * 50), 49)::int AS g, lo, (hi - lo) / 50 AS width, n, p95
        FROM lengths JOIN r USING (lang)),
      b AS (SELECT *, g - (chars < g * width + lo)::int + (g < 49 AND chars >= (g + 1) * width + lo)::int AS bin FROM g)
    , k AS (SELECT lang, bin, count(*) AS c FROM b GROUP BY ALL)
    SELECT lang, e.bin, round(lo + e.bin * ((hi - lo) / 50) + 1e-9, 6) AS bin_start, coalesce(c, 0) AS count,
      round(coalesce(c, 0) / (n * ((hi - lo) / 50)) + 1e-12, 9) AS density, round(p95 + 1e-9, 6) AS axis_limit
    FROM r CROSS JOIN (SELECT unnest(range(50))::int AS bin) e LEFT JOIN k USING (lang, bin)""",
)
def _(spark, sf):
    found = ln.length_histogram(_lengths(spark, sf), "chars", 50, by=("lang",))
    return found.withColumns({"bin_start": inp.rounded("bin_start", 6), "density": inp.rounded("density", 9), "axis_limit": inp.rounded("axis_limit", 6)})


@query(
    "length_cdf",
    f"""WITH {LENGTHS}, c AS (SELECT lang, words AS length, cume_dist() OVER (PARTITION BY lang ORDER BY words) AS cdf
        FROM lengths)
    SELECT lang, length::bigint AS length, count(*) AS "rows", round(max(cdf) + 1e-12, 9) AS cdf FROM c GROUP BY lang, length""",
)
def _(spark, sf):
    found = ln.length_cdf(_lengths(spark, sf), "words", by=("lang",))
    return found.withColumn("cdf", inp.rounded("cdf", 9))


@query(
    "nonempty_text",
    "SELECT lang, count(*) FILTER (text <> '') AS valid, count(*) FILTER (coalesce(text, '') = '') AS empty FROM documents GROUP BY lang",
)
def _(spark, sf):
    docs = inp.table(spark, sf, "documents").select("lang", "text")
    kept, _ = fl.nonempty_text(docs)
    valid = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("valid"))
    whole = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    both = whole.join(valid, "lang", "left")
    n = F.coalesce("valid", F.lit(0))
    return both.select("lang", n.alias("valid"), (F.col("n") - n).alias("empty"))


@query(
    "nonempty_text_counts",
    "SELECT count(*) FILTER (text <> '') AS valid, count(*) FILTER (coalesce(text, '') = '') AS empty FROM documents",
)
def _(spark, sf):
    return fl.nonempty_text(inp.table(spark, sf, "documents").select("text"))[1]


@query(
    "percent",
    "SELECT source, lang, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY source) + 1e-9, 6) AS percent FROM documents GROUP BY source, lang",
)
def _(spark, sf):
    docs = inp.table(spark, sf, "documents")
    parts = docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    whole = parts.groupBy("source").agg(F.sum("n").alias("t"))
    return parts.join(whole, "source").select(
        "source", "lang", inp.rounded(percent(F.col("n"), F.col("t")), 6).alias("percent")
    )
