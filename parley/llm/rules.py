"""Quality scores from a sparse ensemble of rules.

Small trees are grown on statistics of labelled texts; every path from a root is a
conjunction of thresholds, a rule. A lasso logistic regression over the rules keeps
few of them, and the result is compiled into one Spark column expression.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.words import U64, mix, slices, split
from parley.session import materialise

STATISTICS = (
    "chars", "words", "lines", "word_length", "upper", "digits", "symbols", "marks", "bars", "commas", "stops", "beyond_ascii", "distinct", "repeated", "short_lines",
)
HIDDEN = "__statistics"
_CLASSES = {
    "upper": range(65, 91), "digits": range(48, 58), "symbols": b"#$%&*+=<>@^_~{}[]\\/", "marks": b"!?", "bars": b"|", "commas": b",;:", "stops": b".", "beyond_ascii": range(128, 256),
}


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """The statistics of each whole text; shares are of bytes or words, and 0 for a text without any."""
    words = split(column)
    n, size = words.counts, np.diff(words.offsets)
    per = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[words.offsets])
    share = lambda a, b: np.divide(a, b, out=np.zeros(len(a)), where=b > 0)
    out = {"chars": (size - per((words.data & 0xC0) == 0x80)).astype(float), "words": n.astype(float)}
    lines = per(words.data == 10) + (size > 0)
    out["lines"] = lines.astype(float)
    held = np.concatenate([[0], np.cumsum(words.ends - words.starts)])
    out["word_length"] = share(np.diff(held[words.first]), n)
    for name, members in _CLASSES.items():
        table = np.zeros(256, bool)
        table[list(members)] = True
        out[name] = share(per(table[words.data]), size)
    names, owner = words.hashes(), words.owner()
    _, firsts = np.unique(mix(names ^ mix(owner.astype(U64))), return_index=True)  # one value per word and text
    out["distinct"] = share(np.bincount(owner[firsts], minlength=len(n)).astype(float), n)
    again = np.zeros(len(names), bool)
    again[1:] = (names[1:] == names[:-1]) & (owner[1:] == owner[:-1])
    out["repeated"] = share(np.bincount(owner[again], minlength=len(n)).astype(float), n)
    out["short_lines"] = share(lines.astype(float), n)
    return {name: out[name] for name in STATISTICS}


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` and a struct ``__statistics``; every other column passes through untouched."""
    kind = T.StructType([T.StructField(s, T.DoubleType()) for s in STATISTICS])
    if docs.schema[text].dataType.simpleString() != "string":
        docs = docs.withColumn(text, F.col(text).cast("string"))

    def run(batches):
        for part in slices(batches, text):
            found = statistics(part.column(text))
            struct = pa.StructArray.from_arrays([pa.array(found[s], pa.float64()) for s in STATISTICS], list(STATISTICS))
            yield pa.RecordBatch.from_arrays([*part.columns, struct], [*part.schema.names, HIDDEN])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(HIDDEN, kind)]))


Rule = tuple[tuple[int, str, float], ...]  # (statistic, <= or >, threshold), all of which hold


def tree_rules(debug: str) -> list[Rule]:
    """The conjunctions on all paths of a tree, as its description lists them."""
    found, path = [], []
    for line in debug.splitlines():
        if m := re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line):
            depth = len(m[1])
            path = [p for p in path if p[0] < depth] + [(depth, (int(m[2]), m[3], float(m[4])))]
            found.append(_tight(tuple(x for _, x in path)))
    return found


def _tight(rule: Rule) -> Rule:
    """One bound per statistic and side."""
    best: dict[tuple[int, str], float] = {}
    for k, op, x in rule:
        best[k, op] = x if (k, op) not in best else (min if op == "<=" else max)(best[k, op], x)
    return tuple(sorted((k, op, x) for (k, op), x in best.items()))


def rule_column(rule: Rule, stats: str = HIDDEN) -> Column:
    out = F.lit(True)
    for k, op, x in rule:
        c = F.col(f"{stats}.{STATISTICS[k]}")
        out = out & ((c <= x) if op == "<=" else (c > x))
    return out


@dataclass
class RuleModel:
    intercept: float
    weights: list[tuple[Rule, float]]

    def score(self, stats: str = HIDDEN) -> Column:
        """The probability of label 1."""
        total = F.lit(self.intercept)
        for rule, weight in self.weights:
            total = total + F.when(rule_column(rule, stats), weight).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 20_000, trees: int = 20, depth: int = 3, penalty: float = 0.002, seed: int = 7) -> RuleModel:
    """Learn from at most ``sample`` labelled rows outside the held-out fold, those with the smallest hashes.

    Labels other than 0 and 1, and null ids, are ignored; an id labelled twice counts
    with its smaller label. Without rows of both labels the score is the smoothed share
    of label 1. Only the sample's size bounds what is broadcast and held by the fit.
    """
    chosen = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min(label).cast("double").alias("label"))
    chosen = materialise(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "labels")
    texts = docs.select(F.col("doc_id"), F.col("text")).join(F.broadcast(chosen), "doc_id")
    rows = with_statistics(texts).select("doc_id", "label", HIDDEN).dropDuplicates(["doc_id"])
    rows = materialise(rows.repartition(4, "doc_id").sortWithinPartitions("doc_id"), "training")
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < positive < n:
        share = (positive + 1) / (n + 2)
        return RuleModel(math.log(share / (1 - share)), [])
    vectors = VectorAssembler(inputCols=[f"s{k}" for k in range(len(STATISTICS))], outputCol="features")
    flat = rows.select("label", *[F.col(f"{HIDDEN}.{s}").alias(f"s{k}") for k, s in enumerate(STATISTICS)])
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=64, featureSubsetStrategy="sqrt")
    grown = forest.fit(vectors.transform(flat))
    rules = sorted({r for t in grown.trees for r in tree_rules(t.toDebugString)})
    held = rows.select("label", *[rule_column(r).cast("double").alias(f"r{k}") for k, r in enumerate(rules)])
    held = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="features").transform(held)
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False).fit(held.select("label", "features"))
    weights = [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray()) if w]
    return RuleModel(float(lasso.intercept), weights)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text).

    Null and empty texts have all statistics 0 and are scored like others. Repeated
    rows keep one result each. Other columns are ignored. A null doc_id is not held out.
    """
    model = fit(docs, labels, **options)
    scored = with_statistics(docs.select("doc_id", "text")).select("doc_id", held_out().alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns."""
    model = fit(docs, labels, **options)
    return with_statistics(docs).where(model.score() >= threshold).select(*docs.columns)
