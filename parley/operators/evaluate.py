"""Roll-ups of prediction, metric and vector tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions import arrays as ar
from parley.functions import vectors as vc


def masked_accuracy(
    pred: DataFrame, by=("k",), position_mask: str = "loss_mask", mask: str = "loss_mask"
) -> DataFrame:
    """AGG-16: hits on counted positions over the number of supervised ones (+ 1e-6)."""
    hit = (F.col("pred") == F.col("target")).cast("int") * F.col(position_mask)
    return pred.groupBy(*by).agg((F.sum(hit) / (F.sum(mask) + F.lit(1e-6))).alias("accuracy"))


def topk_accuracy(pred: DataFrame, ks=(1, 2, 3), by=()) -> DataFrame:
    """AGG-17: hit counts of the first k guesses on supervised positions, and shares (+ 1e-5)."""
    at = F.array_position("top_ids", F.col("target"))
    on = F.col("loss_mask") == 1
    total = F.coalesce(F.sum("loss_mask"), F.lit(0))
    columns = [
        F.coalesce(F.sum((F.col("pred") == F.col("target")).cast("int") * F.col("loss_mask")), F.lit(0)).alias("correct"),
        total.alias("total"),
        *[F.count_if(on & at.between(1, k)).alias(f"top{k}") for k in ks],
    ]
    counts = pred.groupBy(*by).agg(*columns)
    share = {"acc": F.col("correct") / (F.col("total") + F.lit(1e-5))}
    share |= {f"top{k}_acc": F.col(f"top{k}") / (F.col("total") + F.lit(1e-5)) for k in ks}
    return counts.withColumns(share)


def discounted_loss(metrics: DataFrame, gamma: float = 0.8, by=("epoch", "step")) -> DataFrame:
    """AGG-18: sum of gamma^k * loss over the prediction positions of a step."""
    return metrics.groupBy(*by).agg(F.sum(F.pow(F.lit(gamma), F.col("k")) * F.col("loss")).alias("total_loss"))


def epoch_rollup(metrics: DataFrame, mode: str = "rank_means") -> DataFrame:
    """AGG-19: mean loss and accuracy per epoch and position.

    ``rank0`` rank 0 only; ``rank_means`` mean of the means of the ranks; ``pooled`` all rows alike.
    """
    means = [F.avg("loss").alias("loss"), F.avg("acc").alias("acc")]
    if mode == "rank0":
        return metrics.where("rank = 0").groupBy("epoch", "k").agg(*means)
    if mode == "rank_means":
        return metrics.groupBy("epoch", "k", "rank").agg(*means).groupBy("epoch", "k").agg(*means)
    if mode == "pooled":
        return metrics.groupBy("epoch", "k").agg(*means)
    raise ValueError(f"unknown roll-up {mode!r}")


def prediction_views(df: DataFrame, length: int = 7, columns=("input_ids", "target", "loss_mask")) -> DataFrame:
    """WIN-5 once per prediction position: one row per ``k`` = 0 .. length - 1, sequences moved up by ``k``."""
    views = df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    return views.withColumns({c: ar.shift_zero_fill(F.col(c), F.col("k")) for c in columns})


def concat_layers(vectors: DataFrame, keep_last: bool = True, key=("index", "position")) -> DataFrame:
    """ARR-18: join the layer vectors of a position in layer order.

    With ``keep_last`` the last layer is kept apart in ``last_state``. A position
    has one vector per stored layer, so a group is a handful of rows.
    """
    layers = F.array_sort(F.collect_list(F.struct("layer", "vec")))
    stacked = vectors.groupBy(*key).agg(layers.alias("_l"))
    body = F.slice("_l", F.lit(1), F.greatest(F.size("_l") - 1, F.lit(0))) if keep_last else F.col("_l")
    columns = [F.flatten(F.transform(body, lambda s: s["vec"])).alias("states")]
    if keep_last:
        columns.append(F.element_at("_l", -1)["vec"].alias("last_state"))
    return stacked.select(*key, *columns)


def smooth_l1(df: DataFrame, a: str, b: str, mask: str, by=()) -> DataFrame:
    """ARR-20: masked smooth-L1 distance, divided by the number of positions (masked or not)."""
    return df.groupBy(*by).agg(
        (F.sum(F.col(mask) * vc.smooth_l1(F.col(a), F.col(b))) / F.count(F.lit(1))).alias("vloss")
    )


def soft_cross_entropy(df: DataFrame, pred: str, target: str, mask: str, draft=None, by=()) -> DataFrame:
    """ARR-21: masked cross entropy between two logit vectors, averaged over positions.

    ``draft`` (ids, ascending) restricts the target to the draft vocabulary; ``pred``
    then has one logit per draft id.
    """
    goal = F.col(target) if draft is None else vc.take(F.col(target), draft)
    one = F.col(mask) * vc.cross_entropy(F.col(pred), goal)
    return df.groupBy(*by).agg((F.sum(one) / F.count(F.lit(1))).alias("ploss"))
