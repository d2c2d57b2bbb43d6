"""Element-wise work on stored vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions.arrays import let


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def unit_draw(seed: int, key: Column, i: Column) -> Column:
    """A number in [0, 1) that depends on (seed, key, i) only, so a retry repeats it."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), i.cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform_noise(vec: Column, key: Column, std: float = 0.2, seed: int = 0) -> Column:
    """ARR-19: v + (u - 0.5) * std * 512 / width."""
    return let(
        F.lit(std * 512.0) / F.size(vec),
        lambda scale: F.transform(
            vec.cast("array<double>"), lambda x, i: x + (unit_draw(seed, key, i) - F.lit(0.5)) * scale
        ),
    )


def smooth_l1(a: Column, b: Column) -> Column:
    """Mean over the width of the element-wise smooth-L1 distance (beta 1)."""

    def one(x, y):
        d = F.abs(x - y)
        return F.when(d < 1.0, d * d * F.lit(0.5)).otherwise(d - F.lit(0.5))

    parts = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), one)
    return _sum(parts) / F.size(a)


def log_softmax(logits: Column) -> Column:
    """Max-shifted log-softmax."""

    def shifted(values):
        return let(F.array_max(values), lambda top: F.transform(values, lambda x: x - top))

    def normed(values):
        norm = F.log(_sum(F.transform(values, lambda x: F.exp(x))))
        return let(norm, lambda n: F.transform(values, lambda x: x - n))

    return let(let(logits.cast("array<double>"), shifted), normed)


def take(values: Column, ids: list[int] | Column) -> Column:
    """Elements at the given (0-based) positions."""
    at = ids if isinstance(ids, Column) else F.array(*[F.lit(int(i)) for i in ids])
    return let(values, lambda v: F.transform(at, lambda i: F.get(v, i)))


def cross_entropy(pred: Column, target: Column) -> Column:
    """-sum softmax(target) * log_softmax(pred) for one position."""
    p = F.transform(log_softmax(target), lambda x: F.exp(x))
    return -_sum(F.zip_with(p, log_softmax(pred), lambda x, y: x * y))
