"""Padding, shifting, bucketing of token sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once.

    An expression that a lambda refers to from outside is evaluated again for every
    element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(values: Column, start: Column, op, neutral: Column) -> Column:
    """[start, start op v0, start op v0 op v1, ...], one element more than ``values``.

    Worked out in blocks of about the square root of the length, so that a record
    with very many turns does not copy its whole prefix for every turn.
    """

    def running(part, first):
        return F.aggregate(
            part, F.array(first), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x)))
        )

    def blocked(v, width):
        last = F.floor((F.greatest(F.size(v), F.lit(1)) - 1) / width).cast("int")
        parts = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(v, b * width + 1, width))
        return let(F.transform(parts, lambda part: running(part, neutral)), joined)

    def joined(inner):
        return let(running(F.transform(inner, lambda r: F.element_at(r, -1)), start), lambda s: spread(inner, s))

    def spread(inner, starts):
        shifted = F.zip_with(
            inner,
            head_of(starts),
            lambda r, s: F.transform(head_of(r), lambda x: op(s, x)),
        )
        return F.concat(F.flatten(shifted), F.array(F.element_at(starts, -1)))

    def sized(v):
        width = F.greatest(F.ceil(F.sqrt(F.size(v))), F.lit(1)).cast("int")
        return let(width, lambda w: blocked(v, w))

    return let(values, sized)


# Half-open length ranges and their names.
BUCKETS = (
    (0, 2048, "0K-2K"),
    (2048, 4096, "2K-4K"),
    (4096, 8192, "4K-8K"),
    (8192, 16384, "8K-16K"),
    (16384, 32768, "16K-32K"),
)


def length_bucket(length: Column, edges=BUCKETS) -> Column:
    """ARR-13: name of the range; null outside all of them."""
    name = F.lit(None).cast("string")
    for lo, hi, label in reversed(edges):
        name = F.when((length >= lo) & (length < hi), F.lit(label)).otherwise(name)
    return name


def bucket_max(name: Column) -> Column:
    """The upper length in a directory name: ``a-nK`` gives n * 1024, ``a-n`` gives n, else null."""
    part = F.trim(F.when(name.contains("-"), F.split_part(name, F.lit("-"), F.lit(2))))
    number = F.regexp_extract(part, r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)K$", 1)
    plain = F.regexp_extract(part, r"^([+-]?[0-9]+)$", 1)
    scaled = (number.try_cast("double") * 1024).try_cast("long")
    return F.when(part.endswith("K"), scaled).otherwise(plain.try_cast("long"))


def pad_to(values: Column, n: int | Column, overflow: str = "error") -> Column:
    """ARR-15: zeros on the right up to ``n``; a longer row is cut or is an error."""
    width = n if isinstance(n, Column) else F.lit(n)
    missing = F.greatest(width - F.size(values), F.lit(0))
    padded = F.concat(values, F.array_repeat(F.lit(0), missing.cast("int")))
    if overflow == "crop":
        return F.slice(padded, F.lit(1), width)
    if overflow != "error":
        raise ValueError(f"overflow must be 'error' or 'crop', not {overflow!r}")
    return F.when(F.size(values) > width, F.raise_error(F.lit("sequence is longer than the pad length")).cast("array<int>")).otherwise(padded)


pad_ids = pad_to


def attention_mask(ids: Column, n: int | Column, extra: int = 0) -> Column:
    """ARR-16: ones for real ids (and ``extra`` more), then zeros up to ``n``."""
    width = n if isinstance(n, Column) else F.lit(n)
    ones = F.least(F.size(ids) + extra, width)
    return F.concat(F.array_repeat(F.lit(1), ones), F.array_repeat(F.lit(0), (width - ones).cast("int")))


def shift_zero_fill(values: Column, k: int | Column = 1, left: bool = False, zero=0) -> Column:
    """WIN-5: shift by ``k`` and fill with zeros.

    ``left=False`` moves values towards the start (the next token comes into
    view), ``left=True`` puts the zeros in front.
    """
    size = F.size(values)
    gap = F.least(k if isinstance(k, Column) else F.lit(k), size)
    zeros = F.array_repeat(F.lit(zero), gap)
    if left:
        return F.concat(zeros, F.slice(values, F.lit(1), size - gap))
    return F.concat(F.slice(values, gap + 1, size - gap), zeros)


def tail_of(values: Column) -> Column:
    """All but the first element."""
    return F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))


def head_of(values: Column) -> Column:
    """All but the last element."""
    return F.slice(values, F.lit(1), F.greatest(F.size(values) - 1, F.lit(0)))
