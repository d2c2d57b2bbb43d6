"""Small helpers on text and numbers for reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def preview_text(col: Column, n: int) -> Column:
    """ARR-23: cut at ``n`` characters, dots only when something was cut."""
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit("..."))).otherwise(col)


def percent(count: Column, total: Column) -> Column:
    """ARR-22: ``count`` as a percentage of ``total`` (null for an empty total)."""
    return F.when(total != 0, count / total * 100.0)


def turn_preview(turns: Column, n: int = 3, width: int = 200) -> Column:
    """WIN-7: the first ``n`` turns with their texts cut at ``width`` characters."""
    return F.transform(
        F.slice(turns, 1, n),
        lambda t: F.struct(t["from"].alias("from"), preview_text(t["value"], width).alias("value")),
    )


def turns_left_out(turns: Column, n: int = 3) -> Column:
    return F.greatest(F.size(turns) - n, F.lit(0))
