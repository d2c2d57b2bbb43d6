"""A keyed permutation of 0 .. n - 1 as a column expression.

A position is written as (left, right) with right below b and left below a, where a * b is n
or little more. Rounds add to one half a hash of the other, in turn; each round can be
undone, so all of them are a permutation of a * b numbers. What comes out at n or above
goes through again until it is below: fewer than a numbers are, so this ends, and how
often it can happen is worked out beforehand from those numbers.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 6
_DIGITS = 12  # hexadecimal, so that a half and its hash add up within a long


def halves(n: int) -> tuple[int, int]:
    """(a, b) with a * b at least n and less than n + a."""
    a = max(1, math.isqrt(max(n, 1)))
    return a, -(-max(n, 1) // a)


def _hash(key: str, turn: int, half: int) -> int:
    return int(hashlib.md5(f"{key}:{turn}:{half}".encode()).hexdigest()[:_DIGITS], 16)


def permuted(x: int, n: int, key: str, rounds: int = ROUNDS) -> int:
    """One pass over one number of 0 .. a * b - 1, on the driver."""
    a, b = halves(n)
    left, right = x // b, x % b
    for turn in range(rounds):
        if turn % 2 == 0:
            left = (left + _hash(key, turn, right)) % a
        else:
            right = (right + _hash(key, turn, left)) % b
    return left * b + right


def passes(n: int, key: str, rounds: int = ROUNDS) -> int:
    """After how many passes every number below n has come out below n.

    A number that stays outside has come to one of the a * b - n, fewer than a, outside
    numbers, so the longest way through those tells. A cycle among them is never entered from below.
    """
    a, b = halves(n)
    onward = {x: permuted(x, n, key, rounds) for x in range(n, a * b)}
    longest = 0
    for x in onward.keys() - set(onward.values()):  # where ways through the outside begin
        steps = 0
        while x in onward:
            x, steps = onward[x], steps + 1
        longest = max(longest, steps)
    return 1 + longest


def permute(df: DataFrame, pos: str, n: int, key: str, out: str = "pos", rounds: int = ROUNDS) -> DataFrame:
    """Adds ``out``, where the row of position ``pos`` (0 .. n - 1) stands in the permutation of this key.

    One projection a round; rows are neither moved nor compared.
    """
    a, b = halves(n)
    columns = [F.col(f"`{c}`") for c in df.columns]

    def hashed(turn: int, half: str) -> Column:
        text = F.concat(F.lit(f"{key}:{turn}:"), F.col(half).cast("string"))
        return F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("long")

    rows = df.select(*columns, F.col(pos).cast("long").alias("_x"))
    for turn in range(passes(n, key, rounds)):
        # Later passes leave alone what is below n.
        rows = rows.select(*columns, "_x", F.expr(f"_x div {b}").alias("_l"), (F.col("_x") % b).alias("_r"))
        for k in range(rounds):
            if k % 2 == 0:
                new = {"_l": F.pmod(F.col("_l") + hashed(k, "_r"), F.lit(a)), "_r": F.col("_r")}
            else:
                new = {"_l": F.col("_l"), "_r": F.pmod(F.col("_r") + hashed(k, "_l"), F.lit(b))}
            rows = rows.select(*columns, "_x", *[v.cast("long").alias(c) for c, v in new.items()])
        again = F.col("_l") * b + F.col("_r")
        rows = rows.select(*columns, (again if turn == 0 else F.when(F.col("_x") < n, F.col("_x")).otherwise(again)).alias("_x"))
    return rows.select(*columns, F.col("_x").alias(out))
