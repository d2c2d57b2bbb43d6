"""Loss masks from per-turn token counts.

A mask is put together from runs of ones and zeros, so its cost is the length of
the sequence plus the number of turns, not their product.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions.arrays import head_of, let, scan

# Fixed values per family. Zero range of a turn that starts at c with k tokens of
# instruction: [c + lo, c + k + hi); "head" is for turn 0 (lo None = from position
# 0), "tail" for the others. "gap" is added to c after turn 0 and after the others.
RULES = {
    "qwen": {"head": (None, -2), "tail": (-2, -1), "gap": (2, 2), "trim": 0},
    "llama": {"head": (0, -2), "tail": (-3, 1), "gap": (0, 3), "trim": 0},
    "legacy": {"head": (0, -2), "tail": (-3, 1), "gap": (0, 3), "trim": 1},
}
RULES["deepseek"] = RULES["qwen"]


def _by_place(first: Column, head, tail) -> Column:
    return F.when(first, F.lit(head)).otherwise(F.lit(tail))


def _starts(turn_len: Column, family: str) -> Column:
    head_gap, tail_gap = RULES[family]["gap"]
    steps = F.transform(turn_len, lambda t, i: t.cast("int") + _by_place(i == 0, head_gap, tail_gap))
    return scan(steps, F.lit(1), lambda a, b: a + b, F.lit(0))


def cumulative_turn_start(turn_len: Column, family: str) -> Column:
    """WIN-3: token position where each turn starts, then where the last one ends."""
    return _starts(turn_len, family)


def _mask(length: Column, turn_len: Column, instr_len: Column, family: str) -> Column:
    rule = RULES[family]
    (head_lo, head_hi), (tail_lo, tail_hi) = rule["head"], rule["tail"]

    def zero_range(start, k, i, total):
        def inside(position):
            return F.least(F.greatest(position, F.lit(0)), total)

        from_start = F.lit(0) if head_lo is None else start + head_lo
        return F.struct(
            inside(F.when(i == 0, from_start).otherwise(start + tail_lo)).alias("lo"),
            inside(start + k.cast("int") - rule["trim"] + _by_place(i == 0, head_hi, tail_hi)).alias("hi"),
        )

    def ranges(starts, instr, total):
        pairs = F.zip_with(head_of(starts), instr, lambda c, k: F.struct(c.alias("c"), k.alias("k")))
        return F.transform(pairs, lambda x, i: zero_range(x["c"], x["k"], i, total))

    def assemble(starts, zeros, total):
        """Between the ranges ones; ``done`` is how far the mask has got before each range."""
        ends = F.transform(zeros, lambda z: F.greatest(z["lo"], z["hi"]))
        return let(
            scan(ends, F.least(F.lit(1), total), F.greatest, F.lit(0)),
            lambda done: F.concat(
                F.array_repeat(F.lit(0), F.least(F.lit(1), total)),
                F.flatten(F.zip_with(zeros, head_of(done), run)),
                rest(F.element_at(done, -1), F.least(F.element_at(starts, -1), total), total),
            ),
        )

    def run(z, done):
        ones = F.greatest(z["lo"] - done, F.lit(0))
        zeros = F.greatest(z["hi"] - F.greatest(done, z["lo"]), F.lit(0))
        return F.concat(F.array_repeat(F.lit(1), ones), F.array_repeat(F.lit(0), zeros))

    def rest(done, stop, total):
        ones = F.greatest(stop - done, F.lit(0))
        return F.concat(F.array_repeat(F.lit(1), ones), F.array_repeat(F.lit(0), total - done - ones))

    def masked(given):
        total = given["total"]
        return let(
            _starts(given["turn"], family),
            lambda starts: let(ranges(starts, given["instr"], total), lambda zeros: assemble(starts, zeros, total)),
        )

    # All inputs are bound together, outside of any lambda, where they may hold Python functions.
    total = length.cast("int")
    given = F.struct(total.alias("total"), turn_len.alias("turn"), instr_len.alias("instr"))
    return F.when(turn_len.isNull(), F.array_repeat(F.lit(1), total)).otherwise(let(given, masked))


def loss_mask_qwen(length: Column, turn_len: Column, instr_len: Column) -> Column:
    """ARR-8: qwen and deepseek. All ones where ``turn_len`` is null (no separator found)."""
    return _mask(length, turn_len, instr_len, "qwen")


def loss_mask_llama(length: Column, turn_len: Column, instr_len: Column) -> Column:
    """ARR-9."""
    return _mask(length, turn_len, instr_len, "llama")


def loss_mask_legacy(length: Column, turn_len: Column, instr_len: Column) -> Column:
    """ARR-10: as llama with one instruction token fewer."""
    return _mask(length, turn_len, instr_len, "legacy")


def loss_mask(length: Column, turn_len: Column, instr_len: Column, family: str) -> Column:
    if family not in RULES:
        raise ValueError(f"no mask rule for family {family!r}")
    return _mask(length, turn_len, instr_len, family)


def zero_last_mask(mask: Column) -> Column:
    """ARR-11."""
    return F.when(F.size(mask) > 0, F.concat(F.slice(mask, F.lit(1), F.size(mask) - 1), F.array(F.lit(0)))).otherwise(
        mask
    )


def supervised_tokens(ids: Column, mask: Column) -> Column:
    """ARR-17: ids whose mask is 1."""
    pairs = F.arrays_zip(ids.alias("t"), mask.alias("m"))
    return F.transform(F.filter(pairs, lambda x: x["m"] == 1), lambda x: x["t"])
