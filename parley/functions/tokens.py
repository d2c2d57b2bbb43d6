"""Words, token ids, model families, rendering and splitting of chat text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.arrays import let

# The characters Python's str.split() treats as blanks.
BLANKS = r"\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = f"[^{BLANKS}]+"

# Separators between the turns of a rendered conversation.
SEPARATORS = {
    "deepseek": {"user": "<｜User｜>", "assistant": "<｜Assistant｜>\n\n"},
    "qwen": {
        "user": "<|im_end|>\n<|im_start|>user\n",
        "assistant": "<|im_end|>\n<|im_start|>assistant\n",
    },
    "llama": {
        "user": "<|eot_id|><|start_header_id|>user<|end_header_id|>",
        "assistant": "<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n",
    },
    "generic": {
        "user": "<|im_end|>\n<|im_start|>user\n",
        "assistant": "<|im_end|>\n<|im_start|>assistant\n",
    },
}

# What stands before the first turn, and around each turn by role,
# chosen so that neighbouring turns meet in exactly the separators above.
TEMPLATES = {
    "deepseek": {
        "start": "<｜begin▁of▁sentence｜>",
        "open": {"system": "", "user": "<｜User｜>", "assistant": "<｜Assistant｜>\n\n"},
        "close": {"system": "", "user": "", "assistant": "<｜end▁of▁sentence｜>"},
    },
    "qwen": {
        "start": "",
        "open": {r: f"<|im_start|>{r}\n" for r in ("system", "user", "assistant")},
        "close": {r: "<|im_end|>\n" for r in ("system", "user", "assistant")},
    },
    "llama": {
        "start": "<|begin_of_text|>",
        "open": {r: f"<|start_header_id|>{r}<|end_header_id|>\n\n" for r in ("system", "user", "assistant")},
        "close": {r: "<|eot_id|>" for r in ("system", "user", "assistant")},
    },
}
TEMPLATES["generic"] = TEMPLATES["qwen"]

FAMILIES = ("deepseek", "qwen", "llama", "generic")


def words(text: Column) -> Column:
    """Whitespace words, as ``str.split()`` gives them."""
    return F.array_remove(F.split(text, f"[{BLANKS}]+"), "")


def token_id(word: Column, vocab_size: int = 4096) -> Column:
    """Id of one word: leading 24 bits of its md5, modulo the vocabulary size."""
    return (F.conv(F.substring(F.md5(word), 1, 6), 16, 10).cast("int") % vocab_size).cast("int")


def tokenise(text: Column, vocab_size: int = 4096) -> Column:
    """ARR-4: text to ids without special tokens (the built-in word tokeniser)."""
    return F.transform(words(text), lambda w: token_id(w, vocab_size))


def truncate_ids(ids: Column, n: int | Column) -> Column:
    """ARR-5: the first ``n`` ids."""
    return F.slice(ids, F.lit(1), n if isinstance(n, Column) else F.lit(n))


def family_of(path: Column) -> Column:
    """ARR-1: model family from a path; the first matching name wins."""
    low = F.lower(path)
    found = F.when(low.contains("deepseek"), "deepseek")
    found = found.when(low.contains("qwen"), "qwen").when(low.contains("llama"), "llama")
    return found.otherwise("generic")


def family_separators(spark: SparkSession) -> DataFrame:
    """ARR-2: one row per family."""
    rows = [(f, SEPARATORS[f]["user"], SEPARATORS[f]["assistant"]) for f in FAMILIES]
    return spark.createDataFrame(rows, "family string, sep_user string, sep_assistant string")


def per_family(family: str | Column, build) -> Column:
    """``build(name)`` for the family, chosen per row when ``family`` is a column."""
    if isinstance(family, str):
        return build(family)
    chosen = F.when(family == FAMILIES[0], build(FAMILIES[0]))
    for name in FAMILIES[1:]:
        chosen = chosen.when(family == name, build(name))
    return chosen


def render_chat(turns: Column, family: str | Column) -> Column:
    """ARR-3: turns to one string.

    A role without a template leaves the row null, so that ``concat_fallback``
    can take over.
    """

    def build(name: str) -> Column:
        form = TEMPLATES[name]

        def around(t):
            role, text = t["from"], F.coalesce(t["value"], F.lit(""))
            piece = None
            for r in ("system", "user", "assistant"):
                whole = F.concat(F.lit(form["open"][r]), text, F.lit(form["close"][r]))
                piece = F.when(role == r, whole) if piece is None else piece.when(role == r, whole)
            return piece

        def whole(pieces):
            text = F.concat(F.lit(form["start"]), F.array_join(pieces, ""))
            return F.when(F.forall(pieces, lambda p: p.isNotNull()), text)

        return let(F.transform(turns, around), whole)

    return per_family(family, build)


def _split(text: Column, sep: str) -> Column:
    return F.split(text, re.escape(sep), -1)


def split_turns(text: Column, sep_user: str) -> Column:
    """ARR-6: parts between user separators, the first two glued back together.

    Null when the separator does not occur.
    """

    def glued(parts):
        first = F.concat(F.get(parts, F.lit(0)), F.lit(sep_user), F.get(parts, F.lit(1)))
        rest = F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0)))
        return F.when(F.size(parts) > 1, F.concat(F.array(first), rest))

    return let(_split(text, sep_user), glued)


def valid_turn_prefix(turns: Column, sep_assistant: str) -> Column:
    """ARR-7: turns before the first that is empty or not exactly one question and one answer."""

    def prefix(whole):
        bad = F.transform(whole, lambda t: (t == "") | (F.size(_split(t, sep_assistant)) != 2))
        return let(F.array_position(bad, F.lit(True)).cast("int"), lambda first_bad: upto(whole, first_bad))

    def upto(whole, first_bad):
        keep = F.when(first_bad == 0, F.size(whole)).otherwise(first_bad - 1)
        return F.slice(whole, F.lit(1), keep)

    return let(turns, prefix)


def instruction_part(turn: Column, sep_assistant: str) -> Column:
    """The part of a turn up to and including the assistant separator."""
    return F.concat(F.get(_split(turn, sep_assistant), F.lit(0)), F.lit(sep_assistant))
