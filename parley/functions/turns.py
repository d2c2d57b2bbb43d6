"""Expressions over the turns of one conversation (``array<struct<from,value>>``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.schemas import TURNS

# Role names a chat corpus may use, and what each one means.
ROLES = {"human": "user", "gpt": "assistant", "user": "user", "assistant": "assistant"}

# Fixed value: the system turn put in front of every conversation.
DEFAULT_SYSTEM = (
    "You are a helpful, respectful and honest assistant. Always answer as helpfully as possible, while being safe.  "
    "Your answers should not include any harmful, unethical, racist, sexist, toxic, dangerous, or illegal content. "
    "Please ensure that your responses are socially unbiased and positive in nature.\n\n"
    "If a question does not make any sense, or is not factually coherent, explain why instead of answering something "
    "not correct. If you don't know the answer to a question, please don't share false information."
)


def turn(role, text) -> Column:
    return F.struct(role.alias("from"), text.alias("value"))


def _mapped(role: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.try_element_at(mapping, role)


def _known(role: Column) -> Column:
    return F.coalesce(role.isin(*ROLES), F.lit(False))


def role_map(turns: Column, mode: str = "coerce", user: str = "human") -> Column:
    """PRJ-7 and the role rule of PRJ-1/2/3.

    ``coerce``  the role ``user`` becomes user, every other role assistant
    ``drop``    roles outside the known four are dropped, the rest mapped
    ``keep``    roles stay as they are
    ``reject``  a conversation with an unknown role becomes null
    """
    if mode == "coerce":
        return F.transform(
            turns,
            lambda t: turn(F.when(t["from"] == user, "user").otherwise("assistant"), t["value"]),
        )
    if mode == "keep":
        return F.transform(turns, lambda t: turn(t["from"], t["value"]))
    mapped = F.transform(F.filter(turns, lambda t: _known(t["from"])), lambda t: turn(_mapped(t["from"]), t["value"]))
    if mode == "drop":
        return mapped
    if mode == "reject":
        return F.when(F.forall(turns, lambda t: _known(t["from"])), mapped)
    raise ValueError(f"unknown role mode {mode!r}")


def roles_by_parity(texts: Column) -> Column:
    """PRJ-8: untyped turns, even positions are the user's."""
    return F.transform(
        texts,
        lambda x, i: turn(F.when(i % 2 == 0, "user").otherwise("assistant"), F.coalesce(x, F.lit(""))),
    )


def norm_messages(messages: Column) -> Column:
    """PRJ-9: keep messages that have both a role and a content."""
    kept = F.filter(messages, lambda m: m["role"].isNotNull() & m["content"].isNotNull())
    return F.transform(kept, lambda m: turn(m["role"], m["content"]))


def pair_turns(prompt: Column, response: Column) -> Column:
    """PRJ-10: one user turn, one assistant turn."""
    return F.array(turn(F.lit("user"), prompt), turn(F.lit("assistant"), response))


def assistant_prefix(turns: Column, family: str | Column) -> Column:
    """PRJ-11: the llama family wants one space before assistant text."""
    prefixed = F.transform(
        turns,
        lambda t: turn(
            t["from"],
            F.when(t["from"] == "assistant", F.concat(F.lit(" "), t["value"])).otherwise(t["value"]),
        ),
    )
    if isinstance(family, str):
        return prefixed if family == "llama" else turns
    return F.when(family == "llama", prefixed).otherwise(turns)


def prepend_system(turns: Column, text: str = DEFAULT_SYSTEM) -> Column:
    """PRJ-12."""
    return F.concat(F.array(turn(F.lit("system"), F.lit(text))).cast(TURNS), turns)


def drop_leading_nonuser(turns: Column) -> Column:
    """PRJ-13: drop the first turn when it is not the user's (that one only)."""
    first = F.get(turns, F.lit(0))["from"]
    return F.when(first != "user", F.slice(turns, F.lit(2), F.greatest(F.size(turns) - 1, F.lit(0)))).otherwise(turns)


def alternates(turns: Column) -> Column:
    """True when roles run user, assistant, user, ... by position."""
    expected = F.transform(
        turns,
        lambda t, i: F.coalesce(t["from"] == F.when(i % 2 == 0, "user").otherwise("assistant"), F.lit(False)),
    )
    return F.forall(expected, lambda ok: ok)


def join_texts(turns: Column) -> Column:
    """Non-empty turn texts joined with one space."""
    texts = F.filter(F.transform(turns, lambda t: t["value"]), lambda x: x != "")
    return F.array_join(texts, " ")


def concat_fallback(rendered: Column, turns: Column) -> Column:
    """PRJ-18: contents joined with one space where rendering gave nothing."""
    return F.coalesce(rendered, F.array_join(F.transform(turns, lambda t: F.coalesce(t["value"], F.lit(""))), " "))
