"""Texts or examples to a draft vocabulary with its two-way id map."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions import tokens as tk
from parley.functions import turns as tn
from parley.operators import filters as fl
from parley.operators import normalise as nm
from parley.operators import vocab as vo
from parley.plans.training import chat_examples, encode_words
from parley.session import materialise


@dataclass(frozen=True)
class DraftVocabulary:
    freq: DataFrame
    draft: DataFrame
    d2t: DataFrame
    t2d: DataFrame
    coverage: DataFrame


def text_token_freq(df: DataFrame, text: str = "text", vocab_size: int = 4096) -> DataFrame:
    """Token frequencies of plain texts under the built-in word tokeniser.

    Words are hashed one by one after the explode, which generated code does
    faster than an array function.
    """
    words = df.select(F.explode(tk.words(F.col(text))).alias("w"))
    ids = words.select(tk.token_id(F.col("w"), vocab_size).alias("token_id"))
    return ids.groupBy("token_id").agg(F.count(F.lit(1)).alias("freq"))


@dataclass(frozen=True)
class ChatCounts:
    """Token frequencies of a chat corpus, and what happened to its records."""

    freq: DataFrame
    report: DataFrame  # one row: records, empty, fallback, failed


def encode_text(text):
    """The built-in tokeniser in the shape of ``batches.pluggable_tokeniser``; it never fails."""
    return F.struct(tk.tokenise(text).alias("ids"), F.lit(None).cast("string").alias("error"))


def chat_token_freq(records: DataFrame, family: str, encode=encode_text) -> ChatCounts:
    """Records in any layout to token frequencies: choose the layout, render, encode, count.

    Without a template for a role the texts are joined; plain text and unknown layouts
    are counted as text. ``report`` counts records with too little in them, joined
    texts and texts that could not be encoded. The ids are written once.
    """
    found = nm.dispatch_by_record(records, family, with_text=True)
    rendered = found.select("turns", "text", tk.render_chat(F.col("turns"), family).alias("_form"))
    joined = F.when(F.col("turns").isNotNull(), tn.concat_fallback(F.col("_form"), F.col("turns")))
    texts = rendered.select(
        F.coalesce(joined, F.col("text")).alias("text"),
        (F.col("turns").isNotNull() & F.col("_form").isNull()).alias("fallback"),
    )
    done = texts.select("fallback", F.col("text").isNull().alias("empty"), encode(F.col("text")).alias("e"))
    done = materialise(done.select("fallback", "empty", "e.ids", "e.error"), "chat-ids")
    report = done.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if("empty").alias("empty"),
        F.count_if("fallback").alias("fallback"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
    )
    return ChatCounts(vo.token_freq_all(done, "ids"), report)


def supervised_token_freq(
    records: DataFrame, key: str, family: str, max_len: int, system: str = tn.DEFAULT_SYSTEM, encode=encode_words
) -> ChatCounts:
    """Frequencies of the tokens that count in training, by the legacy mask.

    ``records`` are (key, conversations). Known roles are mapped, a first turn that is
    not the user's goes, the system text comes in front, and conversations that do
    not alternate are left out (``empty`` in the report).
    """
    turns = tn.drop_leading_nonuser(tn.role_map(F.col("conversations"), "drop"))
    mapped = records.select(F.col(key), turns.alias("turns"))
    good, _ = fl.role_alternation(mapped.where(F.size("turns") > 0))
    framed = good.withColumn("turns", tn.prepend_system(F.col("turns"), system))
    made = chat_examples(framed, key, family, max_len=max_len, encode=encode, legacy=True)
    made = materialise(made.select("input_ids", "loss_mask", "fallback", "error"), "supervised-ids")
    kept = made.agg(
        F.count(F.lit(1)).alias("kept"),
        F.count_if("fallback").alias("fallback"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
    )
    records_ = records.agg(F.count(F.lit(1)).alias("n")).scalar()
    report = kept.select(records_.alias("records"), (records_ - F.col("kept")).alias("empty"), "fallback", "failed")
    return ChatCounts(vo.token_freq_supervised(made.where("error IS NULL")), report)


def draft_vocabulary(freq: DataFrame, r, vocab_size: int, eos: int | None = None) -> DraftVocabulary:
    """From token frequencies to the maps and their coverage, for one or several sizes.

    The frequencies (one row per distinct token) are written once, so the corpus is
    read once however many of the tables are used.
    """
    freq = materialise(freq, "freq")
    draft = vo.draft_vocab(freq, r, eos)
    return DraftVocabulary(
        freq=freq,
        draft=draft,
        d2t=vo.d2t_offsets(draft),
        t2d=vo.t2d_mask(freq.sparkSession, draft, vocab_size),
        coverage=vo.draft_coverage(freq, r, eos),
    )
