"""SET-3: several chat corpora to one shuffled corpus."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from parley.operators import normalise as nm
from parley.operators import order

LAYOUTS = {
    "sharegpt": nm.norm_sharegpt,
    "ultrachat": nm.norm_ultrachat,
    "openthoughts": nm.norm_passthrough,
}


@dataclass(frozen=True)
class Corpus:
    """One input: its tag, its records, their layout, a unique key and an optional cap on rows."""

    source: str
    df: DataFrame
    layout: str
    key: str
    cap: int | None = None


def sampled(corpus: Corpus, seed: int = 42) -> DataFrame:
    """The records of a corpus that go into the mix."""
    if corpus.cap is None:
        return corpus.df
    return order.cap_sample(corpus.df, corpus.cap, corpus.key, seed)


def normalised(corpus: Corpus, seed: int = 42) -> DataFrame:
    """The same in the canonical form, key first."""
    records = sampled(corpus, seed).withColumnRenamed(corpus.key, "key")
    return LAYOUTS[corpus.layout](records, corpus.source, keep=("key",))


def mixed_corpus(corpora, seed: int = 42, shuffle: bool = True) -> DataFrame:
    """Cap, normalise, unite and shuffle; rows are (key, conversations, source)."""
    mixed = nm.mix_corpora(normalised(c, seed) for c in corpora)
    return order.seeded_shuffle(mixed, ("source", "key"), seed) if shuffle else mixed
