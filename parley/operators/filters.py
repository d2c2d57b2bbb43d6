"""Row filters, quarantines and anti joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from parley.functions import turns as tn
from parley.functions.bitmaps import bitmap_of, in_bitmap


def min_turns(df: DataFrame, n: int = 2, turns: str = "conversations") -> DataFrame:
    """FLT-1."""
    return df.where(F.size(turns) >= n)


def min_messages(df: DataFrame, n: int = 2, messages: str = "messages") -> DataFrame:
    """FLT-2: at least ``n`` messages that have both a role and a content."""
    return df.where(F.size(tn.norm_messages(F.col(messages))) >= n)


def nonempty_pair(df: DataFrame) -> DataFrame:
    """FLT-3."""
    return df.where((F.length("prompt") > 0) & (F.length("response") > 0))


def nonempty_turns(df: DataFrame, turns: str = "conversations") -> DataFrame:
    """FLT-4."""
    return df.where(F.size(turns) > 0)


def role_alternation(df: DataFrame, turns: str = "turns") -> tuple[DataFrame, DataFrame]:
    """FLT-5: (rows whose roles alternate user, assistant, ...; the others)."""
    ok = F.coalesce(tn.alternates(F.col(turns)), F.lit(False))
    return df.where(ok), df.where(~ok)


@dataclass(frozen=True)
class Rule:
    """What stays, and what is counted over all rows, those that go included.

    Counted by ``counts`` in a job of its own, or by ``observed`` along with the action
    that uses the kept rows.
    """

    keep: Column
    counts: tuple[Column, ...]

    def kept(self, df: DataFrame) -> DataFrame:
        return df.where(self.keep)

    def counted(self, df: DataFrame) -> DataFrame:
        """One row."""
        return df.agg(*self.counts)


def observed(df: DataFrame, rule: Rule) -> tuple[DataFrame, Observation]:
    """(rows that stay, their counts), counted while the first action on the rows runs.

    The input is read once. Read the counts after the action; they are those of one
    complete run of it. Put this behind the last shuffle of what is written: tasks of the last
    stage count once each, while an earlier stage that runs again after a lost executor counts again.
    """
    counts = Observation()
    return df.observe(counts, *rule.counts).where(rule.keep), counts


def observed_row(spark: SparkSession, counts: Observation, schema: str) -> DataFrame:
    """The counts as one row, waiting for the action if need be."""
    got = counts.get
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    return spark.createDataFrame([tuple(got[n] for n in names)], schema)


def _at_most(value: Column, cap: int) -> Rule:
    keep = F.coalesce(value <= cap, F.lit(False))
    return Rule(keep, (F.count_if(~keep).alias("dropped"),))


def cap_rule(cap: int, length: str = "seq_len") -> Rule:
    """FLT-6: at most ``cap`` tokens; a null length goes and is counted as ``dropped``."""
    return _at_most(F.col(length), cap)


def train_cap_rule(cap: int, ids: str = "input_ids") -> Rule:
    """FLT-7: at most ``cap`` ids; missing ids go and are counted as ``dropped``."""
    return _at_most(F.when(F.col(ids).isNotNull(), F.size(ids)), cap)


def text_rule(text: str = "text") -> Rule:
    """FLT-8: some text; counts ``valid`` and ``empty``, null among the empty."""
    has = F.coalesce(F.col(text) != "", F.lit(False))
    return Rule(has, (F.count_if(has).alias("valid"), F.count_if(~has).alias("empty")))


def valid_rule() -> Rule:
    """AGG-14: rows that passed ``integrity_check``; counts ``total``, ``valid`` and ``corrupt``."""
    ok = F.col("is_valid")
    return Rule(ok, (F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("corrupt")))


def length_cap(df: DataFrame, cap: int, length: str = "seq_len") -> tuple[DataFrame, DataFrame]:
    """FLT-6: (rows of at most ``cap`` tokens; one row with the number dropped)."""
    rule = cap_rule(cap, length)
    return rule.kept(df), rule.counted(df)


def train_length_cap(df: DataFrame, cap: int, ids: str = "input_ids") -> tuple[DataFrame, DataFrame]:
    """FLT-7: (rows of at most ``cap`` ids; one row with the number dropped)."""
    rule = train_cap_rule(cap, ids)
    return rule.kept(df), rule.counted(df)


def nonempty_text(df: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """FLT-8: (rows with text; one row with the counts of valid and empty rows)."""
    rule = text_rule(text)
    return rule.kept(df), rule.counted(df)


# Rules an example has to keep, in the order in which they are reported.
EXAMPLE_RULES: tuple[tuple[str, Column | str], ...] = (
    ("input_ids missing", "input_ids is not null"),
    ("loss_mask missing", "loss_mask is not null"),
    ("seq_len is not the number of ids", "size(input_ids) = seq_len"),
    ("loss_mask has another length", "size(loss_mask) = size(input_ids)"),
    ("loss_mask holds other values than 0 and 1", "forall(loss_mask, m -> m is not null and m in (0, 1))"),
)


def integrity_check(df: DataFrame, rules=EXAMPLE_RULES, key: str = "index") -> DataFrame:
    """FLT-10: (key, is_valid, error); ``error`` names the first rule a row breaks.

    A rule that comes out null counts as broken. Where the reader found a corrupt
    record (column ``_corrupt_record``), that is the error.
    """
    error = F.lit(None).cast("string")
    for message, rule in reversed(list(rules)):
        holds = F.expr(rule) if isinstance(rule, str) else rule
        error = F.when(~F.coalesce(holds, F.lit(False)), F.lit(message)).otherwise(error)
    if "_corrupt_record" in df.columns:
        error = F.when(F.col("_corrupt_record").isNotNull(), F.lit("corrupt record")).otherwise(error)
    return df.select(F.col(key), error.alias("error")).select(key, F.col("error").isNull().alias("is_valid"), "error")


def validation_summary(checked: DataFrame) -> DataFrame:
    """AGG-14."""
    return valid_rule().counted(checked)


def remove_listed(df: DataFrame, rejects: DataFrame, key: str) -> DataFrame:
    """FLT-11: everything that is not on the reject list."""
    return df.join(rejects.select(key), key, "left_anti")


def skip_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """FLT-12: everything whose output does not exist yet."""
    return df.join(done.select(key), key, "left_anti")


def skip_many_done(df: DataFrame, done: DataFrame, key: str, bits: int = 1 << 24, hashes: int = 4) -> DataFrame:
    """FLT-12 for wide records and many finished ones: only what may be done is joined, and so shuffled.

    The finished keys set ``hashes`` bits each of a Bloom filter of ``bits`` bits (2 MB as
    given), which is built by a shuffle of its words and tested as an expression. A record with
    a bit unset is not done and passes; the others meet the finished keys in an exact anti join.
    Wrong alarms cost a shuffle of the record and nothing else: about 0.2 % of the records
    at 15 bits a key, nearly all beyond one key a bit. A null key is not done. ``df`` is read twice.
    """

    def places(column: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(column, F.lit(k)), F.lit(bits)) for k in range(hashes)]

    keys = done.select(F.col(key).alias("_key")).where(F.col("_key").isNotNull())
    # Keys are told apart by their bits, so they have to be hashed as one type.
    kind = df.schema[key].dataType
    keys = keys.select(F.col("_key").cast(kind).alias("_key"))
    set_bits = keys.select(F.explode(F.array(*places(F.col("_key")))).alias("_bit"))
    bloom = bitmap_of(set_bits, "_bit", bits).scalar()
    maybe = F.col(key).isNotNull()
    for place in places(F.col(key)):
        maybe = maybe & in_bitmap(bloom, place, bits)
    doubt = df.where(maybe)
    return df.where(~maybe).unionByName(doubt.join(keys.withColumnRenamed("_key", key), key, "left_anti").select(*[F.col(f"`{c}`") for c in df.columns]))
