"""Bringing chat records in several layouts to one schema, and mixing them.

The canonical record is ``conversations array<struct<from,value>>`` plus ``source``.
Functions that take ``keep`` carry those key columns through unchanged (PRJ-17).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import turns as tn
from parley.schemas import TURNS

# Where the text of a chat turn may be, in order of preference.
CONTENT_FIELDS = ("content", "text", "message", "value")
# Parts of column names that promise text.
TEXT_HINTS = ("text", "content", "message", "conversation", "dialogue")
# Layouts whose assistant texts get the prefix of the llama family: when examples are made, and when tokens are counted.
PREFIX_FORMS = ("conversations",)
COUNTING_PREFIX_FORMS = ("conversations", "messages")
# Columns tried first, per kind of corpus.
KIND_FIELDS = {
    "sharegpt": ("conversations",),
    "ultrachat": ("messages",),
    "openthoughts": ("messages", "conversation", "text", "conversations"),
}


def nest_turns(df: DataFrame, key: str = "conv_id", role: str = "from", text: str = "value") -> DataFrame:
    """Long rows (key, turn, role, text) to one record per conversation.

    A conversation is one record of a chat corpus, so its turns fit in a row.
    """
    long = df.groupBy(key).agg(F.collect_list(F.struct("turn", "role", "text")).alias("_t"))
    turns = F.transform(
        F.array_sort("_t"), lambda t: F.struct(t["role"].alias(role), t["text"].alias(text))
    )
    name = "messages" if text == "content" else "conversations"
    return long.select(key, turns.alias(name))


def tag_source(df: DataFrame, source: str) -> DataFrame:
    """PRJ-4."""
    return df.withColumn("source", F.lit(source))


def _normalised(df: DataFrame, turns: Column, source: str, keep) -> DataFrame:
    return tag_source(df.select(*keep, turns.cast(TURNS).alias("conversations")), source)


def norm_sharegpt(df: DataFrame, source: str, keep=()) -> DataFrame:
    """PRJ-1: human becomes user, every other role assistant."""
    return _normalised(df, tn.role_map(F.col("conversations"), "coerce", "human"), source, keep)


def norm_ultrachat(df: DataFrame, source: str, keep=()) -> DataFrame:
    """PRJ-2: user stays, every other role becomes assistant."""
    as_turns = F.transform("messages", lambda m: tn.turn(m["role"], m["content"]))
    return _normalised(df, tn.role_map(as_turns, "coerce", "user"), source, keep)


def norm_passthrough(df: DataFrame, source: str, keep=()) -> DataFrame:
    """PRJ-3: roles and texts as they are, other turn fields and columns dropped."""
    return _normalised(df, tn.role_map(F.col("conversations"), "keep"), source, keep)


def norm_pair(df: DataFrame, keep=()) -> DataFrame:
    """PRJ-10."""
    return df.select(*keep, tn.pair_turns(F.col("prompt"), F.col("response")).alias("turns"))


def text_item(df: DataFrame, text: str = "text", keep=()) -> DataFrame:
    """PRJ-15: plain text needs no turns."""
    return df.select(*keep, F.col(text).alias("text"))


def drop_input_columns(df: DataFrame, outputs) -> DataFrame:
    """PRJ-16: only the outputs go on."""
    return df.select(*outputs)


def carry_index(df: DataFrame, key, name: str = "index") -> DataFrame:
    """PRJ-17: name a real key ``index``, so that dropped rows do not move the others."""
    return df.withColumn(name, F.col(key) if isinstance(key, str) else key)


def _is_text_list(df: DataFrame, column: str) -> bool:
    kind = df.schema[column].dataType
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType)


def _conversation_turns(df: DataFrame, mode: str) -> Column:
    if _is_text_list(df, "conversations"):
        turns = tn.roles_by_parity(F.col("conversations"))
    else:
        turns = tn.role_map(F.col("conversations"), mode)
    return F.when(F.size("conversations") >= 2, turns.cast(TURNS))


def _message_turns() -> Column:
    turns = tn.norm_messages(F.col("messages"))
    return F.when(F.size(turns) > 1, turns.cast(TURNS))


def _pair_turns() -> Column:
    both = (F.length("prompt") > 0) & (F.length("response") > 0)
    return F.when(both, tn.pair_turns(F.col("prompt"), F.col("response")).cast(TURNS))


def dispatch_by_column(
    df: DataFrame, family: str, keep=(), mode: str = "keep", prefix_forms=PREFIX_FORMS
) -> DataFrame:
    """PRJ-5: choose the layout once, by the columns of the table.

    Gives ``keep`` and ``turns``; records with too little in them are dropped.
    ``prefix_forms`` names the layouts whose assistant texts get the prefix of the family.
    """
    have = set(df.columns)
    if "conversations" in have:
        form, turns = "conversations", _conversation_turns(df, mode)
    elif "messages" in have:
        form, turns = "messages", _message_turns()
    elif {"prompt", "response"} <= have:
        form, turns = "pair", _pair_turns()
    else:
        raise ValueError(f"no chat layout among the columns {sorted(have)}")
    if form in prefix_forms:
        turns = tn.assistant_prefix(turns, family)
    return df.select(*keep, turns.alias("turns")).where(F.col("turns").isNotNull())


def dispatch_by_record(
    df: DataFrame,
    family: str,
    with_text: bool = False,
    keep=(),
    mode: str | None = None,
    prefix_forms=None,
) -> DataFrame:
    """PRJ-6: choose the layout per record, by the first column that is not null.

    Gives ``keep``, ``form`` (the layout found), ``turns`` and ``text``. A record
    that has a layout but too little in it has neither turns nor text.
    ``with_text`` is the counting variant: it also takes plain text, keeps known
    roles only, and writes any other record as JSON. ``prefix_forms`` as above; by
    default those of the variant.
    """
    if prefix_forms is None:
        prefix_forms = COUNTING_PREFIX_FORMS if with_text else PREFIX_FORMS
    have = set(df.columns)
    mode = mode or ("drop" if with_text else "keep")
    nothing = F.lit(None).cast(TURNS)
    forms: list[tuple[str, Column, Column]] = []
    if "conversations" in have:
        turns = _conversation_turns(df, mode)
        if with_text:
            turns = F.when(F.size(turns) > 0, turns)
        forms.append(("conversations", F.col("conversations").isNotNull(), turns))
    if "messages" in have:
        forms.append(("messages", F.col("messages").isNotNull(), _message_turns()))
    if with_text and "text" in have:
        forms.append(("text", F.col("text").isNotNull(), nothing))
    if {"prompt", "response"} <= have:
        both = F.col("prompt").isNotNull() & F.col("response").isNotNull()
        pair = tn.pair_turns(F.col("prompt"), F.col("response")).cast(TURNS) if with_text else _pair_turns()
        forms.append(("pair", both, pair))

    form, turns = F.lit("other" if with_text else None).cast("string"), nothing
    for name, found, value in reversed(forms):
        if name in prefix_forms:
            value = tn.assistant_prefix(value, family)
        form = F.when(found, F.lit(name)).otherwise(form)
        turns = F.when(found, value).otherwise(turns)
    if with_text:
        record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in keep]))
        text = F.when(F.col("form") == "text", F.col("text") if "text" in have else F.lit(None))
        text = text.when(F.col("form") == "other", record)
    else:
        text = F.lit(None).cast("string")
    return df.withColumns({"form": form, "turns": turns}).select(*keep, "form", "turns", text.alias("text"))


def usable_records(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of ``dispatch_by_record`` that have something in them, and a one-row count of the others."""
    usable = F.col("turns").isNotNull() | F.col("text").isNotNull()
    return df.where(usable), df.agg(F.count_if(~usable).alias("dropped"))


def _list_texts(df: DataFrame, column: str, every_field: bool = False) -> Column | None:
    """Texts of a list column: its strings, or the content fields of its records."""
    element = df.schema[column].dataType.elementType
    if isinstance(element, T.StringType):
        return F.filter(F.col(column), lambda x: x != "")
    if not isinstance(element, T.StructType):
        return None
    fields = [f for f in CONTENT_FIELDS if f in element.fieldNames()]
    if not fields:
        return None
    if every_field:
        texts = F.flatten(F.transform(column, lambda t: F.array(*[t[f].cast("string") for f in fields])))
    else:
        texts = F.transform(
            column, lambda t: F.coalesce(*[F.when(t[f].cast("string") != "", t[f].cast("string")) for f in fields])
        )
    return F.filter(texts, lambda x: x != "")


def _nonempty(text: Column) -> Column:
    return F.when(text != "", text)


def extract_text(df: DataFrame, kind: str) -> Column:
    """PRJ-14: the text of a record, ``""`` when it has none.

    Looks at the columns of its kind first, then at any column whose name
    promises text, in column order.
    """
    found: list[Column] = []
    types = {f.name: f.dataType for f in df.schema.fields}

    def add_list(column, every_field=False):
        texts = _list_texts(df, column, every_field)
        if texts is not None:
            found.append(_nonempty(F.array_join(texts, " ")))

    ended = F.lit(False)  # by a list of strings, which sends the search to the names below
    for column in KIND_FIELDS[kind]:
        dtype = types.get(column)
        if isinstance(dtype, T.StringType):
            found.append(F.when(~ended, _nonempty(F.col(column))))
        elif isinstance(dtype, T.ArrayType):
            if kind != "openthoughts":
                field = {"sharegpt": "value", "ultrachat": "content"}[kind]
                if isinstance(dtype.elementType, T.StructType) and field in dtype.elementType.fieldNames():
                    texts = F.filter(F.transform(column, lambda t: t[field].cast("string")), lambda x: x != "")
                    found.append(_nonempty(F.array_join(texts, " ")))
            elif column == "messages" and isinstance(dtype.elementType, T.StringType):
                found.append(F.when(F.size(column) > 0, F.array_join(column, " ")))
            elif column == "messages":
                add_list(column)
            elif isinstance(dtype.elementType, T.StringType):
                found.append(F.when(~ended, _nonempty(F.array_join(_list_texts(df, column), " "))))
                ended = ended | F.coalesce(F.size(column) > 0, F.lit(False))
    if kind != "openthoughts" and isinstance(types.get("text"), T.StringType):
        main = KIND_FIELDS[kind][0]
        empty = (F.coalesce(F.size(main), F.lit(0)) <= 0) if isinstance(types.get(main), T.ArrayType) else F.lit(True)
        found.append(F.when(empty, _nonempty(F.col("text"))))
    for column, dtype in types.items():
        if any(hint in column.lower() for hint in TEXT_HINTS):
            if isinstance(dtype, T.StringType):
                found.append(_nonempty(F.col(column)))
            elif _is_text_list(df, column):
                # A list of strings ends the search, even when all of them are empty.
                texts = F.array_join(F.filter(F.col(column), lambda x: x != ""), " ")
                found.append(F.when(F.size(column) > 0, texts))
            elif isinstance(dtype, T.ArrayType):
                add_list(column, every_field=True)
    return F.coalesce(*found, F.lit(""))


def mix_corpora(dfs) -> DataFrame:
    """SET-1: bag union of normalised corpora."""
    return reduce(DataFrame.unionByName, list(dfs))


def distinct_sources(df: DataFrame) -> DataFrame:
    """SET-2."""
    return df.select("source").distinct()
