"""Schemas of the records this library reads and writes."""

from pyspark.sql import types as T

TURN = T.StructType([T.StructField("from", T.StringType()), T.StructField("value", T.StringType())])
MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
TURNS = T.ArrayType(TURN)

SHAREGPT = T.StructType([T.StructField("id", T.StringType()), T.StructField("conversations", TURNS)])
ULTRACHAT = T.StructType([T.StructField("messages", T.ArrayType(MESSAGE))])
OPENTHOUGHTS = T.StructType([T.StructField("conversations", TURNS)])
MIXED = T.StructType([T.StructField("conversations", TURNS), T.StructField("source", T.StringType())])
PAIRS = T.StructType([T.StructField("prompt", T.StringType()), T.StructField("response", T.StringType())])
PLAIN_TURNS = T.StructType([T.StructField("conversations", T.ArrayType(T.StringType()))])
TEXTS = T.StructType([T.StructField("text", T.StringType())])
PRETOKENISED = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("input_ids", T.ArrayType(T.IntegerType())),
        T.StructField("attention_mask", T.ArrayType(T.IntegerType())),
    ]
)
EXAMPLES = T.StructType(
    [
        T.StructField("index", T.LongType()),
        T.StructField("input_ids", T.ArrayType(T.IntegerType())),
        T.StructField("loss_mask", T.ArrayType(T.IntegerType())),
        T.StructField("seq_len", T.IntegerType()),
    ]
)
D2T = T.StructType(
    [
        T.StructField("draft_id", T.IntegerType()),
        T.StructField("token_id", T.IntegerType()),
        T.StructField("offset", T.IntegerType()),
    ]
)
T2D = T.StructType([T.StructField("token_id", T.IntegerType()), T.StructField("in_draft", T.BooleanType())])
