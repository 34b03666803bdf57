"""Explicit schemas; nothing in the engine infers one."""

from pyspark.sql import types as T

MUTATION = T.StructType([
    T.StructField("epoch", T.LongType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("key", T.StringType(), False),
    T.StructField("op", T.StringType(), False),
    T.StructField("value", T.StringType()),
])
LOG_FRAME = T.StructType([
    T.StructField("file", T.StringType(), False),
    T.StructField("file_seq", T.LongType()),
    T.StructField("ordinal", T.LongType(), False),
    T.StructField("op", T.StringType(), False),
    T.StructField("key", T.StringType(), False),
    T.StructField("value", T.BinaryType()),
])
SORTED_ENTRY = T.StructType([
    T.StructField("file", T.StringType(), False),
    T.StructField("block", T.IntegerType(), False),
    T.StructField("key", T.StringType(), False),
    T.StructField("value", T.BinaryType()),
    T.StructField("tombstone", T.BooleanType(), False),
    T.StructField("seq", T.LongType(), False),
])
MANIFEST_EVENT = T.StructType([
    T.StructField("type", T.StringType(), False),
    T.StructField("path", T.StringType(), False),
    T.StructField("sst_seq", T.LongType()),
])
VOTE_REQUEST = T.StructType([
    T.StructField("voter", T.StringType(), False),
    T.StructField("ord", T.LongType(), False),
    T.StructField("term", T.LongType(), False),
    T.StructField("candidate", T.StringType(), False),
    T.StructField("last_log_index", T.LongType(), False),
    T.StructField("last_log_term", T.LongType(), False),
])
HARD_STATE = T.StructType([
    T.StructField("current_term", T.LongType(), False),
    T.StructField("voted_for", T.StringType(), False),
    T.StructField("snap_last_index", T.LongType(), False),
    T.StructField("snap_last_term", T.LongType(), False),
])
