"""Schemas of the input and output tables."""

from pyspark.sql import types as T

FILES = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("content", T.StringType()),
])

BLOBS = T.StructType([
    T.StructField("blob_id", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("content", T.StringType()),
])

TREE_ENTRIES = T.StructType([
    T.StructField("commit", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("blob_id", T.StringType()),
])

COMMITS = T.StructType([
    T.StructField("commit", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("log_pos", T.LongType()),
])

RULES = T.StructType([
    T.StructField("rule_id", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("pattern", T.StringType()),
])

# Columns that do not apply to a finding are null.
FINDING = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("line", T.LongType()),
    T.StructField("type", T.StringType()),
    T.StructField("match", T.StringType()),
    T.StructField("commit", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("introduced_commit", T.StringType()),
    T.StructField("removed_commit", T.StringType()),
    T.StructField("exposure_commits", T.LongType()),
    T.StructField("exposure_window", T.StringType()),
    T.StructField("still_present_in_head", T.BooleanType()),
])

FINDING_KEY = ["file", "line", "type", "match"]
