"""Schemas of the stored tables; every stored row names the version of its format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT_VERSION, POSTING_VERSION, PAIR_DOC_VERSION = 1, 2, 1

DOCUMENT = T.StructType([
    T.StructField("version", T.IntegerType()), T.StructField("ns", T.StringType()), T.StructField("key", T.StringType()),
    T.StructField("ts", T.TimestampType()), T.StructField("data", T.StringType()),
])
POSTING = T.StructType([
    T.StructField("version", T.IntegerType()), T.StructField("key", T.StringType()), T.StructField("token", T.StringType()),
    T.StructField("positions", T.ArrayType(T.IntegerType())), T.StructField("ts", T.TimestampType()),
])
MEMBERSHIP = T.StructType([T.StructField("collection", T.StringType()), T.StructField("key", T.StringType()), T.StructField("ts", T.TimestampType())])
REPLY = T.StructType([
    T.StructField("request_url", T.StringType()), T.StructField("url", T.StringType()), T.StructField("code", T.IntegerType()),
    T.StructField("content_type", T.StringType()), T.StructField("body", T.StringType()), T.StructField("error", T.StringType()),
])
MESSAGE = T.StructType([T.StructField("url", T.StringType()), T.StructField("body", T.StringType()), T.StructField("extra", T.MapType(T.StringType(), T.StringType()))])


def documents(df: DataFrame, key: Column, data: Column, ts: Column | None = None, ns: str = "") -> DataFrame:
    """Rows of the document table; without a time they are stamped now."""
    return df.select(F.lit(DOCUMENT_VERSION).alias("version"), F.lit(ns).alias("ns"), key.alias("key"), (F.current_timestamp() if ts is None else ts).alias("ts"), data.alias("data"))


def checked(df: DataFrame, version: int) -> DataFrame:
    """The rows; reading one of another version fails."""
    wrong = F.raise_error(F.concat(F.lit(f"format version {version} expected, found "), F.col("version").cast("string")))
    return df.withColumn("version", F.when(F.col("version") == version, F.col("version")).otherwise(wrong.cast("int")))


def document_id(key: Column, bits: int = 512) -> Column:
    """The id under which a key is stored, in hexadecimal digits."""
    return F.sha2(key, bits)
