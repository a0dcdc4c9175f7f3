"""Reading: files of a folder, pair lists, stored keys, and the answers of a document service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.urls import is_textual
from lexmill.operators.similarity import learn_pairs


def directory(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, name, content) of the files of a folder, not of its sub-folders."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "false")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def text_files(spark: SparkSession, path: str, glob: str | None = None, strict: bool = False) -> DataFrame:
    """(path, name, text) of the files that hold text by their first 1024 bytes; with `strict`, another kind of file fails."""
    files = directory(spark, path, glob).withColumn("text", F.col("content").cast("string"))
    plain = is_textual(F.substring("text", 1, 1024)) | (F.length("content") == 0)
    if strict:
        text = F.when(plain, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("not a text file: "), F.col("path"))).cast("string"))
        return files.select("path", "name", text.alias("text"))
    return files.where(plain).select("path", "name", "text")


def html_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, html) of the files named <doc_id>.html in a folder."""
    files = text_files(spark, path, "*.html")
    return files.where(F.col("name").rlike(r"^\d+\.html$")).select(F.regexp_extract("name", r"^(\d+)", 1).cast("long").alias("doc_id"), F.col("text").alias("html"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line): the lines of a file with growing numbers that keep their order."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))


def pair_file(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """The pairs of a tab-separated file."""
    return learn_pairs(numbered_lines(spark, path), most=most)


def required(url: Column, *names: str) -> Column:
    """The first of the query parameters that a request lacks, null if it has all."""
    from lexmill.functions.urls import query_item

    missing = F.lit(None).cast("string")
    for n in reversed(names):
        missing = F.when(query_item(url, n).isNull(), n).otherwise(missing)
    return missing


def get_status(found: Column, ts: Column, since: Column) -> Column:
    """The answer to a read: 404 without a document, 304 if it is no newer than the time given, else 200."""
    return F.when(~found, 404).when(since.isNotNull() & (F.unix_timestamp(ts) <= F.unix_timestamp(since)), 304).otherwise(200)


def upload_status(url: Column, failed: Column) -> Column:
    """The answer to a write: 400 without a name or collection, 503 if the store fails, else 200."""
    return F.when(required(url, "base_index", "name").isNotNull(), 400).when(failed, 503).otherwise(200)


def push_status(url: Column, failed: Column) -> Column:
    """The answer to a message for the pipeline: 400 without a URL, 505 if the queue fails, else 200."""
    return F.when(required(url, "url").isNotNull(), 400).when(failed, 505).otherwise(200)
