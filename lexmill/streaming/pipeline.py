"""The document pipeline: stages that run alike over a table and over a stream.

A message is a row that gains columns from stage to stage. Stages are narrow, so a stream needs no
state; its checkpoint plays the part of the queue's acknowledgements, and the sink is written so that a
repeated batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.html import text_nodes
from lexmill.functions.text import TOKEN
from lexmill.schemas import MESSAGE

Stage = Callable[[DataFrame], DataFrame]


def html_stage(df: DataFrame) -> DataFrame:
    """text: the text nodes of the body."""
    return df.withColumn("text", text_nodes(F.col("body")))


def _with_counts(df: DataFrame, items: Column, name: str) -> DataFrame:
    """A column of (word, n) for each distinct item, sorted: runs of equal items in a sorted array, inside the row.

    The sorted array and its run starts are columns of their own, so they are made once a row.
    """
    ordered, starts = F.col("_ordered"), F.col("_starts")
    df = df.withColumn("_ordered", F.sort_array(items))
    begins = F.transform(ordered, lambda x, i: F.when((i == 0) | (F.try_element_at(ordered, F.greatest(i, F.lit(1))) != x), i))
    df = df.withColumn("_starts", F.filter(begins, lambda i: i.isNotNull()))
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(F.size(ordered)))
    runs = F.zip_with(starts, ends, lambda a, z: F.struct(F.try_element_at(ordered, a + 1).alias("word"), (z - a).cast("long").alias("n")))
    empty = F.array().cast("array<struct<word:string,n:bigint>>")
    return df.withColumn(name, F.when(F.size(ordered) > 0, runs).otherwise(empty)).drop("_ordered", "_starts")


def feature_stage(df: DataFrame, words: bool = False) -> DataFrame:
    """terms_frequencies: how often each text node occurs, or each word with `words`."""
    items = F.flatten(F.transform("text", lambda t: F.regexp_extract_all(F.lower(t), F.lit(TOKEN), F.lit(0)))) if words else F.col("text")
    return _with_counts(df, items, "terms_frequencies")


def stub_stage(df: DataFrame) -> DataFrame:
    return df.withColumn("stub", F.lit("stub-info"))


STAGES: tuple[Stage, ...] = (html_stage, feature_stage, stub_stage)


def run_batch(df: DataFrame, stages: Sequence[Stage] = STAGES) -> DataFrame:
    for stage in stages:
        df = df.transform(stage)
    return df


def set_first(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A field set once: a value that is there already stays."""
    return df.withColumn(name, F.coalesce(F.col(name), value) if name in df.columns else value)


def value_or(df: DataFrame, name: str, default: Column) -> Column:
    """A field, or the default where the message lacks it."""
    return F.coalesce(F.col(name), default) if name in df.columns else default


def messages(spark: SparkSession, path: str, schema=MESSAGE, max_files: int | None = None) -> DataFrame:
    """The stream of messages that arrive as Parquet files in a folder."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def push(df: DataFrame, path: str) -> None:
    """Add messages to the folder of a stream."""
    df.write.mode("append").parquet(path)


def feed(replies: DataFrame, path: str) -> None:
    """Add the accepted replies of a crawl level to a stream, as a crawler's processor: lambda df: feed(df, path)."""
    push(replies.select("url", "body", F.create_map().cast("map<string,string>").alias("extra")), path)


def run_stream(source: DataFrame, out: str, checkpoint: str, stages: Sequence[Stage] = STAGES, once: bool = True):
    """The pipeline over a stream into Parquet. A batch that repeats after a failure replaces its own folder, so rows come once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = run_batch(source, stages).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def backlog(received: DataFrame, done: DataFrame, key: str = "url") -> DataFrame:
    """Messages that came in and were never finished."""
    return received.join(done.select(key).distinct(), key, "left_anti")


def recover(received: DataFrame, done: DataFrame, stages: Sequence[Stage] = STAGES, parallel: int = 8, key: str = "url") -> DataFrame:
    """The unfinished messages, run again over `parallel` tasks, each with the status s (worked) or f (failed)."""
    if parallel < 1:
        raise ValueError("parallel must be at least 1")
    again = run_batch(backlog(received, done, key).repartition(parallel), stages)
    return again.withColumn("status", F.when(F.col("body").isNotNull(), "s").otherwise("f"))
