"""Term and document frequencies, and the top words of documents by their ratio."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import TOKEN, exploded, tokens
from lexmill.operators.groups import join_largest


def term_freq(docs: DataFrame, key: str, text: str, pattern: str = TOKEN) -> DataFrame:
    """(key, token, cnt): texts are dealt out by the key and words counted where their document is, so texts shuffle and words don't."""
    return exploded(docs.select(key, text).repartition(F.col(key)), [key], tokens(F.col(text), pattern), "token").groupBy(key, "token").agg(F.count(F.lit(1)).alias("cnt"))


def doc_word_stats(tf: DataFrame, key: str) -> DataFrame:
    """(key, total_words, distinct_words)."""
    return tf.groupBy(key).agg(F.sum("cnt").alias("total_words"), F.count(F.lit(1)).alias("distinct_words"))


def count_of(tf: DataFrame, docs: DataFrame, key: str, word: str) -> DataFrame:
    """(key, cnt): how often a document has a word, 0 if it hasn't."""
    return docs.select(key).join(tf.where(F.col("token") == word).select(key, "cnt"), key, "left").select(key, F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


def frequencies(tf: DataFrame, key: str) -> DataFrame:
    """(key, token, freq, smoothed): the share of a word, and Laplace's.

    The totals join back on the key that tf is already dealt out by, and without sorting it.
    """
    both = tf.join(doc_word_stats(tf, key).hint("shuffle_hash"), key)
    return both.select(key, "token", (F.col("cnt") / F.col("total_words")).alias("freq"), ((F.col("cnt") + 1) / (F.col("total_words") + F.col("distinct_words"))).alias("smoothed"))


def doc_freq(tf: DataFrame) -> DataFrame:
    """(token, n_docs); tf has a row per document and token."""
    return tf.groupBy("token").agg(F.count(F.lit(1)).alias("n_docs"))


def merge_doc_freq(*parts: DataFrame) -> DataFrame:
    """(token, n_docs) of the documents of all parts together."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("token").agg(F.sum("n_docs").alias("n_docs"))


def top_words(tf: DataFrame, df: DataFrame, key: str, num: int) -> DataFrame:
    """(key, token, score, rank): a document's words with the largest tf / df; equal scores go by word.

    A document's words are bounded by its text, so the window by document is no hot spot; words that
    very many documents have join by a bounded broadcast.
    """
    scored = join_largest(tf, df, "token", "n_docs").select(key, "token", (F.col("cnt") / F.col("n_docs")).alias("score"))
    order = Window.partitionBy(key).orderBy(F.desc("score"), "token")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= num)
