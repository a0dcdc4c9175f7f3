"""Confusion counts and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, actual: Column, predicted: Column) -> DataFrame:
    """One row: tp, fp, tn, fn; rows in which either side is null don't count."""
    return df.agg(
        F.count_if(actual & predicted).alias("tp"), F.count_if(~actual & predicted).alias("fp"),
        F.count_if(~actual & ~predicted).alias("tn"), F.count_if(actual & ~predicted).alias("fn"),
    )


def precision_recall(counts: DataFrame) -> DataFrame:
    """precision, recall and f1 of confusion counts; null where nothing is to divide by."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"))


def success_percent(counts: DataFrame) -> DataFrame:
    """The share of right answers in whole percent."""
    right = F.col("tp") + F.col("tn")
    return counts.select(F.floor(F.try_divide(right * 100, right + F.col("fp") + F.col("fn"))).cast("long").alias("percent"))


def class_counts(df: DataFrame, label: Column, valid: Column) -> DataFrame:
    """One row: positive, negative and invalid examples."""
    return df.agg(F.count_if(valid & (label > 0)).alias("positive"), F.count_if(valid & (label <= 0)).alias("negative"), F.count_if(~valid).alias("invalid"))
