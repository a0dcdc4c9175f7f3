"""Operations in row order without gathering all rows in one task.

Rows are cut into ranges of the order that hold about equally many, whatever the numbers; each is a window of
bounded size, and only a row per range goes through a window over the ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.session import cut

#: Rows of a range.
WIDTH = 1_000_000


def _bucketed(df: DataFrame, order: str, width: int) -> DataFrame:
    """df with the number of each row's range; written once, as ranges are sampled anew by each run."""
    n = max(1, -(-df.count() // width))
    return cut(df.repartitionByRange(n, order).withColumn("_bucket", F.spark_partition_id()))


def consecutive_pairs(df: DataFrame, order: str, width: int = WIDTH) -> DataFrame:
    """(first, second): each distinct order number with the next one that occurs."""
    rows = _bucketed(df.select(order).where(F.col(order).isNotNull()).distinct(), order, width)
    inside = rows.withColumn("second", F.lead(order).over(Window.partitionBy("_bucket").orderBy(order)))
    firsts = rows.groupBy("_bucket").agg(F.min(order).alias("_first"))
    after = firsts.select("_bucket", F.lead("_first").over(Window.orderBy("_bucket")).alias("_after"))  # a row per bucket
    joined = inside.join(after, "_bucket")
    return joined.select(F.col(order).alias("first"), F.coalesce("second", "_after").alias("second")).where("second IS NOT NULL")


def balance_classes(df: DataFrame, order: str, positive, ratio: int = 2, width: int = WIDTH) -> DataFrame:
    """All rows of the positive class, and of the others, in order, each while those kept are under `ratio` times the positives so far.

    What a loop would keep has a closed form: with N negatives and P positives so far, the number kept
    at a negative row is N + min(0, least of ratio * P - N so far); a row is kept where that number grows.
    """
    rows = _bucketed(df, order, width).withColumn("_pos", positive.cast("long")).withColumn("_neg", 1 - F.col("_pos"))
    inside = Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_p": F.sum("_pos").over(inside), "_n": F.sum("_neg").over(inside)})
    gap = F.when(F.col("_neg") == 1, ratio * F.col("_p") - F.col("_n"))
    rows = rows.withColumn("_low", F.min(gap).over(inside))
    sums = rows.groupBy("_bucket").agg(F.sum("_pos").alias("_tp"), F.sum("_neg").alias("_tn"), F.min("_low").alias("_tl"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    sums = sums.withColumns({"_bp": F.coalesce(F.sum("_tp").over(before), F.lit(0)), "_bn": F.coalesce(F.sum("_tn").over(before), F.lit(0))})
    sums = sums.withColumn("_bl", F.min(F.col("_tl") + ratio * F.col("_bp") - F.col("_bn")).over(before))
    rows = rows.join(sums.select("_bucket", "_bp", "_bn", "_bl"), "_bucket")
    n, here = F.col("_bn") + F.col("_n"), F.col("_low") + ratio * F.col("_bp") - F.col("_bn")
    now = n + F.least(F.lit(0), here, F.coalesce("_bl", here))
    rows = rows.withColumn("_kept", now)
    earlier = Window.partitionBy("_bucket", "_neg").orderBy(order)
    base = F.col("_bn") + F.least(F.lit(0), F.coalesce("_bl", F.lit(0)))
    grew = F.col("_kept") > F.coalesce(F.lag("_kept").over(earlier), base)
    return rows.withColumn("_keep", (F.col("_pos") == 1) | grew).where("_keep").select(df.columns)
