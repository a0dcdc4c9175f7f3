"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators.groups import fresh, join_groups
from lexmill.session import cut, spread, tasks
from lexmill.session import scratch as checkpoint_dir

__all__ = ["checkpoint_dir", "cut", "free_names", "fresh", "join_groups", "keys", "spread", "table", "tasks"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(columns: list[str], *names: str) -> list[str]:
    """Names for result columns: as asked for, or with the first number from 2 on that the table doesn't have yet."""
    taken = {c.lower() for c in columns}
    return [next(x for k in range(1, len(taken) + 2) if (x := n if k == 1 else f"{n}_{k}").lower() not in taken) for n in names]


def keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    """A document's own key of 128 bits."""
    parts = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)
