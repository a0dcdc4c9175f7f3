"""Joining rows to their groups where some groups hold a large share of all rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A broadcast of hot groups has at most this many rows.
HOT_GROUPS = 2000


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names for helper columns that clash with none of the table's own."""
    tag = ""
    while any(f"_{n}{tag}".lower() in {c.lower() for c in columns} for n in names):
        tag = "_" + uuid.uuid4().hex[:6]
    return [f"_{n}{tag}" for n in names]


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int, how: str = "inner") -> DataFrame:
    """rows joined to their groups, groups having a row per key and the number of its rows in `size`.

    Fewer than HOT_GROUPS groups can hold over n_rows / HOT_GROUPS rows each, so those are broadcast
    whatever the table's size; the others are too small to make a task of the shuffle uneven. A left join
    keeps rows without a group.
    """
    big = n_rows // HOT_GROUPS + 1
    return _in_two(rows, groups.where(F.col(size) >= big), groups.where(F.col(size) < big), key, how)


def join_largest(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """The same without knowing the number of rows: the HOT_GROUPS largest groups are broadcast."""
    return _in_two(rows, groups.orderBy(F.desc(size), key).limit(HOT_GROUPS), groups, key, "inner")


def _in_two(rows: DataFrame, large: DataFrame, others: DataFrame, key: str, how: str) -> DataFrame:
    (hot_key,) = fresh(rows.columns + large.columns, "hot")
    hot = F.broadcast(large.withColumnRenamed(key, hot_key))
    found = rows.join(hot, F.col(key).eqNullSafe(F.col(hot_key)), "left")
    first = found.where(F.col(hot_key).isNotNull()).drop(hot_key)
    rest = found.where(F.col(hot_key).isNull()).select(rows.columns).join(others, key, how)
    return first.select(rest.columns).unionByName(rest)
