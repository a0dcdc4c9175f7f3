"""Text normalisation by a service: what to ask it, and what to take from its answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Normalizer = Callable[[Column], Column]


def request(text: Column) -> Column:
    """The message that asks for the normalised form of a text."""
    return F.to_json(F.struct(F.struct(text.alias("data"), F.lit("yes").alias("normalize")).alias("request")))


def answered(text: Column, reply: Column, code: Column, failed: Column) -> Column:
    """The normalised text of an answer, the last one where it has several; the text itself if there is none.

    An answer counts as none if it failed with another code than 200, isn't JSON, or lacks the field.
    """
    one = F.get_json_object(reply, "$.reply.normalize")
    many = F.from_json(F.get_json_object(reply, "$.reply"), "array<struct<normalize:string>>")
    last = F.try_element_at(F.filter(F.transform(many, lambda x: x["normalize"]), lambda x: x.isNotNull()), F.lit(-1))
    whole = F.when(F.get_json_object(reply, "$.reply").startswith("["), last).otherwise(one)
    return F.when(failed & (code != 200), text).otherwise(F.coalesce(whole, text))


def normalized(df: DataFrame, column: str, normalizer: Normalizer | None) -> DataFrame:
    """A column through a normaliser; where that gives null, and without one, it stays as it is."""
    return df if normalizer is None else df.withColumn(column, F.coalesce(normalizer(F.col(column)), F.col(column)))
