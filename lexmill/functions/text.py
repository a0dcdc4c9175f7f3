"""Words, n-grams and joins of text, as column expressions; all but the n-grams stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.grams import gram_lists

#: The ranges of ideographs and of kana.
IDEOGRAPHS = r"\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{323AF}"
HIRAGANA, KATAKANA = r"\u3041-\u309F", r"\u30A0-\u30FF\uFF66-\uFF9F"
_LETTER = rf"[\p{{L}}\p{{M}}\p{{N}}_&&[^{IDEOGRAPHS}{HIRAGANA}{KATAKANA}]]"
#: A word: letters, marks, digits and underscores, joined by a dot or an apostrophe inside; an ideograph, or a run of one kana.
TOKEN = rf"{_LETTER}+(?:[.'’]{_LETTER}+)*|[{IDEOGRAPHS}]|[{HIRAGANA}]+|[{KATAKANA}]+"
#: Stricter about what joins: dots and apostrophes between letters, dots and commas between digits;
#: a run of underscores alone is no word. Needs look-around, so it has no SQL twin.
STRICT_TOKEN = r"(?=_*[\p{L}\p{M}\p{N}])[\p{L}\p{M}\p{N}_](?:[\p{L}\p{M}\p{N}_]|(?<=\p{L}\p{M}{0,4})[.'’:·](?=\p{L})|(?<=\p{N})[.',;](?=\p{N}))*"


def tokens(text: Column, pattern: str = TOKEN) -> Column:
    """Lower-cased words in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def distinct_tokens(text: Column, pattern: str = TOKEN) -> Column:
    """Lower-cased words, each once, in order of first appearance."""
    return F.array_distinct(tokens(text, pattern))


def ngrams(text: Column, n: int = 4) -> Column:
    """Distinct character n-grams over the raw text, spaces included, sorted."""
    return gram_lists(text, n)


def ngram_keys(text: Column, n: int = 4) -> Column:
    """n-grams as the hexadecimal digits of their first eight UTF-8 bytes, distinct and sorted."""
    return gram_lists(text, n, keys=True)


def join_trailing(items: Column, separator: str) -> Column:
    """Items joined by a separator, which also follows the last one."""
    return F.array_join(F.transform(items, lambda x: F.concat(x, F.lit(separator))), "")


def sorted_set(items: Column) -> Column:
    return F.sort_array(F.array_distinct(items))


def to_text(value: Column) -> Column:
    """A number in decimal digits."""
    return value.cast("string")


def exploded(df: DataFrame, keys: list[Column | str], items: Column, item: str, place: str | None = None) -> DataFrame:
    """A row for each item of an array, with its place on request.

    An outer explode: for a plain one the optimizer puts a filter on the array's size below it, which
    makes a costly array twice.
    """
    made = F.explode_outer(items).alias(item) if place is None else F.posexplode_outer(items).alias(place, item)
    return df.select(*keys, made).where(F.col(item).isNotNull())
