"""Conjunctive and phrase search over postings, without ranking.

A query is words and "quoted phrases". A document matches if it has all words, and each phrase's words
one after another. Words that a phrase repeats count once, a dash only separates, an unmatched quote
is ignored, and a phrase without words asks for nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The same words as functions.text.TOKEN: \w holds letters, digits and underscores, and the marks are added.
_MARKS = "".join(chr(c) for a, b in ((0x300, 0x36F), (0x483, 0x489), (0x591, 0x5BD), (0x610, 0x61A), (0x64B, 0x65F), (0x93A, 0x94D)) for c in range(a, b + 1))
_IDEOGRAPHS, _HIRAGANA, _KATAKANA = "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U000323af", "\u3041-\u309f", "\u30a0-\u30ff\uff66-\uff9f"
_LETTER = rf"(?:(?![{_IDEOGRAPHS}{_HIRAGANA}{_KATAKANA}])[\w{_MARKS}])"
_WORD = re.compile(rf"{_LETTER}+(?:[.'’]{_LETTER}+)*|[{_IDEOGRAPHS}]|[{_HIRAGANA}]+|[{_KATAKANA}]+")


class Query(NamedTuple):
    phrases: list[list[str]]
    words: list[str]

    @property
    def all_words(self) -> list[str]:
        return list(dict.fromkeys([w for p in self.phrases for w in p] + self.words))


def words_in(text: str) -> list[str]:
    """Distinct words in order of appearance."""
    return list(dict.fromkeys(_WORD.findall(text.lower())))


def parse(text: str) -> Query:
    """Phrases between pairs of quotes, words elsewhere."""
    pieces = text.split('"')
    if len(pieces) % 2 == 0:  # an unmatched quote: what follows it is words
        pieces[-2:] = [pieces[-2] + " " + pieces[-1]]
    phrases = [p for p in map(words_in, pieces[1::2]) if p]
    return Query(phrases, words_in(" ".join(pieces[::2])))


def search(postings: DataFrame, text: str | Query, key: str = "key") -> DataFrame:
    """(key, matches): the documents that match, with the positions of each word of the query.

    The filter on the query's words reaches the scan; one grouping by document follows, in which a
    document has as many rows as the query has words.
    """
    query = parse(text) if isinstance(text, str) else text
    words = query.all_words
    if not words:
        return postings.sparkSession.createDataFrame([], f"{key} {dict(postings.dtypes)[key]}, matches map<string, array<int>>")
    hits = postings.where(F.col("token").isin(words)).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("token", "positions"))).alias("matches"))
    hits = hits.where(F.size("matches") == len(words))

    def follows(phrase: list[str]):
        def begin(w: str, i: int) -> Column:
            return F.transform(F.col("matches")[w], lambda p: p - i)

        begins = [begin(w, i) for i, w in enumerate(phrase)]
        return F.arrays_overlap(reduce(F.array_intersect, begins[:-1]), begins[-1])  # by hashing, so linear in the positions

    for phrase in query.phrases:
        if len(phrase) > 1:
            hits = hits.where(follows(phrase))
    return hits


def positions(hits: DataFrame, key: str = "key") -> DataFrame:
    """(key, token, positions): a row for each word of each hit."""
    return hits.select(key, F.explode("matches").alias("token", "positions"))


def as_json(hits: DataFrame, key: str = "key") -> DataFrame:
    """(key, json): each hit with its words and their space-joined positions."""
    entries = F.transform(F.array_sort(F.map_entries("matches")), lambda e: F.struct(e["key"].alias("token"), F.array_join(e["value"].cast("array<string>"), " ").alias("positions")))
    return hits.select(key, F.to_json(F.struct(F.col(key).cast("string").alias("key"), entries.alias("tokens"))).alias("json"))


def ids(hits: DataFrame, key: str = "key", bits: int = 256) -> DataFrame:
    """(id): the ids of all hits, sorted across partitions."""
    return hits.select(F.sha2(F.col(key).cast("string"), bits).alias("id")).orderBy("id")


def ids_json(hits: DataFrame, key: str = "key", bits: int = 256) -> Iterator[str]:
    """The reply that lists the ids of all hits, in pieces: the driver holds one partition at a time."""
    yield '{"result":['
    for k, row in enumerate(ids(hits, key, bits).toLocalIterator()):
        yield (',"' if k else '"') + row["id"] + '"'
    yield "]}"
