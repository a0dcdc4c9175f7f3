"""The positional inverted index and the versioned document table.

Tables are appended to, never changed in place: a key's current state is that of its latest time, so
writing a document, replacing its postings and dropping them are all appends, safe to repeat.
On disk postings are partitioned by a hash bucket of the token, documents by one of their id, memberships by
one of the collection: a query reads only the buckets of its own words, key or collection, and within
them Parquet's statistics skip row groups.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill import schemas
from lexmill.functions.text import TOKEN, exploded, tokens
from lexmill.functions.urls import host
from lexmill.session import ship

BUCKETS = 256
#: Bytes of rows that a task sorts when it writes to a table, as held in memory.
TASK_BYTES = 64 << 20
#: What a row takes beside its key and its text, and the bytes of text to a posting: the postings of a text are larger than the text.
ROW, WORD = 128, 10
_BUCKET = T.StructField("bucket", T.IntegerType())


def token_positions(docs: DataFrame, key: str | Sequence[str], text: str, pattern: str = TOKEN) -> DataFrame:
    """(key, pos, token): every word with its place, counted from 0."""
    return exploded(docs, [key] if isinstance(key, str) else list(key), tokens(F.col(text), pattern), "token", "pos")


def build_postings(docs: DataFrame, key: str | Sequence[str], text: str, pattern: str = TOKEN, words: Sequence[str] | None = None, size: int = 0) -> DataFrame:
    """(key, token, positions): the places of each word in each document; documents with no words have no postings.

    Texts are dealt out by the first column of the key and a document's words grouped where it is, batch by batch,
    so texts shuffle and words neither shuffle nor spill. Of a few given words only their own places shuffle.
    Where the postings themselves shuffle next, a task holds all it makes: then give their size in bytes, which sets the
    number of tasks.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if words is not None:
        placed = token_positions(docs, keys, text, pattern).where(F.col("token").isin(list(words)))
        return placed.groupBy(*keys, "token").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    ship(docs.sparkSession)
    tasks = -(-size // (2 * TASK_BYTES))
    dealt = [tasks] if tasks > docs.sparkSession.sparkContext.defaultParallelism else []
    texts = docs.select(*keys, text).repartition(*dealt, F.col(keys[0])).groupBy(*keys).agg(F.collect_list(text).alias("_texts"))
    rows = texts.select(*keys, F.transform("_texts", lambda t: tokens(t, pattern)).alias("_words"))
    schema = T.StructType([*rows.select(*keys).schema.fields, T.StructField("token", T.StringType()), T.StructField("positions", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(_grouped, schema)


def _grouped(batches):
    """Postings of rows whose last column has the words of each text of a document."""
    import pyarrow as pa

    for batch in batches:
        texts = batch.columns[-1]
        n_texts, lists = texts.value_lengths().to_numpy(), texts.flatten()
        n_words, words = lists.value_lengths().to_numpy(), lists.flatten()
        if len(words):
            pos = np.arange(len(words)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
            coded = words.dictionary_encode()
            row = np.repeat(np.repeat(np.arange(len(texts)), n_texts), n_words)
            group = row * len(coded.dictionary) + coded.indices.to_numpy()
            order = np.lexsort((pos, group)) if n_texts.max() > 1 else np.argsort(group, kind="stable")
            group = group[order]
            starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            row, code = np.divmod(group[starts], len(coded.dictionary))
            places = pa.ListArray.from_arrays(pa.array(np.append(starts, len(words)), pa.int32()), pa.array(pos[order], pa.int32()))
            columns = [*[c.take(pa.array(row)) for c in batch.columns[:-1]], coded.dictionary.take(pa.array(code)), places]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "token", "positions"])


def latest(table: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """The rows of each key's latest time; all of them where several have it.

    The latest time is an aggregate that combines before its shuffle, so a key with many versions
    doesn't gather in one task.
    """
    newest = table.groupBy(*keys).agg(F.max(ts).alias("_newest"))
    return table.join(newest, list(keys)).where(F.col(ts) == F.col("_newest")).drop("_newest")


def latest_documents(table: DataFrame, keys: Sequence[str] = ("ns", "key"), ts: str = "ts") -> DataFrame:
    """One row per key: that of the latest time, and of equal ones the last written by content."""
    columns = [c for c in table.columns if c not in keys]
    best = table.groupBy(*keys).agg(F.max(F.struct(F.col(ts), *[F.col(c) for c in columns if c != ts])).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in columns])


def live_postings(postings: DataFrame, documents: DataFrame) -> DataFrame:
    """Postings of each document's latest time only: what replaced them hides older ones."""
    newest = documents.groupBy("key").agg(F.max("ts").alias("_newest"))
    return postings.join(newest.hint("shuffle_hash"), "key").where(F.col("ts") == F.col("_newest")).drop("_newest")


def memberships(pages: DataFrame, key: str, url: str) -> DataFrame:
    """(collection, key): each page in the collection of its host."""
    return pages.select(F.concat(host(F.col(url)), F.lit(".collection")).alias("collection"), F.col(key).alias("key"))


def collection_scan(members: DataFrame, collection: str | None = None) -> DataFrame:
    return members if collection is None else members.where(F.col("collection") == collection)


def bulk_read(documents: DataFrame, wanted: DataFrame, key: str = "key") -> DataFrame:
    """The documents of the wanted keys; keys that are missing give no row."""
    return documents.join(wanted.select(key).distinct(), key, "left_semi")


def render_document(key: Column, ts: Column, data: Column) -> Column:
    """A document in one line."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(": key: '"), key, F.lit("', doc-size: "), F.octet_length(data).cast("string"))


def render_posting(token: Column, positions: Column) -> Column:
    """A posting in one line."""
    return F.concat(token, F.lit(", positions in document: "), F.array_join(positions.cast("array<string>"), " "))


class Sizes(NamedTuple):
    """About how many bytes the rows of some documents take in memory, by table."""

    members: int
    documents: int
    postings: int


def sizes(docs: DataFrame, key: str, data: str) -> Sizes:
    row, text = [F.coalesce(F.octet_length(F.col(c).cast("string")).cast("long"), F.lit(0)) for c in (key, data)]
    row = row + F.lit(ROW)
    return Sizes(*[int(n or 0) for n in docs.agg(F.sum(row), F.sum(row + text), F.sum(row * text / WORD)).first()])


class IndexStore:
    """Documents, collections and postings under one folder."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _table(self, name: str, schema) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def documents(self, ns: str = "") -> DataFrame:
        return self._latest(self._stored().where(F.col("ns") == ns))

    def _stored(self) -> DataFrame:
        return self._table("documents", T.StructType([*schemas.DOCUMENT.fields, _BUCKET]))

    def _latest(self, rows: DataFrame) -> DataFrame:
        return latest_documents(schemas.checked(rows.drop("bucket"), schemas.DOCUMENT_VERSION))

    def members(self, collection: str | None = None) -> DataFrame:
        """All memberships, or those of one collection, whose bucket alone is read."""
        table = self._table("collections", T.StructType([*schemas.MEMBERSHIP.fields, _BUCKET]))
        if collection is not None:
            table = table.where(F.col("bucket") == self._number(self._bucket(F.lit(collection))))
        return collection_scan(table.drop("bucket"), collection)

    def postings(self, words: Sequence[str] | None = None) -> DataFrame:
        """Live postings, of the given words only: the buckets of other words are not read."""
        table = self._table("postings", T.StructType([*schemas.POSTING.fields, _BUCKET]))
        if words is not None:
            buckets = [r[0] for r in self.spark.createDataFrame([(w,) for w in words] or [("",)], "token string").select(self._bucket(F.col("token"))).collect()]
            table = table.where(F.col("bucket").isin(buckets) & F.col("token").isin(list(words)))
        return live_postings(schemas.checked(table, schemas.POSTING_VERSION), self._stored().where(F.col("ns") == "")).drop("bucket", "version", "ts")

    def _bucket(self, token: Column) -> Column:
        return F.pmod(F.xxhash64(token), F.lit(self.buckets)).cast("int")

    def _key_bucket(self, doc_id: Column) -> Column:
        """The bucket of a document by its id, so that a key and an id lead to the same one."""
        return F.pmod(F.conv(F.substring(doc_id, 1, 8), 16, 10).cast("long"), F.lit(self.buckets)).cast("int")

    def _number(self, value: Column) -> int:
        return self.spark.range(1).select(value).first()[0]

    def _append(self, rows: DataFrame, name: str, size: int, bucket: Column, *order: str, even: bool = True) -> None:
        """Add rows of about that many bytes to a table, dealt out by bucket, of which each task writes whole ones or a slice of one.

        The number of slices follows from the size, so that a task sorts no more of a larger table. Where buckets
        aren't even, any of them may hold all rows.
        """
        slices = max(1, -(-size // (TASK_BYTES * (self.buckets if even else 1))))
        tasks = max(-(-size // TASK_BYTES), min(self.buckets, self.spark.sparkContext.defaultParallelism)) if slices == 1 else self.buckets * slices
        part = F.col("bucket") * slices + F.pmod(F.xxhash64("key", "ts"), F.lit(slices)).cast("int")
        dealt = rows.withColumn("bucket", bucket).repartitionById(tasks, F.coalesce(part, F.lit(0)))
        dealt.sortWithinPartitions("bucket", *order).write.mode("append").partitionBy("bucket").parquet(f"{self.path}/{name}")

    def write_documents(self, rows: DataFrame, size: int | None = None) -> None:
        """Write documents of about that many bytes, which are counted unless they are known."""
        size = sizes(rows, "key", "data").documents if size is None else size
        self._append(rows.select(schemas.DOCUMENT.fieldNames()), "documents", size, self._key_bucket(schemas.document_id(F.col("key"))), "key")

    def upload(self, docs: DataFrame, collection: str | Column, key: str = "key", data: str = "data", ts: Column | None = None, text_copy: bool = False, size: Sizes | None = None) -> None:
        """Write documents, index their words in place of older ones, and add them to a collection.

        The collection is one name or a column of names; an empty one adds to none. An empty document has no
        postings but is a member. What size the documents have is counted unless it is known; an upper bound will do.
        """
        size = sizes(docs, key, data) if size is None else size
        now = F.lit(self._now()) if ts is None else ts
        rows = schemas.documents(docs, F.col(key), F.col(data), now)
        postings = build_postings(rows, ["key", "ts"], "data", size=size.postings)
        postings = postings.select(F.lit(schemas.POSTING_VERSION).alias("version"), "key", "token", "positions", "ts")
        self._append(postings, "postings", size.postings, self._bucket(F.col("token")), "token")
        if isinstance(collection, Column) or collection:
            name = collection if isinstance(collection, Column) else F.lit(collection)
            members = docs.select(name.alias("collection"), F.col(key).alias("key"), now.alias("ts")).where("collection <> ''")
            self._append(members, "collections", size.members, self._bucket(F.col("collection")), "collection", "key", even=False)
        if text_copy:
            self.write_documents(rows.withColumn("ns", F.lit("text")), size.documents)
        self.write_documents(rows, size.documents)  # last: a document counts once its postings are there

    def _now(self):
        return self.spark.sql("SELECT current_timestamp()").first()[0]

    def read(self, key: str, ns: str = "") -> dict:
        """One document; KeyError if there is none."""
        row = self.find_key(key, ns).first()
        if row is None:
            raise KeyError(key)
        return row.asDict()

    def find_key(self, key: str, ns: str = "") -> DataFrame:
        """The document of a key, if there is one; its bucket alone is read."""
        bucket = self._number(self._key_bucket(schemas.document_id(F.lit(key))))
        return self._latest(self._stored().where((F.col("bucket") == bucket) & (F.col("key") == key) & (F.col("ns") == ns)))

    def find_id(self, doc_id: str, ns: str = "") -> DataFrame:
        """The document of an id, if there is one; its bucket alone is read."""
        bucket = self._number(self._key_bucket(F.lit(doc_id)))
        return self._latest(self._stored().where((F.col("bucket") == bucket) & (schemas.document_id(F.col("key")) == doc_id) & (F.col("ns") == ns)))

    def read_by_id(self, doc_id: str, ns: str = "") -> dict:
        row = self.find_id(doc_id, ns).first()
        if row is None:
            raise KeyError(doc_id)
        return row.asDict()

    def contents(self, collection: str, ns: str = "") -> DataFrame:
        """The documents of a collection."""
        return bulk_read(self.documents(ns), self.members(collection))
