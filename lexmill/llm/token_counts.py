"""Token counts without ids: pieces per distinct pre-token, joined to per-document frequencies.

A first pass over all texts counts every pre-token of the corpus (combined within each task before
the shuffle); the library then counts the pieces of each distinct pre-token once. A second pass
counts pre-tokens within each document. The pre-tokens that the corpus has most often, at most
`max_head` of them, are broadcast, so their share of a document is summed at once; the rest of its
frequencies join the piece counts by a shuffle. Neither side of that join grows a hot key, since any
pre-token common enough to be one is in the head.

Documents are known by a key of their id, text and partition, so a task that runs again numbers them alike.

Defined results: a null or empty text has no bytes and no tokens; special strings are one token each, as
the library's default has it; ids keep their type; rows with a null or a repeated doc_id return as often as they come; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import cut, spread, table
from lexmill.session import ship

LIMIT = 2048
#: Pre-tokens that may be broadcast; some 40 MB in a worker.
MAX_HEAD = 1 << 18
#: Distinct pre-tokens that a task gathers before it passes their counts on.
FLUSH = 400_000


def vocabulary(docs: DataFrame, text_col: str, path: str | None) -> DataFrame:
    """(word, n): how often each pre-token occurs in the corpus."""

    def run(batches):
        import pyarrow as pa

        from lexmill.llm.pretokens import cutter

        def rows(seen):
            return pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

        seen, words = Counter(), cutter(path).words
        for batch in batches:
            for text in batch.column(0):
                seen.update(words(text.as_py() or ""))
                if len(seen) > FLUSH:
                    yield rows(seen)
                    seen.clear()
        yield rows(seen)

    return docs.select(F.col(f"`{text_col}`")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def piece_counts(words: DataFrame, path: str | None) -> DataFrame:
    """(word, n, pieces): how many pieces the library makes of each pre-token."""

    def run(batches):
        import pyarrow as pa

        from lexmill.llm.pretokens import cutter

        ids = cutter(path).ids
        for batch in batches:
            pieces = [len(ids(w)) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces, pa.int64())], ["word", "n", "pieces"])

    return words.mapInArrow(run, "word string, n long, pieces long")


def head_of(counted: DataFrame, most: int) -> tuple[int, dict[str, int]]:
    """The least frequency 2**t that at most `most` pre-tokens reach, and the pieces of those pre-tokens."""
    sizes = dict(counted.groupBy(F.floor(F.log2("n")).cast("int").alias("t")).count().collect())  # a row per power of two
    t = max(sizes, default=0) + 1
    while t > 0 and sum(n for k, n in sizes.items() if k >= t - 1) <= most:
        t -= 1
    return 1 << t, {r["word"]: r["pieces"] for r in counted.where(F.col("n") >= 1 << t).select("word", "pieces").collect()}


def frequencies(docs: DataFrame, id_col: str, text_col: str, head, path: str | None) -> DataFrame:
    """A row per further pre-token of each document (its key, freq), the first of which has the document's id, n_bytes and tokens of head pre-tokens.

    A document without further pre-tokens has one row, with a word of its own, so that such rows make no hot key.
    """
    parts = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.spark_partition_id()
    rows = docs.select(F.xxhash64(F.lit(1), *parts).alias("k1"), F.xxhash64(F.lit(2), *parts).alias("k2"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`"))
    longs = [T.StructField(n, T.LongType()) for n in ("n_bytes", "tokens", "freq")]
    schema = T.StructType([*rows.schema.fields[:3], *longs, T.StructField("word", T.StringType())])
    for f in schema.fields:
        f.nullable = True

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        from lexmill.llm.pretokens import cutter

        pieces, words = head.value, cutter(path).words
        for batch in batches:
            texts, at = batch.column(3), []
            n_bytes, tokens, freq, word = [], [], [], []
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            for k, (text, size) in enumerate(zip(texts, sizes, strict=True)):
                known, rest = 0, []
                for w, n in Counter(words(text.as_py() or "")).items():
                    if (p := pieces.get(w)) is not None:
                        known += n * p
                    else:
                        rest.append((w, n))
                rest = rest or [(f"\x00{batch.column(0)[k].as_py()}", 0)]
                at += [k] * len(rest)
                n_bytes += [size, *[None] * (len(rest) - 1)]
                tokens += [known, *[None] * (len(rest) - 1)]
                word += [w for w, _ in rest]
                freq += [n for _, n in rest]
            own = [c.take(pa.array(at, pa.int64())) for c in batch.columns[:3]]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, pa.int64()) for c in (n_bytes, tokens, freq)), pa.array(word, pa.string())], schema.names)

    return rows.mapInArrow(run, schema)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, path: str | None = None, max_head: int = MAX_HEAD) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    spark = docs.sparkSession
    ship(spark)
    counted = cut(piece_counts(vocabulary(docs, text_col, path), path))
    least, head = head_of(counted, max_head)
    rows = frequencies(docs, id_col, text_col, spark.sparkContext.broadcast(head), path)
    joined = rows.join(counted.where(F.col("n") < least).select("word", "pieces"), "word", "left")
    tokens = F.sum(F.coalesce("tokens", F.lit(0)) + F.coalesce(F.col("freq") * F.col("pieces"), F.lit(0)))
    sums = joined.groupBy("k1", "k2", "doc_id").agg(F.max("n_bytes").alias("n_bytes"), tokens.alias("total"), F.count("n_bytes").alias("times"))
    each = sums.withColumn("_", F.explode(F.sequence(F.lit(1), "times")))  # equal rows of one partition share a key
    n_tokens = F.expr("total div times")
    return each.select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
