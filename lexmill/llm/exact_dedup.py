"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions alone.

Pass one hashes each text into two cells of a blocked Bloom filter and keeps, as bitmaps, only the
cells that two or more rows hit. Pass two tests every row against those bitmaps: a row with a cell
hit once is certainly unique and passes straight through; only the others shuffle by their SHA-256,
and the exact hash decides there. The filter has a fixed upper size, so it may be broadcast; a
table too large for it only raises the share of rows that shuffle, never changes a result.

Defined results: a null text counts as empty; a null doc_id sorts after all others; rows that agree
in doc_id and text are one document (marked alike in the digest, returned once by the operator);
an empty table gives an empty result; other columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import cut, fresh, join_groups, keys, spread, table

#: A bitmap function of Spark makes bitmaps of this many bits.
BLOCK_BITS = 32768
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def text_hash(text: Column) -> Column:
    return F.sha2(F.encode(normalised(text), "UTF-8"), 256)


def n_blocks(n_rows: int, cells_per_row: int, max_filter_mb: int) -> int:
    """Blocks of two bitmaps (8 KB together): enough for the rows, at most what may be broadcast."""
    return max(1, min(-(-n_rows * cells_per_row // BLOCK_BITS), max_filter_mb * 128))


def _cells(sha: Column, blocks: int) -> tuple[Column, Column, Column]:
    h, g = F.xxhash64(sha), F.xxhash64(sha, F.lit(1))
    return F.pmod(h, F.lit(blocks)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(BLOCK_BITS)), F.pmod(g, F.lit(BLOCK_BITS))


def repeated_cells(hashes: DataFrame, sha: str, blocks: int, at_least: int = 2) -> DataFrame:
    """Pass one: per block, the bitmaps (first, second) of the cells that two or more (`at_least`) rows hit."""
    block, first, second = _cells(F.col(sha), blocks)
    cells = hashes.select(F.explode(F.array((block * 2) * BLOCK_BITS + first, (block * 2 + 1) * BLOCK_BITS + second)).alias("cell"))
    often = cells.groupBy("cell").count().where(F.col("count") >= at_least)
    which, bit = F.floor(F.col("cell") / BLOCK_BITS), F.pmod("cell", F.lit(BLOCK_BITS))
    return often.groupBy(F.floor(which / 2).alias("block")).agg(
        F.bitmap_construct_agg(F.when(which % 2 == 0, bit)).alias("first"),
        F.bitmap_construct_agg(F.when(which % 2 == 1, bit)).alias("second"),
    )


def _bit(bitmap: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1


def flag_repeats(df: DataFrame, sha: str, cells: DataFrame, blocks: int, flag: str) -> DataFrame:
    """Pass two: add a flag that is false only for rows whose hash certainly occurs once."""
    b, x, y = fresh(df.columns, "block", "first", "second")
    block, first, second = _cells(F.col(sha), blocks)
    held = F.broadcast(cells.select(F.col("block").alias(b), F.col("first").alias(x), F.col("second").alias(y)))
    found = df.join(held, block == F.col(b), "left")
    return found.select(*[found[f"`{c}`"] for c in df.columns], F.coalesce(_bit(F.col(x), first) & _bit(F.col(y), second), F.lit(False)).alias(flag))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells_per_row: int = 8, max_filter_mb: int = 64) -> DataFrame:
    """The digest of all rows: doc_id, keep_id, group_size, kept, text_sha256."""
    hashes = cut(docs.select(F.col(id_col).alias("doc_id"), text_hash(F.col(text_col)).alias("text_sha256")))
    n = hashes.count()
    blocks = n_blocks(n, cells_per_row, max_filter_mb)
    flagged = flag_repeats(hashes, "text_sha256", repeated_cells(hashes, "text_sha256", blocks), blocks, "maybe")
    alone = flagged.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    maybe = flagged.where("maybe").select("doc_id", "text_sha256")
    groups = maybe.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    rest = join_groups(maybe, groups, "text_sha256", "group_size", n).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return alone.unionByName(rest)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells_per_row: int = 8, max_filter_mb: int = 64) -> DataFrame:
    """The rows that stay, with all their columns; of equal texts the one with the smallest doc_id."""
    k1, k2 = keys(id_col, text_col)
    hashes = cut(docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_hash(F.col(f"`{text_col}`")).alias("sha"), k1.alias("k1"), k2.alias("k2")))
    n = hashes.count()
    blocks = n_blocks(n, cells_per_row, max_filter_mb)
    maybe = flag_repeats(hashes, "sha", repeated_cells(hashes, "sha", blocks), blocks, "maybe").where("maybe").drop("maybe")
    groups = maybe.groupBy("sha").agg(F.min("doc_id").alias("keep"), F.count(F.lit(1)).alias("size"))
    placed = join_groups(maybe, groups, "sha", "size", n).withColumn("drop", ~F.col("doc_id").eqNullSafe(F.col("keep")))
    return keep_decided(docs, placed, id_col, text_col, cells_per_row, max_filter_mb)


def keep_decided(docs: DataFrame, placed: DataFrame, id_col: str, text_col: str, cells_per_row: int = 8, max_filter_mb: int = 64) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    placed: (k1, k2, drop) for each row that may go, by a document's own key. Rows of one document are one decision and
    stay once; documents that aren't listed pass straight through.
    """
    a, b, flag, act = fresh(docs.columns, "k1", "k2", "maybe", "drop")
    k1, k2 = keys(id_col, text_col)
    # what to do with a document that goes (drop), or that stays but comes several times
    decided = placed.groupBy("k1", "k2").agg(F.max("drop").alias("drop"), F.count(F.lit(1)).alias("n")).where("drop OR n > 1")
    decided = cut(decided.select(F.col("k1").alias(a), F.col("k2").alias(b), F.col("drop").alias(act)))
    blocks = n_blocks(decided.count(), 2 * cells_per_row, max_filter_mb)
    flagged = flag_repeats(docs.withColumns({a: k1, b: k2}), a, repeated_cells(decided, a, blocks, 1), blocks, flag)
    once = flagged.where(F.col(flag)).dropDuplicates([a, b])  # combines before its shuffle, so no key is hot in the join
    hit = once.join(decided, [a, b], "left").where(~F.coalesce(F.col(act), F.lit(False)))
    own = [f"`{c}`" for c in docs.columns]
    return flagged.where(~F.col(flag)).select(own).unionByName(hit.select(own))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
