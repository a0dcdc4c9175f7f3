"""Document-pair similarity over character n-grams, and the pairs to learn it from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.grams import with_counts
from lexmill.functions.text import ngrams
from lexmill.operators.ordered import consecutive_pairs
from lexmill.schemas import PAIR_DOC_VERSION, checked
from lexmill.session import ship


def learn_pairs(lines: DataFrame, line: str = "line", number: str = "line_no", most: int | None = None) -> DataFrame:
    """(line_no, doc1, doc2, label, request) from lines of three tab-separated numbers and a request.

    The request is what follows the last tab. Reading stops at the first malformed line; a line
    without a request is skipped; any label but 0 means +1, 0 means -1; at most `most` lines are read.
    """
    form = r"^(-?\d+)\t(-?\d+)\t(-?\d+)\t"
    stop = lines.where(~F.col(line).rlike(form)).agg(F.min(number)).first()[0]
    read = lines if stop is None else lines.where(F.col(number) < stop)
    if most is not None:
        read = read.orderBy(number).limit(most)
    part = [F.regexp_extract(line, form, k).cast("long") for k in (1, 2, 3)]
    rows = read.select(F.col(number).alias("line_no"), part[0].alias("doc1"), part[1].alias("doc2"), F.when(part[2] != 0, 1).otherwise(-1).alias("label"), F.substring_index(line, "\t", -1).alias("request"))
    return rows.where("request <> ''")


def pair_documents(pairs: DataFrame) -> DataFrame:
    """(doc_id): the distinct documents of the pairs."""
    return pairs.select(F.explode(F.array("doc1", "doc2")).alias("doc_id")).distinct()


def with_grams(docs: DataFrame, key: str, text: str, n: int = 4) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col(key), ngrams(F.col(text), n).alias("grams"))


def overlap_percent(a: Column, b: Column) -> Column:
    """Shared n-grams in whole percent of the smaller side; null if a side has none."""
    return F.floor(F.try_divide(F.size(F.array_intersect(a, b)) * 100, F.least(F.size(a), F.size(b))))


def paired(pairs: DataFrame, docs: DataFrame, key: str, text: str, first: str, second: str) -> DataFrame:
    """pairs with the texts _f and _s of both documents; a pair with a missing document is dropped.

    Texts are joined and n-grams made behind the joins, as those take many times the room.
    """
    f = docs.select(F.col(key).alias(first), F.col(text).alias("_f"))
    s = docs.select(F.col(key).alias(second), F.col(text).alias("_s"))
    return pairs.join(f, first).join(s, second)


def consecutive_overlap(docs: DataFrame, key: str, text: str, threshold: int = 50) -> DataFrame:
    """(first, second, shared, percent, matched) for each document and the next one."""
    met = with_counts(paired(consecutive_pairs(docs, key), docs, key, text, "first", "second"), ["first", "second"], "_f", "_s")
    percent = F.floor(F.try_divide(F.col("n_shared") * 100, F.least("n_first", "n_second"))).cast("long")
    return met.select("first", "second", F.col("n_shared").alias("shared"), percent.alias("percent"), (percent > threshold).alias("matched"))


def pair_features(pairs: DataFrame, docs: DataFrame, key: str, text: str, n: int = 4) -> DataFrame:
    """pairs with the five features: sizes of both sides, of what they share, of the request, and of what all three share.

    `valid` is whether both documents have n-grams.
    """
    met = with_counts(paired(pairs, docs, key, text, "doc1", "doc2"), pairs.columns, "_f", "_s", "request", n)
    return met.withColumn("valid", (F.col("n_first") > 0) & (F.col("n_second") > 0))


# --- stored pairs and their documents --------------------------------------------------------------

PAIR_DOCUMENT = "version int, id long, text string, ngrams array<string>"
ELEMENT = "doc_ids array<long>, label int, request string, req_ngrams array<string>"


def pair_document_rows(docs: DataFrame, key: str, text: str, n: int = 4) -> DataFrame:
    """Documents as they are stored for pairs: with their n-grams."""
    ship(docs.sparkSession)
    return docs.select(F.lit(PAIR_DOC_VERSION).alias("version"), F.col(key).cast("long").alias("id"), F.col(text).alias("text"), ngrams(F.col(text), n).alias("ngrams"))


def element_rows(pairs: DataFrame, n: int = 4) -> DataFrame:
    """Pairs as they are stored for learning: with the n-grams of the request."""
    ship(pairs.sparkSession)
    return pairs.select(F.array("doc1", "doc2").alias("doc_ids"), F.col("label").cast("int").alias("label"), "request", ngrams(F.col("request"), n).alias("req_ngrams"))


class PairStore:
    """Pair documents and learn elements under one folder; Spark's own tasks give the back pressure."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write_documents(self, docs: DataFrame, key: str, text: str, n: int = 4) -> None:
        pair_document_rows(docs, key, text, n).write.mode("append").parquet(f"{self.path}/documents")

    def write_elements(self, pairs: DataFrame, n: int = 4) -> None:
        element_rows(pairs, n).write.mode("overwrite").parquet(f"{self.path}/elements")

    def documents(self) -> DataFrame:
        return checked(self.spark.read.schema(PAIR_DOCUMENT).parquet(f"{self.path}/documents"), PAIR_DOC_VERSION)

    def elements(self) -> DataFrame:
        return self.spark.read.schema(ELEMENT).parquet(f"{self.path}/elements")

    def features(self, n: int = 4) -> DataFrame:
        """The features of all stored elements whose documents are stored, as `pair_features` gives them; n is that of the stored n-grams.

        They are counted from the stored texts, which shuffle in a fraction of the n-grams' bytes.
        """
        pairs = self.elements().select(F.monotonically_increasing_id().alias("line_no"), F.col("doc_ids")[0].alias("doc1"), F.col("doc_ids")[1].alias("doc2"), "label", "request")
        return pair_features(pairs, self.documents(), "id", "text", n)
