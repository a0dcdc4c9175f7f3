"""Quality classifier by compression: which of two dictionaries explains a text better?

zstandard dictionaries of equal size are trained on text labelled good and text labelled bad. A text is
compressed chunk by chunk with either; the difference of the two sizes, over the chunk's length, says how
much more the good dictionary helps. The length-weighted mean of the chunks, the worst chunk and the sizes
themselves go through a logistic curve fitted on labelled texts that no dictionary has seen, so the
score is a calibrated probability. Chunks keep long texts from explaining themselves; all of a text
is compressed, only alone its bytes count.

Fitting takes a bounded sample of labelled rows, each read whole: of either class the first in order of a
hash of doc_id, at most `per_class` of them and no more than together have `max_bytes` bytes. Two
thirds are for the dictionaries and one third is for the curve. A dictionary has the same share of its
samples whatever their number, at most `DICTIONARY_BYTES`, and is always trained. Rows with crc32(doc_id as text)
mod 3 = 1 are held out of it all. Scoring reads every row once and shuffles nothing.

Defined results: a null text is scored as an empty one; an empty text has the features of a text that
neither dictionary helps; labels that are null, neither 0 nor 1, or contradictory for a doc_id are
not learned from; of several texts of one doc_id the least is learned from; with under `MIN_ROWS` rows of
either class for the dictionaries or under one for the curve, or texts in which zstandard finds nothing to train on,
every score is the share of good labels (0.5 without labels); rows with a null doc_id are scored, held_out
being null; repeated rows return as often as they come; other columns of the input pass through
`keep_good` unread.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import cut, fresh, spread, table
from lexmill.session import ship

#: Labelled rows of either class that are learned from, and the bytes that they may have together.
PER_CLASS, MAX_BYTES = 6000, 8 << 20
#: A dictionary's share of its samples and its greatest size.
SHARE, DICTIONARY_BYTES = 1 / 8, 262_144
LEVEL, CHUNK, SAMPLE = 3, 1024, 4096
#: Rows of either class that the dictionaries need; zstandard itself refuses fewer than some five samples.
MIN_ROWS = 8
#: Bytes that a compressed chunk has whatever it holds.
FRAME = 12


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


class Model:
    """Two dictionaries and a logistic curve over the features they give a text."""

    def __init__(self, good: list[str], bad: list[str]):
        self.weights = np.zeros(0)
        self.constant: float | None = None
        self.pair = None
        samples = [[data[a : a + SAMPLE] for t in texts for data in (t.encode(),) for a in range(0, len(data), SAMPLE)] for texts in (bad, good)]
        for x in samples:  # in order of a hash, so that a long repetitive text isn't all that a stretch of the samples holds
            x.sort(key=lambda part: (zlib.crc32(part), part))
        size = int(min(DICTIONARY_BYTES, SHARE * min(sum(map(len, x)) for x in samples)))
        self.dictionaries = [self.train(x, size) for x in samples] if min(len(good), len(bad)) >= MIN_ROWS else [None, None]

    @property
    def trained(self) -> bool:
        return None not in self.dictionaries

    @staticmethod
    def train(samples: list[bytes], size: int) -> bytes | None:
        """A dictionary of at most so many bytes; None where zstandard finds nothing to train on."""
        import zstandard

        try:
            return zstandard.train_dictionary(size, samples).as_bytes()
        except (zstandard.ZstdError, ValueError):
            return None

    def __getstate__(self):
        return self.__dict__ | {"pair": None}

    def compressors(self):
        import zstandard

        if self.pair is None:
            self.pair = []
            for data in self.dictionaries:
                held = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT)
                held.precompute_compress(level=LEVEL)
                self.pair.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False).compress)
        return self.pair

    def features(self, text: str | None) -> np.ndarray:
        data, (with_bad, with_good) = (text or "").encode(), self.compressors()
        if not data:
            return np.array([1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0])
        view, sizes = memoryview(data), []
        for a in range(0, len(data), CHUNK):
            chunk = view[a : a + CHUNK]
            sizes.append((len(with_bad(chunk)), len(with_good(chunk)), len(chunk)))
        bad, good, n = np.array(sizes, float).T
        each = (bad - good) / (n + 40)
        mean = (bad - good).sum() / (n.sum() + 40)
        return np.array([1.0, mean, each.min(), (good - FRAME).sum() / (n.sum() + 40), 100 / (n.sum() + 100), mean * abs(mean), (bad - good).sum() / (n.sum() + 300)])

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> None:
        """Weighted logistic regression by Newton's method."""
        self.scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
        x, w = x / self.scale, np.zeros(x.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (weight * (y - p)) - ridge * w
            h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
            w = w + (step := np.linalg.solve(h, g))
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        z = float((self.features(text) / self.scale) @ self.weights)
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def labelled(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(doc_id, good): one row per labelled document that may be learned from."""
    rows = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("good")).where("good IN (0, 1) AND doc_id IS NOT NULL")
    return rows.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("good").alias("good"), F.max("good").alias("most")).where("good = most").drop("most")


def sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int, max_bytes: int) -> tuple[dict[int, int], DataFrame]:
    """The number of labelled rows by class, and (good, text, later): the bounded sample of whole rows."""
    known = labelled(labels, id_col, label_col).withColumn("turn", F.xxhash64("doc_id"))
    counts = dict(known.groupBy("good").count().collect())
    chosen = [known.where(F.col("good") == k).orderBy("turn", "doc_id").limit(per_class) for k in (0, 1)]
    first = F.broadcast(chosen[0].union(chosen[1]))  # 2 * per_class rows at most
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).join(first, "doc_id")
    texts = cut(texts.groupBy("doc_id", "good", "turn").agg(F.min("text").alias("text")))
    left, last = {0: max_bytes, 1: max_bytes}, {}
    for row in sorted(texts.select("good", "turn", F.octet_length("text").alias("size")).collect()):  # at most as many rows
        left[row["good"]] -= row["size"]
        if left[row["good"]] >= 0:
            last[row["good"]] = row["turn"]
    fits = [F.lit(False)] + [(F.col("good") == k) & (F.col("turn") <= turn) for k, turn in last.items()]
    return counts, texts.where(reduce(lambda a, b: a | b, fits)).select("good", "text", (F.pmod("turn", F.lit(3)) == 0).alias("later"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> Model:
    """A model learned from a bounded sample of the labelled rows that aren't held out."""
    spark = docs.sparkSession
    ship(spark)
    counts, texts = sampled(docs, labels, id_col, text_col, label_col, per_class, max_bytes)
    rows = sorted((r["good"], r["text"]) for r in texts.where("not later").select("good", "text").collect())  # 2 * max_bytes at most
    model = Model([t for g, t in rows if g == 1], [t for g, t in rows if g == 0])
    del rows
    if not model.trained:
        model.constant = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
        return model
    held = spark.sparkContext.broadcast(model)

    def describe(batches):
        import pyarrow as pa

        for batch in batches:
            x = [held.value.features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(v) for v in x], pa.list_(pa.float64()))], ["good", "x"])

    found = sorted((r["good"], list(r["x"])) for r in texts.where("later").select("good", "text").mapInArrow(describe, "good int, x array<double>").collect())
    if not found or found[0][0] == found[-1][0]:
        model.constant = counts[1] / (counts[0] + counts[1])
        return model
    y = np.array([g for g, _ in found], float)
    share = {k: counts[k] / (counts[0] + counts[1]) for k in (0, 1)}  # the sample may hold the classes in another proportion
    weight = np.where(y == 1, share[1] / y.mean(), share[0] / (1 - y.mean()))
    model.fit(np.array([x for _, x in found]), y, weight)
    return model


def with_scores(docs: DataFrame, model: Model, text_col: str, score: str, blank: bool = False, at_least: float | None = None) -> DataFrame:
    """docs and a score column; blank: texts come back null; at_least: only rows of at least that score."""
    ship(docs.sparkSession)
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)
    schema = docs.select("*", F.lit(0.0).alias(score)).schema

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = pa.array([held.value.score(t.as_py()) for t in batch.column(at)], pa.float64())
            columns = batch.columns
            if blank:
                columns[at] = pa.nulls(batch.num_rows, columns[at].type)
            out = pa.RecordBatch.from_arrays([*columns, found], [*batch.schema.names, score])
            yield out if at_least is None else out.filter(pa.array(np.asarray(found) >= at_least))

    for field in schema.fields:
        field.nullable = True
    return docs.mapInArrow(run, schema)


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest of all rows: doc_id, held_out, score, predicted."""
    rows = with_scores(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), model, "text", "score", blank=True)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", at_least: float = 0.5) -> DataFrame:
    """The rows that score at least so much, with all their columns."""
    (score,) = fresh(docs.columns, "score")
    return with_scores(docs, model, text_col, score, at_least=at_least).drop(score)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scores(docs, fit(docs, table(spark, sf_dir, "labels")))
