import pytest
from pyspark.sql import functions as F

from lexmill.engine import SearchEngine
from lexmill.operators import index, tfidf


def exchanges(df) -> list[str]:
    """What each shuffle of the plan deals out by."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.split("Exchange hashpartitioning(")[1].split(",")[0].split("#")[0] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(1, "b a b"), (2, "a"), (1, "c b"), (None, "b"), (None, "b"), (3, None), (4, "")], "k long, t string")


def test_words_of_repeated_and_null_keys_come_together(rows):
    found = {(r.k, r.token): r.positions for r in index.build_postings(rows, "k", "t").collect()}
    assert found == {(1, "a"): [1], (1, "b"): [0, 1, 2], (1, "c"): [0], (2, "a"): [0], (None, "b"): [0, 0]}
    assert {(r.k, r.token): r.cnt for r in tfidf.term_freq(rows, "k", "t").collect()} == {k: len(p) for k, p in found.items()}


def test_texts_shuffle_and_words_do_not(rows):
    tf = tfidf.term_freq(rows, "k", "t")
    assert exchanges(tf) == ["k"] and set(exchanges(tfidf.frequencies(tf, "k"))) == {"k"}
    assert exchanges(index.build_postings(rows, "k", "t")) == ["k"]


def test_one_upload_of_several_versions(spark, tmp_path):
    engine = SearchEngine(spark, str(tmp_path / "store"), buckets=4)
    rows = spark.createDataFrame([("a", "old words", 1), ("a", "new words", 2)], "key string, data string, s int")
    engine.upload(rows, "", ts=F.timestamp_seconds("s"))
    assert engine.find("old").isEmpty() and [r.key for r in engine.find("words").collect()] == ["a"]


def test_no_task_writes_more_of_a_larger_table(spark, tmp_path, monkeypatch):
    limit = 64 << 10
    monkeypatch.setattr(index, "TASK_BYTES", limit, raising=False)
    store = index.IndexStore(spark, str(tmp_path / "store"), buckets=4)
    rows = spark.range(3000).select(F.concat(F.lit("doc/"), F.col("id")).alias("key"), F.concat(F.lit("one two three "), F.col("id") % 500, F.repeat(F.lit(" w"), 40)).alias("data"))
    store.upload(rows, "all")
    for name, row in (("postings", F.size("positions") * 4 + 150), ("documents", F.length("data") + 140), ("collections", F.lit(140))):
        table = spark.read.parquet(f"{store.path}/{name}")
        tasks = table.groupBy(F.regexp_extract(F.input_file_name(), "part-([0-9]+)", 1)).agg(F.sum(row).alias("size"), F.count_distinct("bucket").alias("buckets")).collect()
        assert sum(t["size"] for t in tasks) > 5 * limit and max(t["size"] for t in tasks) < 2.5 * limit, name
        assert max(t["buckets"] for t in tasks) == 1, name
    assert store.contents("all").count() == store.postings(["one"]).count() == 3000 and store.postings(["499"]).count() == 6


def test_no_task_makes_more_postings_of_larger_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "TASK_BYTES", 64 << 10, raising=False)
    made = {}
    monkeypatch.setattr(index.IndexStore, "_append", lambda self, rows, name, *_, **__: made.update({name: rows.groupBy(F.spark_partition_id()).count().collect()}))
    rows = spark.range(3000).select(F.concat(F.lit("doc/"), F.col("id")).alias("key"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.concat(F.lit("another"), i))).alias("data"))
    index.IndexStore(spark, str(tmp_path / "store"), buckets=4).upload(rows, "")
    counts = [r["count"] for r in made["postings"]]
    assert sum(counts) == 60_000 and max(counts) * 150 < 5 * (64 << 10)
