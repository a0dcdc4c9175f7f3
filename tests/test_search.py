import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import index, search


def find(spark, docs, query):
    df = spark.createDataFrame(docs, "key string, data string")
    return {r.key for r in search.search(index.build_postings(df, "key", "data"), query).collect()}


@pytest.mark.parametrize(("query", "phrases", "words"), [
    ('"aaaa" x "b" foo', [["aaaa"], ["b"]], ["x", "foo"]), ('a "b', [], ["a", "b"]), ("a -b", [], ["a", "b"]), ("", [], []),
    ('"to be or not to be"', [["to", "be", "or", "not"]], []), ('"" z', [], ["z"]), ('"A b" a', [["a", "b"]], ["a"]),
])
def test_parse(query, phrases, words):
    assert search.parse(query) == (phrases, words)


@pytest.mark.parametrize(("doc", "query", "hit"), [
    ("a b c", '"a b"', True), ("a b c", '"b a"', False), ("to be or not", '"to be or not to be"', True), ("a b", "a -b", True), ("a b", 'a "b', True),
    ("a b", "a c", False), ("a x b", '"a b"', False), ("a b a c", '"a c"', True), ("x", '"" x', True),
])
def test_matches(spark, doc, query, hit):
    assert (find(spark, [("k", doc)], query) == {"k"}) is hit


def test_empty_query_and_table(spark):
    assert find(spark, [("k", "a")], "") == set()
    assert find(spark, [], "a") == set()


def test_phrases_against_a_scan(spark):
    r = random.Random(3)
    docs = [(str(k), " ".join(r.choice("abcd") for _ in range(r.randint(0, 12)))) for k in range(60)]
    for _ in range(6):
        phrase = [r.choice("abcd") for _ in range(r.randint(1, 4))]
        distinct = list(dict.fromkeys(phrase))
        want = {k for k, d in docs if any(d.split()[i : i + len(distinct)] == distinct for i in range(len(d.split())))}
        assert find(spark, docs, f'"{" ".join(phrase)}"') == want


def test_json(spark):
    df = spark.createDataFrame([("k", "b a b")], "key string, data string")
    hits = search.search(index.build_postings(df, "key", "data"), "a b")
    assert search.as_json(hits).first()["json"] == '{"key":"k","tokens":[{"token":"a","positions":"1"},{"token":"b","positions":"0 2"}]}'
    import json

    assert len(json.loads("".join(search.ids_json(hits)))["result"]) == 1 and "".join(search.ids_json(hits.limit(0))) == '{"result":[]}'


def test_filter_reaches_the_scan(spark, tmp_path):
    df = spark.createDataFrame([("k", "b a b")], "key string, data string")
    index.build_postings(df, "key", "data").write.parquet(path := str(tmp_path / "p"))
    plan = search.search(spark.read.parquet(path), "a b")._jdf.queryExecution().executedPlan().toString()
    assert "In(token" in plan.replace("PushedFilters: [", "")


def test_latest(spark):
    rows = spark.createDataFrame([("", "k", 1, "old"), ("", "k", 2, "new"), ("", "j", 1, "only")], "ns string, key string, ts int, data string")
    assert {(r.key, r.data) for r in index.latest_documents(rows).collect()} == {("k", "new"), ("j", "only")}
    assert {r.data for r in index.latest(rows, ["key"]).collect()} == {"new", "only"}
    assert index.latest(rows.where(F.lit(False)), ["key"]).count() == 0
