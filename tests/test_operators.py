import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import crawl, model, ordered, score, similarity, tfidf
from lexmill.sources import readers
from lexmill.sources.web import table_fetcher
from lexmill.streaming import pipeline


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_frequencies(spark):
    tf = tfidf.term_freq(docs(spark, "a a b c d e f g h i"), "doc_id", "text")
    row = tfidf.frequencies(tf, "doc_id").where("token = 'a'").first()
    assert row.freq == pytest.approx(0.2) and row.smoothed == pytest.approx(3 / 19)
    assert tfidf.count_of(tf, docs(spark, "a a b c d e f g h i", "z"), "doc_id", "a").orderBy("doc_id").collect() == [(0, 2), (1, 0)]


def test_top_words_break_ties_by_word(spark):
    tf = tfidf.term_freq(docs(spark, "b a c", "c"), "doc_id", "text")
    top = tfidf.top_words(tf, tfidf.doc_freq(tf), "doc_id", 2).where("doc_id = 0").orderBy("rank")
    assert [(r.token, r.score) for r in top.collect()] == [("a", 1.0), ("b", 1.0)]


def test_consecutive_pairs_over_buckets(spark):
    ids = sorted(random.Random(1).sample(range(1000), 120))
    df = spark.createDataFrame([(i,) for i in ids] + [(None,), (ids[0],)], "n long")
    want = list(zip(ids, ids[1:], strict=False))
    assert sorted(tuple(r) for r in ordered.consecutive_pairs(df, "n", width=50).collect()) == want


def balanced(labels):
    out, p, n = [], 0, 0
    for k, positive in enumerate(labels):
        if positive:
            p += 1
            out.append(k)
        elif n < 2 * p:
            n += 1
            out.append(k)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_balance_equals_the_loop(spark, seed):
    r = random.Random(seed)
    labels = [r.random() < 0.25 for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(labels)), "n long, y boolean")
    assert sorted(x.n for x in ordered.balance_classes(df, "n", F.col("y"), width=17).collect()) == balanced(labels)


def test_balance_example(spark):
    df = spark.createDataFrame([(k, c == "+") for k, c in enumerate("-+---+")], "n long, y boolean")
    assert sorted(x.n for x in ordered.balance_classes(df, "n", F.col("y")).collect()) == [1, 2, 3, 5]


def test_learn_pairs(spark):
    lines = ["1\t2\t0\tq", "1\t2\t3\ta\tb", "4\t5\t1\t", "bad", "7\t8\t1\tz"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")
    assert [tuple(r)[1:] for r in similarity.learn_pairs(df).orderBy("line_no").collect()] == [(1, 2, -1, "q"), (1, 2, 1, "b")]
    assert similarity.learn_pairs(df, most=1).count() == 1


def test_overlap(spark):
    df = spark.createDataFrame([(list(range(100)), list(range(49, 149))), (list(range(100)), list(range(50, 150))), ([], [1])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(similarity.overlap_percent(F.col("a"), F.col("b"))).collect()] == [51, 50, None]


def test_pair_features(spark):
    pairs = spark.createDataFrame([(0, 0, 1, 1, "bcde"), (1, 0, 9, 1, "x")], "line_no long, doc1 long, doc2 long, label int, request string")
    rows = similarity.pair_features(pairs, docs(spark, "abcdef", "bcdefg"), "doc_id", "text").collect()
    assert len(rows) == 1 and tuple(rows[0])[5:] == (3, 3, 2, 1, 1, True)


def test_scores(spark):
    rows = [(True, True)] * 2 + [(False, True), (True, False), (None, True)]
    counts = score.confusion(spark.createDataFrame(rows, "a boolean, p boolean"), F.col("a"), F.col("p"))
    assert tuple(counts.first()) == (2, 1, 0, 1)
    assert tuple(score.precision_recall(counts).first()) == pytest.approx((2 / 3, 2 / 3, 2 / 3))
    assert score.success_percent(counts).first()[0] == 50
    none = score.confusion(spark.createDataFrame([], "a boolean, p boolean"), F.col("a"), F.col("p"))
    assert tuple(score.precision_recall(none).first()) == (None, None, None)


def test_model_round_trip(spark, tmp_path):
    r = random.Random(5)
    rows = [(k, 1 if s > 50 else -1, 100, 100, s, 10, s // 20, True) for k, s in enumerate(r.randint(0, 100) for _ in range(120))]
    features = spark.createDataFrame(rows, "line_no long, label int, n_first int, n_second int, n_shared int, n_request int, n_shared_request int, valid boolean")
    trained = model.train(features, folds=2, regularisations=(0.001,))
    assert model.evaluate(trained, features).first()["f1"] > 0.9
    model.save(trained, path := str(tmp_path / "m"))
    assert model.evaluate(model.load(path), features).first() == model.evaluate(trained, features).first()


def test_plan_of_a_frontier(spark):
    urls = spark.createDataFrame([("old",), ("same",), ("new",), ("none",)], "url string")
    cache = spark.createDataFrame([("old", 1), ("same", 2), ("new", 3)], "key string, s int").select("key", F.timestamp_seconds("s").alias("ts"))
    found = crawl.plan(urls, cache, F.timestamp_seconds(F.lit(2)))
    assert {r.url: r.action for r in found.collect()} == {"old": "revalidate", "same": "skip", "new": "skip", "none": "download"}


def test_crawl(spark):
    pages = {"http://h/": '<a href="/a">.</a><a href="/">self</a><a href="mailto:x">m</a><a href="http://o/">o</a>', "http://h/a": '<a href="/b">.</a>', "http://h/b": '<a href="/">.</a>'}
    table = spark.createDataFrame(list(pages.items()), "url string, html string")
    cache = spark.createDataFrame([], "key string, ts timestamp, data string")
    seen = crawl.crawl(spark.createDataFrame([("http://h/",)], "url string"), table_fetcher(table), cache, F.current_timestamp(), lambda d: d.checkpoint(), [crawl.domain_filter("h")], 5)
    assert {tuple(r) for r in seen.collect()} == {("http://h/", 0), ("http://h/a", 1), ("http://h/b", 2)}


def test_not_modified_keeps_the_cached_body(spark):
    replies = spark.createDataFrame([("u", "u", 304, None), ("v", "v", 200, "new")], "request_url string, url string, code int, body string")
    cache = spark.createDataFrame([("u", "held"), ("v", "held")], "key string, data string")
    assert {r.url: r.body for r in crawl.with_cached_bodies(replies, cache).collect()} == {"u": "held", "v": "new"}


def test_stored_under_both_urls(spark):
    replies = spark.createDataFrame([("a", "b", "x"), ("c", "c", "y")], "request_url string, url string, body string")
    assert sorted(tuple(r) for r in crawl.stored(replies).collect()) == [("a", "x"), ("b", "x"), ("c", "y")]


def test_readers(spark, tmp_path):
    (tmp_path / "1.html").write_text("<p>a</p>")
    (tmp_path / "x.html").write_text("no number")
    (tmp_path / "2.bin").write_bytes(bytes(range(32)) * 10)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "3.html").write_text("below")
    assert {r.name for r in readers.directory(spark, str(tmp_path)).collect()} == {"1.html", "x.html", "2.bin"}
    assert {r.name for r in readers.text_files(spark, str(tmp_path)).collect()} == {"1.html", "x.html"}
    assert [tuple(r) for r in readers.html_documents(spark, str(tmp_path)).collect()] == [(1, "<p>a</p>")]
    with pytest.raises(Exception, match="not a text file"):
        readers.text_files(spark, str(tmp_path), strict=True).collect()
    (tmp_path / "pairs.tsv").write_text("1\t2\t1\tq\n3\t4\t0\tr\nbad\n5\t6\t1\ts\n")
    assert [(r.doc1, r.label) for r in readers.pair_file(spark, str(tmp_path / "pairs.tsv")).collect()] == [(1, 1), (3, -1)]


def test_statuses(spark):
    df = spark.createDataFrame([(True, 5, 5), (True, 5, 4), (False, 5, 4), (True, 5, None)], "f boolean, t int, s int")
    got = df.select(readers.get_status(F.col("f"), F.timestamp_seconds("t"), F.timestamp_seconds("s"))).collect()
    assert [r[0] for r in got] == [304, 200, 404, 200]


def test_pipeline_first_write_wins(spark):
    df = pipeline.set_first(pipeline.set_first(spark.range(1), "k", F.lit(1)), "k", F.lit(2))
    assert df.first()["k"] == 1


def test_feature_stage(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), ([],), (["One one"],)], "text array<string>")
    assert [[tuple(x) for x in r.terms_frequencies] for r in pipeline.feature_stage(df).collect()] == [[("a", 1), ("b", 2)], [], [("One one", 1)]]
    assert [tuple(x) for x in pipeline.feature_stage(df, words=True).collect()[2].terms_frequencies] == [("one", 2)]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([("u1", "<p>a</p><p>a</p>", {}), ("u2", "", {}), ("u3", None, {})], "url string, body string, extra map<string,string>")
    pipeline.push(rows, str(tmp_path / "in"))
    for _ in range(2):  # nothing comes twice
        pipeline.run_stream(pipeline.messages(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    want = pipeline.run_batch(rows)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_recover(spark):
    received = spark.createDataFrame([("a", "<p>x</p>"), ("b", None), ("c", "y")], "url string, body string")
    done = spark.createDataFrame([("c",)], "url string")
    assert {r.url: r.status for r in pipeline.recover(received, done).collect()} == {"a": "s", "b": "f"}
    with pytest.raises(ValueError):
        pipeline.recover(received, done, parallel=0)


def test_crawled_pages_feed_the_stream(spark, tmp_path):
    replies = spark.createDataFrame([("u", "u", 200, "text/html", "<p>a</p>", None)], "request_url string, url string, code int, content_type string, body string, error string")
    pipeline.feed(replies, str(tmp_path / "in"))
    pipeline.run_stream(pipeline.messages(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [(r.url, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("u", ["a"])]


def test_normalizer_falls_back(spark):
    from lexmill.functions.normalize import normalized

    df = spark.createDataFrame([("a",), ("b",)], "t string")
    assert [r.t for r in normalized(df, "t", lambda c: F.when(c == "a", "A")).collect()] == ["A", "b"]
    assert normalized(df, "t", None) is df
