import datetime

import pytest
from pyspark.sql import functions as F

from lexmill import schemas
from lexmill.engine import SearchEngine
from lexmill.operators.crawl import domain_filter
from lexmill.sources.web import table_fetcher


@pytest.fixture
def engine(spark, tmp_path):
    return SearchEngine(spark, str(tmp_path / "store"), buckets=4)


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "key string, data string")


def test_upload_find_get(spark, engine):
    engine.upload(rows(spark, ("a", "The cat, the CAT sat."), ("b", "a dog and the cat"), ("c", "")), "things")
    assert {r.key for r in engine.find("the cat").collect()} == {"a", "b"}
    assert {r.key for r in engine.find('"cat sat"').collect()} == {"a"}
    assert engine.find("nothing here").isEmpty()
    status, body, ts = engine.get("a")
    assert (status, body) == (200, "The cat, the CAT sat.")
    assert engine.get("a", since=ts + datetime.timedelta(seconds=1))[0] == 304
    assert engine.get("missing")[0] == 404
    assert {r.key for r in engine.iterate("things").collect()} == {"a", "b", "c"}
    assert engine.in_cache("a") and not engine.in_cache("z")
    assert engine.store.read("b")["data"] == "a dog and the cat"
    doc_id = spark.range(1).select(schemas.document_id(F.lit("b"))).first()[0]
    assert engine.store.read_by_id(doc_id)["key"] == "b"
    with pytest.raises(KeyError):
        engine.store.read("z")


def test_upload_replaces(spark, engine):
    engine.upload(rows(spark, ("a", "old words")), "")
    engine.upload(rows(spark, ("a", "new words")), "")
    assert engine.find("old").isEmpty()
    assert [r.key for r in engine.find("words").collect()] == ["a"]
    assert [(r.token, r.score) for r in engine.top_words(1).collect()] == [("new", 1.0)]


def test_find_reads_only_its_buckets(spark, engine):
    engine.upload(rows(spark, ("a", "one two three four five six seven eight")), "")
    plan = engine.find("one")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("PartitionFilters: [isnotnull(bucket", "PartitionFilters: [bucket") or "bucket" in plan


def test_version_is_checked(spark):
    with pytest.raises(Exception, match="format version"):
        schemas.checked(spark.createDataFrame([(3,)], "version int"), 1).collect()


def test_crawl_and_index(spark, engine):
    pages = spark.createDataFrame([("http://h/", '<a href="/b">b</a> <a href="http://o/">o</a>'), ("http://h/b", "<p>leaf word</p>")], "url string, html string")
    engine.add_processor(engine.index_pages)
    engine.add_url_filter(domain_filter("h"))
    seen = engine.crawl(["http://h/"], table_fetcher(pages), lambda d: d.checkpoint(), depth=3)
    assert {r.url for r in seen.collect()} == {"http://h/", "http://h/b"}
    assert [r.key for r in engine.find("leaf").collect()] == ["http://h/b"]
    assert [r.data for r in engine.find_documents("leaf", "text").collect()] == ["leaf word "]
    assert {r.key for r in engine.iterate("h.collection").collect()} == {"http://h/", "http://h/b"}


def test_parsers_retries_and_collections(spark, engine):
    pages = spark.createDataFrame([("http://h/", "see [/b] and [http://o/c]"), ("http://h/b", "leaf"), ("http://o/c", "other")], "url string, html string")
    calls = []

    def flaky(rows):
        calls.append(rows.count())
        if len(calls) == 1:
            raise RuntimeError("once")
        engine.index_pages(rows)

    engine.add_processor(flaky)
    engine.add_parser(lambda body: F.regexp_extract_all(body, F.lit(r"\[([^\]]*)\]"), F.lit(1)))
    seen = engine.crawl(["http://h/"], table_fetcher(pages), lambda d: d.checkpoint(), depth=2)
    assert {r.url for r in seen.collect()} == {"http://h/", "http://h/b", "http://o/c"} and calls[0] == calls[1] == 1 and engine.total == 3
    assert {r.key for r in engine.iterate("h.collection").collect()} == {"http://h/", "http://h/b"}
    assert {r.key for r in engine.iterate("o.collection").collect()} == {"http://o/c"} and "".join(engine.find_ids("leaf")).count('"') == 4
    plan = engine.store.members("h.collection")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_commands(spark, engine, tmp_path, capsys):
    from lexmill import __main__ as cli
    from lexmill.operators import model

    folder = tmp_path / "docs"
    folder.mkdir()
    for i, words in enumerate(["alpha beta gamma delta", "alpha beta gamma", "omega psi chi"]):
        (folder / f"{i}.html").write_text(f"<p>{words}</p>")
    (tmp_path / "pairs").write_text("0\t1\t1\tgamma ray\n1\t2\t0\tbeta\n")
    assert cli.main([str(tmp_path), "upload", "things", str(folder)], engine) == 0
    assert cli.main([str(tmp_path), "find", "alpha", "beta"], engine) == 0 and cli.main([str(tmp_path), "find", "nothing"], engine) == 1
    assert cli.main([str(tmp_path), "get", "2.html", str(tmp_path / "body")], engine) == 0 and (tmp_path / "body").read_text() == "<p>omega psi chi</p>"
    assert cli.main([str(tmp_path), "get", "missing"], engine) == 1 and cli.main([str(tmp_path), "bogus"], engine) == 2
    assert cli.main([str(tmp_path), "overlap", str(folder)], engine) == 0
    assert cli.main([str(tmp_path), "pairs", str(tmp_path / "pairs"), str(folder)], engine) == 0
    out = capsys.readouterr().out
    assert "Found 2 documents" in out and "Stored 2 pairs and 3 documents" in out and "0 1 " in out
    pages = spark.createDataFrame([("http://h/", '<a href="x">b</a> <a href="/blog/1">c</a> <a href="http://h:81/">d</a>'), ("http://h/x", "<p>leaf")], "url string, html string")
    cli.crawl_site(engine, "http://h/", "2", table_fetcher(pages))
    assert "1 http://h/x\nProcessed 2 pages" in capsys.readouterr().out
    picks = model.random_picks(spark.range(50).repartition(4), 200, seed=1)
    assert picks.count() == 200 and picks.distinct().count() > 20 and model.random_picks(spark.range(0), 5).count() == 0
