import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.functions import charset, html, text, urls


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("given_text", "words"), [
    ("The cat, the CAT sat.", ["the", "cat", "the", "cat", "sat"]),
    ("it's 3.14 a_b", ["it's", "3.14", "a_b"]),
    ("", []),
    ("Ünïcode École 中文", ["ünïcode", "école", "中", "文"]), ("abc中文def ひらがなカタカナー漢", ["abc", "中", "文", "def", "ひらがな", "カタカナー", "漢"]),
])
def test_tokens(spark, given_text, words):
    assert one(spark, text.tokens(F.col("t")), t=given_text) == words


def test_tokens_of_null(spark):
    assert spark.range(1).select(text.tokens(F.lit(None).cast("string"))).first()[0] is None


def test_distinct_tokens_keep_first_order(spark):
    assert one(spark, text.distinct_tokens(F.col("t")), t="The cat, the CAT sat.") == ["the", "cat", "sat"]


def test_strict_tokens(spark):
    assert one(spark, text.tokens(F.col("t"), text.STRICT_TOKEN), t="__ 2.e it's 1,5 a.b x_y") == ["2", "e", "it's", "1,5", "a.b", "x_y"]


@pytest.mark.parametrize(("t", "grams"), [("abcde", ["abcd", "bcde"]), ("abc", []), ("aaaaa", ["aaaa"]), ("a\nbcd", ["a\nbc", "\nbcd"])])
def test_ngrams(spark, t, grams):
    assert one(spark, text.ngrams(F.col("t")), t=t) == sorted(grams)


def test_ngram_keys_are_eight_bytes(spark):
    assert one(spark, text.ngram_keys(F.col("t")), t="ééééé") == ["é".encode().hex().upper() * 4]


def test_trailing_separator(spark):
    df = spark.createDataFrame([(["x", "y"],), ([],)], "n array<string>")
    assert [r[0] for r in df.select(text.join_trailing(F.col("n"), " ")).collect()] == ["x y ", ""]


def test_text_nodes(spark):
    page = "<title>t</title><script>var a='</p>';</script><style>p{}</style><p>a<b>b</b> &amp;lt; &lt;</p><!-- c --> <P\n>d"
    assert one(spark, html.text_nodes(F.col("h")), h=page) == ["t", "a", "b", "&lt; <", "d"]
    assert one(spark, html.text_nodes(F.col("h")), h="") == []


def test_links(spark):
    page = '<a href="/x">1</a><a>2</a><a class="b" href="/x"><a HREF = "/y">'
    assert one(spark, html.links(F.col("h")), h=page) == ["/x", "/x", "/y"]
    assert one(spark, html.link_set(F.col("h")), h=page) == ["/x", "/y"]


def test_links_in_every_way_of_writing(spark):
    page = """<a href='/one'>1</a><a href=/two>2</a><a href="three.html">3</a><a title="a > b" href="/four?a=1&amp;b=2">4</a><a data-href="/no" class=x HREF = '/five"5'>5</a>
<!-- <a href="/hidden"> --><script>var x = '<a href="/script">';</script><a href=" /six ">6</a><a title='href="/no"'>7</a><a\nhref="/s&#101;ven&#x41;">8</a><abbr href="/no">9</abbr><a href="">10</a>"""
    assert one(spark, html.links(F.col("h")), h=page) == ["/one", "/two", "three.html", "/four?a=1&b=2", '/five"5', "/six", "/sevenA", ""]


def test_references(spark):
    page = "<p>caf&#233; &eacute;t&eacute; &#x1F600; &amp;lt; &hellip; &unknown; &#0; 5 &lt; 6 &NotEqualTilde; a&nbsp;b &amp;</p><p title='a>b'>x</p>"
    assert one(spark, html.text_nodes(F.col("h")), h=page) == ["café été \U0001f600 &lt; … &unknown; \ufffd 5 < 6 ≂̸ a b &", "x"]


def test_word_tokens_and_plain_text(spark):
    page = "<p>One two</p><p>Two</p>"
    assert one(spark, html.word_tokens(F.col("h")), h=page) == ["one", "two", "two"]
    assert one(spark, html.plain_text(F.col("h")), h=page) == "One two Two "


@pytest.mark.parametrize(("url", "parts"), [
    ("http://User@Example.com:8080/a/b?x=1#f", ("http", "example.com", "8080")),
    ("HTTPS://h", ("https", "h", "")),
    ("/rooted", ("", "", "")),
])
def test_url_parts(spark, url, parts):
    assert (one(spark, urls.scheme(F.col("u")), u=url), one(spark, urls.host(F.col("u")), u=url), one(spark, urls.port(F.col("u")), u=url)) == parts


@pytest.mark.parametrize(("link", "want"), [
    ("http://o/z", "http://o/z"), ("//o/z", "http://o/z"), ("/z", "http://h:1/z"), ("?q=2", "http://h:1/a/b?q=2"), ("#f", "http://h:1/a/b?x=1#f"),
    ("c", "http://h:1/a/c"), ("./c?d/../e", "http://h:1/a/c?d/../e"), ("../c", "http://h:1/c"), ("../../../c", "http://h:1/c"), ("c/..", "http://h:1/a/"), ("", "http://h:1/a/b?x=1"), ("/x/./y/../z#f", "http://h:1/x/z#f"),
])
def test_resolve(spark, link, want):
    assert one(spark, urls.resolve(F.col("b"), F.col("l")), b="http://h:1/a/b?x=1#old", l=link) == want


def test_resolve_as_the_standard_library(spark):
    from itertools import product
    from urllib.parse import urljoin

    bases = ["http://h", "http://h/", "https://h/a", "http://h/a/", "http://h/a/b/c?q#f"]
    links = ["".join(p) for n in (1, 2, 3) for p in product(("x", ".", "..", "/", "?y", "#z"), repeat=n)]
    links = [x for x in links if "//" not in x and "..." not in x]
    df = spark.createDataFrame([(b, x) for b in bases for x in links], "b string, l string")
    for r in df.select("b", "l", urls.resolve(F.col("b"), F.col("l")).alias("got")).collect():
        want = urljoin(r.b, r.l)
        if not r.l.startswith("?") or "?" not in r.b:
            assert r.got.rstrip("#") == want.rstrip("#"), (r.b, r.l, r.got, want)


@pytest.mark.parametrize(("url", "passes"), [("http://h/", True), ("http://h:8080/", True), ("http://h:81/", False)])
def test_port_filter(spark, url, passes):
    assert one(spark, urls.allowed_port(F.col("u"), [80, 8080]), u=url) is passes


@pytest.mark.parametrize(("url", "word", "passes"), [("http://h/blog", "/blog", False), ("http://h/news", "/blog", True), ("http://h/x", "x", True), ("http://x/x", "x", False)])
def test_words_filter(spark, url, word, passes):
    assert one(spark, urls.without_words(F.col("u"), [word]), u=url) is passes


def test_domain_filter_needs_a_host():
    with pytest.raises(ValueError):
        urls.in_domain("", None)


def test_text_gate(spark):
    assert one(spark, urls.is_textual(F.col("b")), b="plain text\n") is True
    assert one(spark, urls.is_textual(F.col("b")), b="\x01\x02\x03") is False
    df = spark.createDataFrame([("image/png", "x"), ("text/html", "\x01"), (None, "x")], "c string, b string")
    assert [r[0] for r in df.select(urls.accepts_text(F.col("c"), F.col("b"))).collect()] == [False, True, True]


def test_charsets():
    sample = "съешь ещё этих мягких французских булок, да выпей чаю "
    profiles = charset.train_profiles({c: sample.encode(c) for c in ("utf-8", "koi8-r", "windows-1251")})
    for c in profiles:
        assert charset.detect("ещё мягких булок".encode(c), profiles) == c
    assert charset.detect(b"", profiles) is None
    assert charset.convert("булок".encode("koi8-r"), "koi8-r") == "булок"
    assert charset.convert(b"ab\xffcd", "utf-8") == "abcd"
    assert charset.convert("é".encode()[:1] + b"", "utf-8") == ""
    assert charset.convert(b"plain", "no such charset") == "plain"
    assert charset.convert(None, "utf-8") is None


def test_charset_columns(spark):
    profiles = {"utf-8": np.zeros(65536, np.float32)}
    df = spark.createDataFrame([(b"abc",), (None,)], "d binary")
    found = df.select(charset.detect_charset(F.col("d"), profiles).alias("c"), charset.convert_charset("d", F.lit("utf-8")).alias("t")).collect()
    assert [tuple(r) for r in found] == [("utf-8", "abc"), (None, None)]


@settings(deadline=None, max_examples=50)
@given(st.binary(max_size=40), st.integers(0, 2**31))
def test_murmur_is_a_signed_long(data, seed):
    h = charset.murmur64(data, seed)
    assert -(2**63) <= h < 2**63 and h == charset.murmur64(data, seed)


def test_murmur_of_nothing():
    assert charset.murmur64(b"", 0) == 0
