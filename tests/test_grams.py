import pytest
from pyspark.sql import functions as F

from lexmill.functions import grams, text
from lexmill.operators import similarity

TEXTS = ["", "abc", "abcd", "abcdabcd", "a\U0001f600bcd\U0001f600e", "é中文🙂 " * 30 + "Ω", "x" * 50, "中文字符中文字符", "née — ça", "".join(map(chr, range(0x20, 0x3000, 7)))]


def expected(t, n=4):
    return sorted({t[i : i + n] for i in range(len(t) - n + 1)})


@pytest.mark.parametrize("n", [1, 3, 4, 9])
def test_lists_equal_slices_of_code_points(spark, n):
    df = spark.createDataFrame([*enumerate(TEXTS), (99, None)], "k long, t string")
    got = {r.k: (r.g, r.h) for r in df.select("k", text.ngrams(F.col("t"), n).alias("g"), text.ngram_keys(F.col("t"), n).alias("h")).collect()}
    assert got.pop(99) == (None, None)
    for k, t in enumerate(TEXTS):
        assert got[k][0] == expected(t, n)
        assert got[k][1] == sorted({g.encode()[:8].hex().upper() for g in expected(t, n)})


def test_counts_equal_sets(spark):
    rows = [(i, a, b, c) for i, (a, b, c) in enumerate((a, b, c) for a in TEXTS for b in TEXTS[3:6] for c in (TEXTS[3], "中文字符中"))]
    df = spark.createDataFrame([*rows, (-1, None, "abcd", "abcd")], "k long, a string, b string, c string")
    for n in (4, 7):
        got = {r.k: tuple(r)[1:] for r in grams.with_counts(df, ["k"], "a", "b", "c", n).collect()}
        assert got.pop(-1) == (None, len(expected("abcd", n)), None, len(expected("abcd", n)), None)
        for k, *texts in rows:
            a, b, c = (set(expected(t, n)) for t in texts)
            assert got[k] == (len(a), len(b), len(a & b), len(c), len(a & b & c))


def test_pairs_shuffle_texts_and_no_grams(spark):
    docs = spark.createDataFrame([(0, "abcdef"), (1, "bcdefg"), (2, None)], "doc_id long, text string")
    pairs = spark.createDataFrame([(0, 0, 1, 1, "bcde"), (1, 1, 2, 1, "bcde")], "line_no long, doc1 long, doc2 long, label int, request string")
    found = similarity.pair_features(pairs, docs, "doc_id", "text")
    assert {r.line_no: tuple(r)[5:] for r in found.collect()} == {0: (3, 3, 2, 1, 1, True), 1: (3, None, None, 1, None, None)}
    joined = found._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[1]  # below the joins
    assert "regexp_extract_all" not in joined and "ArrowEvalPython" not in joined
