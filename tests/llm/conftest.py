import pytest
from pyspark.sql import functions as F

#: Column names that operators might use themselves.
CLASHES = "line at n leaf maybe sha block first second k1 k2 drops raw new word tokens row fp node spans items score key hot _sha _maybe _k1 _k2 _drops _has _new _score _gone _spans _words _items".split()

LONG = "lorem ipsum dolor sit amet consectetur " * 20_000


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Documents with every oddity: nulls, empty and very long texts, repeated rows, clashing columns."""
    rows = [
        (1, "alpha beta gamma delta"), (2, None), (3, ""), (4, "  \t\n "), (5, "alpha beta gamma delta"), (5, "alpha beta gamma delta"),
        (None, "no id here"), (None, None), (6, LONG), (7, LONG), (8, "ünïcødé — 中文 ́x Σίσυφος <|endoftext|> \U0001f600"), (9, "x"), (9, "y"), (10, "nul \x00 inside"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("doc_id", "text", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where(F.lit(False))


def native(df) -> bool:
    """Whether the plan stays out of Python."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any(x in plan for x in ("Python", "Pandas", "Arrow", "MapInArrow"))
