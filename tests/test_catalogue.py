import pytest

from lexmill.plans import catalogue
from tests.oracle import check


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_equals_sql(spark, sf_dir, name):
    check(spark, name, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES.keys() - catalogue.ORACLE_SQL.keys() - {"similarity_model"}))
def test_runs(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_every_oracle_has_a_query():
    assert catalogue.ORACLE_SQL.keys() <= catalogue.QUERIES.keys()


def test_flagship(spark, sf_dir):
    assert catalogue.flagship(spark, sf_dir).count() > 0


def test_bulk_filters_reach_the_scan(spark, sf_dir):
    plan = catalogue.QUERIES["score_confusion"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[-1]
