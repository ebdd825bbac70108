import pytest

import __spark_entry__ as entry
from leafmill.plans.oracle import ORACLE
from leafmill.plans.queries import QUERIES
from tests.oracle import connect, rows_of, rows_of_sql

WITH_PYTHON = {"model_stages", "model_summary", "model_reformat", "model_retries", "stitch_stream"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(entry.queries()) >= set(QUERIES) and set(entry.oracle_sql()) >= set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_what_its_sql_gives(spark, duck, sf_dir, name):
    assert rows_of(QUERIES[name](spark, sf_dir)) == rows_of_sql(duck, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WITH_PYTHON))
def test_plan_has_no_python(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["doc_id", "markdown", "n_chars", "n_pages"] and found.count() > 0
