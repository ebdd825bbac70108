import pytest

import __spark_entry__ as entry
from leafmill.llm.oracle import ORACLE
from leafmill.llm.queries import QUERIES
from tests.oracle import connect, rows_of, rows_of_sql


def test_ten_queries_and_the_pipeline():
    assert [int(x[2:].split("_")[0]) for x in QUERIES] == [*range(1, 11)]
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_gives_what_its_sql_gives(spark, sf_dir, name):
    assert rows_of(QUERIES[name](spark, sf_dir)) == rows_of_sql(connect(sf_dir), ORACLE[name])


@pytest.mark.parametrize("name", ["op7_line_dedup", "op9_pseudonyms"])
def test_native_queries_have_no_python(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
