import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from leafmill.operators import pages
from leafmill.operators.pages import PageSpecError, parse_page_spec, resolve_pages

GOOD = {"3": [3], "1-5": [1, 2, 3, 4, 5], "1-5,8,11-13": [1, 2, 3, 4, 5, 8, 11, 12, 13], "1-5,1-3": [1, 2, 3, 4, 5], " 1 - 5 , 8 ": [1, 2, 3, 4, 5, 8], "9,2": [9, 2], "1-10000": list(range(1, 10001))}
BAD = ["", "abc", "0", "-3", "5-3", "3-", "-5", "1-5,abc", "1.5", "1,,3", "1-99999", "0-4", " ", "1-10001"]


@pytest.mark.parametrize("spec", GOOD)
def test_good_specs(spec):
    assert parse_page_spec(spec) == GOOD[spec]


@pytest.mark.parametrize("spec", BAD)
def test_bad_specs(spec):
    with pytest.raises(PageSpecError):
        parse_page_spec(spec)


def test_specs_as_a_column(spark):
    df = spark.createDataFrame([(x,) for x in [*GOOD, *BAD, None]], "s string")
    assert [r.x for r in df.select(pages.spec_pages(F.col("s")).alias("x")).collect()] == [*GOOD.values(), *[None] * (len(BAD) + 1)]


def test_resolve():
    assert resolve_pages([5, 1, 1], 5) == [1, 5]
    for spec, total in (([1], 0), ([6, 7], 5), ([0], 5)):
        with pytest.raises(PageSpecError):
            resolve_pages(spec, total)


def test_selection_and_missing(spark):
    rows = spark.createDataFrame([(d, p) for d in (1, 2, 3) for p in range(1, 6)], "doc_id int, page_number int")
    specs = spark.createDataFrame([(1, "2-3"), (2, "5,1")], "doc_id int, spec string")
    key = lambda df: sorted((r.doc_id, r.page_number) for r in df.collect())
    chosen = pages.select_pages(rows, specs)
    assert key(chosen) == [(1, 2), (1, 3), (2, 1), (2, 5)]
    assert key(pages.missing_pages(chosen, rows.where("page_number < 3"))) == [(1, 3), (2, 5)]
    bad = pages.pages_out_of_range(spark.createDataFrame([(1, "9,7,1")], "doc_id int, spec string"), spark.createDataFrame([(1, 5)], "doc_id int, total int"))
    assert [tuple(r) for r in bad.collect()] == [(1, 7)]
    with pytest.raises(PySparkException):
        pages.select_pages(rows, spark.createDataFrame([(1, "x")], "doc_id int, spec string")).collect()


def test_split_of_edges(spark):
    df = spark.createDataFrame([(1, "a" * 801), (2, ""), (3, None), (4, "𠀀" * 401)], "doc_id int, text string")
    assert {(r.doc_id, r.page_number): len(r.markdown) for r in pages.page_split(df).collect()} == {(1, 1): 400, (1, 2): 400, (1, 3): 1, (4, 1): 400, (4, 2): 1}
