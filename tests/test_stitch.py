import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.operators.pages import page_split
from leafmill.operators.stitch import boundaries, stitch
from leafmill.operators.stitcher import stitch_pages
from tests.plain import stitched

PARTS = ["word", "ends here.", "# Head", "## A\nbody", "| a | b |", "| a | b", "|---|---|", "| h | k |\n|---|---|\n| 1 | 2", "- item", "1. one", "> q", "```", "中文", "中", "open (", "「", "x ", "  lead", "trail  ", "　", "#x", "line\nline", "end!", "a|", "| 1 |\n| 2 | text"]
SEPARATORS = ["\n\n", "\n", "\n \n", "\n \n", " "]

CASES = {
    "latin": (["shall be", "connected"], "shall be connected"),
    "cjk": (["电动汽车应通过检测点3", "电压状态来识别"], "电动汽车应通过检测点3电压状态来识别"),
    "cjk to latin": (["阶段", "A.3.6.1 describes"], "阶段A.3.6.1 describes"),
    "terminated": (["First paragraph ends here.", "Second paragraph starts fresh."], "First paragraph ends here.\n\nSecond paragraph starts fresh."),
    "heading": (["Some body text.\n\n# A.4 New Section", "This belongs to section A.4."], "Some body text.\n\n# A.4 New Section\n\nThis belongs to section A.4."),
    "list item": (["- First item gets cut", "off at the page boundary.\n- Second item."], "- First item gets cut off at the page boundary.\n- Second item."),
    "new list": (["Intro paragraph not terminated", "- First list item\n- Second list item"], "Intro paragraph not terminated\n\n- First list item\n- Second list item"),
    "open row": (["| 1 | 2 | 3 |\n| 4 | 5 | 6", "| 7 | 8 | 9 |"], "| 1 | 2 | 3 |\n| 4 | 5 | 6 |\n| 7 | 8 | 9 |"),
    "repeated header": (["| a | b |\n|---|---|\n| 1 | 2", "| a | b |\n|---|---|\n| 3 | 4 |"], "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |"),
    "blank page": (["shall be", " \n ", "connected"], "shall be connected"),
    "several blocks": (["Before charging, the connector shall be", "connected and locked.\n\nNew para here."], "Before charging, the connector shall be connected and locked.\n\nNew para here."),
    "closed table and prose": (["| a | b |\n|---|---|\n| 1 | 2 |", "Next paragraph"], "| a | b |\n|---|---|\n| 1 | 2 | Next paragraph"),
    "nothing": (["", None], ""),
}


def frame(spark, documents):
    rows = [(i, k + 1, x) for i, pages in enumerate(documents) for k, x in enumerate(pages)]
    random.Random(7).shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, page_number int, markdown string").repartition(3)


def texts(df):
    return {r.doc_id: r.markdown for r in df.collect()}


def test_cases(spark):
    found = texts(stitch(frame(spark, [pages for pages, _ in CASES.values()])))
    assert found == {i: expected for i, (_, expected) in enumerate(CASES.values())}


def test_off_keeps_blank_pages(spark):
    assert texts(stitch(frame(spark, [["para one.", "", "para two."]]), "off")) == {0: "para one.\n\n---\n\n\n\n---\n\npara two."}


def test_compat_loses_the_joined_block(spark):
    pages = frame(spark, [CASES["several blocks"][0]])
    assert texts(stitch(pages, "heuristic_compat")) == {0: "New para here."}


def fuzz(n=600, seed=3):
    r = random.Random(seed)
    page = lambda: "".join(r.choice(PARTS) + r.choice(SEPARATORS) for _ in range(r.randint(0, 4)))
    return [[page() for _ in range(r.randint(1, 7))] for _ in range(n)]


@pytest.mark.parametrize("mode", ["heuristic", "heuristic_compat"])
def test_strategies_agree_on_random_pages(spark, mode):
    documents = fuzz()
    expected = {i: stitched(x, mode.endswith("compat")) for i, x in enumerate(documents)}
    pages = frame(spark, documents)
    assert texts(stitch(pages, mode)) == expected
    assert texts(stitch(pages, mode, strategy="pandas")) == expected


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS + SEPARATORS), max_size=6).map("".join), max_size=6), st.booleans())
def test_python_stitcher(pages, compat):
    assert stitch_pages(pages, compat) == stitched(pages, compat)


def test_no_text_is_lost_without_tables(spark, documents):
    pages = page_split(documents.where("not contains(text, '|')"), 400, double_breaks=True)
    squeezed = lambda x: "".join(x.split())
    whole = {r.doc_id: squeezed(r.text) for r in documents.collect()}
    for doc_id, text in texts(stitch(pages)).items():
        assert squeezed(text) == whole[doc_id]


def test_plan_is_native_with_one_shuffle(spark, documents):
    plan = stitch(page_split(documents))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert plan.count("Exchange") == 1


def test_boundaries(spark):
    found = {(r.doc_id, r.page_number): r.kind for r in boundaries(frame(spark, [CASES["latin"][0], CASES["terminated"][0], CASES["open row"][0], CASES["blank page"][0]])).collect()}
    assert found == {(0, 1): "first", (0, 2): "text", (1, 1): "first", (1, 2): "new", (2, 1): "first", (2, 2): "table", (3, 1): "first", (3, 3): "text"}


def test_boundaries_look_at_each_page_once(spark, documents):
    plan = boundaries(page_split(documents))._jdf.queryExecution().optimizedPlan().toString()
    whole = stitch(page_split(documents))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= whole.count("split(") and plan.count("RLIKE") <= whole.count("RLIKE")


def test_unknown_mode(spark, documents):
    with pytest.raises(ValueError):
        stitch(page_split(documents), "other")
