import base64

import pytest
from pyspark.sql import functions as F

from leafmill.functions import budget, prompts, retry
from leafmill.functions import text as X
from leafmill.operators.model import cut_summary, extract_prompt_text, fallback_text, sentinel_text


def column(spark, rows, expression, kind="string"):
    return [r.x for r in spark.createDataFrame([(x,) for x in rows], f"s {kind}").select(expression(F.col("s")).alias("x")).collect()]


def test_strip_is_unicode(spark):
    rows = ["  a b\x85", "　x　", "\x1c\t", " y ", None, ""]
    assert column(spark, rows, X.strip) == ["a b", "x", "", "y", None, ""]


def test_text_tokens(spark):
    cases = {"": 0, "hello world!": 3, "你好世界中": 2, "你好 world": 3, "Ａ": 1, None: 0}
    assert column(spark, list(cases), X.estimate_text_tokens) == list(cases.values())


def test_strip_reasoning(spark):
    cases = {"before<think>scratch</think>after": "beforeafter", "<think>a</think>x<think>b\nc</think>y": "xy", " plain ": "plain", "<think>open": "<think>open", None: ""}
    assert column(spark, list(cases), X.strip_reasoning) == list(cases.values())


@pytest.mark.parametrize("most", [-1, 0, 1, 43, 44, 45, 60, 200])
def test_truncate_summary(spark, most):
    rows = ["", "short", "word " * 30, "一" * 120, " " * 100 + "end"]
    found = column(spark, rows, lambda s: X.truncate_summary(s, most))
    assert found == [cut_summary(x, most) for x in rows]
    assert most <= 0 or all(len(x) <= most for x in found)


def test_smart_join(spark):
    df = spark.createDataFrame([("a ", " b"), ("(", "b"), ("中", "b"), ("a", "中"), ("", "b"), ("a", " "), ("𠀀", "x")], "a string, b string")
    assert [r.x for r in df.select(X.smart_join(F.col("a"), F.col("b")).alias("x")).collect()] == ["a b", "(b", "中b", "a中", "b", "a", "𠀀x"]


def test_open_rows_and_headers(spark):
    assert column(spark, ["| a | b", "| a |", "a | b", "  | x  ", ""], X.is_open_row) == [True, False, False, True, False]
    assert column(spark, ["h\n|---|---|\nrow", "h\n|---|---|", "a\nb\nc"], X.without_repeated_header) == ["row", "h\n|---|---|", "a\nb\nc"]


def test_data_url_has_no_line_breaks(spark):
    content = bytes(range(256)) * 3
    df = spark.createDataFrame([(bytearray(content),)], "b binary")
    assert df.select(X.data_url(F.col("b")).alias("x")).first().x == "data:image/jpeg;base64," + base64.b64encode(content).decode()


def test_image_references(spark):
    rows = [("/a", bytearray(b"abc"), None), ("/a", bytearray(b"abc"), "look"), ("/a", None, "look"), ("/a", None, None), ("https://x", None, "look"), ("data:image/png;base64,QQ==", None, None), ("", None, None)]
    df = spark.createDataFrame(rows, "u string, b binary, a string")
    assert [r.x for r in df.select(X.image_reference(F.col("u"), F.col("b"), F.col("a")).alias("x")).collect()] == [
        "VISION_IMAGE:image/jpeg:YWJj", "look\nVISION_IMAGE:image/jpeg:YWJj", "look", "(could not inline image at /a)", "look", "VISION_IMAGE:image/png:QQ==", "(could not inline image at )",
    ]


def test_fallback_and_sentinel(spark):
    layers = ["text ", "", " \n", None, "a\nb"]
    assert column(spark, layers, X.text_layer_fallback) == [fallback_text(x or "") for x in layers]
    assert column(spark, [3], X.fallback_sentinel, "int") == [sentinel_text(3)]
    assert column(spark, [sentinel_text(3), "  " + sentinel_text(12), "real", "", None], X.is_real_extract) == [False, False, True, False, False]


def test_image_tokens(spark):
    assert column(spark, [0, 1, 3, 4, None, 184_000], budget.estimate_image_tokens, "long") == [1, 2, 2, 3, 0, 70096]


def plan(ctx, persona, fixed, size, w, h, target=1536, least=768, safety=0.85):
    """The search restated plainly."""
    limit = int(ctx * safety)
    room, tokens = max(0, limit - persona - fixed), lambda n: max(1, -(-((n + 2) // 3 * 4) * 2 // 7))
    at = lambda s, side: max(1024, int(size * (s / side) ** 2)) if side > 0 and size > 0 else size
    own = tokens(size) if size > 0 else 0
    side = max(w, h)
    if own <= room:
        return persona + fixed + own, limit, True, target
    if side <= least:
        return persona + fixed + own, limit, False, side
    low, high = least, side
    while high - low > 4:
        mid = (low + high) // 2
        low, high = (mid, high) if tokens(at(mid, side)) <= room else (low, mid)
    total = persona + fixed + tokens(at(low, side))
    return total, limit, total <= limit, low


def test_plan_for_image(spark):
    import random

    r = random.Random(5)
    cases = [(r.choice([2000, 9000, 60000]), r.randint(0, 500), r.randint(0, 9000), r.choice([0, 1, 900, r.randint(1, 10**6)]), r.randint(1, 4000), r.randint(1, 4000)) for _ in range(500)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, c long, p long, f long, b long, w int, h int")
    found = {x.i: x.d for x in df.select("i", budget.plan_for_image(*map(F.col, "cpfbwh")).alias("d")).collect()}
    for i, case in enumerate(cases):
        assert tuple(found[i][:4]) == plan(*case), case
    for wrong in ({"safety": 0}, {"target": 0}, {"least": 2000}):
        with pytest.raises(ValueError):
            budget.plan_for_image(*map(F.col, "cpfbwh"), **wrong)


def test_waits(spark):
    df = spark.createDataFrame([(7, 2.0, 900.0), (6, 2.0, 7.0), (1, 1.0, 9.0)], "n int, a double, m double")
    found = [list(r.x) for r in df.select(retry.waits(F.col("n"), F.col("a"), F.col("m")).alias("x")).collect()]
    assert found == [[2, 2, 4, 6, 10, 16], [2, 2, 4, 6, 7], []]


def test_prompts_match_their_string_form(spark):
    rows = [("a.png", "hint", "sum"), ("b.png", " ", ""), ("c.png", None, "x" * 200)]
    df = spark.createDataFrame(rows, "p string, h string, s string")
    found = [r.x for r in df.select(prompts.extract_prompt(F.col("p"), F.col("h"), F.col("s"), 60).alias("x")).collect()]
    assert found == [extract_prompt_text(p, h or "", s, 60) for p, h, s in rows]
