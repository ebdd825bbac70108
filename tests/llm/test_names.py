"""Operators over a table whose other columns have the names that operators use themselves, and odd ones."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from leafmill.llm import cuckoo, decontaminate, language_id, line_dedup, near_dedup, pseudonyms, quotations, secrets, sentencepiece_sampling, substring_dedup
from leafmill.llm.tables import unused

NAMES = """seed _seed k1 k2 _k1 _k2 h1 h2 id again key at dropped match gap new _pii_match _pii_gap _pii_new _line__k1 _line_dropped _line_key _near_k1 _near_k2
gone1 gone2 class cells group blocks shingles signature language _language lines _lines found _found pieces _pieces spans repository owner value body conv turn row buckets
a.b x`y count n""".split()


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, f"line of text\nThe house {i % 3} of many words stands here a@b.example 2021-02-28", "en", "s", 3) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.concat(F.lit(f"{name}-"), F.col("doc_id")).alias(name) for name in NAMES)).repartition(2)


def others(df):
    names = [f"`{n.replace('`', '``')}`" for n in NAMES]
    return sorted(tuple(r) for r in df.select("doc_id", *names).collect())


@pytest.mark.parametrize("inline_keys", [0, 50_000])
def test_line_dedup(clashing, inline_keys):
    found = line_dedup.dedup_lines(clashing, inline_keys=inline_keys)
    assert others(found) == others(clashing) and found.columns == [*clashing.columns, "line_dedup"]


def test_operators_that_add_a_column(spark, clashing):
    items = spark.createDataFrame([("house 1 of many words stands here", 1)], "text string, item_id long")
    model = language_id.train(clashing)
    for found in (
        sentencepiece_sampling.encode(clashing, into="out"), language_id.identify(clashing, model, into="out"),
        decontaminate.decontaminate(clashing, items, into="out"), pseudonyms.pseudonymise(clashing, "k", into="out"),
    ):
        assert others(found) == others(clashing) and found.columns == [*clashing.columns, "out"]


def test_operators_that_drop_or_judge_rows(clashing):
    kept = near_dedup.drop_near_duplicates(clashing)
    assert kept.columns == clashing.columns and set(others(kept)) < set(others(clashing))
    for found in (near_dedup.near_duplicates(clashing), cuckoo.exact_dedup(clashing), secrets.scan_secrets(clashing), substring_dedup.remove_repeats(clashing)):
        assert sorted(r.doc_id for r in found.collect()) == list(range(12))
    talk = clashing.withColumns({"conv_id": F.lit(1), "turn": F.col("doc_id").cast("long"), "role": F.lit("user")})
    assert sum(len(r.messages) for r in quotations.reply_ordered(talk).collect()) == 12


def test_stages(spark, sf_dir, clashing):
    docs = clashing
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == clashing.columns and docs.count() > 0
    assert pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()


def test_unused_names():
    assert unused(["a", "B"], "a", "b", "c", "a") == ["a_", "b_", "c", "a__"]
