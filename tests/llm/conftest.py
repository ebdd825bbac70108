import pytest

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
#: Nulls, empty and white texts, very long ones, repeated rows, ties, ids that repeat, texts of all scripts.
AWKWARD = [
    (1, "plain text of some words"), (1, "plain text of some words"), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (6, LONG), (None, "no id here"), (None, None),
    (7, "a"), (7, "another text under the same id"), (8, "日本語のテキスト。 😀 ▁ x"), (9, "12345 67890 !!"), (10, "\n\n\n"), (11, "A" * 50_000),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """With extra columns whose names the operators use themselves, full of nulls."""
    rows = [(i, t, None if k % 2 else "en", None if k % 3 else "src", None, None, "x", None) for k, (i, t) in enumerate(AWKWARD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words string, class int").repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def small(documents):
    return [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
