import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id long, digest string, key string, n int"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, and extra columns with clashing names."""
    long = "word " * 60_000 + "end"
    twin = "one two three four five six seven eight nine ten"
    texts = [(1, twin), (2, twin), (2, twin), (3, None), (4, ""), (5, " \n "), (6, long), (7, "x"), (None, "no id at all, just text"), (8, twin.upper()), (9, "日本語 テキスト 👩‍👩‍👧"), (10, "x" * 5000)]
    rows = [(i, t, None if k % 3 == 0 else "en", None if k % 2 else "s", None, 0.5, 7, "d", None, k) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(1, 1, 0), (2, 1, 0), (2, 1, 0), (6, 0, 1), (7, 0, 1), (9, 1, None), (None, 1, 1), (10, None, 0), (5, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
