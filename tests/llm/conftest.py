import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, epoch int, ids string, redacted string, `group` string, key string, size bigint"
LONG = "word " * 60_000 + "end"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns with names of results."""
    texts = [None, "", " \n ", LONG, LONG, "one", "one two", "ünï ▁ \x00 码 😀", "the same words here and there " * 9, "the same words here and there " * 9]
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, len(t or ""), 0.5, 1, "x", "y", "g", "k", 3) for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], rows[5], (None, "no id at all", "en", "s", None, None, None, None, None, None, None, None), (None,) * 12]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")
