import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, a column with a clashing name."""
    long = "word %s the of and " * 4000
    rows = [
        (3, "a b c", "en", "s", 5), (3, "a b c", "en", "s", 5), (None, "null id", None, None, None), (None, None, "en", None, None),
        (7, "", None, "s", 0), (8, None, "de", "s", None), (9, long % tuple(range(4000)), "en", "s", 1), (10, "x" * 30000, "en", "s", 1),
        (3, "other text, same id", "fr", "s", 2), (11, "日本語 é <|endoftext|> don't 12½", None, "t", 1), (12, "%%% 123 \n\t", "en", "t", 1),
    ]
    rows = [r + (1, "x", 2) for r in rows]
    return spark.createDataFrame(rows, DOCS + ", shard int, _part string, length int")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def few_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
