import pytest

TEXT = "doc_id bigint, text string, source string, n_words bigint, Size string, label string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with results."""
    prose = "the quick fox of the house is in a garden and it was on a wall with the cat by the door " * 4
    rows = [
        (1, None, None, 5, "x", None),
        (2, "", "a", None, "x", "l"),
        (3, " \t\n ", "a", 1, None, "l"),
        (4, prose, "b", 1, "x", "l"),
        (4, prose, "b", 1, "x", "l"),
        (5, prose, "b", 2, "y", "l"),
        (None, prose + "tail", "b", 2, "y", None),
        (6, "one", "", 1, "x", "l"),
        (7, "Été " * 30000, "c", 1, "x", "l"),
        (8, "5" * 50000, "c", 1, "x", "l"),
        (9, "é" * 10 + " mail a.b@c.example.org now", "d\U0001f600", 1, "x", "l"),
    ]
    return spark.createDataFrame(rows, TEXT)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], TEXT)


@pytest.fixture(scope="session")
def sample(spark):
    """The given documents of the small table."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
