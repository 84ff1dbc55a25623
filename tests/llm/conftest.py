import pytest

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

#: Rows with nulls, empty texts, repeated rows, and columns whose names operators might use themselves.
ODD = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "b", 5, "x", 1, 2),
    (2, None, None, None, None, None, None, None),
    (3, "", "fr", "a", 0, "", 0, 0),
    (None, "no id here but some words to read", "en", None, 1, None, 3, 3),
    (4, "One\n\nTwoé \U0001f600 " + "long" * 3000, "de", "a", 7, "y", 9, 9),
    (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "b", 5, "x", 1, 2),
    (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "b", 5, "x", 1, 2),
    (6, " \t\n ", "en", "\U0001f600", 4, "z", 0, 0),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size int, spans int"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{MIDDLE}/documents.parquet")
