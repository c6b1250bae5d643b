import pytest


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and white-space texts, ties, repeated rows, and columns whose names operators use inside."""
    long = " ".join(f"w{i % 97} é日{i % 13}" for i in range(30_000))
    rows = [
        (1, "a b c d e f g", "en", "x", 0), (1, "a b c d e f g", "en", "x", 0), (1, "other words under one id", None, "y", 1), (2, None, "en", None, None),
        (None, "a b c d e f g", None, "x", 0), (None, None, None, None, None), (3, "", "fr", "", 5), (4, " \n\t ", "fr", "z", 6), (5, long, "de", "z", 7),
        (6, "line one here\nline two here\nline three here\n" * 3, "en", "x", 8),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string, _id long")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
