import pytest

ODD = "doc_id long, text string, lang string, source string, n_chars long, size int, score string, batch int, label string, shard int"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, and names that operators use."""
    long = " ".join(f"w{i % 700}" for i in range(30_000))
    rows = [
        (None, "null id", "en", "s", 1, 1, "x", 1, "l", 1),
        (1, None, None, None, None, None, None, None, None, None),
        (2, "", "en", "s", 0, 1, "x", 1, "l", 1),
        (3, "a b c d e f g", "en", "s", 13, 1, "x", 1, "l", 1),
        (3, "a b c d e f g", "en", "s", 13, 1, "x", 1, "l", 1),
        (4, "A  b\tc\nd e f g ", "fr", "t", 13, 2, "y", 2, "m", 2),
        (5, long, "en", "s", len(long), 1, "x", 1, "l", 1),
        (6, long, "en", "u", len(long), 1, "x", 1, "l", 1),
        (7, "é́ ß 日本   x 😀", "ja", None, 9, 1, "x", 1, "l", 1),
        (3, "another text under one id", "en", "s", 25, 1, "x", 1, "l", 1),
    ]
    return spark.createDataFrame(rows, ODD)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.filter("false")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
