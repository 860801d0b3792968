import pytest

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, size string, g string"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, columns with clashing names."""
    long_text = "alpha beta gamma delta " * 30_000
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 60),
        (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 60),
        (2, "the QUICK brown fox jumps over the lazy dog near the river bank today", None, "a", None),
        (3, None, "en", None, None), (4, "", "en", "b", 0), (5, " \n\t ", None, None, 3), (6, long_text, "en", "b", len(long_text)),
        (None, "a row without an id but with words in it", "en", "b", 10), (7, "12 34 56", None, "c", 8), (8, "é è ü ñ 漢字", "fr", "é", 9),
        (None, None, None, None, None), (9, "one two", "en", "c", 7), (10, "one  two", "en", "c", 8),
    ]
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
