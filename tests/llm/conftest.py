import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, key double, h int, th string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, and columns whose names the operators use themselves."""
    long = "word " * 5000 + "x" * 20000
    rows = [
        (1, "The cat sat on the mat near the door today.\nAnother line here with some more words.", "en", "a", 80, 1, 0.5, 1, "x"),
        (2, None, None, None, None, None, None, None, None),
        (3, "", "en", "b", 0, 0, 0.0, 0, ""),
        (4, long, "en", "a", len(long), 1, 1.0, 1, "y"),
        (None, "no id but text, and a few more words to read", "en", "b", 10, 1, 1.0, 1, "y"),
        (5, "same text for two ids, word for word the same", "en", "c", 10, 1, 1.0, 1, "y"),
        (6, "same text for two ids, word for word the same", "en", "c", 10, 1, 1.0, 1, "y"),
        (7, "a repeated row", "de", None, 14, 1, 1.0, 1, "y"),
        (7, "a repeated row", "de", None, 14, 1, 1.0, 1, "y"),
        (8, "### $$$ 123 !!!", "en", "a", 15, 1, 1.0, 1, "y"),
        (9, "漢字 と é\x0b😀\t<|endoftext|> ▁x\x1c", "en", "d", 20, 1, 1.0, 1, "y"),
        (10, "\n\n \n", "fr", "d", 4, 1, 1.0, 1, "y"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
