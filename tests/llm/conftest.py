import pytest

LONG = "wort " * 30_000 + "ende"
EXTRA = "doc_id long, text string, score double, block int, key string, n_tokens int, signature string, kept string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """NULLs in any column, empty and very long texts, equal rows, a shared id,
    and extra columns with the names that operators use inside."""
    texts = [
        (0, "the quick brown fox jumps over the lazy dog again and again until the night falls over the hills far away from here"),
        (1, "the quick brown fox jumps over the lazy dog again and again until the night falls over the hills far away from here"),
        (2, None), (3, ""), (4, " \t\n "), (5, "one two"), (5, "one two"), (6, LONG), (7, LONG), (None, "no id at all"), (None, None),
        (8, "été ñandú\x0bx\r\ny  z\n\n'tis don't <|endoftext|> 😀"), (9, "one two"), (5, "another text of the same id"),
    ]
    rows = [(i, t, 1.5, 7, None, None, "s", None) for i, t in texts]
    return spark.createDataFrame(rows, EXTRA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], EXTRA)
