import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_text string, rank int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, a very long one, equal texts, a repeated row and clashing extra columns."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", "en", "a", 35, "x", 1),
        (2, "alpha beta gamma delta epsilon zeta", "en", "a", 35, "x", 1),
        (3, "", "en", "b", 0, None, None),
        (4, None, None, None, None, None, None),
        (5, "  \n\t ", "de", "b", 5, "y", 2),
        (6, long, "en", "a", len(long), "z", 3),
        (7, long + " tail", "en", "a", len(long) + 5, "z", 3),
        (8, "Ünïcode ÄÖ <|endoftext|>     x\u0000y  \r\n\r\n  end ", "de", "c", 9, "q", 4),
        (None, "alpha beta gamma delta epsilon zeta", "en", "a", 35, "x", 1),
        (9, "one two", "en", "a", 7, "x", 1),
        (9, "one two", "en", "a", 7, "x", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id").checkpoint()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
