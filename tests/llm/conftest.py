import pytest

LONG = "lorem ipsum dolor " * 40_000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names clash."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "x", "a", 1),
        (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "x", "a", 1),
        (2, "The quick  brown fox jumps over\nthe lazy dog near the river bank today.", "en", None, "b", None),
        (None, None, None, None, None, None),
        (3, None, "en", "y", "c", 3),
        (4, "", None, "y", "d", 4),
        (5, " \t\n ", "de", "y", None, 5),
        (None, "a text without an id", "en", "y", "e", 6),
        (6, LONG, "la", "y", "f", 7),
        (7, "12 345 !!! ---", "en", "y", "g", 8),
        (8, "word", "en", "y", "h", 9),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, key string, node string, word long")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("1 = 0")
