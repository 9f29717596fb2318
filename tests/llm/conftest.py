"""Edge rows that every operator is run on."""

import pytest


@pytest.fixture
def odd_documents(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows and clashing extra columns."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog and then runs home again", "en", "a", 68, 1.0, "x"),
        (1, "the quick brown fox jumps over the lazy dog and then runs home again", "en", "a", 68, 1.0, "x"),
        (2, "", "en", "a", 0, None, None),
        (3, None, None, None, None, None, None),
        (4, " \t\n ", "de", "b", 4, 2.0, "y"),
        (5, "é🎉 " * 20000 + "end", "fr", "b", 60003, 3.0, "z"),
        (None, "a row without an id that has a few words of its own", "en", "c", 51, 4.0, "w"),
        (6, "x" * 50000, "en", "c", 50000, 5.0, "v"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string"
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def no_documents(odd_documents):
    return odd_documents.limit(0)


@pytest.fixture
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
