import pytest

#: Columns that a table of documents may have besides; their names clash with the operators' own.
CLASHING = "size long, position double, fp long, row string, key string, words string, copy string, parent long, score double, s string, value string"
DOCUMENTS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"


@pytest.fixture(scope="session")
def documents(spark):
    """A table of documents from (doc_id, text, source) rows, with extra columns."""

    def make(rows):
        full = [(i, t, "en", s, None if t is None else len(t), 1, 0.5, 2, "r", "k", "w", "c", 3, 0.1, "s", "v") for i, t, s in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    long = "lorem ipsum dolor " * 40_000
    return [
        (1, "one two three four five six", "a"), (2, "one two three four five six", "a"), (2, "one two three four five six", "a"),
        (3, None, "a"), (4, "", None), (5, " \t\r\n ", "b"), (6, long, "b"), (None, "a row without an id", "c"), (None, None, None),
        (7, "naïve Ünïcode \U0001f600 text’s end", "c"), (8, "word", "c"), (9, "Word", None),
    ]
