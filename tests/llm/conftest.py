import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _text string, _row int"

LONG = " ".join(f"word{i % 977}x{i}" for i in range(60_000))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and very long texts, repeated rows and columns whose names could clash."""
    rows = [
        (1, None, "en", "s", 0, "a", "b", 1),
        (2, "", "en", None, 0, None, None, None),
        (None, "no id here but a text of several words", None, "s", 3, "a", "b", 1),
        (3, "one", "en", "s", 3, "a", "b", 1),
        (3, "one", "en", "s", 3, "a", "b", 1),
        (4, LONG, "en", "s", len(LONG), "a", "b", 1),
        (5, " \t\n\v\f\r ", "en", "s", 7, "a", "b", 1),
        (6, "é ü ß 日本語 \U0001f600 mixed text\nwith lines\n\nand  runs   of spaces ", "xx", "s", 1, "a", "b", 1),
    ]
    return spark.createDataFrame(rows, DOC_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
