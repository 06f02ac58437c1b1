import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long,"
    " row string, key string, size long, copies int, kept boolean, score double, batch int"
)
PROSE = "the quick brown fox jumps over the lazy dog near the river bank on a sunny day. "


def row(doc_id, text, lang="en", source="a"):
    size = None if text is None else len(text)
    return (doc_id, text, lang, source, size, "r", "k", 7, 3, False, 2.0, 9)


ODD = [
    row(1, None),
    row(2, ""),
    row(3, " \t\n \x0b\x0c\r \n"),
    row(4, "12345 !!! 67"),
    row(5, PROSE * 3 + "\nA shared line of text\n"),
    row(5, PROSE * 3 + "\nA shared line of text\n"),
    row(6, "  a SHARED line of text \nown words here é漢字🙂 ▁ mark\nA shared line of text"),
    row(7, "der schnelle braune Fuchs springt über den faulen Hund", "de", None),
    row(8, "x" * 5000 + " " + "word " * 40000, None, "b"),
    row(9, "one two", None, None),
    row(None, "a shared line of text\nrow without an id", "en", "b"),
    row(10, PROSE * 3 + "\nA shared line of text\n", None, ""),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Null and empty texts, repeated rows, long words, null ids, columns that clash with internal names."""
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
