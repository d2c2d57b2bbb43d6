import pytest

EDGE_TEXTS = [
    (1, "one two three four five six seven eight nine ten"),
    (2, None),
    (3, ""),
    (4, " \n\t \n"),
    (5, "one two three four five six seven eight nine ten"),
    (5, "one two three four five six seven eight nine ten"),
    (None, "a text without a number, with some words of its own in it"),
    (6, "x"),
    (7, "Été à l'œuvre — naïve façade\nsecond line here, quite long\n\nx"),
    (8, "long " * 30_000 + "end"),
    (9, "second line here, quite longer\nA THIRD ONE!!! | with | bars"),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty, blank, very long and repeated texts, and columns whose names clash with results."""
    rows = [(i, t, "en", "src0", len(t or ""), "a", "b", 1, 2) for i, t in EDGE_TEXTS]
    schema = "doc_id long, text string, lang string, source string, n_chars long, component string, node string, n_words int, n_removed int"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
