import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, label int, row string, key string, block string"

TEXTS = [
    None,
    "",
    " ",
    "\n\n",
    "one",
    "one two",
    "one two three",
    "One TWO  three\tfour\n five",
    "The cat sat on the mat.\nshared line\nAnother line. idiot " * 30,
    "shared line\n SHARED LINE \n\nunique one",
    "ä" * 5000,
    "x " * 20000,
    "Straße ΑΣ İ é 漢字 😀 <|endoftext|> don't x y\x1cz",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties and repeated rows, and extra columns whose names an operator might use."""
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(100 + k, "shared line\n doc %d\nmore" % k) for k in range(12)] + [(None, "null id"), (None, None), (3, TEXTS[8]), (3, TEXTS[8])]
    return spark.createDataFrame([(i, t, "en" if t else None, None, len(t) if t else None, "f", 1, "r", "k", "b") for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
