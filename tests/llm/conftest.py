import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string, w string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of texts, with extra columns whose names clash with those that operators use inside."""

    def make(texts, langs=None, ids=None):
        ids = ids if ids is not None else list(range(len(texts)))
        langs = langs or ["en"] * len(texts)
        rows = [(i, t, lang, "src0", len(t) if t is not None else None, "x", "y") for i, t, lang in zip(ids, texts, langs)]
        return spark.createDataFrame(rows, DOCS)

    return make


ODD_TEXTS = [None, "", " ", "a", "one two", "é", "\n\n", "a" * 5000, "word " * 3000, "same text here now", "same text here now", "😀 😀", "123 456"]


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Null, empty, blank, tiny and long texts, repeats, no letters, a row without an id."""
    return make_docs(ODD_TEXTS, langs=["en", None] * 6 + ["en"], ids=[*range(len(ODD_TEXTS) - 1), None])
