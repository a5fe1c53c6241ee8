import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes a documents table, with an extra column that clashes with internal names."""

    def make(texts, sources=None, langs=None, ids=None):
        n = len(texts)
        rows = [
            (ids[i] if ids else i, t, (langs[i] if langs else "en"), (sources[i] if sources else "s0"), len(t or ""), "x")
            for i, t in enumerate(texts)
        ]
        return spark.createDataFrame(rows, DOCS + ", size string") if n else spark.createDataFrame([], DOCS + ", size string")

    return make


ODD = [None, "", " \n\t ", "one", "Two  words", "a a a a a a a a a a a a", "x" * 5000, "café 中文 \U0001f44d", "one", "w " * 30000]


@pytest.fixture
def odd():
    """Texts that are null, blank, short, repeated, long, and not ASCII."""
    return list(ODD)
