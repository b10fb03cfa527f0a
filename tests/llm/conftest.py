import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text, lang, source, n_chars) with the edge cases every operator meets."""
    def make(texts, sources=None, ids=None):
        rows = [((ids or range(len(texts)))[i], t, "en", (sources or ["s"] * len(texts))[i], None if t is None else len(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return make


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
