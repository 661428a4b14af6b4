import public_tokenizers
import pytest


@pytest.fixture(scope="session")
def documents_of(spark):
    """A documents table of (doc_id, text) rows, with a column whose name could clash with those operators make."""

    def make(rows, extra="kept"):
        full = [(d, t, "en", "s", len(t or ""), "x") for d, t in rows]
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {extra} string")

    return make


@pytest.fixture(scope="session")
def tokenizers():
    return public_tokenizers
