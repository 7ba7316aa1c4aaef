from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """DataFrames from rows."""
    def build(rows, schema):
        return spark.createDataFrame(rows, schema).repartition(3)
    return build


@pytest.fixture(scope="session")
def odd_documents(make):
    """NULLs in every column, empty and very long texts, repeated rows, and columns operators use names of."""
    words = " ".join(f"word{i % 977} the of" for i in range(30_000))
    rows = [(1, None, None, None, None, 1, 2), (2, "", "en", "s", 0, 1, 2), (3, words, "en", "s", len(words), 1, 2),
            (4, "same row", "de", "s", 8, 1, 2), (4, "same row", "de", "s", 8, 1, 2), (None, "no id here", "fr", "s", 10, 1, 2),
            (5, " \n\t ", "en", "s", 4, None, None), (6, words, None, "s", len(words), 1, 2)]
    return make(rows, f"{DOCUMENTS}, score int, node int")


@pytest.fixture(scope="session")
def no_documents(make):
    return make([], DOCUMENTS)
