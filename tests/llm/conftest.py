from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents from (id, text) pairs, with the other columns filled in and one whose name an operator might use."""
    def make(rows, **extra):
        filled = [(i, t, "en", None if i is None else f"src{i % 3}", None if t is None else len(t), *extra.values()) for i, t in rows]
        return spark.createDataFrame(filled, DOCS + "".join(f", {name} string" for name in extra))

    return make
