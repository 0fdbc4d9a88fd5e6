"""Small tables with the awkward rows that every operator has to stand."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "th string, row string, gone string, key string, n long, h long, component_id long, digest string, rule string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) pairs, with columns whose names the operators use themselves."""

    def make(pairs, lang="en"):
        rows = [(i, t, lang, None, len(t) if t is not None else None, *[None] * 9) for i, t in pairs]
        return spark.createDataFrame(rows, f"{SCHEMA}, {CLASHING}")

    return make


@pytest.fixture(scope="session")
def odd_pairs():
    """Null and empty texts, blanks, a null id, repeated rows, and a very long text."""
    return [
        (1, None), (2, ""), (3, " \n\t "), (None, "null id word"), (5, "twice the same row"), (5, "twice the same row"),
        (6, "x" * 50_000), (7, "alpha beta " * 20_000), (8, "é漢😀\n1 2 3"),
    ]
