from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, in two partitions."""

    def docs(rows, extra=""):
        full = [(i, t, None, "s", len(t) if t is not None else None, *more) for i, t, *more in rows]
        return spark.createDataFrame(full, DOCS + extra).repartition(2)

    return docs
