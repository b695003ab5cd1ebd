from __future__ import annotations

import pytest

from dumpsieve.llm.shared import WHITE  # noqa: F401 - the subpackage must be there


@pytest.fixture
def docs(spark):
    """``docs([(id, text), ...])`` with columns that clash with what operators use inside."""

    def make(rows):
        extra = [(i, t, "x", 1.0, "k") for i, t in rows]
        return spark.createDataFrame(extra, "doc_id long, text string, doc string, score double, key string")

    return make
