"""Helpers of these tests."""

import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Builds documents from (doc_id, text) pairs, with a clashing column."""

    def build(rows):
        return spark.createDataFrame([(i, t, "en", "s", 0, "kept") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, size string")

    return build
