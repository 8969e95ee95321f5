"""Fixtures of the training-data tests."""

import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, blanks, ties, repeats, a long text, a copy under other case, and columns
    whose names the operators use themselves."""
    rows = [
        (1, "one two three four five six", "a"), (2, "one two three four five six", "a"), (3, None, None), (4, "", "b"), (5, "ONE two three four five six", "b"),
        (6, "x " * 4000, "b"), (7, "\t \n", None), (8, "é à ü ß words of a text", "c"), (8, "é à ü ß words of a text", "c"), (None, "no id at all here", None),
    ]
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, source string, fp int, shard int, part int, key int")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string, n_chars long")
