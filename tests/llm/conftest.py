"""Small tables with the odd cases that every operator must take."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(20_000))
BODY = "the quick brown fox jumps over the lazy dog while a second fox looks on and the third one sleeps near the old barn by the river"


def row(i, text, lang="en"):
    return (i, text, lang, "s", None if text is None else len(text))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank, very long, equal and repeated rows, a null id."""
    rows = [row(1, BODY), row(2, BODY), row(3, None), row(4, ""), row(5, " \n\t "), row(6, LONG), row(7, "日本語 ñandú"), row(7, "日本語 ñandú"), row(None, BODY), row(8, BODY + " indeed", None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same rows with columns named like those that operators make."""
    from pyspark.sql import functions as F

    return odd.withColumns({c: F.lit("mine") for c in ("id", "score", "kept", "component", "key", "words", "h1", "n", "digest", "range", "blocks")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
