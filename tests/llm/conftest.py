"""Awkward tables that every operator has to take."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves.
CLASHES = (
    "digest", "order", "row", "keep_id", "size", "rate", "words", "lines", "whole", "found", "part", "ids", "n", "salt",
    "mix_n", "mix_rate", "mix_source", "text_key", "id_key", "_rule_n_words", "copies", "group_size", "Shard",
    "n_pseudonyms", "odd.name",
)


@pytest.fixture(scope="session")
def awkward_rows():
    long_text = " ".join(f"word{i % 5000}" for i in range(60_000))
    body = "the quick brown fox jumps over a lazy dog and then walks home to sleep until the next bright morning comes"
    return [
        (1, body, "en", "a", 1), (2, body, "en", "a", 1), (2, body, "en", "a", 1), (3, body.replace(" ", "  "), None, "b", 1),
        (4, None, "en", "a", None), (5, "", "en", None, 0), (6, " \n\t", None, None, 3), (None, body + " x", "en", "b", 9),
        (None, None, None, None, None), (7, long_text, "en", "c", 1), (8, long_text, "en", "c", 1), (9, "one", "en", "c", 3),
        (10, "one", "fr", "c", 3), (11, "Eñe\x00   ß😀 <|endoftext|>", "es", "d", 5),
    ]


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    return spark.createDataFrame(awkward_rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(awkward):
    """The awkward table with a column of every working name."""
    from pyspark.sql import functions as F

    return awkward.withColumns({c: F.lit(7) for c in CLASHES})
