from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

LONG = "lorem ipsum dolor sit amet " * 4000


def make(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def odd(spark):
    """NULLs in every column, empty, blank and very long texts, repeated rows and ids, and ties."""
    rows = [
        (1, "The cat sat on the mat by the door.", "en", "a", 10), (2, "the CAT sat on the mat by the door.", "en", "a", 10), (2, "the CAT sat on the mat by the door.", "en", "a", 10),
        (3, "", "en", None, 0), (4, None, None, "b", None), (None, "The cat sat on the mat by the door.", "en", "a", 1), (5, " \n\t ", "de", "b", 3), (6, LONG, "de", "b", len(LONG)),
        (7, "é È ß 日本語 <|endoftext|> x's", "fr", "c", 5), (-8, "Released under the MIT License.", None, None, 3),
    ]
    return make(spark, rows)


@pytest.fixture(scope="session")
def none(spark):
    return make(spark, [])


@pytest.fixture(scope="session")
def sample(spark):
    """A few hundred of the driver's documents with their labels, as tables of their own."""
    folder = "/root/testdata/sf0.001"
    return spark.read.parquet(f"{folder}/documents.parquet").cache(), spark.read.parquet(f"{folder}/labels.parquet").cache()
