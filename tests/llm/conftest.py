import random

import pytest
from pyspark.sql import types as T

SCHEMA = "doc_id long, text string, source string, id string, row int, size string, hash string, score string, n_words string"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("etaoinsh") for _ in range(r.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeats, other scripts."""
    base = [None, "", " \t\n", "a", "A b", "a\tb", "ab", words(1, 60), words(1, 60).upper(), words(1, 60) + " x", words(2, 3000), "é ß 字 😀\x00\x85 z", "x" * 5000, "a b c " * 400, "line one\nline one\n\nline two", "\n\n", "!!! ## $$"]
    rows = [(i, t, ["s1", "s2", None, ""][i % 4]) for i, t in enumerate(base * 2)]
    rows += [(None, "null id", "s1"), (None, None, None), (None, "null id", "s1"), (7, words(1, 60), None), (7, words(1, 60), None), (-5, "Ab", "\U0001f600")]
    return [(i, t, s, "x", 1, None, "h", "q", None) for i, t, s in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with extra columns named as operators might name their own."""
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


_ = T
