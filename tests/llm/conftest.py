import random

import pytest


def words(r: random.Random, n: int) -> list[str]:
    return ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(n)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing extra columns."""
    r = random.Random(3)
    base = " ".join(words(r, 120))
    rows = [
        (1, base, "en", "a"), (1, base, "en", "a"), (2, base, "en", None), (3, None, None, None), (4, "", "de", "b"), (None, "one two three", "en", "b"), (None, base, None, "a"),
        (5, " ".join(words(r, 60000)), "en", "a"), (6, " \n\t ", "en", "c"), (7, "ab " * 500, "en", "a"), (8, base + " more", "en", "a"), (9, 'x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" y', "en", "a"),
        (10, "ünï 的 \U0001f600 " * 30, "fr", "a"),
    ]
    rows = [(*x, 0, 0.5, "t", True) for x in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int, target double, component_id string, kept boolean").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("doc_id = -99")
