import math

import pytest

from pointloom.session import prepare


@pytest.fixture(scope="session")
def docs_of(spark):
    """DataFrame of documents from (doc_id, text) pairs, with columns whose names the operators use themselves."""
    prepare(spark)

    def make(rows, lang="en"):
        data = [(i, t, lang, 1, 2, "k", True) for i, t in rows]
        return spark.createDataFrame(data, "doc_id long, text string, lang string, rid int, start int, key string, spans boolean")

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, null and repeated ids and rows, a long text, one long word."""
    long_text = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    return [(1, None), (2, ""), (3, "  \n\t "), (None, "some words of a text without an id"), (4, "a b"), (4, "a b"), (4, "another text of the same id"), (5, long_text), (6, "x" * 100_000), (7, "é" * 300 + " \x00\x1c end")]


def close(a, b):
    return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
