import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(r, n):
    return " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in each column, empty and very long texts, ties, repeated rows, and columns whose names clash with results."""
    r = random.Random(3)
    base = words(r, 120)
    rows = [(i, words(r, r.randint(5, 200)), "en", f"s{i % 4}", 1) for i in range(60)]
    rows += [(100, None, None, None, None), (101, "", "en", "s1", 0), (102, " \t\n\x0b\x0c\r ", "en", "s1", 7), (103, words(r, 40_000), "en", "s2", 1)]
    rows += [(110 + k, base, "en", "s0", 1) for k in range(5)] + [(110, base, "en", "s0", 1)] * 3
    rows += [(120 + k, base.replace(" ", f" x{k} ", 4), "en", None, 1) for k in range(5)]
    rows += [(130, "one", "en", "s1", 3), (131, "One", "en", "s1", 3), (132, "a b c d", "en", "s1", 7), (133, "&&& ### é\u00a0ü |||", "fr", "ß", 9), (None, "no id here at all", "en", "s3", 1)]
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, DOCS)
    clash = {c: F.lit("x") for c in ("score", "predicted", "kept", "size", "target", "copies", "shard", "slot", "node", "component", "key", "spans", "y")}
    return docs.withColumns(clash)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
