import random

import pytest

WORDS = ["alpha", "beta", "gamma", "delta", "river", "stone", "cloud", "Über", "naïve", "to", "of", "the"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing column names."""
    base = prose(1, 60)
    rows = [
        (1, base, "en", "src0", "x"), (2, base, "en", "src0", None), (2, base, "en", "src0", None),
        (3, None, "en", "src1", "y"), (4, "", None, None, "y"), (5, " \t\n \n", "de", "src1", "z"),
        (6, prose(2, 40_000), "en", "src2", "z"), (7, "x" * 60_000, None, "src2", "z"),
        (8, base + " " + prose(3, 5), "fr", "src3", "z"), (None, prose(4, 50), "en", "src0", "z"),
        (9, "one line\none line\nanother line of some length\nanother line of some lengthy", "en", None, "z"),
        (10, "\U0001d518 ▁ 日本 +1 (456) 555-2186 and 4111111111111111 and a@b.cd 1.2.3.4", "es", "src4", "z"),
        (11, "two words", "es", "src4", "z"), (12, "two words", "es", "src4", "z"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, id string")
    from pyspark.sql import functions as F
    for name in ("k1", "cell", "score", "copies", "comp", "n", "x", "marks", "key", "row"):  # names used inside
        docs = docs.withColumn(name, F.lit(name))
    return docs.cache()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
