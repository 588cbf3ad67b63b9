import pytest

ODD = [
    (5, None, "en", None, 0),
    (4, "", "en", "web", 0),
    (3, " \t\n ", None, "web", 4),
    (None, "a text without an id and with enough words", "en", "web", None),
    (None, None, None, None, None),
    (7, "one", "en", "book", 3),
    (8, "token = 'abcdef123456' and AKIA" + "Q" * 20, "en", "web", 60),
    (9, "the same text stands here more than once, word for word, for all to see", "en", "web", 5),
    (9, "the same text stands here more than once, word for word, for all to see", "en", "web", 5),
    (10, "the same text stands here more than once, word for word, for all to see", "en", "book", 5),
    (2**62, "x" * 100_000, "en", "web", 100_000),
    (-3, "long " * 30_000 + "é😀\u2028end", "en", "web", 1),
]
#: Names that the operators use themselves.
CLASH = ["rep", "component", "key", "bucket", "n", "size", "copies", "rank", "class", "offset", "sequence_id", "host", "found", "mix_id", "target"]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and very long texts, repeated rows, ties and clashing extra columns."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"x-{c}") for c in CLASH}).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
