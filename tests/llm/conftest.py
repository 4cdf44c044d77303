import pytest


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from semestra.llm.shipping import ship
    ship(spark)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties and repeated rows, and
    extra columns that clash with names the operators use."""
    base = "the quick brown fox jumps over the lazy dog and then runs home through the dark wood"
    rows = [(1, base, "en", "a", 1), (1, base, "en", "a", 1), (2, base, "en", None, None), (None, base, None, None, None),
            (3, None, "en", "a", 0), (4, "", "en", "a", 0), (5, " \n\t ", "en", "a", 3), (6, "one two", None, "a", 7),
            (7, "word " * 60_000, "en", "b", 300_000), (None, None, None, None, None), (8, "12 34 !!", "en", "b", 8),
            (9, "x" * 100_000, "de", "b", 100_000)]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("removed", "ids", "shard", "rank", "rid", "h", "c0", "key", "found"):
        df = df.withColumn(name, df.source)
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
