import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASHING = ("id", "row", "key", "hash", "part", "size", "taken", "copies", "target", "rule", "verdict", "host", "path", "spans", "blob", "whole", "predicted", "n_removed", "rep", "comp", "v", "dim", "ask")


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows and ids, and extra columns with clashing names."""
    word = "the quick brown fox jumps over the lazy dog and runs far away from home"
    rows = [
        (1, word, "en", "a", 10), (1, word, "en", "a", 10), (2, word, None, None, None), (3, None, "en", "a", 1), (4, "", "en", "b", 0), (5, " \n\t ", "fr", "b", 4),
        (None, word, "en", None, 5), (None, None, None, None, None), (6, "one", "en", "a", 3), (7, "one two", "en", "c", 7), (8, "12 34 !!", "en", "a", 8),
        (9, "a\n" * 5000, "en", "a", 10000), (10, "le petit chat est sur la table et il dort toute la nuit", "fr", "b", 9), (11, "w" * 300_000, "en", "a", 300_000),
        (12, " ".join(f"word{i % 977}" for i in range(60_000)), "en", "a", 5), (13, "Zoë \U0001f600 naïve ÀÉ\x00 z", "fr", "é", 3), (6, "another text with this id", "en", "a", 3),
    ]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(f"x{c}") for c in CLASHING})


@pytest.fixture(scope="session")
def none(messy):
    return messy.limit(0)


@pytest.fixture(scope="session")
def documents(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}
