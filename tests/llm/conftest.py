from __future__ import annotations

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    session = (
        SparkSession.builder.master("local[4]").appName("llm-tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"
A = "the quick brown fox jumps over the lazy dog and then runs far away from all of the noisy hounds in this quiet green valley today"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and long texts, repeated rows, near and exact copies, a further column."""
    rows = [
        (1, A, "en", "a", 10, "x"),
        (2, A, "en", "a", 10, None),
        (3, A + " indeed", "en", "b", 10, "x"),
        (4, None, None, None, None, None),
        (5, "", "en", "a", 0, "x"),
        (6, " \t\n ", "en", "a", 4, "x"),
        (7, "one two", "en", "b", 7, "x"),
        (7, "one two", "en", "b", 7, "x"),
        (8, "One TWO", "de", "b", 7, "x"),
        (9, " ".join(f"w{i % 700}x{i // 700}" for i in range(30_000)), "en", "a", 1, "x"),
        (10, "Élan É élan ß x\x0by", "fr", "c", 1, "x"),
        (None, A, "en", "a", 1, "x"),
        (12, "mail 19@mail5.example.com or jane (at) corp dot example dot org, +1 (663) 555-6869, 152.143.123.131", "en", "c", 1, "x"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
