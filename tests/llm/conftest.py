import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = "/root/testdata/sf0.001"
TEXTS = "doc_id long, text string"


@pytest.fixture(scope="session")
def tables():
    return DATA


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty, blank and long texts, ties, repeated rows, columns with names that operators use themselves."""
    long = " ".join(f"w{i % 977}" for i in range(30000))
    rows = [
        (1, "One two three.\nFour five six.\nSeven eight nine.", "x", 1),
        (2, "One two three.\nFour five six.\nSeven eight nine.", "x", 2),
        (2, "One two three.\nFour five six.\nSeven eight nine.", "x", 2),
        (2, "Another text under the same id", None, None),
        (None, "A text without an id", "y", 3),
        (None, "A text without an id", "y", 3),
        (None, None, None, None),
        (3, None, "z", 4),
        (4, "", "z", 5),
        (5, " \n\t \n ", "z", 6),
        (6, long, "z", 7),
        (7, "a" * 5000, "z", 8),
        (8, "it's 12 o'clock <|endoftext|> naïve 日本語 👍🏽\r\n　end  ", "z", 9),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, grp string, text_hash long").withColumn("score", _lit())


def _lit():
    from pyspark.sql import functions as F

    return F.lit("own")
