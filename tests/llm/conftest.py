import pytest
from pyspark.sql import types as T

ROWS = [
    (0, "The quick brown fox jumps over the lazy dog near the river bank today again and again.", "en", "a", 5),
    (1, "The quick brown fox jumps over the lazy dog near the river bank today again and again.", "en", "a", 5),
    (2, "the QUICK brown fox jumps over the lazy dog near the river bank today again and AGAIN.", None, "b", 5),
    (3, "", "en", "b", 0),
    (4, None, None, None, None),
    (5, "   \n\t ", "fr", "c", 5),
    (6, "one two", "en", "a", 7),
    (7, "1234 5678 ... !!", None, "c", 9),
    (8, "le chat est sur la table et il dort dans la maison avec nous " * 3, "fr", "c", 60),
    (9, "word " * 60000, "en", "a", 300000),
    (10, "mail me at jane.doe@mail.example.com or +1 (523) 555-1055 from 10.20.30.40 card 4111 1111 1111 1111", "en", "b", 1),
    (10, "mail me at jane.doe@mail.example.com or +1 (523) 555-1055 from 10.20.30.40 card 4111 1111 1111 1111", "en", "b", 1),
    (12, "distributed under the MIT License, Apache License and GNU General Public License; CC BY 4.0", "en", "b", 1),
]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("size", T.LongType()), T.StructField("score", T.DoubleType())]
)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names clash with results."""
    return spark.createDataFrame([(*r, 1, 0.5) for r in ROWS], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
