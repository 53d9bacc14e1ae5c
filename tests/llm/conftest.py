import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("kept", T.StringType())])


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty, ties, repeated rows, a long text, and a column whose name operators use."""
    words = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [
        (1, None, "en", None, 0, "x"),
        (2, "", "en", "a", 0, "x"),
        (3, words, None, "a", 5, None),
        (3, words, None, "a", 5, None),
        (4, words + " extra", "en", "b", 5, "x"),
        (5, "  \n\t ", "en", "b", 5, "x"),
        (6, "short", "en", None, 5, "x"),
        (None, "no id here at all", "en", "c", 5, "x"),
        (7, (words + "\n") * 3000, "en", "c", 5, "x"),
        (8, "MIT License é ß 日本 <|endoftext|> don't", "en", "b", 5, "x"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
