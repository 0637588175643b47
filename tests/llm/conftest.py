import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])
#: Nulls, empty and blank texts, ties, special strings, repeated rows and a long text.
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t ", "en", "a", 4),
    (4, "One two three", "en", None, 13),
    (5, "one TWO three", None, "a", 13),
    (5, "one TWO three", None, "a", 13),
    (6, "x<|endoftext|>y it's Été ΣΑΣ 日本 <|startoftext|>", "fr", "b", 40),
    (7, "... !!! ???", "en", "b", 11),
    (8, "word " * 60_000, "en", "a", 300_000),
    (9, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "a", 80),
    (10, "You are an idiot, you moron. He said she was stupid. Not stupid at all.", "en", "b", 70),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
