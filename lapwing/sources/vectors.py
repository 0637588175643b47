"""Vector text files and the embedding store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from lapwing.sources.behaviours import words


def parse_vec_line(line: Column) -> tuple[Column, Column]:
    """`id f1 f2 ...` to (id, ARRAY<DOUBLE>)."""
    parts = words(line)
    return parts[0], F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))).cast("array<double>")


def read_vec(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace text of vectors; lines with one token or none are skipped, a missing file is empty."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "id STRING, vec ARRAY<DOUBLE>")
    key, vec = parse_vec_line(F.col("value"))
    return lines.where(F.size(words(F.col("value"))) > 1).select(key.alias("id"), vec.alias("vec"))


def save_embeddings(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Both tables hold the same rows (multiset equality)."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
