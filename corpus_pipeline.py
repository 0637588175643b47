"""A training corpus from `documents`: toxic texts, near copies and benchmark leaks go, sources are mixed, ids are written.

Each stage reads what the one before it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lapwing.llm import decontaminate, language, mixing, ngramjoin, toxicity, wavelet
from lapwing.session import stage


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose clauses score below 0.5. Labels of four folds of `documents` teach the insults."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~language.held_out())
    return toxicity.civil(docs, toxicity.learn(docs, labels))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each class of documents linked by shingle similarity."""
    return ngramjoin.one_of_each(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those of which a twentieth or more is benchmark text."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Three quarters of the tokens, dealt to sources by weight, each document once at most."""
    return mixing.mix(docs, budget_share=0.75, epochs=1)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of token ids, and per document its place in them."""
    return wavelet.digest(docs)


STAGES = [
    ("toxicity", toxic),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", leaks),
    ("source_mixing", mixture),
    ("token_output", token_ids),
]

#: Learned clause scores are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
