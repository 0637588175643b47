"""Queries of the operators over whole tables, each beside its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from lapwing.llm import collocations, decontaminate, exactdup, language, merkle, mixing, ngramjoin, quality, sharding, tokencount, toxicity, vptree, wavelet

CATALOG: dict = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        CATALOG[name] = (fn, sql)
        return fn

    return add


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def predicted(scored, limit: float):
    return scored.select("doc_id", language.held_out().alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))


WORD_SQL = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


@register("op1_benchmark_decontamination")
def op1(spark, d):
    return decontaminate.digest(decontaminate.find(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark")))


@register("op2_language_id")
def op2(spark, d):
    docs = table(spark, d, "documents")
    prototypes = language.learn(docs.where(~language.held_out()))
    out = language.predict(docs.select("doc_id", "text"), prototypes)
    return out.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


@register("op3_hilbert_sharding")
def op3(spark, d):
    return sharding.digest(table(spark, d, "documents"))


@register("op4_token_counts")
def op4(spark, d):
    return tokencount.digest(table(spark, d, "documents"))


@register("op5_ngram_jaccard_join")
def op5(spark, d):
    return ngramjoin.digest(table(spark, d, "documents"))


@register("op6_toxicity")
def op6(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").where(~language.held_out())
    return predicted(toxicity.score(docs.select("doc_id", "text"), toxicity.learn(docs, labels)), 0.5)


@register("op7_source_mixing", mixing.DIGEST_SQL)
def op7(spark, d):
    return mixing.digest(table(spark, d, "documents"))


@register("op8_quality_classifier")
def op8(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").where(~language.held_out())
    return predicted(quality.classify(docs.select("doc_id", "text"), labels), 0.3)


@register("op9_token_output")
def op9(spark, d):
    return wavelet.digest(table(spark, d, "documents"))


@register("op10_exact_dedup", exactdup.DIGEST_SQL)
def op10(spark, d):
    return exactdup.digest(table(spark, d, "documents"))


@register("op11_merkle_manifest", merkle.DIGEST_SQL)
def op11(spark, d):
    return merkle.digest(table(spark, d, "documents"))


@register("op12_nearest_neighbours", vptree.DIGEST_SQL)
def op12(spark, d):
    return vptree.digest(table(spark, d, "embeddings"))


@register("op13_collocations", collocations.DIGEST_SQL)
def op13(spark, d):
    return collocations.mine(table(spark, d, "documents"))


@register("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, d):
    return corpus_pipeline.run(spark, d)
