"""Data-quality checks: each gives metric rows (section, metric, value) and issues come from thresholds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lapwing.functions import vectors as V
from lapwing.functions.ranking import top_k
from lapwing.operators.diversity import gini

# fixed values: section, metric, comparison, threshold, severity
RULES = [
    ("missing", "empty_histories", ">", 0.0, "warning"),
    ("duplicates", "duplicate_items", ">", 0.0, "error"),
    ("duplicates", "duplicate_impressions", ">", 0.0, "error"),
    ("entities", "coverage_pct", "<", 80.0, "warning"),
    ("balance", "imbalance_ratio", ">", 100.0, "warning"),
    ("interactions", "short_history_pct", ">", 30.0, "warning"),
    ("text", "missing_abstract_pct", ">", 50.0, "warning"),
]


def metric_rows(one_row: DataFrame, section: str) -> DataFrame:
    """Columns of a one-row result as (section, metric, value) rows."""
    pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in one_row.columns]
    return one_row.select(F.lit(section).alias("section"), F.inline(F.array(*pairs)))


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls per column in one pass: (column_name, n_missing)."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    pairs = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_missing")) for c in one.columns]
    return one.select(F.inline(F.array(*pairs)))


def empty_histories(lengths: DataFrame) -> DataFrame:
    return lengths.agg(
        F.count_if(F.col("n_history") == 0).alias("empty_histories"),
        (F.count_if(F.col("n_history") == 0) * 100.0 / F.count(F.lit(1))).alias("empty_pct"),
    )


def duplicates(df: DataFrame, key: str | list[str], name: str) -> DataFrame:
    """Rows beyond the first of each id."""
    return df.groupBy(*([key] if isinstance(key, str) else key)).agg((F.count(F.lit(1)) - 1).alias("extra")).agg(F.coalesce(F.sum("extra"), F.lit(0)).alias(name))


def entity_coverage(entities: DataFrame, vectors: DataFrame) -> DataFrame:
    """Distinct entities with a vector. Without any vector the coverage is 0."""
    seen = entities.select("entity_id").distinct()
    known = vectors.select("entity_id").distinct().withColumn("hit", F.lit(1))
    counts = seen.join(known, "entity_id", "left").agg(F.count(F.lit(1)).alias("total_entities"), F.count("hit").alias("covered_entities"))
    return counts.select(
        "total_entities",
        "covered_entities",
        F.coalesce(F.col("covered_entities") * 100.0 / F.nullif("total_entities", F.lit(0)), F.lit(0.0)).alias("coverage_pct"),
        (F.col("total_entities") - F.col("covered_entities")).alias("missing_count"),
    )


def missing_entities(entities: DataFrame, vectors: DataFrame, n: int = 10) -> DataFrame:
    """The report's sample: first n entities without a vector."""
    missing = entities.select("entity_id").distinct().join(vectors.select("entity_id"), "entity_id", "left_anti")
    return missing.orderBy("entity_id").limit(n)


def category_balance(items: DataFrame) -> DataFrame:
    """Largest/smallest category and Gini of the category counts (bare formula: a single category gives 0)."""
    counts = items.where(F.col("category").isNotNull()).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    ratio = counts.agg((F.max("n") / F.min("n")).alias("imbalance_ratio"), F.count(F.lit(1)).alias("n_categories"))
    return ratio.withColumn("gini", gini(counts, [], singleton=0.0).select("gini").scalar())


def temporal(heads: DataFrame, cutoff: str) -> DataFrame:
    """Range in whole days and rows after the cut-off."""
    span = (F.unix_micros(F.max("time")) - F.unix_micros(F.min("time"))) / 86_400_000_000
    return heads.agg(
        F.floor(span).cast("bigint").alias("time_range_days"),
        F.count_if(F.col("time") > F.lit(cutoff).cast("timestamp")).alias("future_rows"),
    )


def short_histories(lengths: DataFrame, short: int = 3) -> DataFrame:
    return lengths.agg(
        F.count_if(F.col("n_history") < short).alias("short_history_users"),
        (F.count_if(F.col("n_history") < short) * 100.0 / F.count(F.lit(1))).alias("short_history_pct"),
        F.avg("n_history").alias("avg_history_length"),
        F.percentile("n_history", F.lit(0.5)).alias("median_history_length"),
    )


def text_quality(df: DataFrame, title: str, abstract: str, min_title: int = 10) -> DataFrame:
    """Short titles, missing abstracts, invalid encodings and mean lengths. Titles may come as bytes, as a damaged file has them."""
    raw = F.col(title)
    if dict(df.dtypes)[title] == "binary":
        raw = F.col(title).cast("string")  # the bytes as they are; readable ones are checked, the others replaced
        df = df.withColumn("_title", F.make_valid_utf8(raw))
        title = "_title"
    no_abstract = F.coalesce(F.length(abstract), F.lit(0)) == 0
    return df.agg(
        F.count_if(F.length(title) < min_title).alias("short_titles"),
        F.count_if(no_abstract).alias("missing_abstracts"),
        (F.count_if(no_abstract) * 100.0 / F.count(F.lit(1))).alias("missing_abstract_pct"),
        F.count_if(~F.is_valid_utf8(raw)).alias("encoding_issues"),
        F.avg(F.length(title)).alias("avg_title_length"),
        F.avg(F.length(abstract)).alias("avg_abstract_length"),
    )


def all_metrics(parts: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [metric_rows(df, section) for section, df in parts.items()])


def issues(metrics: DataFrame, rules=RULES) -> DataFrame:
    """Metrics that break their threshold."""
    severity: Column = F.lit(None).cast("string")
    for section, metric, op, limit, level in rules:
        hit = (F.col("section") == section) & (F.col("metric") == metric)
        broken = F.col("value") > limit if op == ">" else F.col("value") < limit
        severity = F.when(hit & broken, F.lit(level)).otherwise(severity)
    return metrics.withColumn("severity", severity).where(F.col("severity").isNotNull())


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Comparison of two metric tables."""
    b = before.select("section", "metric", F.col("value").alias("before"))
    a = after.select("section", "metric", F.col("value").alias("after"))
    return b.join(a, ["section", "metric"], "full")


def report_lines(metrics: DataFrame) -> DataFrame:
    """Text report: one line per metric."""
    line = F.concat(F.col("section"), F.lit("."), F.col("metric"), F.lit(": "), F.format_number("value", 2))
    return metrics.select("section", "metric", line.alias("line"))


def embedding_checks(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """Dimension range, norm range and NaN/Inf element counts."""
    v = F.col(vec)
    infinite = lambda x: (x == float("inf")) | (x == float("-inf"))
    rows = vectors.select(
        F.size(v).cast("bigint").alias("dim"),
        V.norm(v).alias("norm"),
        F.size(F.filter(v, F.isnan)).alias("nan"),
        F.size(F.filter(v, infinite)).alias("inf"),
    )
    return rows.agg(
        F.count(F.lit(1)).alias("n_vectors"),
        F.min("dim").alias("min_dim"),
        F.max("dim").alias("max_dim"),
        F.min("norm").alias("min_norm"),
        F.max("norm").alias("max_norm"),
        F.sum("nan").alias("nan_values"),
        F.sum("inf").alias("inf_values"),
    )


def coherence(items: DataFrame, n: int = 5) -> DataFrame:
    """Mean similarity within the largest category and across the two largest, over the first n items of each."""
    counts = items.groupBy("category").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= n)
    two = counts.orderBy(F.col("n").desc(), "category").limit(2)
    rows = items.join(F.broadcast(two), "category")
    sample = top_k(rows, ["category"], [F.col("item_id")], n)
    packed = sample.groupBy("category", "n").agg(F.collect_list("embedding").alias("vecs"))  # n vectors each
    pair = packed.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "category", "vecs"))).alias("p"))
    a, b = F.col("p")[0], F.col("p")[1]
    mean = lambda sims: V.total(sims) / F.size(sims)
    within = F.flatten(
        F.transform(a["vecs"], lambda x, i: F.transform(F.slice(a["vecs"], i + 2, n), lambda y: V.dot(x, y)))
    )
    cross = F.flatten(F.transform(a["vecs"], lambda x: F.transform(b["vecs"], lambda y: V.dot(x, y))))
    return pair.select(
        a["category"].alias("category_a"),
        b["category"].alias("category_b"),
        mean(within).alias("avg_within"),
        mean(cross).alias("avg_cross"),
    )
