"""Shares, diversity statistics and dataset summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lapwing.functions.ranking import positions, top_k


def shares(df: DataFrame, column: str, value: str = "value") -> DataFrame:
    """Count and share of the whole table per value."""
    total = df.where(F.col(column).isNotNull()).agg(F.count(F.lit(1))).scalar()
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias(value)).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / total)


def ordered_union(history: DataFrame, chunk: int = 1000) -> DataFrame:
    """All histories of a user merged: distinct items in order of their first click."""
    firsts = history.groupBy("user_id", "item_id").agg(F.min("pos").alias("first_pos"))
    return positions(firsts, ["user_id"], F.floor(F.col("first_pos") / chunk), [F.col("first_pos")], "ord").select(
        "user_id", "item_id", "ord"
    )


def entities_per_category(articles: DataFrame, entities: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct entities per category. Exact form dedups (category, entity) first, so no category is gathered."""
    pairs = articles.select("article_id", "category").join(entities, "article_id")
    if approximate:
        return pairs.groupBy("category").agg(F.approx_count_distinct("entity_id").alias("n_entities"))
    return pairs.select("category", "entity_id").distinct().groupBy("category").agg(F.count(F.lit(1)).alias("n_entities"))


def history_lengths(history: DataFrame) -> DataFrame:
    return history.groupBy("impression_id", "user_id", "bucket").agg(F.count(F.lit(1)).alias("n_history"))


def latest_history(lengths: DataFrame) -> DataFrame:
    """Latest impression with a history per user."""
    return lengths.groupBy("user_id").agg(
        F.max_by("impression_id", "bucket").alias("impression_id"), F.max_by("n_history", "bucket").alias("n_history")
    )


def category_counts(lists: DataFrame, items: DataFrame, keys: list[str], category: str = "category") -> DataFrame:
    """Items per list and category, without those that have none. Items are counted before the join with their category."""
    per_item = lists.groupBy(*keys, "item_id").agg(F.count(F.lit(1)).alias("_n"))
    return per_item.join(items.select("item_id", category).where(F.col(category).isNotNull()), "item_id").groupBy(*keys, category).agg(F.sum("_n").alias("n"))


def category_spread(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Unique categories, items and their ratio per list, from category counts."""
    return counts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("unique_categories"),
        F.sum("n").alias("total_items"),
        (F.count(F.lit(1)) / F.sum("n")).alias("diversity_ratio"),
    )


def top_categories(counts: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    return top_k(counts, keys, [F.col("n").desc(), F.col("category").asc()], k)


def dataset_summary(heads: DataFrame, lengths: DataFrame, articles: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: impressions, users, mean history, impressions per user, catalogue size, entity rows, time range."""
    n_hist = lengths.agg(F.sum("n_history")).scalar()
    behaviour = heads.agg(
        F.count(F.lit(1)).alias("total_impressions"),
        F.countDistinct("user_id").alias("unique_users"),
        F.min("time").alias("t0"),
        F.max("time").alias("t1"),
    )
    news = articles.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("category").alias("c"), F.countDistinct("subcategory").alias("s")
    )
    with_entities = articles.join(entities.select("article_id").distinct(), "article_id", "left_semi").agg(F.count(F.lit(1)))
    return behaviour.select(
        "total_impressions",
        "unique_users",
        (F.coalesce(n_hist, F.lit(0)) / F.col("total_impressions")).alias("avg_history_length"),
        (F.col("total_impressions") / F.col("unique_users")).alias("avg_impressions_per_user"),
        news.select("n").scalar().alias("total_items"),
        news.select("c").scalar().alias("categories"),
        news.select("s").scalar().alias("subcategories"),
        with_entities.scalar().alias("items_with_entities"),
        F.floor((F.unix_micros("t1") - F.unix_micros("t0")) / 86_400_000_000).cast("bigint").alias("duration_days"),
    )


def interaction_summary(shown: DataFrame, lengths: DataFrame, short: int = 3) -> DataFrame:
    """Shown items, clicks, click rate, mean and median history length and the number of short histories."""
    n_rows = lengths.agg(
        F.avg("n_history").alias("avg_history_length"),
        F.percentile("n_history", F.lit(0.5)).alias("median_history_length"),
        F.count_if(F.col("n_history") < short).alias("short_histories"),
    )
    one = shown.agg(F.count(F.lit(1)).alias("total_shown"), F.sum("label").alias("total_clicks"))
    return one.select(
        "total_shown",
        "total_clicks",
        F.coalesce(F.col("total_clicks") * 100.0 / F.nullif("total_shown", F.lit(0)), F.lit(0.0)).alias("ctr_pct"),
        *[n_rows.select(c).scalar().alias(c) for c in n_rows.columns],
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every DOUBLE column (for results that are compared or printed)."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
