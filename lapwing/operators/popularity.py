"""Popularity, recency and co-click signals from interactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lapwing.functions.ranking import exact_quantiles, top_k

# fixed values of the signal definitions
RAW_SHARE, CTR_SHARE = 0.7, 0.3
PAIR_WINDOW = 15
COCLICK_TOP = 50


def popularity_max(in_histories: DataFrame, shown: DataFrame, items: DataFrame) -> DataFrame:
    """Clicks in histories (item_id, n) plus positive labels, divided by the largest count; items without clicks get 0."""
    labels = shown.where(F.col("label") == 1).select("item_id", F.lit(1).cast("bigint").alias("n"))
    counted = in_histories.select("item_id", "n").unionByName(labels).groupBy("item_id").agg(F.sum("n").alias("n"))
    top = counted.agg(F.max("n")).scalar()
    return items.select("item_id").join(counted, "item_id", "left").select(
        "item_id", F.coalesce(F.col("n") / top, F.lit(0.0)).alias("popularity")
    )


def popularity_ctr(shown: DataFrame, items: DataFrame) -> DataFrame:
    """0.7 * clicks/max clicks + 0.3 * click rate per item; never-shown items count as shown once."""
    counted = shown.groupBy("item_id").agg(F.sum("label").alias("clicks"), F.count(F.lit(1)).alias("shown"))
    top = counted.agg(F.greatest(F.max("clicks"), F.lit(1))).scalar()
    rows = items.select("item_id").join(counted, "item_id", "left").select(
        "item_id", F.coalesce("clicks", F.lit(0)).alias("clicks"), F.coalesce("shown", F.lit(1)).alias("shown")
    )
    score = RAW_SHARE * F.col("clicks") / F.coalesce(top, F.lit(1)) + CTR_SHARE * F.col("clicks") / F.col("shown")
    return rows.select("item_id", "clicks", "shown", score.alias("popularity"))


def default_popularity(popularity: DataFrame) -> Column:
    """Median popularity: the value for items outside the table."""
    return F.lit(exact_quantiles(popularity, "popularity", [0.5])[0]).cast("double")


def recency(shown: DataFrame, items: DataFrame) -> DataFrame:
    """(last seen - first) / (last - first) over the last-seen times of all items; unseen items get 0."""
    seen = shown.where(F.col("time").isNotNull()).groupBy("item_id").agg(
        (F.unix_micros(F.max("time")) / 1e6).alias("last")
    )
    low, high = seen.agg(F.min("last")).scalar(), seen.agg(F.max("last")).scalar()
    span = F.when(high > low, high - low).otherwise(F.lit(1.0))
    return items.select("item_id").join(seen, "item_id", "left").select(
        "item_id", F.coalesce((F.col("last") - low) / span, F.lit(0.0)).alias("recency")
    )


def longest_history(lengths: DataFrame) -> DataFrame:
    """Per user the impression with the longest history (the earliest of equals)."""
    best = F.max_by("impression_id", F.struct("n_history", -F.col("impression_id")))
    return lengths.groupBy("user_id").agg(best.alias("impression_id"), F.max("n_history").alias("n_history"))


def recent_clicks(history: DataFrame, n: int, keys: list[str] | None = None) -> DataFrame:
    """Last n clicks per list; each map task forwards at most n rows per list."""
    return top_k(history, keys or ["impression_id"], [F.col("pos").desc()], n, "age")


def coclick(recent: DataFrame, key: str = "user_id", top: int = COCLICK_TOP) -> DataFrame:
    """Symmetric co-click weights from each user's last clicks: count / largest count of the item, best `top` kept.

    A list holds at most 15 clicks, so the pairs of a user are at most 105; counts merge map-side and the
    per-item cut is a group-limited window, so a popular item is never gathered in one task.
    """
    lists = recent.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "item_id"))).alias("c"))
    pairs = F.flatten(
        F.transform(
            "c",
            lambda a, i: F.transform(F.slice("c", i + 2, PAIR_WINDOW), lambda b: F.struct(a["item_id"].alias("a"), b["item_id"].alias("b"))),
        )
    )
    one_way = lists.select(F.inline(pairs)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    both = one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    counts = both.groupBy("a", "b").agg(F.sum("n").alias("n"))
    largest = counts.groupBy("a").agg(F.max("n").alias("n_max"))
    kept = top_k(counts, ["a"], [F.col("n").desc(), F.col("b").asc()], top)
    return kept.join(largest, "a").select("a", "b", (F.col("n") / F.col("n_max")).alias("weight"))


def top_in_category(items: DataFrame, popularity: DataFrame, k: int, category: str = "category") -> DataFrame:
    """Most popular items per category."""
    rows = items.select("item_id", category).join(popularity.select("item_id", "popularity"), "item_id")
    return top_k(rows, [category], [F.round("popularity", 9).desc(), F.col("item_id").asc()], k)


