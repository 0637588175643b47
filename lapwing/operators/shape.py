"""Filters, encodings and scalar shaping of behaviour and item tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lapwing.functions import vectors as V
from lapwing.functions.ranking import positions
from lapwing.session import stage
from lapwing.sources.behaviours import words


def filter_short_history(behaviours: DataFrame, min_len: int = 1, length: Column | None = None) -> DataFrame:
    return behaviours.where((F.size("history") if length is None else length) >= min_len)


def filter_no_click(behaviours: DataFrame) -> DataFrame:
    return behaviours.where(F.exists("impressions", lambda x: x["label"] == 1))


def removal_report(behaviours: DataFrame, kept: Column) -> DataFrame:
    """Rows before, kept and removed by a filter, with the removed share in percent."""
    counts = behaviours.agg(F.count(F.lit(1)).alias("n_before"), F.count_if(kept).alias("n_kept"))
    removed = F.col("n_before") - F.col("n_kept")
    return counts.select(
        "n_before",
        "n_kept",
        removed.alias("n_removed"),
        F.round(F.coalesce(removed * 100.0 / F.nullif("n_before", F.lit(0)), F.lit(0.0)), 6).alias("removed_pct"),
    )


def fix_metadata(df: DataFrame, **applied) -> DataFrame:
    """Attach a struct that records which fixes were applied."""
    return df.withColumn("fixes", F.struct(*[F.lit(v).alias(k) for k, v in applied.items()]))


def dense_codes(df: DataFrame, order: list[str], code: str) -> DataFrame:
    """0-based position of each row in the order of the whole table; `order` makes rows distinct.

    Rows are dealt by range, so no form of the ids is assumed, and written once, so that counts and positions see the same
    ranges. A position is the rows in earlier ranges plus the place in its own: one count per range is all that meets.
    """
    ranges = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    return positions(stage(ranges, "ranges"), [], F.col("_range"), [F.col(c) for c in order], code).drop("_range")


def first_seen_codes(df: DataFrame, value: str, ordinal: str, code: str = "code") -> DataFrame:
    """Dense 0-based code per value in order of first appearance (`ordinal` is a unique row number)."""
    firsts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(ordinal).alias("_first"))
    return dense_codes(firsts, ["_first", value], code).select(value, code)


def sorted_codes(df: DataFrame, value: str, code: str = "code") -> DataFrame:
    """Dense 0-based code per value in sorted order."""
    distinct = df.select(value).where(F.col(value).isNotNull()).distinct()
    return dense_codes(distinct, [value], code).select(value, code)


def text_lengths(df: DataFrame, title: str, abstract: str, entities: Column) -> DataFrame:
    """Entity count and word counts of title and abstract."""
    return df.select(
        "*",
        F.size(entities).cast("bigint").alias("entity_count"),
        F.size(words(F.col(title))).cast("bigint").alias("title_length"),
        F.size(words(F.col(abstract))).cast("bigint").alias("abstract_length"),
    )


def history_indices(history: DataFrame, codes: DataFrame, code: str = "code") -> DataFrame:
    """History as item codes; unknown items fall out, positions keep their order."""
    return history.join(codes, "item_id").select("impression_id", "pos", F.col(code).alias("item_idx"))


def known_interactions(impressions: DataFrame, known: DataFrame) -> DataFrame:
    return impressions.join(known.select("item_id"), "item_id", "left_semi")


def min_max(df: DataFrame, keys: list[str], value: str, out: str, flat: str = "raw", placed: bool = False) -> DataFrame:
    """Per-list min-max scaling. A flat list keeps its raw values, or with flat='floor' uses a range floor of 1e-9.

    The extremes are aggregated map-side and joined back, so a hot list is never buffered whole. `placed` rows
    (short lists that already sit together) use a window instead.
    """
    if placed:
        w = W.partitionBy(*keys)
        rows = df.withColumn("_lo", F.min(value).over(w)).withColumn("_hi", F.max(value).over(w))
    else:
        rows = df.join(df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")), keys)
    v = F.col(value)
    if flat == "floor":
        scaled = (v - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-9))
    else:
        scaled = F.when(F.col("_hi") > F.col("_lo"), (v - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(v)
    return rows.withColumn(out, scaled).drop("_lo", "_hi")


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows in a fixed order (sampling knob)."""
    return df.orderBy(order).limit(n)


def vectors_for(ids: DataFrame, vectors: DataFrame, key: str, dim: int, vec: str = "embedding") -> DataFrame:
    """Vectors aligned to a list of ids: unknown ids get the zero vector and known = 0."""
    return ids.join(vectors.select(key, vec), key, "left").select(
        key,
        F.coalesce(F.col(vec), V.zeros(dim)).alias(vec),
        F.col(vec).isNotNull().cast("bigint").alias("known"),
    )


def latest_rows(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Keep the latest row per key (window group limit keeps one row per key and map task)."""
    w = W.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
