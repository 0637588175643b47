"""Entity, category and text towers, their fusion, and vector diagnostics."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import md5
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lapwing.functions import vectors as V
from lapwing.operators.shape import sorted_codes
from lapwing.session import stage

# fixed values: tower weights and category dimensions
TOWER_WEIGHTS = {"text": 0.60, "entity": 0.30, "category": 0.10}
CATEGORY_DIM, SUBCATEGORY_DIM = 32, 16


def entity_idf(entities: DataFrame, n_articles: Column) -> DataFrame:
    """Document frequency and smooth IDF ln((1+N)/(1+df)) + 1 per entity."""
    df = entities.select("article_id", "entity_id").distinct().groupBy("entity_id").agg(F.count(F.lit(1)).alias("df"))
    return df.select("entity_id", "df", (F.ln((1 + n_articles) / (1 + F.col("df"))) + 1).alias("idf"))


def entity_means(entities: DataFrame, vectors: DataFrame, idf: DataFrame | None = None) -> DataFrame:
    """Mean (or IDF-weighted mean) vector of an article's known entities; articles without one have no row."""
    rows = entities.join(vectors, "entity_id")
    weight = None
    if idf is not None:
        rows, weight = rows.join(idf.select("entity_id", "idf"), "entity_id"), F.col("idf")
    return rows.groupBy("article_id").agg(V.mean_vector(F.col("vec"), weight).alias("vec"), F.count(F.lit(1)).alias("n_known"))


def entity_features(articles: DataFrame, means: DataFrame, dim: int | None = None) -> DataFrame:
    """Mean vector per article: null without a known entity, or zeros when `dim` is given."""
    vec = F.col("vec") if dim is None else F.coalesce("vec", V.zeros(dim))
    return articles.select("article_id").join(means, "article_id", "left").select(
        "article_id", vec.alias("vec"), F.coalesce("n_known", F.lit(0)).alias("n_known")
    )


def hit_coverage(features: DataFrame) -> DataFrame:
    return features.agg(
        F.count(F.lit(1)).alias("n_articles"),
        F.count_if(F.col("n_known") > 0).alias("n_hit"),
        (F.count_if(F.col("n_known") > 0) * 100.0 / F.count(F.lit(1))).alias("coverage_pct"),
    )


def _one_hot(code: Column, dim: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(i == code, 1.0).otherwise(0.0))


def _hash_signs(value: Column, dim: int) -> Column:
    """Unit vector of +-1/sqrt(dim), the sign of slot i taken from the first hex digit of md5(value|i)."""
    scale = dim**-0.5
    digit = lambda i: F.substring(F.md5(F.concat_ws("|", value, i.cast("string"))), 1, 1)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(digit(i) < "8", scale).otherwise(-scale))


def category_table(items: DataFrame, column: str, dim: int, n_values: int) -> DataFrame:
    """One unit vector per value: one-hot while the values fit into `dim`, a hash projection beyond that."""
    codes = sorted_codes(items, column)
    vec = _one_hot(F.col("code"), dim) if n_values <= dim else _hash_signs(F.col(column), dim)
    return codes.select(column, vec.alias(f"{column}_vec"))


def category_tower(items: DataFrame, cat_dim: int = CATEGORY_DIM, sub_dim: int = SUBCATEGORY_DIM) -> DataFrame:
    """category || subcategory vectors per item; unknown values give zeros."""
    n = items.agg(F.countDistinct("category").alias("c"), F.countDistinct("subcategory").alias("s")).first()
    cats = category_table(items, "category", cat_dim, n["c"])
    subs = category_table(items, "subcategory", sub_dim, n["s"])
    rows = items.select("item_id", "category", "subcategory").join(cats, "category", "left").join(subs, "subcategory", "left")
    both = F.concat(F.coalesce("category_vec", V.zeros(cat_dim)), F.coalesce("subcategory_vec", V.zeros(sub_dim)))
    return rows.select("item_id", both.alias("vec"))


def fuse(towers: DataFrame, names: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """Normalise each tower, weight, concatenate and normalise again (`fused`)."""
    w = weights or TOWER_WEIGHTS
    blocks = [V.scaled(V.unit(F.col(n)), w[n]) for n in names]
    return towers.select("item_id", V.unit(F.concat(*blocks)).alias("fused"))


def weights_warning(weights: dict[str, float]) -> str | None:
    total = sum(weights.values())
    return None if abs(total - 1.0) < 1e-6 else f"tower weights sum to {total}, not 1"


def block_shares(vectors: DataFrame, dims: dict[str, int], vec: str = "fused") -> DataFrame:
    """Mean norm of each block of a concatenated vector, as a share of all blocks in percent."""
    start, norms = 1, []
    for name, dim in dims.items():
        norms.append(F.avg(V.norm(F.slice(vec, start, dim))).alias(name))
        start += dim
    one = vectors.agg(*norms)
    total = sum((F.col(n) for n in dims), F.lit(0.0))
    rows = [F.struct(F.lit(n).alias("tower"), (F.col(n) / total * 100).alias("pct")) for n in dims]
    return one.select(F.inline(F.array(*rows)))


def text_tower(docs: DataFrame, encode: Callable[[DataFrame], DataFrame] | None = None, n_features: int = 768) -> DataFrame:
    """(item_id, text) to (item_id, vec). Any encoder fits; the default is hashed TF-IDF with unit rows.

    Words are runs of letters a-z (upper case included), digits and `_`. A word's slot is the first 32 bits of its md5 modulo
    `n_features`, the weight of a slot its count times ln((n + 1) / (documents with the slot + 1)). A text without words
    has the zero vector; texts of one item id count as one. A text is read once, and at most `n_features` slots of it with
    their counts are sent and written; the weights of the slots are no more than `n_features` numbers.
    """
    if encode is not None:
        return encode(docs)
    counts = docs.select("item_id", "text").mapInArrow(slot_counter(n_features), f"item_id {docs.schema['item_id'].dataType.simpleString()}, slots array<int>, counts array<bigint>")
    sparse = stage(counts.groupBy("item_id").agg(F.flatten(F.collect_list("slots")).alias("slots"), F.flatten(F.collect_list("counts")).alias("counts")), "slots")
    n = docs.count()
    found = sparse.select(F.explode(F.array_distinct("slots")).alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("n")).collect()  # no more rows than slots
    idf = np.zeros(n_features)
    for slot, with_slot in found:
        idf[slot] = log((n + 1) / (with_slot + 1))
    rows = docs.select("item_id").join(sparse, "item_id", "left")
    return rows.mapInArrow(weigher(idf), f"item_id {docs.schema['item_id'].dataType.simpleString()}, vec array<double>")


def slot_counter(n_features: int):
    """Task function: the slots of each text's words and how often each comes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = re.compile("[A-Za-z0-9_]+").findall
        slot = lru_cache(1 << 17)(lambda word: int.from_bytes(md5(word.lower().encode()).digest()[:4], "big") % n_features)
        for batch in batches:
            tallies = []
            for text in batch.column("text"):
                tally = {}
                for word, count in Counter(words(text.as_py() or "")).items():
                    at = slot(word)
                    tally[at] = tally.get(at, 0) + count
                tallies.append(tally)
            slots = pa.array([list(t) for t in tallies], pa.list_(pa.int32()))
            counts = pa.array([list(t.values()) for t in tallies], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), slots, counts], names=["item_id", "slots", "counts"])

    return run


def weigher(idf: np.ndarray):
    """Task function: unit vectors of the counts of slots times the slots' weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                slots, counts = batch.column("slots"), batch.column("counts")
                rows = np.repeat(np.arange(batch.num_rows), slots.value_lengths().fill_null(0).to_numpy())
                vec = np.zeros((batch.num_rows, len(idf)))
                np.add.at(vec, (rows, slots.flatten().to_numpy()), counts.flatten().to_numpy())
                vec *= idf
                norm = np.sqrt((vec * vec).sum(axis=1, keepdims=True))
                np.divide(vec, norm, out=vec, where=norm > 0)
                offsets = np.arange(0, vec.size + 1, len(idf), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.ListArray.from_arrays(offsets, vec.ravel())], names=["item_id", "vec"])

    return run
