"""User profile vectors from click histories. Every mean merges map-side, so long histories stay split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from lapwing.functions import vectors as V
from lapwing.operators.popularity import recent_clicks

# fixed values of the attention profile
DECAY, MAX_HISTORY, FLOOR = 0.3, 50, 1e-6
RECENT = 5


def uniform_profile(history: DataFrame, vectors: DataFrame, normalise: bool = True) -> DataFrame:
    """Mean vector of the known clicks of a list, unit length unless it is a plain centroid."""
    rows = history.join(vectors, "item_id")
    mean = rows.groupBy("impression_id").agg(V.mean_vector(F.col("embedding")).alias("profile"))
    return mean.select("impression_id", (V.unit(F.col("profile")) if normalise else F.col("profile")).alias("profile"))


def profile_of_sums(sums: DataFrame, normalise: bool = True) -> DataFrame:
    """`uniform_profile` from the number and the vector sum of a list's known clicks (_n, _s)."""
    mean = V.let(F.col("_n"), lambda n: V.scaled(F.col("_s"), 1 / n))
    return sums.select("impression_id", (V.unit(mean) if normalise else mean).alias("profile"))


def recent_profile(history: DataFrame, vectors: DataFrame, n: int = RECENT) -> DataFrame:
    """Profile of the last n clicks; the cut comes before unknown items fall out."""
    return uniform_profile(recent_clicks(history, n), vectors)


def attention_profile(
    history: DataFrame, vectors: DataFrame, context: DataFrame | None = None, decay: float = DECAY, max_history: int = MAX_HISTORY
) -> DataFrame:
    """Weights exp(decay * -age) * (max(0, e.m) + 1e-6) over the last 50 clicks, unit length.

    m is the plain mean of those clicks, or `context` (impression_id, context) when given. Lists without a
    known click have no row (the zero vector by `coalesce`).
    """
    known = recent_clicks(history, max_history).join(vectors, "item_id")
    age = F.row_number().over(W.partitionBy("impression_id").orderBy(F.col("pos").desc())) - 1
    rows = known.select("impression_id", "embedding", age.alias("age"))
    if context is None:
        context = rows.groupBy("impression_id").agg(V.mean_vector(F.col("embedding")).alias("context"))
    content = F.greatest(V.dot(F.col("embedding"), F.col("context")), F.lit(0.0)) + FLOOR
    weighted = rows.join(context, "impression_id").select("impression_id", "embedding", (F.exp(-decay * F.col("age")) * content).alias("w"))
    mean = weighted.groupBy("impression_id").agg(V.mean_vector(F.col("embedding"), F.col("w")).alias("profile"))
    return mean.select("impression_id", V.unit(F.col("profile")).alias("profile"))
