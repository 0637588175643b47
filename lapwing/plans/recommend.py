"""The recommendation plan: profiles, retrieval, hybrid scores and top-k for many lists at once."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from lapwing.functions import blocks
from lapwing.operators import aggregates as A, popularity as P, profiles as PR, retrieve as R, score as S
from lapwing.plans import tables as T
from lapwing.session import lean, stage


@dataclass
class Model:
    """Fitted tables; all of them are ordinary DataFrames."""

    items: DataFrame
    vectors: DataFrame
    popularity: DataFrame
    recency: DataFrame
    coclick: DataFrame


def fit(meta: DataFrame, vectors: DataFrame, shown: DataFrame, recent: DataFrame) -> Model:
    """Popularity, recency and the co-click graph from training interactions and each user's last training clicks."""
    recent = recent.join(meta.select("item_id"), "item_id", "left_semi")
    return Model(meta, blocks.sized(vectors), P.popularity_ctr(shown, meta), P.recency(shown, meta), P.coclick(recent))


def profiles(history: DataFrame, vectors: DataFrame) -> DataFrame:
    """impression_id, user_id, n_history, attention, uniform, recent; lists without a known click fall out."""
    att, uni, rec = PR.attention_profile(history, vectors), PR.uniform_profile(history, vectors), PR.recent_profile(history, vectors)
    out = A.history_lengths(history).select("impression_id", "user_id", "n_history")
    out = out.join(att.withColumnRenamed("profile", "attention"), "impression_id")
    out = out.join(uni.withColumnRenamed("profile", "uniform"), "impression_id", "left")
    return out.join(rec.withColumnRenamed("profile", "recent"), "impression_id", "left")


def signals(candidates: DataFrame, history: DataFrame, model: Model, profile_table: DataFrame, bounded: bool = False) -> DataFrame:
    content = S.content_scores(candidates, R.combined_query(profile_table), history, model.vectors, bounded)
    return S.hybrid(
        content,
        profile_table,
        model.items,
        model.popularity,
        model.recency,
        S.affinity(history, model.items),
        S.cf_signal(history, model.coclick),
    )


def recommend(
    lists: DataFrame, history: DataFrame, model: Model, k: int, profile_table: DataFrame | None = None, exclude_history: bool = True
) -> DataFrame:
    """Top-k of the three-query candidate pool for each list of `lists`: (impression_id, item_id, score, rank).

    `history` may cover more lists. A list without a profile (no history, or none of its items known) or with an
    empty pool gets the k most popular items, scored by popularity. With `exclude_history` read items stay out of
    the pool. Lists, profiles and the pool feed several branches, so they are written once and read back.
    """
    wanted = stage(lists.select("impression_id").distinct(), "wanted")
    table = (profile_table if profile_table is not None else profiles(history, model.vectors)).join(wanted, "impression_id", "left_semi")
    if profile_table is None:  # cut to the lists before it is written, so that no reader joins them again
        table = stage(table, "profiles")
    pool = stage(R.candidate_pool(R.profile_queries(table), model.vectors, history if exclude_history else None), "pool")
    warm = S.best(signals(pool, history, model, table, bounded=True), k)
    # one row per list: as a whole the column compresses to next to nothing, and would pass for a broadcast
    cold = S.cold_start(wanted.join(pool.select("impression_id").distinct(), "impression_id", "left_anti"), model.popularity, k)
    return warm.unionByName(cold)


def score_candidates(
    shown: DataFrame, history: DataFrame, model: Model, profile_table: DataFrame | None = None, exclude_history: bool = False
) -> DataFrame:
    """Scores of given candidates (impression_id, item_id) for lists with a history, read items included by default."""
    table = profile_table if profile_table is not None else stage(profiles(history, model.vectors), "profiles")
    shown = shown.select("impression_id", "item_id")
    if exclude_history:
        shown = shown.join(history.select("impression_id", "item_id"), ["impression_id", "item_id"], "left_anti")
    return signals(shown, history, model, table)


def fitted(spark, sf_dir, meta: DataFrame | None = None) -> tuple[Model, DataFrame]:
    """Model of the training buckets (over the items in `meta`, if given) and the histories of the test bucket.

    Histories feed every user signal, popularity, the co-click graph and the items are read several times: they are written
    once, and the plans that read them stay small.
    """
    lean(spark)
    meta = stage(T.item_meta(spark, sf_dir) if meta is None else meta, "items")
    model = fit(meta, T.item_vectors(spark, sf_dir), T.train(spark, sf_dir), training_clicks(spark, sf_dir))
    model = replace(model, popularity=stage(model.popularity, "popularity"), coclick=stage(model.coclick, "coclick"))
    return model, test_history(spark, sf_dir)


def training_clicks(spark, sf_dir) -> DataFrame:
    """The last clicks of each user's longest training history, as many as make co-click pairs."""
    training = T.history_lengths(spark, sf_dir).where(F.col("bucket") < T.last_bucket(spark, sf_dir))
    longest = P.longest_history(training).withColumn("bucket", F.lit(None).cast("bigint"))
    return T.prefixes(spark, sf_dir, longest, P.PAIR_WINDOW)


prepared = fitted


def test_history(spark, sf_dir) -> DataFrame:
    """Histories of the test bucket, written once: every signal reads them."""
    lean(spark)
    return stage(T.history(spark, sf_dir, T.last_bucket(spark, sf_dir)), "history")
