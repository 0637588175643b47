"""Diversity re-ranking of per-list candidate pools.

Three forms, all over pools bounded by the feature itself (top-100 plus five items per absent category):
window functions where the greedy choice has a closed form, a fold over category heads where it depends on
the number of picks, and a packed Arrow step where it depends on similarity to the picks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lapwing.functions import blocks, vectors as V
from lapwing.functions.blocks import packed_vectors, struct_block, vector_block
from lapwing.functions.ranking import by_score, positions, top_k
from lapwing.operators.aggregates import category_counts, shares
from lapwing.operators.profiles import uniform_profile
from lapwing.session import stage

# fixed values of the methods
INJECT_PER_CATEGORY, INJECT_QUANTILE, INJECT_DEFAULT = 5, 0.3, 0.01
MMR_SIM, MMR_CATEGORY = 0.7, 0.3
COVERAGE_FLOOR = 0.005
SMOOTHING = 0.01
SERENDIPITY_PARTS = (0.35, 0.25, 0.25, 0.15)
RANGE_FLOOR = 1e-9
ID_CHUNK = 100_000
KEY = "impression_id"


@dataclass
class Context:
    """What the methods know besides the candidates; plain DataFrames."""

    items: DataFrame  # item_id, category, subcategory
    vectors: DataFrame  # item_id, embedding
    popularity: DataFrame  # item_id, popularity
    history: DataFrame  # impression_id, item_id, ...

    def n_categories(self) -> Column:
        return self.items.agg(F.countDistinct("category")).scalar()

    def n_subcategories(self) -> Column:
        return self.items.agg(F.countDistinct("subcategory")).scalar()


# --------------------------------------------------------------------------- pools


def category_pool(ctx: Context, known: DataFrame | None = None) -> DataFrame:
    """Items (of `known`, if given) by popularity within their category, 1-based `place`. Large categories are numbered in pieces."""
    rows = ctx.items.select("item_id", "category").where(F.col("category").isNotNull())
    if known is not None:
        rows = rows.join(known.select("item_id"), "item_id", "left_semi")
    rows = rows.join(ctx.popularity.select("item_id", "popularity"), "item_id", "left")
    rows = rows.withColumn("popularity", F.round(F.coalesce("popularity", F.lit(0.0)), 9))
    none = F.when(F.col("popularity") == 0, F.floor(F.col("item_id") / ID_CHUNK)).otherwise(F.lit(0).cast("bigint"))
    chunk = F.struct(F.floor(-F.col("popularity") * 1000).alias("p"), none.alias("i"))
    ranked = positions(rows, ["category"], chunk, [F.col("popularity").desc(), F.col("item_id")], "place")
    return ranked.withColumn("place", F.col("place") + 1)


def unseen_popular(wanted: DataFrame, ctx: Context, n: int, known: DataFrame | None = None) -> DataFrame:
    """First n popular items per wanted (list, category) outside the list's history, only those in `known` if given.

    A list with h history items in a category needs its first n + h places, so exactly those are looked up by
    (category, place) instead of pairing lists with whole categories.
    """
    seen = ctx.history.select(KEY, "item_id").distinct()
    skipped = seen.join(ctx.items.select("item_id", "category"), "item_id").groupBy(KEY, "category").agg(F.count(F.lit(1)).alias("_h"))
    places = F.explode(F.sequence(F.lit(1).cast("bigint"), n + F.coalesce("_h", F.lit(0))))
    asked = wanted.join(skipped, [KEY, "category"], "left").select(KEY, "category", places.alias("place"))
    found = asked.join(category_pool(ctx, known), ["category", "place"]).join(seen, [KEY, "item_id"], "left_anti")
    return top_k(found, [KEY, "category"], [F.col("place")], n).select(KEY, "item_id", "category", "popularity")


def all_pairs_of(lists: DataFrame, ctx: Context) -> DataFrame:
    """(list, category) for every category of the catalogue; the categories travel as one small array."""
    cats = ctx.items.agg(F.collect_set("category")).scalar()
    return lists.select(KEY, F.explode(cats).alias("category"))


def inject(candidates: DataFrame, ctx: Context, n: int = INJECT_PER_CATEGORY) -> DataFrame:
    """Add up to n popular unseen items with a vector of every category absent from the list, scored at the 30 % point of
    the positive score range."""
    scores = candidates.groupBy(KEY).agg(
        F.min(F.when(F.col("score") > 0, F.col("score"))).alias("_lo"), F.max(F.when(F.col("score") > 0, F.col("score"))).alias("_hi")
    )
    present = candidates.join(ctx.items.select("item_id", "category"), "item_id").select(KEY, "category").distinct()
    absent = all_pairs_of(scores, ctx).join(present, [KEY, "category"], "left_anti")
    score = F.coalesce(F.col("_lo") + INJECT_QUANTILE * (F.col("_hi") - F.col("_lo")), F.lit(INJECT_DEFAULT))
    added = unseen_popular(absent, ctx, n, ctx.vectors).join(scores, KEY).select(KEY, "item_id", score.alias("score"), F.lit(1).alias("injected"))
    return candidates.select(KEY, "item_id", "score", F.lit(0).alias("injected")).unionByName(added)


def with_categories(pool: DataFrame, ctx: Context, how: str = "inner") -> DataFrame:
    """Add category and subcategory; an inner join keeps candidates that have a category."""
    meta = ctx.items.select("item_id", "category", "subcategory")
    meta = meta.where(F.col("category").isNotNull()) if how == "inner" else meta
    return pool.select(KEY, "item_id", "score").join(meta, "item_id", how)


def with_history_share(rows: DataFrame, ctx: Context) -> DataFrame:
    """Add n_hist (clicks in the row's category), hist_total and n_categories."""
    counts = category_counts(ctx.history, ctx.items, [KEY])
    totals = counts.groupBy(KEY).agg(F.sum("n").alias("hist_total"))
    out = rows.join(counts.withColumnRenamed("n", "n_hist"), [KEY, "category"], "left").join(totals, KEY, "left")
    return out.fillna(0, ["n_hist", "hist_total"]).withColumn("n_categories", ctx.n_categories())


def blended_target(weight: float, smoothing: float) -> Column:
    """(1-w) * history share + w / n; the share is uniform without a history, the target without a category."""
    n = F.col("n_categories")
    share = (F.col("n_hist") + smoothing) / (F.col("hist_total") + smoothing * n)
    target = (1 - weight) * F.when(F.col("hist_total") > 0, share).otherwise(1 / n) + weight / n
    return F.when(F.col("category").isNotNull(), target).otherwise(1 / n)


def ordered(rows: DataFrame, order: list[Column], k: int | None) -> DataFrame:
    """Rank rows per list and keep k (all without k): (impression_id, rank, item_id, score)."""
    if k is not None:
        out = top_k(rows, [KEY], order, k)
    else:
        out = rows.withColumn("rank", F.row_number().over(W.partitionBy(KEY).orderBy(*order)).cast("bigint"))
    return out.select(KEY, "rank", "item_id", "score")


def place_in_category(rows: DataFrame) -> DataFrame:
    """`j`: place of a candidate within its category by relevance."""
    return rows.withColumn("j", F.row_number().over(W.partitionBy(KEY, "category").orderBy(*by_score())))


def separable(rows: DataFrame, value: Column, k: int | None) -> DataFrame:
    """Greedy choice for objectives that fall with every pick of the same category and ignore other categories.

    The candidates of a category then win in order of relevance with falling values, so picking the best head
    k times is the same as sorting all values once.
    """
    return ordered(rows.withColumn("_v", F.round(value, 9)), [F.col("_v").desc(), F.col("item_id")], k)


# --------------------------------------------------------------------------- window methods


def baseline(pool: DataFrame, ctx: Context, k: int | None) -> DataFrame:
    return ordered(pool, by_score(), k)


def random(pool: DataFrame, ctx: Context, k: int | None, seed: int = 42) -> DataFrame:
    """Order by a seeded hash of list and item, among items with a vector."""
    rows = pool.join(ctx.vectors.select("item_id"), "item_id", "left_semi")
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(KEY).cast("string"), F.col("item_id").cast("string")))
    return ordered(rows, [key.asc(), F.col("item_id")], k)


def bounded_greedy(pool: DataFrame, ctx: Context, k: int | None, max_per_category: int = 2) -> DataFrame:
    """At most `max_per_category` per category by relevance, then the rest by relevance."""
    rows = place_in_category(with_categories(pool, ctx))
    return ordered(rows, [(F.col("j") > max_per_category).asc(), *by_score()], k)


def max_coverage(pool: DataFrame, ctx: Context, k: int | None, coverage_budget: float = 0.6) -> DataFrame:
    """First int(budget * k) places: the best item of each category, unseen categories first, then the least read;
    the rest by relevance."""
    rows = place_in_category(with_history_share(with_categories(pool, ctx), ctx))
    size = F.count(F.lit(1)).over(W.partitionBy(KEY)) if k is None else F.lit(k)
    heads_first = W.partitionBy(KEY).orderBy((F.col("j") > 1).asc(), F.col("n_hist"), *by_score())
    covered = (F.col("j") == 1) & (F.row_number().over(heads_first) <= F.floor(coverage_budget * size))
    rows = rows.withColumn("_c", covered)
    return ordered(rows, [F.col("_c").desc(), F.when(F.col("_c"), F.col("n_hist")), *by_score()], k)


def calibrated(pool: DataFrame, ctx: Context, k: int | None, alpha: float = 0.5, diversity_weight: float = 0.3) -> DataFrame:
    """(1-a) * relevance - a * KL(target || picks + item).

    Adding the j-th item of category x changes the divergence by a term common to all candidates and by
    -t_x * ln((j+s)/(j-1+s)), which depends on the category alone and falls with j: the separable form.
    """
    rows = place_in_category(with_history_share(with_categories(pool, ctx), ctx))
    gain = blended_target(diversity_weight, SMOOTHING) * F.ln((F.col("j") + SMOOTHING) / (F.col("j") - 1 + SMOOTHING))
    return separable(rows, (1 - alpha) * F.col("score") + alpha * gain, k)


# --------------------------------------------------------------------------- folds over category heads


def category_fold(rows: DataFrame, attrs: list[str], k: int | None, objective: Callable[..., Column]) -> DataFrame:
    """Greedy picks when the objective of a candidate depends on its category's count and the number of picks.

    Only the most relevant remaining item of a category can win, so the state is one counter per category.
    `objective(score, attrs, n_cat, n_picked)` builds the value; n_picked is at least 1 as a divisor and
    `first` tells the first step.
    """
    if k is not None:
        rows = top_k(rows, [KEY, "category"], by_score(), k, "_place")
    order = F.struct((-F.round("score", 9)).alias("o"), F.col("item_id"), F.col("score"))
    cats = rows.groupBy(KEY, "category", *attrs).agg(F.sort_array(F.collect_list(order)).alias("items"))
    lists = cats.groupBy(KEY).agg(F.collect_list(F.struct("category", *attrs, "items")).alias("cats"))
    lists = lists.withColumn("n", F.aggregate("cats", F.lit(0), lambda acc, c: acc + F.size(c["items"])))
    steps = F.sequence(F.lit(1), F.col("n") if k is None else F.least(F.col("n"), F.lit(k)))
    zero = F.struct(
        F.transform("cats", lambda c: F.lit(0)).alias("taken"),
        F.array().cast("array<struct<item_id:bigint,score:double>>").alias("picks"),
    )

    def step(state: Column, _: Column) -> Column:
        n_picked = F.size(state["picks"])

        def head(c: Column, taken: Column, i: Column) -> Column:
            item = F.get(c["items"], taken)
            value = objective(item["score"], c, taken, n_picked)
            return F.when(
                item.isNotNull(),
                F.struct(F.round(value, 9).alias("v"), (-item["item_id"]).alias("neg"), i.alias("i"), item["score"].alias("score")),
            )

        heads = F.transform("cats", lambda c, i: head(c, F.get(state["taken"], i), i))
        advance = lambda b: F.struct(
            F.transform(state["taken"], lambda t, i: F.when(i == b["i"], t + 1).otherwise(t)).alias("taken"),
            F.concat(state["picks"], F.array(F.struct((-b["neg"]).alias("item_id"), b["score"].alias("score")))).alias("picks"),
        )
        return V.let(F.array_max(heads), advance)

    folded = lists.select(KEY, F.aggregate(steps, zero, step, lambda s: s["picks"]).alias("picks"))
    out = folded.select(KEY, F.posexplode("picks").alias("pos", "pick"))
    return out.select(KEY, (F.col("pos") + 1).cast("bigint").alias("rank"), F.col("pick.item_id").alias("item_id"), F.col("pick.score").alias("score"))


def xquad(pool: DataFrame, ctx: Context, k: int | None, lambda_param: float = 0.5, explore_weight: float = 0.3) -> DataFrame:
    """l * relevance + (1-l) * max(floor, target - share of the category among the picks)."""
    rows = with_history_share(with_categories(pool, ctx), ctx).withColumn("target", blended_target(explore_weight, 0.0))

    def objective(score, c, n_cat, n_picked):
        gap = c["target"] - n_cat / F.greatest(n_picked, F.lit(1))
        return lambda_param * score + (1 - lambda_param) * F.greatest(F.lit(COVERAGE_FLOOR), gap)

    return category_fold(rows, ["target"], k, objective)


# --------------------------------------------------------------------------- similarity-aware greedy (Arrow)


FEATURES = ("item_id", "score", "popularity", "target", "scarcity", "cat", "sub", "has_cat", "has_sub")


def greedy_picks(c: dict, vec: np.ndarray, centre: np.ndarray | None, k: int | None, objective: Callable[..., np.ndarray]) -> list[int]:
    """Picks of one list. The largest similarity to the picks is kept up to date, so a step costs one matrix-vector product."""
    c["cos"] = vec @ centre if centre is not None else None
    n = len(vec)
    free, sim = np.ones(n, bool), np.full(n, -np.inf)
    n_cat, n_sub = np.zeros(n), np.zeros(n)
    picks = []
    for step in range(n if k is None else min(k, n)):
        value = np.round(objective(c, sim if step else None, n_cat / max(1, step), n_sub / max(1, step)), 9)
        best = int(np.argmax(np.where(free, value, -np.inf)))
        picks.append(best)
        free[best] = False
        sim = np.maximum(sim, vec @ vec[best])
        # items without a category have none in common
        n_cat[(c["cat"] == c["cat"][best]) & c["has_cat"]] += c["has_cat"][best]
        n_sub[(c["sub"] == c["sub"][best]) & c["has_sub"]] += c["has_sub"][best]
    return picks


def greedy_task(k: int | None, objective: Callable[..., np.ndarray]):
    """Task function: picks for each packed list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {name: batch.column(name) for name in batch.schema.names}
            for r in range(batch.num_rows):
                cands = cols["cands"][r]
                c = {f: struct_block(cands, f) for f in FEATURES}
                centre = cols["centroid"][r]
                c["n_categories"], c["n_subcategories"] = cols["n_categories"][r].as_py(), cols["n_subcategories"][r].as_py()
                picks = greedy_picks(c, vector_block(cands), centre.values.to_numpy(zero_copy_only=False) if centre.is_valid else None, k, objective)
                out = [np.full(len(picks), cols[KEY][r].as_py()), np.arange(1, len(picks) + 1), c["item_id"][picks], c["score"][picks]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=[KEY, "rank", "item_id", "score"])

    return run


def greedy_beside(k: int | None, objective: Callable[..., np.ndarray], n_categories: float, n_subcategories: float):
    """Picks for the lists of some rows beside the catalogue, see `blocks.beside`: kind 0 is a list's centroid, kind 1 a candidate."""

    def run(held: blocks.Held, rows: pa.Table) -> pa.RecordBatch:
        starts = blocks.heads(rows)
        of = np.repeat(np.arange(len(starts)), np.diff([*starts, rows.num_rows]))
        at = np.flatnonzero((rows.column("kind").to_numpy() == 1) & rows.column("item").is_valid().to_numpy())
        mean = np.flatnonzero(rows.column("kind").to_numpy() == 0)
        centres = dict(zip(of[mean].tolist(), rows.column("centroid").take(pa.array(mean)).to_pylist()))
        cands = rows.take(pa.array(at))
        places, entry = held.find(cands.column("item").to_numpy())
        number = of[at][entry]
        columns = {f: cands.column("item" if f == "item_id" else f).to_numpy()[entry] for f in FEATURES}
        cuts = np.searchsorted(number, np.arange(len(starts) + 1))
        picked, rank = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in np.flatnonzero(np.diff(cuts)).tolist():
            inside = slice(cuts[i], cuts[i + 1])
            c = {f: x[inside] for f, x in columns.items()} | {"n_categories": n_categories, "n_subcategories": n_subcategories}
            centre = centres.get(i)
            picks = greedy_picks(c, held.take(places[inside]), None if centre is None else np.array(centre), k, objective)
            picked.append(cuts[i] + np.array(picks, np.int64))
            rank.append(np.arange(1, len(picks) + 1))
        chosen = np.concatenate(picked)
        out = [
            rows.column("list").combine_chunks().take(pa.array(starts[number[chosen]])),
            pa.array(np.concatenate(rank)),
            pa.array(columns["item_id"][chosen]),
            pa.array(columns["score"][chosen]),
        ]
        return pa.RecordBatch.from_arrays(out, names=[KEY, "rank", "item_id", "score"])

    return run


GREEDY = f"{KEY} bigint, rank bigint, item_id bigint, score double"


def vector_greedy(pool: DataFrame, ctx: Context, k: int | None, objective, explore_weight: float = 0.3, fairness: str = "subcategory") -> DataFrame:
    """Run the greedy task over each pool, candidates in id order. Pools pass by the whole catalogue as ids while a task can hold it;
    beyond that they are packed, with vectors joined after the rows are placed.

    Candidates need a vector, not a category: without one their category share is 0. Without a subcategory fairness goes by
    category, without both it is 0.
    """
    rows = with_history_share(with_categories(pool, ctx, "left"), ctx)
    uniform = 1 / (ctx.n_subcategories() if fairness == "subcategory" else F.col("n_categories"))
    rows = rows.join(shares(ctx.items, fairness, fairness).select(fairness, "share"), fairness, "left")
    scarcity = F.when(F.col("n_hist") > 0, 1.0).otherwise(uniform / F.col("share"))
    if fairness == "subcategory":
        corpus = shares(ctx.items, "category", "category")
        rows = rows.join(corpus.select("category", F.col("share").alias("_c")), "category", "left")
        by_category = F.when(F.col("n_hist") > 0, 1.0).otherwise(1 / F.col("n_categories") / F.col("_c"))
        scarcity = F.when(F.col("subcategory").isNotNull(), scarcity).when(F.col("category").isNotNull(), by_category)
    else:
        scarcity = F.when(F.col("category").isNotNull(), scarcity)
    rows = (
        rows.join(ctx.popularity.select("item_id", "popularity"), "item_id", "left")
        .select(
            KEY,
            "item_id",
            "score",
            F.coalesce("popularity", F.lit(0.0)).alias("popularity"),
            blended_target(explore_weight, SMOOTHING).alias("target"),
            F.coalesce(scarcity, F.lit(0.0)).alias("scarcity"),
            F.xxhash64("category").alias("cat"),
            F.xxhash64(fairness).alias("sub"),
            F.col("category").isNotNull().alias("has_cat"),
            F.col(fairness).isNotNull().alias("has_sub"),
        )
    )
    # written, since placing counts its rows
    rows, stock = stage(rows, "features"), blocks.catalogue(ctx.vectors)
    centroid = uniform_profile(ctx.history, ctx.vectors, normalise=False).withColumnRenamed("profile", "centroid")
    if stock is not None:
        sizes = ctx.items.agg(F.countDistinct("category"), F.countDistinct("subcategory")).first()
        entries = rows.select(
            F.col(KEY).cast("bigint").alias("list"),
            F.lit(1).alias("kind"),
            F.col("item_id").cast("bigint").alias("item"),
            *[F.col(f).cast("double").alias(f) if f in ("score", "target", "scarcity", "popularity") else F.col(f) for f in FEATURES[1:]],
            F.lit(None).cast("array<double>").alias("centroid"),
        )
        of_list = {"list": F.col(KEY).cast("bigint"), "kind": F.lit(0), "centroid": F.col("centroid")}
        means = centroid.where(F.col(KEY).isNotNull()).select(
            *[of_list.get(c, F.lit(None).cast(entries.schema[c].dataType)).alias(c) for c in entries.columns]
        )
        run = greedy_beside(k, objective, float(sizes[0]), float(sizes[1]))
        return blocks.beside(entries.unionByName(means), stock, run, GREEDY, FEATURES[1:], n=rows.count(), width=160)
    lists = packed_vectors(rows, ctx.vectors, [KEY], [*FEATURES, "vec"], "cands").withColumn("cands", F.sort_array("cands"))
    lists = lists.join(centroid, KEY, "left").select(
        KEY,
        "cands",
        "centroid",
        ctx.n_categories().cast("double").alias("n_categories"),
        ctx.n_subcategories().cast("double").alias("n_subcategories"),
    )
    return lists.mapInArrow(greedy_task(k, objective), GREEDY)


def mmr(pool: DataFrame, ctx: Context, k: int | None, lambda_param: float = 0.3) -> DataFrame:
    """l * relevance - (1-l) * (.7 * largest similarity to the picks + .3 * share of the category)."""

    def objective(c, sim, cat_share, sub_share):
        penalty = 0.0 if sim is None else MMR_SIM * sim + MMR_CATEGORY * cat_share
        return lambda_param * c["score"] - (1 - lambda_param) * penalty

    return vector_greedy(pool, ctx, k, objective)


def serendipity(pool: DataFrame, ctx: Context, k: int | None, beta: float = 0.4) -> DataFrame:
    """(1-b) * relevance + b * (unexpectedness, novelty, distance to the picks, minus category share)."""
    w_unexpected, w_novel, w_distance, w_share = SERENDIPITY_PARTS

    def objective(c, sim, cat_share, sub_share):
        unexpected = 0.5 if c["cos"] is None else 1.0 - c["cos"]
        novel = 1.0 - c["popularity"] / (c["popularity"].max() or 1.0)
        distance = 1.0 if sim is None else 1.0 - sim
        bonus = w_unexpected * unexpected + w_novel * novel + w_distance * distance - w_share * cat_share
        return (1 - beta) * c["score"] + beta * bonus

    return vector_greedy(pool, ctx, k, objective)


def composite(
    pool: DataFrame,
    ctx: Context,
    k: int | None,
    w_relevance: float = 0.40,
    w_diversity: float = 0.15,
    w_calibration: float = 0.15,
    w_serendipity: float = 0.15,
    w_fairness: float = 0.15,
    explore_weight: float = 0.30,
    fairness: str = "subcategory",
) -> DataFrame:
    """Weighted sum of scaled relevance, distance to the picks, calibration gap, serendipity and fairness."""

    def objective(c, sim, cat_share, sub_share):
        low, high = c["score"].min(), c["score"].max()
        relevance = (c["score"] - low) / max(high - low, RANGE_FLOOR)
        distance = 1.0 if sim is None else np.clip(1.0 - sim, 0.0, 1.0)
        gap = np.clip((c["target"] - cat_share) * c["n_categories"], -1.0, 1.0)
        surprise = 0.5 if c["cos"] is None else np.clip(1.0 - np.clip(c["cos"], -1.0, 1.0), 0.0, 1.0)
        uniform = 1.0 / np.where(c["has_sub"] & (fairness == "subcategory"), max(c["n_subcategories"], 1.0), max(c["n_categories"], 1.0))
        level = np.where(c["has_sub"], sub_share, cat_share)
        fair = np.minimum(1.0, np.maximum(0.0, uniform - level) * c["scarcity"] / uniform)
        return (
            w_relevance * relevance
            + w_diversity * distance
            + w_calibration * (gap + 1.0) / 2.0
            + w_serendipity * surprise
            + w_fairness * fair
        )

    return vector_greedy(pool, ctx, k, objective, explore_weight, fairness)


# --------------------------------------------------------------------------- category-only variants (no vectors)


def popular_pool(lists: DataFrame, ctx: Context, k: int) -> DataFrame:
    """Catalogue without the history, scored by popularity: the first k per category, since no more can be picked."""
    rows = unseen_popular(all_pairs_of(lists, ctx), ctx, k)
    return rows.select(KEY, "item_id", F.col("popularity").alias("score"))


def simple_mmr(pool, ctx, k, lambda_param: float = 0.5):
    rows = place_in_category(with_categories(pool, ctx))
    repeat = F.when(F.col("j") > 1, 1.0).otherwise(0.0)
    return separable(rows, lambda_param * F.col("score") - (1 - lambda_param) * repeat, k)


def simple_xquad(pool, ctx, k, lambda_param: float = 0.5):
    rows = place_in_category(with_categories(pool, ctx))
    novelty = F.when(F.col("j") == 1, 1.0).otherwise(0.5 / F.col("j"))
    return separable(rows, (1 - lambda_param) * F.col("score") + lambda_param * novelty, k)


def simple_serendipity(pool, ctx, k, beta: float = 0.4):
    rows = with_history_share(with_categories(pool, ctx), ctx)
    bonus = F.when(F.col("n_hist") == 0, beta).otherwise(0.0)
    value = F.round((1 - beta) * F.col("score") + bonus, 9)
    return ordered(rows.withColumn("_v", value), [F.col("_v").desc(), F.col("item_id")], k)


def simple_calibrated(pool, ctx, k, alpha: float = 0.6):
    rows = with_history_share(with_categories(pool, ctx), ctx)
    share = F.when(F.col("n_hist") > 0, F.col("n_hist") / F.nullif("hist_total", F.lit(0)))
    rows = rows.withColumn("target", F.coalesce(share, 1 / F.col("n_categories")))

    def objective(score, c, n_cat, n_picked):
        return (1 - alpha) * score + alpha * F.greatest(F.lit(0.0), c["target"] - (n_cat + 1) / (n_picked + 1))

    return category_fold(rows, ["target"], k, objective)


def simple_composite(
    pool,
    ctx,
    k,
    w_relevance: float = 0.40,
    w_diversity: float = 0.15,
    w_calibration: float = 0.15,
    w_serendipity: float = 0.15,
    w_fairness: float = 0.15,
    explore_weight: float = 0.30,
):
    rows = with_history_share(with_categories(pool, ctx), ctx)
    share = F.coalesce(F.col("n_hist") / F.nullif("hist_total", F.lit(0)), F.lit(0.0))
    rows = rows.withColumn("target", (1 - explore_weight) * share + explore_weight / F.col("n_categories"))
    corpus = shares(ctx.items, "category", "category").select("category", "share")
    rows = rows.join(corpus, "category")
    known = F.col("n_hist") > 0
    rows = rows.withColumn("scarcity", F.when(known, 1.0).otherwise(1 / F.col("n_categories") / F.col("share")))
    rows = rows.withColumn("novelty", F.when(known, 0.1).otherwise(1.0))

    def objective(score, c, n_cat, n_picked):
        cur = n_cat / F.greatest(n_picked, F.lit(1))
        n = c["n_categories"]
        gap = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (c["target"] - cur) * n))
        fresh = F.when(n_cat == 0, c["novelty"]).otherwise(0.0)
        fair = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 / n - cur) * c["scarcity"] * n)
        return w_relevance * score + w_diversity * (1 - cur) + w_calibration * gap + w_serendipity * fresh + w_fairness * fair

    return category_fold(rows, ["target", "scarcity", "novelty", "n_categories"], k, objective)


# --------------------------------------------------------------------------- dispatch

METHODS = {
    "baseline": baseline,
    "random": random,
    "mmr": mmr,
    "xquad": xquad,
    "calibrated": calibrated,
    "serendipity": serendipity,
    "bounded_greedy": bounded_greedy,
    "max_coverage": max_coverage,
    "composite": composite,
}
SIMPLE_METHODS = {
    "baseline": baseline,
    "mmr": simple_mmr,
    "xquad": simple_xquad,
    "calibrated": simple_calibrated,
    "serendipity": simple_serendipity,
    "composite": simple_composite,
}
FALLBACK = {"xquad": lambda p: p.get("lambda_param", 0.5), "calibrated": lambda p: 0.5}


def rerank(method: str, candidates: DataFrame, ctx: Context, k: int | None, inject_candidates: bool = True, fallback: bool = False, **params) -> DataFrame:
    """Re-rank by name. With `fallback`, lists of xquad/calibrated without any categorised item go through mmr."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}, choose from {sorted(METHODS)}")
    pool = candidates if method == "baseline" or not inject_candidates else inject(candidates, ctx)
    out = METHODS[method](pool, ctx, k, **params)
    if fallback and method in FALLBACK:
        usable = with_categories(pool, ctx).select(KEY).distinct()
        rest = pool.join(usable, KEY, "left_anti")
        out = out.unionByName(mmr(rest, ctx, k, lambda_param=FALLBACK[method](params)))
    return out
