"""Hybrid relevance: content, popularity, recency, category affinity and co-click signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lapwing.functions import blocks
from lapwing.functions.ranking import by_score, top_k
from lapwing.operators.aggregates import category_counts
from lapwing.operators.popularity import default_popularity
from lapwing.operators.shape import min_max
from lapwing.session import stage

# fixed values: weights (content, popularity, recency, affinity, co-click) by history length
WEIGHTS = {"short": (0.45, 0.15, 0.0, 0.15, 0.25), "medium": (0.60, 0.05, 0.0, 0.20, 0.15), "long": (0.65, 0.0, 0.0, 0.25, 0.10)}
WEIGHTS_NO_CATEGORY = {"short": (0.45, 0.15, 0.0, 0.0, 0.40), "medium": (0.60, 0.05, 0.0, 0.0, 0.35), "long": (0.70, 0.0, 0.0, 0.0, 0.30)}
SHORT, MEDIUM = 3, 10
MATCH_WEIGHT = 0.20
SIGNALS = ("content", "popularity", "recency", "affinity", "cf")
DEFAULT_RECENCY = 0.5


def dynamic_weights(n_history: Column, table: dict = WEIGHTS) -> dict[str, Column]:
    """Signal weights of a list as columns."""

    def pick(i: int) -> Column:
        return (
            F.when(n_history <= SHORT, table["short"][i]).when(n_history <= MEDIUM, table["medium"][i]).otherwise(table["long"][i])
        )

    return {name: pick(i) for i, name in enumerate(SIGNALS)}


def content_scores(candidates: DataFrame, queries: DataFrame, seen: DataFrame, vectors: DataFrame, bounded: bool = False) -> DataFrame:
    """Weighted profile similarity plus 0.2 * best match with a history item, min-max scaled per list.

    Lists pass by the whole catalogue as ids while a task can hold it. Beyond that, candidates and history are packed with
    their vectors in bounded pieces per list (`bounded` says that the lists are short by construction); each pair of pieces
    is one small matrix product, and the best match is a max over pieces. Candidates and history are counted: `bounded`
    ones and `seen` should have been written.
    """
    c, stock = candidates.select("impression_id", "item_id"), blocks.catalogue(vectors)
    if stock is not None:
        parts = blocks.matched(c if bounded else stage(c, "candidates"), queries, seen.select("impression_id", "item_id"), stock)
    else:
        parts = packed_matches(c, queries, seen, vectors, bounded)
    placed = parts.repartition("impression_id")  # one exchange serves the match, the scaling and the signal joins
    match = F.coalesce(F.max("match"), F.lit(0.0))  # null: the list has no known history
    raw = placed.groupBy("impression_id", "item_id").agg((F.max("base") + MATCH_WEIGHT * match).alias("raw"))
    return min_max(raw, ["impression_id"], "raw", "content", placed=True).drop("raw")


def packed_matches(c: DataFrame, queries: DataFrame, seen: DataFrame, vectors: DataFrame, bounded: bool) -> DataFrame:
    """`blocks.matched` for catalogues of any size: every entry of a list travels with its vector."""
    keys = ["impression_id"] if bounded else ["impression_id", "chunk"]
    c = c if bounded else stage(blocks.in_chunks(c, "impression_id"), "candidates")
    cands = blocks.packed_vectors(c, vectors, keys, ["item_id", "vec"], "cands")
    h = seen.select("impression_id", "item_id", F.floor(F.col("pos") / blocks.BLOCK_LIST).alias("chunk"))
    past = blocks.packed_vectors(h, vectors, ["impression_id", "chunk"], ["vec"], "seen")
    pairs = cands.join(queries, "impression_id").join(past.drop("chunk"), "impression_id", "left")
    return pairs.select("impression_id", "query", "cands", "seen").mapInArrow(blocks.best_match, blocks.MATCHED)


def affinity(history: DataFrame, items: DataFrame) -> DataFrame:
    """Share of each category in a history: (impression_id, category, affinity)."""
    counts = category_counts(history, items, ["impression_id"])
    total = counts.groupBy("impression_id").agg(F.sum("n").alias("_t"))
    return counts.join(total, "impression_id").select("impression_id", "category", (F.col("n") / F.col("_t")).alias("affinity"))


def cf_signal(history: DataFrame, edges: DataFrame) -> DataFrame:
    """Co-click votes from the history, divided by the largest vote over all co-clicked items."""
    counted = history.groupBy("impression_id", "item_id").agg(F.count(F.lit(1)).alias("_n"))
    votes = (
        counted.join(edges, counted.item_id == edges.a)
        .groupBy("impression_id", F.col("b").alias("item_id"))
        .agg(F.sum(F.col("_n") * F.col("weight")).alias("_v"))
    )
    top = votes.groupBy("impression_id").agg(F.max("_v").alias("_m"))
    return votes.join(top, "impression_id").select("impression_id", "item_id", (F.col("_v") / F.col("_m")).alias("cf"))


def hybrid(
    content: DataFrame,
    lengths: DataFrame,
    items: DataFrame,
    popularity: DataFrame,
    recency: DataFrame | None,
    affinities: DataFrame | None,
    cf: DataFrame | None,
) -> DataFrame:
    """Weighted sum of the signals with their defaults, for the candidates in `content`: (impression_id, item_id, score)."""
    rows = (
        content.join(lengths.select("impression_id", "n_history"), "impression_id")
        .join(popularity.select("item_id", "popularity"), "item_id", "left")
        .withColumn("popularity", F.coalesce("popularity", default_popularity(popularity)))
    )
    table = WEIGHTS if affinities is not None else WEIGHTS_NO_CATEGORY
    if recency is not None and any(tier[2] for tier in table.values()):  # a zero weight needs no join
        rows = rows.join(recency, "item_id", "left")
    else:
        rows = rows.withColumn("recency", F.lit(DEFAULT_RECENCY))
    if affinities is not None:
        rows = rows.join(items.select("item_id", "category"), "item_id", "left").join(affinities, ["impression_id", "category"], "left")
    else:
        rows = rows.withColumn("affinity", F.lit(0.0))
    rows = rows.join(cf, ["impression_id", "item_id"], "left") if cf is not None else rows.withColumn("cf", F.lit(0.0))
    weights = dynamic_weights(F.col("n_history"), table)
    defaults = {"recency": DEFAULT_RECENCY, "affinity": 0.0, "cf": 0.0}
    signal = {s: F.coalesce(F.col(s), F.lit(defaults[s])) if s in defaults else F.col(s) for s in SIGNALS}
    score = sum((weights[s] * signal[s] for s in SIGNALS), F.lit(0.0))
    return rows.select("impression_id", "item_id", score.alias("score"))


def best(scores: DataFrame, k: int) -> DataFrame:
    return top_k(scores, ["impression_id"], by_score(), k)


def cold_start(lists: DataFrame, popularity: DataFrame, k: int) -> DataFrame:
    """Globally most popular items for lists without a usable history (k rows travel as one array)."""
    order = F.struct((-F.round("popularity", 9)).alias("o"), "item_id", "popularity")
    first = popularity.orderBy(*by_score("popularity")).limit(k).agg(F.sort_array(F.collect_list(order)).alias("t"))
    rows = lists.select("impression_id", F.posexplode(first.scalar()).alias("_i", "_t"))
    return rows.select(
        "impression_id",
        (F.col("_i") + 1).cast("bigint").alias("rank"),
        F.col("_t.item_id").alias("item_id"),
        F.col("_t.popularity").alias("score"),
    )


def seed_history(topics: DataFrame, popular: DataFrame) -> DataFrame:
    """History of a new user: the popular items of each chosen topic, topic by topic."""
    return topics.join(popular, topics.topic == popular.category).select(
        "user_id", "topic", (F.col("topic_pos") * 1000 + F.col("rank")).alias("pos"), "item_id"
    )


def aliased(topics: DataFrame, known: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Replace topics outside the catalogue by their alias; topics with neither stay as they are."""
    pairs = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    rows = topics.join(known.select(F.col("category").alias("topic"), F.lit(True).alias("_known")), "topic", "left")
    topic = F.when(F.col("_known"), F.col("topic")).otherwise(F.coalesce(F.try_element_at(pairs, F.col("topic")), F.col("topic")))
    return rows.withColumn("topic", topic).drop("_known")
