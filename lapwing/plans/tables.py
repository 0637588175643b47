"""Behaviour-log views over a folder of parquet tables (see FIXTURES.md, part 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from lapwing.functions import vectors as V
from lapwing.functions.ranking import positions

DIM = 64
EPOCH = "2024-01-01"
BUCKET_DAYS = 6
#: List ids hold the bucket in their low 20 bits: 17,000 years of buckets never run into the next user.
BUCKETS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark, sf_dir) -> DataFrame:
    """item_id, category, subcategory, embedding (ARRAY<DOUBLE>)."""
    emb = table(spark, sf_dir, "embeddings")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return emb.join(docs, emb.vec_id == docs.doc_id, "left").select(
        F.col("vec_id").alias("item_id"),
        F.concat(F.lit("c"), F.col("label").cast("string")).alias("category"),
        F.coalesce("source", F.lit("none")).alias("subcategory"),
        V.doubles("embedding").alias("embedding"),
    )


def item_meta(spark, sf_dir) -> DataFrame:
    """item_id, category, subcategory: the scan never touches the vectors."""
    return items(spark, sf_dir).drop("embedding")


def partial_meta(spark, sf_dir) -> DataFrame:
    """Item metadata with gaps and uneven categories: language and source, for labelled documents only."""
    labelled = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("_l", F.lit(True))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(labelled, "doc_id", "left")
    emb = table(spark, sf_dir, "embeddings").select("vec_id")
    return emb.join(docs, emb.vec_id == docs.doc_id, "left").select(
        F.col("vec_id").alias("item_id"),
        F.when(F.col("_l"), F.concat("lang", F.lit("-"), "source")).alias("category"),
        F.coalesce("source", F.lit("none")).alias("subcategory"),
    )


def item_vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"), V.doubles("embedding").alias("embedding")
    )


def doc_items(spark, sf_dir) -> DataFrame:
    """Unbalanced catalogue: documents with lang as category and source as subcategory."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("item_id"), F.col("lang").alias("category"), F.col("source").alias("subcategory"), "text"
    )


def events(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    days = F.datediff(F.to_date("ts"), F.lit(EPOCH).cast("date"))
    return ev.select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        F.col("ts").cast("timestamp").alias("ts"),
        F.get_json_object("props", "$.k").cast("bigint").alias("item_id"),
        F.floor(days / BUCKET_DAYS).cast("bigint").alias("bucket"),
    )


def log(spark, sf_dir) -> DataFrame:
    """Shown items with a click label: clicks are 1, views are 0."""
    return (
        events(spark, sf_dir)
        .where(F.col("event_type").isin("click", "view"))
        .withColumn("label", (F.col("event_type") == "click").cast("bigint"))
    )


def impression_id():
    return (F.col("user_id") * BUCKETS + F.col("bucket")).alias("impression_id")


def impressions(spark, sf_dir) -> DataFrame:
    """impression_id, user_id, bucket, item_id, label, time: one row per shown item."""
    return (
        log(spark, sf_dir)
        .groupBy("user_id", "bucket", "item_id")
        .agg(F.max("label").alias("label"), F.max("ts").alias("time"))
        .select(impression_id(), "user_id", "bucket", "item_id", "label", "time")
    )


def last_bucket(spark, sf_dir) -> Column:
    """The bucket of the latest log event: it is the test set, all earlier ones are the training set."""
    return log(spark, sf_dir).agg(F.max("bucket")).scalar()


def train(spark, sf_dir) -> DataFrame:
    return impressions(spark, sf_dir).where(F.col("bucket") < last_bucket(spark, sf_dir))


def test(spark, sf_dir) -> DataFrame:
    return impressions(spark, sf_dir).where(F.col("bucket") == last_bucket(spark, sf_dir))


def test_lists(spark, sf_dir) -> DataFrame:
    """One row per impression of the test bucket."""
    return heads(spark, sf_dir).where(F.col("bucket") == last_bucket(spark, sf_dir))


def heads(spark, sf_dir) -> DataFrame:
    """One row per impression."""
    return (
        log(spark, sf_dir)
        .groupBy("user_id", "bucket")
        .agg(F.max("ts").alias("time"))
        .select(impression_id(), "user_id", "bucket", "time")
    )


def clicks(spark, sf_dir) -> DataFrame:
    """All clicks with their position in the user's click order (hour chunks keep a hot user parallel)."""
    rows = log(spark, sf_dir).where(F.col("label") == 1).select("user_id", "bucket", "ts", "event_id", "item_id")
    return positions(rows, ["user_id"], F.date_trunc("hour", "ts"), [F.col("ts"), F.col("event_id")])


def cuts(spark, sf_dir) -> DataFrame:
    """How far each impression's history reaches: impression_id, user_id, bucket, time, n_history.

    A user's later histories extend the earlier ones, and a click keeps its position in all of them: the history of an
    impression is the user's clicks at positions below n_history. One running sum over the buckets of a user.
    """
    days = log(spark, sf_dir).groupBy("user_id", "bucket").agg(F.max("ts").alias("time"), F.sum("label").alias("_n"))
    before = W.partitionBy("user_id").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    return days.select(impression_id(), "user_id", "bucket", "time", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("n_history"))


def history_lengths(spark, sf_dir) -> DataFrame:
    """impression_id, user_id, bucket, n_history of the impressions with a history."""
    return cuts(spark, sf_dir).where(F.col("n_history") > 0).drop("time")


def prefixes(spark, sf_dir, lists: DataFrame, last: int | None = None) -> DataFrame:
    """Histories of the given lists (impression_id, user_id, bucket, n_history), or their last clicks: impression_id,
    user_id, bucket, pos, item_id. With one list per user there are no more rows than clicks."""
    c = clicks(spark, sf_dir).select("user_id", "pos", "item_id")
    inside = F.col("pos") < F.col("n_history")
    if last is not None:
        inside &= F.col("pos") >= F.col("n_history") - last
    return c.join(lists, "user_id").where(inside).select("impression_id", "user_id", "bucket", "pos", "item_id")


def history(spark, sf_dir, bucket: int | Column | None = None) -> DataFrame:
    """Clicks before the start of an impression's bucket: impression_id, user_id, bucket, pos, item_id.

    Without a bucket every impression gets its own copy of its history, which grows with the square of a user's log: what
    only needs counts or sums of all histories takes `history_lengths`, `history_counts` or `history_sums`.
    """
    lists = history_lengths(spark, sf_dir)
    return prefixes(spark, sf_dir, lists if bucket is None else lists.where(F.col("bucket") == bucket))


def _clicked(spark, sf_dir, keys: list[str], *measures: Column, items: DataFrame) -> DataFrame:
    """Clicks of each user and bucket, counted by item before they meet `items`, then by `keys`."""
    per_item = log(spark, sf_dir).where(F.col("label") == 1).groupBy("user_id", "bucket", "item_id").agg(F.count(F.lit(1)).alias("_c"))
    return per_item.join(items, "item_id").groupBy("user_id", "bucket", *keys).agg(*measures)


def history_counts(spark, sf_dir, meta: DataFrame, category: str = "category") -> DataFrame:
    """Items per category in the history of every impression: impression_id, category, n.

    Clicks are counted by user, bucket and category; a running count holds from the bucket after it to the next bucket
    in which the user clicked that category, and every impression takes the counts that hold in its bucket.
    """
    known = meta.select("item_id", category).where(F.col(category).isNotNull())
    per = _clicked(spark, sf_dir, [category], F.sum("_c").alias("_n"), items=known)
    walk = W.partitionBy("user_id", category).orderBy("bucket")
    held = per.select("user_id", category, F.col("bucket").alias("_from"), F.lead("bucket").over(walk).alias("_to"), F.sum("_n").over(walk).alias("n"))
    lists = history_lengths(spark, sf_dir).select("impression_id", "user_id", "bucket")
    holds = (F.col("bucket") > F.col("_from")) & (F.col("_to").isNull() | (F.col("bucket") <= F.col("_to")))
    return lists.join(held, "user_id").where(holds).select("impression_id", category, "n")


def history_sums(spark, sf_dir, vectors: DataFrame) -> DataFrame:
    """Number, vector sum and squared norms of the known items in every history: impression_id, _n, _s, _q.

    Clicks are summed by user and bucket first; an impression adds up the buckets before its own.
    """
    known = vectors.select("item_id", "embedding")
    weighted = V.scaled(F.col("embedding"), F.col("_c"))
    square = F.sum(F.col("_c") * V.dot(F.col("embedding"), F.col("embedding")))
    per = _clicked(spark, sf_dir, [], F.sum("_c").alias("_n"), V.sum_vector(weighted).alias("_s"), square.alias("_q"), items=known)
    lists = history_lengths(spark, sf_dir).select("impression_id", "user_id", F.col("bucket").alias("_b"))
    rows = lists.join(per, "user_id").where(F.col("bucket") < F.col("_b"))
    return rows.groupBy("impression_id").agg(F.sum("_n").alias("_n"), V.sum_vector(F.col("_s")).alias("_s"), F.sum("_q").alias("_q"))


def later_impressions(spark, sf_dir) -> DataFrame:
    """How many histories hold each click: item_id, n, added up over clicks."""
    after = W.partitionBy("user_id").orderBy(F.col("bucket").desc()).rowsBetween(W.unboundedPreceding, -1)
    days = log(spark, sf_dir).groupBy("user_id", "bucket").agg(F.lit(1).alias("_one"))
    later = days.select("user_id", "bucket", F.coalesce(F.sum("_one").over(after), F.lit(0)).alias("_later")).where("_later > 0")
    per_item = log(spark, sf_dir).where(F.col("label") == 1).groupBy("user_id", "bucket", "item_id").agg(F.count(F.lit(1)).alias("_n"))
    return per_item.join(later, ["user_id", "bucket"]).groupBy("item_id").agg(F.sum(F.col("_n") * F.col("_later")).alias("n"))


def behaviours(spark, sf_dir) -> DataFrame:
    """Row form: one impression with its list of shown items (bounded by the catalogue) and history length."""
    shown = (
        impressions(spark, sf_dir)
        .groupBy("impression_id", "user_id", "bucket")
        .agg(F.sort_array(F.collect_list(F.struct("item_id", "label"))).alias("impressions"))
    )
    return shown.join(cuts(spark, sf_dir).select("impression_id", "n_history"), "impression_id")


def article_entities(spark, sf_dir) -> DataFrame:
    """Long form of the entity lists: order = article, part = entity, one row per pair."""
    return (
        table(spark, sf_dir, "lineitem")
        .select(F.col("l_orderkey").alias("article_id"), F.col("l_partkey").alias("entity_id"))
        .distinct()
    )


def articles(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("article_id"),
        F.col("o_orderpriority").alias("category"),
        F.col("o_orderstatus").alias("subcategory"),
        F.col("o_orderdate").cast("timestamp").alias("time"),
    )


def entity_vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("entity_id"), V.doubles("embedding").alias("vec"))
