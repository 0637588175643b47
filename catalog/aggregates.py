"""Aggregations over histories, impressions and the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.views import Catalog, sql
from lapwing.operators import aggregates as A, popularity as P
from lapwing.plans import recommend as M, tables as T
from lapwing.session import stage

CATALOG = Catalog()
q = CATALOG.add


def latest_histories(spark, d):
    """The history of each user's latest impression that has one."""
    last = A.latest_history(T.history_lengths(spark, d)).withColumn("bucket", F.lit(None).cast("bigint"))
    return T.prefixes(spark, d, last)


@q(
    "history_union",
    sql(
        "hist",
        """SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY p) - 1 AS ord
        FROM (SELECT user_id, item_id, min(pos) AS p FROM hist GROUP BY 1, 2)""",
    ),
)
def history_union(spark, d):
    longest = T.history_lengths(spark, d).groupBy("user_id").agg(F.max("n_history").alias("n_history"))
    lists = longest.select("user_id", "n_history", F.lit(None).cast("bigint").alias("impression_id"), F.lit(None).cast("bigint").alias("bucket"))
    return A.ordered_union(T.prefixes(spark, d, lists))


@q("user_impressions", sql("impr", "SELECT user_id, count(*) AS n_shown, sum(label)::BIGINT AS n_clicked FROM impr GROUP BY 1"))
def user_impressions(spark, d):
    return T.impressions(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_shown"), F.sum("label").alias("n_clicked"))


_SHARES = "SELECT {0} AS value, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6)::DOUBLE AS share FROM doc_items GROUP BY 1"


@q("category_share", sql("doc_items", _SHARES.format("category")))
def category_share(spark, d):
    return A.rounded(A.shares(T.doc_items(spark, d), "category"))


@q("subcategory_share", sql("doc_items", _SHARES.format("subcategory")))
def subcategory_share(spark, d):
    return A.rounded(A.shares(T.doc_items(spark, d), "subcategory"))


@q(
    "category_rollup",
    sql("doc_items", "SELECT category, subcategory, count(*) AS n FROM doc_items GROUP BY ROLLUP (category, subcategory)"),
)
def category_rollup(spark, d):
    return T.doc_items(spark, d).rollup("category", "subcategory").agg(F.count(F.lit(1)).alias("n"))


@q(
    "entity_diversity",
    sql("ae articles", "SELECT category, count(DISTINCT entity_id) AS n_entities FROM articles JOIN ae USING (article_id) GROUP BY 1"),
)
def entity_diversity(spark, d):
    return A.entities_per_category(T.articles(spark, d), T.article_entities(spark, d))


@q(
    "diversity_totals",
    sql(
        "ae articles",
        """SELECT count(DISTINCT category) AS categories, count(DISTINCT subcategory) AS subcategories, count(*) AS items,
        (SELECT count(DISTINCT entity_id) FROM ae) AS entities FROM articles""",
    ),
)
def diversity_totals(spark, d):
    n_entities = T.article_entities(spark, d).agg(F.countDistinct("entity_id")).scalar()
    return T.articles(spark, d).agg(
        F.countDistinct("category").alias("categories"),
        F.countDistinct("subcategory").alias("subcategories"),
        F.count(F.lit(1)).alias("items"),
    ).withColumn("entities", n_entities)


_LAST = """last AS (SELECT user_id, max(bucket) AS bucket FROM hist GROUP BY 1),
    cat AS (SELECT h.user_id, i.category, count(*) AS n FROM hist h JOIN last USING (user_id, bucket) JOIN items i USING (item_id) GROUP BY 1, 2)"""


@q(
    "user_category_diversity",
    sql(
        "items hist",
        """SELECT user_id, count(*) AS unique_categories, sum(n)::BIGINT AS total_items, round(count(*) / sum(n)::DOUBLE, 6) AS diversity_ratio
        FROM cat GROUP BY 1""",
        _LAST,
    ),
)
def user_category_diversity(spark, d):
    """Category spread of each user's latest history."""
    counts = A.category_counts(latest_histories(spark, d), T.item_meta(spark, d), ["user_id"])
    return A.rounded(A.category_spread(counts, ["user_id"]))


@q(
    "top_user_categories",
    sql(
        "items hist",
        """SELECT user_id, category, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, category) AS rank
        FROM cat QUALIFY rank <= 3""",
        _LAST,
    ),
)
def top_user_categories(spark, d):
    counts = A.category_counts(latest_histories(spark, d), T.item_meta(spark, d), ["user_id"])
    return A.top_categories(counts, ["user_id"])


@q(
    "dataset_summary",
    sql(
        "heads hist ae articles",
        """SELECT count(*) AS total_impressions, count(DISTINCT user_id) AS unique_users,
        round((SELECT count(*) FROM hist) / count(*)::DOUBLE, 6) AS avg_history_length,
        round(count(*) / count(DISTINCT user_id)::DOUBLE, 6) AS avg_impressions_per_user,
        (SELECT count(*) FROM articles) AS total_items, (SELECT count(DISTINCT category) FROM articles) AS categories,
        (SELECT count(DISTINCT subcategory) FROM articles) AS subcategories,
        (SELECT count(*) FROM articles WHERE article_id IN (SELECT article_id FROM ae)) AS items_with_entities,
        CAST(floor(date_diff('microsecond', min("time"), max("time")) / 86400000000.0) AS BIGINT) AS duration_days FROM heads""",
    ),
)
def dataset_summary(spark, d):
    lengths = T.history_lengths(spark, d)
    return A.rounded(A.dataset_summary(T.heads(spark, d), lengths, T.articles(spark, d), T.article_entities(spark, d)))


@q(
    "dataset_categories",
    sql(
        "articles",
        """SELECT category, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6)::DOUBLE AS pct
        FROM articles GROUP BY 1 ORDER BY n DESC, category LIMIT 10""",
    ),
)
def dataset_categories(spark, d):
    """Ten largest categories."""
    rows = A.shares(T.articles(spark, d), "category", "category").select("category", "n", (F.col("share") * 100).alias("pct"))
    return A.rounded(rows.orderBy(F.col("n").desc(), "category").limit(10))


@q(
    "dataset_statistics",
    sql(
        "impr hist ae articles heads",
        """SELECT (SELECT count(*) FROM impr) AS total_shown, (SELECT sum(label)::BIGINT FROM impr) AS total_clicks,
        round((SELECT sum(label) * 100.0 / count(*) FROM impr), 6)::DOUBLE AS ctr_pct,
        round(avg(n), 6) AS avg_history_length, round(quantile_cont(n, 0.5), 6) AS median_history_length,
        count(*) FILTER (WHERE n < 3) AS short_histories,
        round((SELECT count(*) FROM ae) / (SELECT count(*) FROM articles)::DOUBLE, 6) AS avg_entities FROM lens""",
        "lens AS (SELECT h.impression_id, coalesce(x.n, 0) AS n FROM heads h LEFT JOIN (SELECT impression_id, count(*) AS n FROM hist GROUP BY 1) x USING (impression_id))",
    ),
)
def dataset_statistics(spark, d):
    lengths = T.history_lengths(spark, d).select("impression_id", "n_history")
    all_lengths = T.heads(spark, d).join(lengths, "impression_id", "left").fillna(0, ["n_history"])
    n_pairs = T.article_entities(spark, d).agg(F.count(F.lit(1))).scalar()
    n_items = T.articles(spark, d).agg(F.count(F.lit(1))).scalar()
    out = A.interaction_summary(T.impressions(spark, d), all_lengths)
    return A.rounded(out.withColumn("avg_entities", n_pairs / n_items))


@q(
    "popularity_max",
    sql(
        "items impr hist",
        """SELECT i.item_id, round(coalesce(c.n / (SELECT max(n) FROM c)::DOUBLE, 0.0), 6) AS popularity FROM items i LEFT JOIN c USING (item_id)""",
        """c AS (SELECT item_id, count(*) AS n FROM (SELECT item_id FROM hist UNION ALL SELECT item_id FROM impr WHERE label = 1) GROUP BY 1)""",
    ),
)
def popularity_max(spark, d):
    return A.rounded(P.popularity_max(T.later_impressions(spark, d), T.impressions(spark, d), T.item_meta(spark, d)))


POP_SQL = """pc AS (SELECT item_id, sum(label)::BIGINT AS clicks, count(*) AS shown FROM impr WHERE bucket < (SELECT max(bucket) FROM log) GROUP BY 1),
    pop AS (SELECT i.item_id, i.category, i.subcategory, coalesce(clicks, 0) AS clicks, coalesce(shown, 1) AS shown,
        0.7 * coalesce(clicks, 0) / (SELECT greatest(max(clicks), 1) FROM pc) + 0.3 * coalesce(clicks, 0) / coalesce(shown, 1) AS popularity
        FROM items i LEFT JOIN pc USING (item_id))"""


@q(
    "popularity_ctr",
    sql("items impr", "SELECT item_id, clicks, shown, round(popularity::DOUBLE, 6) AS popularity FROM pop", POP_SQL),
)
def popularity_ctr(spark, d):
    return A.rounded(P.popularity_ctr(T.train(spark, d), T.item_meta(spark, d)))


@q(
    "default_popularity",
    sql("items impr", "SELECT count(*) AS n_items, round(quantile_cont(popularity::DOUBLE, 0.5), 6) AS default_popularity FROM pop", POP_SQL),
)
def default_popularity(spark, d):
    pop = stage(P.popularity_ctr(T.train(spark, d), T.item_meta(spark, d)), "popularity")
    return A.rounded(pop.agg(F.count(F.lit(1)).alias("n_items")).withColumn("default_popularity", P.default_popularity(pop)))


@q(
    "recency",
    sql(
        "items impr",
        """SELECT i.item_id, round(coalesce((t - (SELECT min(t) FROM s)) / (SELECT max(t) - min(t) FROM s), 0.0), 6) AS recency
        FROM items i LEFT JOIN s USING (item_id)""",
        """s AS (SELECT item_id, epoch_us(max("time")) / 1e6 AS t FROM impr WHERE bucket < (SELECT max(bucket) FROM log) GROUP BY 1)""",
    ),
)
def recency(spark, d):
    return A.rounded(P.recency(T.train(spark, d), T.item_meta(spark, d)))


@q(
    "longest_history",
    sql(
        "hist",
        """SELECT user_id, arg_max(impression_id, n * 1000000000 - impression_id) AS impression_id, max(n) AS n_history
        FROM (SELECT user_id, impression_id, count(*) AS n FROM hist GROUP BY 1, 2) GROUP BY 1""",
    ),
)
def longest_history(spark, d):
    return P.longest_history(T.history_lengths(spark, d))


COCLICK_SQL = """lng AS (SELECT user_id, arg_max(impression_id, n * 1000000000 - impression_id) AS impression_id
        FROM (SELECT user_id, impression_id, count(*) AS n FROM hist WHERE bucket < (SELECT max(bucket) FROM log) GROUP BY 1, 2) GROUP BY 1),
    rc15 AS (SELECT h.user_id, h.pos, h.item_id FROM hist h JOIN lng USING (user_id, impression_id)
        QUALIFY row_number() OVER (PARTITION BY h.user_id ORDER BY h.pos DESC) <= 15),
    prs AS (SELECT x.item_id AS a, y.item_id AS b, count(*) AS n FROM rc15 x JOIN rc15 y ON x.user_id = y.user_id AND x.pos < y.pos GROUP BY 1, 2),
    sym AS (SELECT a, b, sum(n) AS n FROM (SELECT a, b, n FROM prs UNION ALL SELECT b, a, n FROM prs) GROUP BY 1, 2),
    coc AS (SELECT a, b, n / max(n) OVER (PARTITION BY a)::DOUBLE AS weight FROM sym
        QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, b) <= 50)"""


@q("coclick_top", sql("hist", "SELECT a, b, round(weight, 6) AS weight FROM coc", COCLICK_SQL))
def coclick_top(spark, d):
    """Co-click graph of the training period, 50 best neighbours per item."""
    return A.rounded(coclick_table(spark, d))


def coclick_table(spark, d):
    return P.coclick(M.training_clicks(spark, d))


@q(
    "popular_by_category",
    sql(
        "items impr",
        """SELECT category, item_id, round(popularity::DOUBLE, 6) AS popularity,
        row_number() OVER (PARTITION BY category ORDER BY round(popularity::DOUBLE, 9) DESC, item_id) AS rank FROM pop QUALIFY rank <= 5""",
        POP_SQL,
    ),
)
def popular_by_category(spark, d):
    items = T.item_meta(spark, d)
    return A.rounded(P.top_in_category(items, P.popularity_ctr(T.train(spark, d), items), 5))
