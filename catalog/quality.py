"""Data-quality checks over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.views import Catalog, sql
from lapwing.operators import aggregates as A, quality as Q
from lapwing.plans import tables as T
from lapwing.session import stage

CATALOG = Catalog()
q = CATALOG.add

CUTOFF = "2024-01-25"
_LENS = "lens AS (SELECT h.impression_id, h.bucket, coalesce(x.n, 0) AS n FROM heads h LEFT JOIN (SELECT impression_id, count(*) AS n FROM hist GROUP BY 1) x USING (impression_id))"


def lengths(spark, d):
    """History length of every impression, zero included."""
    return T.cuts(spark, d)


@q(
    "quality_missing",
    """WITH n AS (SELECT p.p_partkey, d.source, d.lang, l.quality FROM part p LEFT JOIN documents d ON p.p_partkey = d.doc_id
        LEFT JOIN labels l ON l.doc_id = p.p_partkey)
    SELECT 'p_partkey' AS column_name, count(*) - count(p_partkey) AS n_missing FROM n
    UNION ALL SELECT 'source', count(*) - count(source) FROM n UNION ALL SELECT 'lang', count(*) - count(lang) FROM n
    UNION ALL SELECT 'quality', count(*) - count(quality) FROM n""",
)
def quality_missing(spark, d):
    part = T.table(spark, d, "part").select("p_partkey")
    docs = T.table(spark, d, "documents").select(F.col("doc_id").alias("p_partkey"), "source", "lang")
    labels = T.table(spark, d, "labels").select(F.col("doc_id").alias("p_partkey"), "quality")
    return Q.null_counts(part.join(docs, "p_partkey", "left").join(labels, "p_partkey", "left"))


@q(
    "quality_empty_histories",
    sql("heads hist", "SELECT count(*) FILTER (WHERE n = 0) AS empty_histories, round(count(*) FILTER (WHERE n = 0) * 100.0 / count(*), 6)::DOUBLE AS empty_pct FROM lens", _LENS),
)
def quality_empty_histories(spark, d):
    return A.rounded(Q.empty_histories(lengths(spark, d)))


@q(
    "quality_duplicates",
    sql(
        "log",
        """SELECT (SELECT count(*) - count(DISTINCT doc_id) FROM documents) AS duplicate_items,
    (SELECT count(*) - count(DISTINCT l_orderkey) FROM lineitem) AS duplicate_orders,
    (SELECT count(*) - count(DISTINCT (user_id, bucket, item_id)) FROM log) AS duplicate_impressions""",
    ),
)
def quality_duplicates(spark, d):
    items = Q.duplicates(T.table(spark, d, "documents").select("doc_id"), "doc_id", "duplicate_items")
    orders = Q.duplicates(T.table(spark, d, "lineitem").select("l_orderkey"), "l_orderkey", "duplicate_orders")
    shown = Q.duplicates(T.log(spark, d).select("user_id", "bucket", "item_id"), ["user_id", "bucket", "item_id"], "duplicate_impressions")
    return items.withColumn("duplicate_orders", orders.scalar()).withColumn("duplicate_impressions", shown.scalar())


@q(
    "quality_entity_coverage",
    sql(
        "ae evec",
        """SELECT count(*) AS total_entities, count(v.entity_id) AS covered_entities,
        round(count(v.entity_id) * 100.0 / count(*), 6)::DOUBLE AS coverage_pct, count(*) - count(v.entity_id) AS missing_count
        FROM (SELECT DISTINCT entity_id FROM ae) e LEFT JOIN evec v USING (entity_id)""",
    ),
)
def quality_entity_coverage(spark, d):
    return A.rounded(Q.entity_coverage(T.article_entities(spark, d), T.entity_vectors(spark, d)))


@q(
    "quality_missing_entities",
    sql("ae evec", "SELECT DISTINCT entity_id FROM ae WHERE entity_id NOT IN (SELECT entity_id FROM evec) ORDER BY 1 LIMIT 10"),
)
def quality_missing_entities(spark, d):
    """The ten-entity sample of the coverage report."""
    return Q.missing_entities(T.article_entities(spark, d), T.entity_vectors(spark, d))


_BALANCE = """cc AS (SELECT category, count(*) AS n FROM doc_items GROUP BY 1),
    rk AS (SELECT n, row_number() OVER (ORDER BY n) AS i FROM cc)"""


@q(
    "quality_balance",
    sql(
        "doc_items",
        """SELECT round(max(n) / min(n)::DOUBLE, 6) AS imbalance_ratio, count(*) AS n_categories,
        round(2 * sum(i * n) / (count(*) * sum(n))::DOUBLE - (count(*) + 1) / count(*)::DOUBLE, 6) AS gini FROM rk""",
        _BALANCE,
    ),
)
def quality_balance(spark, d):
    return A.rounded(Q.category_balance(T.doc_items(spark, d)))


@q(
    "quality_temporal",
    sql(
        "heads",
        f"""SELECT CAST(floor(date_diff('microsecond', min("time"), max("time")) / 86400000000.0) AS BIGINT) AS time_range_days,
        count(*) FILTER (WHERE "time" > TIMESTAMP '{CUTOFF}') AS future_rows FROM heads""",
    ),
)
def quality_temporal(spark, d):
    return Q.temporal(T.heads(spark, d), CUTOFF)


@q(
    "quality_interactions",
    sql(
        "impr heads hist",
        """SELECT (SELECT count(*) FROM impr) AS total_shown, (SELECT sum(label)::BIGINT FROM impr) AS total_clicks,
        round((SELECT sum(label) * 100.0 / count(*) FROM impr), 6)::DOUBLE AS ctr_pct, round(avg(n), 6) AS avg_history_length,
        round(quantile_cont(n, 0.5), 6) AS median_history_length, count(*) FILTER (WHERE n < 3) AS short_histories FROM lens""",
        _LENS,
    ),
)
def quality_interactions(spark, d):
    return A.rounded(A.interaction_summary(T.impressions(spark, d), lengths(spark, d)))


@q(
    "quality_text",
    """SELECT count(*) FILTER (WHERE length(url) < 40) AS short_titles, count(*) FILTER (WHERE length(html) = 0) AS missing_abstracts,
    round(count(*) FILTER (WHERE length(html) = 0) * 100.0 / count(*), 6)::DOUBLE AS missing_abstract_pct, CAST(0 AS BIGINT) AS encoding_issues,
    round(avg(length(url)), 6) AS avg_title_length, round(avg(length(html)), 6) AS avg_abstract_length FROM pages""",
)
def quality_text(spark, d):
    return A.rounded(Q.text_quality(T.table(spark, d, "pages"), "url", "html", 40))


def _metrics(spark, d, kept_only: bool):
    """All checks as (section, metric, value), over all impressions or over those that both fixes keep: a history and a click."""
    lens, shown, log = lengths(spark, d), T.impressions(spark, d), T.log(spark, d).select(T.impression_id(), "item_id")
    if kept_only:
        clicked = shown.where(F.col("label") == 1).select("impression_id").distinct()
        lens = stage(lens.where(F.col("n_history") >= 1).join(clicked, "impression_id", "left_semi"), "kept")
        shown, log = (df.join(lens.select("impression_id"), "impression_id", "left_semi") for df in (shown, log))
    items = T.doc_items(spark, d)
    return Q.all_metrics(
        {
            "missing": Q.empty_histories(lens),
            "duplicates": Q.duplicates(items.select("item_id"), "item_id", "duplicate_items").withColumn(
                "duplicate_impressions", Q.duplicates(log, ["impression_id", "item_id"], "duplicate_impressions").scalar()
            ),
            "entities": Q.entity_coverage(T.article_entities(spark, d), T.entity_vectors(spark, d)),
            "balance": Q.category_balance(items),
            "temporal": Q.temporal(lens, CUTOFF),
            "interactions": Q.short_histories(lens).withColumn("total_shown", shown.agg(F.count(F.lit(1))).scalar()),
            "text": Q.text_quality(T.table(spark, d, "pages"), "url", "html", 40),
        }
    )


_METRIC_SQL = """lens AS (SELECT h.impression_id, h.user_id, h.bucket, h."time", coalesce(x.n, 0) AS n, CASE WHEN x.n >= 1 AND h.impression_id IN (SELECT impression_id FROM impr WHERE label = 1) THEN 1 ELSE 0 END AS ok
        FROM heads h LEFT JOIN (SELECT impression_id, count(*) AS n FROM hist GROUP BY 1) x USING (impression_id)),
    cc AS (SELECT category, count(*) AS n FROM doc_items GROUP BY 1), rk AS (SELECT n, row_number() OVER (ORDER BY n) AS i FROM cc),
    cov AS (SELECT count(*) AS t, count(v.entity_id) AS c FROM (SELECT DISTINCT entity_id FROM ae) e LEFT JOIN evec v USING (entity_id)),
    fixed AS (SELECT 'duplicates' AS section, 'duplicate_items' AS metric, (count(*) - count(DISTINCT item_id))::DOUBLE AS value FROM doc_items
        UNION ALL SELECT 'entities', 'total_entities', t FROM cov UNION ALL SELECT 'entities', 'covered_entities', c FROM cov
        UNION ALL SELECT 'entities', 'coverage_pct', c * 100.0 / t FROM cov UNION ALL SELECT 'entities', 'missing_count', t - c FROM cov
        UNION ALL SELECT 'balance', 'imbalance_ratio', max(n) / min(n)::DOUBLE FROM rk UNION ALL SELECT 'balance', 'n_categories', count(*) FROM rk
        UNION ALL SELECT 'balance', 'gini', 2 * sum(i * n) / (count(*) * sum(n))::DOUBLE - (count(*) + 1) / count(*)::DOUBLE FROM rk
        UNION ALL SELECT 'text', 'short_titles', count(*) FILTER (WHERE length(url) < 40) FROM pages
        UNION ALL SELECT 'text', 'missing_abstracts', count(*) FILTER (WHERE length(html) = 0) FROM pages
        UNION ALL SELECT 'text', 'missing_abstract_pct', count(*) FILTER (WHERE length(html) = 0) * 100.0 / count(*) FROM pages
        UNION ALL SELECT 'text', 'encoding_issues', 0 UNION ALL SELECT 'text', 'avg_title_length', avg(length(url)) FROM pages
        UNION ALL SELECT 'text', 'avg_abstract_length', avg(length(html)) FROM pages),
    varying AS (SELECT k.f, m.* FROM (VALUES (0), (1)) k(f), LATERAL (
        SELECT 'missing' AS section, 'empty_histories' AS metric, count(*) FILTER (WHERE n = 0)::DOUBLE AS value FROM lens WHERE ok >= k.f
        UNION ALL SELECT 'missing', 'empty_pct', count(*) FILTER (WHERE n = 0) * 100.0 / count(*) FROM lens WHERE ok >= k.f
        UNION ALL SELECT 'temporal', 'time_range_days', floor(date_diff('microsecond', min("time"), max("time")) / 86400000000.0) FROM lens WHERE ok >= k.f
        UNION ALL SELECT 'temporal', 'future_rows', count(*) FILTER (WHERE "time" > TIMESTAMP '2024-01-25') FROM lens WHERE ok >= k.f
        UNION ALL SELECT 'interactions', 'short_history_users', count(*) FILTER (WHERE n < 3) FROM lens WHERE ok >= k.f
        UNION ALL SELECT 'interactions', 'short_history_pct', count(*) FILTER (WHERE n < 3) * 100.0 / count(*) FROM lens WHERE ok >= k.f
        UNION ALL SELECT 'interactions', 'avg_history_length', avg(n) FROM lens WHERE ok >= k.f
        UNION ALL SELECT 'interactions', 'median_history_length', quantile_cont(n, 0.5) FROM lens WHERE ok >= k.f
        UNION ALL SELECT 'duplicates', 'duplicate_impressions', count(*) - count(DISTINCT (impression_id, item_id)) FROM log JOIN lens USING (user_id, bucket) WHERE ok >= k.f
        UNION ALL SELECT 'interactions', 'total_shown', count(*) FROM impr JOIN lens USING (impression_id) WHERE ok >= k.f) m)"""


@q(
    "quality_before_after",
    sql(
        "doc_items impr heads hist ae evec",
        """SELECT section, metric, round(value, 6)::DOUBLE AS before, round(value, 6)::DOUBLE AS after FROM fixed
        UNION ALL SELECT b.section, b.metric, round(b.value, 6)::DOUBLE, round(a.value, 6)::DOUBLE FROM varying b
        JOIN varying a ON a.section = b.section AND a.metric = b.metric AND b.f = 0 AND a.f = 1""",
        _METRIC_SQL,
    ),
)
def quality_before_after(spark, d):
    """All checks before and after dropping impressions without a history or without a click."""
    return A.rounded(Q.before_after(_metrics(spark, d, False), _metrics(spark, d, True)))


@q(
    "quality_issues",
    sql(
        "doc_items impr heads hist ae evec",
        """SELECT section, metric, round(value, 6)::DOUBLE AS value, CASE WHEN section = 'duplicates' THEN 'error' ELSE 'warning' END AS severity
        FROM (SELECT section, metric, value FROM fixed UNION ALL SELECT section, metric, value FROM varying WHERE f = 0)
        WHERE (metric IN ('empty_histories', 'duplicate_items', 'duplicate_impressions') AND value > 0) OR (metric = 'coverage_pct' AND value < 80)
        OR (metric = 'imbalance_ratio' AND value > 100) OR (metric = 'short_history_pct' AND value > 30) OR (metric = 'missing_abstract_pct' AND value > 50)""",
        _METRIC_SQL,
    ),
)
def quality_issues(spark, d):
    return A.rounded(Q.issues(_metrics(spark, d, False)))


@q(
    "quality_report",
    sql(
        "doc_items impr heads hist ae evec",
        """SELECT section, metric, section || '.' || metric || ': ' || format('{:,.2f}', value::DOUBLE) AS line FROM (SELECT section, metric, value FROM fixed UNION ALL SELECT section, metric, value FROM varying WHERE f = 0)""",
        _METRIC_SQL,
    ),
)
def quality_report(spark, d):
    """The text report, a line per metric."""
    return Q.report_lines(_metrics(spark, d, False))


_BROKEN = """pg AS (SELECT page_id, url, html, page_id % 7 = 3 AS bad FROM pages)"""


@q(
    "encoding_issues",
    f"""WITH {_BROKEN} SELECT count(*) AS n_rows, count(*) FILTER (WHERE bad) AS encoding_issues, count(*) FILTER (WHERE length(url) + CASE WHEN bad THEN 1 ELSE 0 END < 40) AS short_titles FROM pg""",
)
def encoding_issues(spark, d):
    """Titles written as bytes, one in seven with a byte that no UTF-8 text has, read again and checked as bytes."""
    broken = F.concat(F.encode(F.col("url"), "UTF-8"), F.when(F.col("page_id") % 7 == 3, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit(""))))
    raw = stage(T.table(spark, d, "pages").select("page_id", broken.alias("url"), "html"), "pages")
    out = Q.text_quality(raw, "url", "html", 40)
    return out.withColumn("n_rows", raw.agg(F.count(F.lit(1))).scalar()).select("n_rows", "encoding_issues", "short_titles")


@q(
    "embedding_checks",
    """SELECT count(*) AS n_vectors, min(len(e))::BIGINT AS min_dim, max(len(e))::BIGINT AS max_dim, round(min(sqrt(list_inner_product(e, e))), 6) AS min_norm,
    round(max(sqrt(list_inner_product(e, e))), 6) AS max_norm, sum(len(list_filter(e, lambda x: isnan(x))))::BIGINT AS nan_values,
    sum(len(list_filter(e, lambda x: isinf(x))))::BIGINT AS inf_values FROM (SELECT embedding::DOUBLE[] AS e FROM embeddings)""",
)
def embedding_checks(spark, d):
    return A.rounded(Q.embedding_checks(T.item_vectors(spark, d)))


@q(
    "semantic_coherence",
    sql(
        "items",
        """SELECT (SELECT category FROM two WHERE r = 1) AS category_a, (SELECT category FROM two WHERE r = 2) AS category_b,
        (SELECT round(avg(list_inner_product(x.embedding, y.embedding)), 6) FROM s x JOIN s y ON x.r = 1 AND y.r = 1 AND x.item_id < y.item_id) AS avg_within,
        (SELECT round(avg(list_inner_product(x.embedding, y.embedding)), 6) FROM s x JOIN s y ON x.r = 1 AND y.r = 2) AS avg_cross""",
        """two AS (SELECT category, row_number() OVER (ORDER BY count(*) DESC, category) AS r FROM items GROUP BY 1 HAVING count(*) >= 5 QUALIFY r <= 2),
        s AS (SELECT i.item_id, i.embedding, two.r FROM items i JOIN two USING (category) QUALIFY row_number() OVER (PARTITION BY category ORDER BY item_id) <= 5)""",
    ),
)
def semantic_coherence(spark, d):
    return A.rounded(Q.coherence(T.items(spark, d)))
