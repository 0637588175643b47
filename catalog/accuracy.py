"""Accuracy of the scored test impressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.rerank import MMR, BOUNDED, greedy_sql, feature_sql
from catalog.retrieval import EVAL_SQL
from catalog.views import Catalog, sql
from lapwing.operators import accuracy as I, aggregates as A, rerank as H
from lapwing.plans import recommend as M, tables as T
from lapwing.session import stage

CATALOG = Catalog()
q = CATALOG.add

VIEWS = "items impr hist"
LABELLED = EVAL_SQL + ",\nls AS (SELECT s.impression_id, s.item_id, s.category, s.subcategory, p.label, s.score FROM esc s JOIN shown p USING (impression_id, item_id))"


def labelled(spark, d):
    """Test impressions with labels and hybrid scores, plus the re-ranking context."""
    model, h = M.prepared(spark, d)
    shown = T.test(spark, d)
    scores = M.score_candidates(shown, h, model)
    rows = shown.select("impression_id", "item_id", "label").join(scores, ["impression_id", "item_id"])
    return stage(rows, "labelled"), H.Context(model.items, model.vectors, model.popularity, h)


def auc_sql(src: str) -> str:
    """CTE auc_v: Mann-Whitney by brute force over all pairs of a positive and a negative."""
    return f"""auc_v AS (SELECT coalesce(avg(CASE WHEN round(p.score, 9) > round(n.score, 9) THEN 1.0 WHEN round(p.score, 9) = round(n.score, 9) THEN 0.5 ELSE 0 END), 0) AS auc
        FROM {src} p, {src} n WHERE p.label = 1 AND n.label = 0)"""


def metrics_sql(src: str, name: str = "lm") -> str:
    """CTE `name`: metrics per list and k by the definitions."""
    return f"""{name}_r AS (SELECT *, row_number() OVER (PARTITION BY impression_id ORDER BY round(score, 9) DESC, item_id) AS rank,
        row_number() OVER (PARTITION BY impression_id ORDER BY label DESC, item_id) AS ideal FROM {src}),
    {name}_h AS (SELECT *, sum(label) OVER (PARTITION BY impression_id ORDER BY rank) AS hits FROM {name}_r),
    {name}_a AS (SELECT impression_id, k, sum(label) AS nrel, min(CASE WHEN label = 1 THEN rank END) AS first_hit, coalesce(sum(label) FILTER (WHERE rank <= k), 0) AS h,
        coalesce(sum(label / log2(rank + 1)) FILTER (WHERE rank <= k), 0) AS dcg, coalesce(sum(label / log2(ideal + 1)) FILTER (WHERE ideal <= k), 0) AS idcg,
        coalesce(sum(label * hits / rank::DOUBLE) FILTER (WHERE rank <= k), 0) AS ap FROM {name}_h, (VALUES (5), (10), (20)) v(k) GROUP BY 1, 2),
    {name}_p AS (SELECT *, h / k::DOUBLE AS precision, CASE WHEN nrel > 0 THEN h / nrel::DOUBLE ELSE 0 END AS recall FROM {name}_a),
    {name} AS (SELECT impression_id, k::BIGINT AS k, nrel::BIGINT AS n_relevant, coalesce(1.0 / first_hit, 0)::DOUBLE AS mrr, precision, recall,
        CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END AS ndcg,
        CASE WHEN h > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hr, CASE WHEN nrel > 0 THEN ap / least(nrel, k) ELSE 0 END AS "map",
        CASE WHEN first_hit <= k THEN 1.0 / first_hit ELSE 0 END::DOUBLE AS mrr_at_k FROM {name}_p)"""


@q("auc", sql(VIEWS, "SELECT round(auc::DOUBLE, 6) AS auc FROM auc_v", LABELLED + ",\n" + auc_sql("ls")))
def auc(spark, d):
    return A.rounded(I.auc(labelled(spark, d)[0]))


_COLS = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(ndcg, 6) AS ndcg, hr, round(\"map\", 6) AS \"map\", round(mrr, 6) AS mrr"


@q("list_metrics", sql(VIEWS, f"SELECT impression_id, k, n_relevant, {_COLS}, round(mrr_at_k, 6) AS mrr_at_k FROM lm", LABELLED + ",\n" + metrics_sql("ls")))
def list_metrics(spark, d):
    """Precision, recall, F1, NDCG, hit rate, MAP and MRR of every test list at k = 5, 10, 20."""
    return A.rounded(I.list_metrics(labelled(spark, d)[0]))


@q(
    "metric_grid",
    sql(
        VIEWS,
        """SELECT k, count(*) AS n_lists, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, round(avg(ndcg), 6) AS ndcg,
        round(avg(hr), 6) AS hr, round(avg("map"), 6) AS "map", round(avg(mrr), 6) AS mrr FROM lm GROUP BY 1""",
        LABELLED + ",\n" + metrics_sql("ls"),
    ),
)
def metric_grid(spark, d):
    return A.rounded(I.grid(I.list_metrics(labelled(spark, d)[0])))


@q(
    "metric_grid_clicked",
    sql(
        VIEWS,
        """SELECT k, count(*) AS n_lists, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg, round(avg(mrr_at_k), 6) AS mrr
        FROM lm WHERE n_relevant > 0 GROUP BY 1""",
        LABELLED + ",\n" + metrics_sql("ls"),
    ),
)
def metric_grid_clicked(spark, d):
    """The second protocol: lists with a click only, MRR cut at k."""
    return A.rounded(I.clicked_grid(I.list_metrics(labelled(spark, d)[0])))


@q(
    "score_gap",
    sql(VIEWS, "SELECT round(avg(score) FILTER (WHERE label = 1) - avg(score) FILTER (WHERE label = 0), 6) AS score_gap FROM ls", LABELLED),
)
def score_gap(spark, d):
    return A.rounded(I.score_gap(labelled(spark, d)[0]))


_RANDOM = """rs AS (SELECT impression_id, item_id, label, ('0x' || substr(md5('42|' || impression_id || '|' || item_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS score FROM impr)"""


@q("random_auc", sql("impr", "SELECT round(auc::DOUBLE, 6) AS auc FROM auc_v", _RANDOM + ",\n" + auc_sql("rs")))
def random_auc(spark, d):
    """AUC of the random lower bound over all impressions."""
    return A.rounded(I.auc(I.random_scores(T.impressions(spark, d).select("impression_id", "item_id", "label"))))


@q(
    "popularity_metrics",
    sql(
        "impr",
        f"SELECT impression_id, k, n_relevant, {_COLS}, round(mrr_at_k, 6) AS mrr_at_k FROM lm",
        "pv AS (SELECT item_id, avg(value) AS score FROM ev GROUP BY 1),\npl AS (SELECT i.impression_id, i.item_id, i.label, pv.score FROM impr i JOIN pv USING (item_id)),\n" + metrics_sql("pl"),
    ),
)
def popularity_metrics(spark, d):
    """Metrics of all impressions scored by the mean event value of an item."""
    value = T.events(spark, d).groupBy("item_id").agg(F.avg("value").alias("score"))
    rows = T.impressions(spark, d).select("impression_id", "item_id", "label").join(value, "item_id")
    return A.rounded(I.list_metrics(rows))


_EVAL_POOL = LABELLED + ",\n" + feature_sql("ls", "fe")
_BLEND = """bl AS (SELECT l.impression_id, l.item_id, l.label, l.score * (1 - coalesce((r.rank - 1) / greatest(count(r.rank) OVER (PARTITION BY l.impression_id) - 1, 1)::DOUBLE, 1.0)) AS score
    FROM ls l LEFT JOIN {0} r ON r.impression_id = l.impression_id AND r.item_id = l.item_id)"""


@q(
    "blended_mmr",
    sql(
        VIEWS,
        "SELECT impression_id, item_id, label, round(score, 6) AS score FROM bl",
        _EVAL_POOL + ",\n" + greedy_sql("fe", MMR.format(l=0.5), "(SELECT max(c) FROM (SELECT count(*) AS c FROM ls GROUP BY impression_id))") + ",\n" + _BLEND.format("g_out"),
        recursive=True,
    ),
)
def blended_mmr(spark, d):
    """Impressions re-ranked whole by MMR, then baseline score * (1 - normalised rank)."""
    rows, ctx = labelled(spark, d)
    return A.rounded(I.blended(rows, H.rerank("mmr", rows, ctx, None, inject_candidates=False, lambda_param=0.5)))


@q(
    "blended_bounded",
    sql(
        VIEWS,
        "SELECT impression_id, item_id, label, round(score, 6) AS score FROM bl",
        _EVAL_POOL + ",\n" + BOUNDED.format("fe", 1000000) + ",\n" + _BLEND.format("bounded"),
        recursive=True,
    ),
)
def blended_bounded(spark, d):
    rows, ctx = labelled(spark, d)
    return A.rounded(I.blended(rows, H.rerank("bounded_greedy", rows, ctx, None, inject_candidates=False)))
