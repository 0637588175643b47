"""Re-ranking methods over the recommended pools of all test lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.retrieval import RANKED_SQL
from catalog.views import Catalog, sql
from lapwing.operators import aggregates as A, rerank as H
from lapwing.plans import recommend as M, tables as T
from lapwing.session import stage

CATALOG = Catalog()
q = CATALOG.add

VIEWS = "items impr hist"
N_CANDIDATES = 100


def pool_sql(n: int, name: str = "pool") -> str:
    """CTE `name`: top n candidates plus the injected items."""
    return f"""{name}_b AS (SELECT impression_id, item_id, category, subcategory, score FROM rec WHERE rank <= {n}),
    {name}_r AS (SELECT impression_id, min(score) FILTER (WHERE score > 0) AS lo, max(score) FILTER (WHERE score > 0) AS hi FROM {name}_b GROUP BY 1),
    {name}_i AS (SELECT r.impression_id, p.item_id, p.category, p.subcategory, coalesce(lo + 0.3 * (hi - lo), 0.01) AS score
        FROM {name}_r r, pop p WHERE p.category IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {name}_b b WHERE b.impression_id = r.impression_id AND b.category = p.category)
        AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.impression_id = r.impression_id AND s.item_id = p.item_id)
        QUALIFY row_number() OVER (PARTITION BY r.impression_id, p.category ORDER BY round(p.popularity::DOUBLE, 9) DESC, p.item_id) <= 5),
    {name} AS (SELECT *, 0 AS injected FROM {name}_b UNION ALL SELECT *, 1 FROM {name}_i)"""


def feature_sql(pool: str = "pool", name: str = "fe", explore: float = 0.3) -> str:
    """CTE `name`: the pool with history counts, centroid similarity, popularity and corpus shares."""
    return f"""{name}_h AS (SELECT impression_id, category, count(*) AS n_hist FROM th JOIN items USING (item_id) WHERE category IS NOT NULL GROUP BY 1, 2),
    {name}_t AS (SELECT impression_id, sum(n_hist)::DOUBLE AS hist_total FROM {name}_h GROUP BY 1),
    {name}_c AS (SELECT impression_id, list(v ORDER BY i) AS centroid FROM (SELECT impression_id, t.i, avg(embedding[t.i]) AS v FROM he, range(1, 65) t(i) GROUP BY 1, 2) GROUP BY 1),
    {name}_s AS (SELECT subcategory, count(*) / (SELECT count(*) FROM items)::DOUBLE AS share FROM items GROUP BY 1),
    {name} AS (SELECT p.*, i.embedding, pop.popularity::DOUBLE AS popularity, coalesce(h.n_hist, 0) AS n_hist, coalesce(t.hist_total, 0) AS hist_total,
        (SELECT count(DISTINCT category) FROM items)::DOUBLE AS nc, (SELECT count(DISTINCT subcategory) FROM items)::DOUBLE AS ns, s.share,
        CASE WHEN c.centroid IS NULL THEN NULL ELSE list_inner_product(i.embedding, c.centroid) END AS cos,
        max(pop.popularity::DOUBLE) OVER (PARTITION BY p.impression_id) AS max_pop,
        (p.score - min(p.score) OVER (PARTITION BY p.impression_id)) / greatest(max(p.score) OVER (PARTITION BY p.impression_id) - min(p.score) OVER (PARTITION BY p.impression_id), 1e-9) AS rel,
        CASE WHEN p.category IS NULL THEN 1.0 / (SELECT count(DISTINCT category) FROM items) ELSE (1 - {explore}) * CASE WHEN t.hist_total > 0 THEN (coalesce(h.n_hist, 0) + 0.01) / (t.hist_total + 0.01 * (SELECT count(DISTINCT category) FROM items)) ELSE 1.0 / (SELECT count(DISTINCT category) FROM items) END
            + {explore} / (SELECT count(DISTINCT category) FROM items) END AS target
        FROM {pool} p JOIN items i USING (item_id) JOIN pop USING (item_id) LEFT JOIN {name}_h h ON h.impression_id = p.impression_id AND h.category = p.category
        LEFT JOIN {name}_t t ON t.impression_id = p.impression_id LEFT JOIN {name}_c c ON c.impression_id = p.impression_id LEFT JOIN {name}_s s ON s.subcategory = p.subcategory)"""


def greedy_sql(src: str, objective: str, k: str = "10", name: str = "g") -> str:
    """Recursive CTE: one pick per level by brute force over all remaining candidates.

    The objective may use step (picks so far), ncat, nsub (picks of the row's category/subcategory) and msim.
    """
    return f"""{name} AS (
        SELECT 0 AS step, s.*, 0 AS picked, 0 AS ncat, 0 AS nsub, NULL::DOUBLE AS msim FROM {src} s
        UNION ALL
        SELECT step + 1, * EXCLUDE (step, o, b_item, b_cat, b_sub, b_emb) REPLACE (CASE WHEN item_id = b_item AND picked = 0 THEN step + 1 ELSE picked END AS picked,
            ncat + CASE WHEN category = b_cat THEN 1 ELSE 0 END AS ncat, nsub + CASE WHEN subcategory = b_sub THEN 1 ELSE 0 END AS nsub,
            greatest(coalesce(msim, -9), list_inner_product(embedding, b_emb)) AS msim)
        FROM (SELECT *, first_value(item_id) OVER w AS b_item, first_value(category) OVER w AS b_cat, first_value(subcategory) OVER w AS b_sub, first_value(embedding) OVER w AS b_emb
            FROM (SELECT *, {objective} AS o FROM {name} WHERE step < {k}) WINDOW w AS (PARTITION BY impression_id ORDER BY CASE WHEN picked > 0 THEN 1 ELSE 0 END, round(o, 9) DESC, item_id))),
    {name}_out AS (SELECT impression_id, item_id, score, picked::BIGINT AS rank FROM {name} WHERE picked > 0 AND step = {k})"""


MMR = "{l} * score - (1 - {l}) * CASE WHEN step = 0 THEN 0 ELSE 0.7 * msim + 0.3 * ncat / step END"
XQUAD = """{l} * score + (1 - {l}) * greatest(0.005, (1 - {e}) * CASE WHEN hist_total > 0 THEN n_hist / hist_total ELSE 1 / nc END + {e} / nc - ncat / greatest(step, 1)::DOUBLE)"""
SERENDIPITY = """(1 - {b}) * score + {b} * (0.35 * CASE WHEN cos IS NULL THEN 0.5 ELSE 1 - cos END + 0.25 * (1 - popularity / CASE WHEN max_pop = 0 THEN 1 ELSE max_pop END)
    + 0.25 * CASE WHEN step = 0 THEN 1 ELSE 1 - msim END - 0.15 * ncat / greatest(step, 1))"""
COMPOSITE = """{r} * rel + {d} * CASE WHEN step = 0 THEN 1.0 ELSE least(1.0, greatest(0.0, 1 - msim)) END
    + {c} * (least(1.0, greatest(-1.0, (target - ncat / greatest(step, 1)::DOUBLE) * nc)) + 1) / 2
    + {s} * CASE WHEN cos IS NULL THEN 0.5 ELSE least(1.0, greatest(0.0, 1 - least(1.0, greatest(-1.0, cos)))) END
    + {f} * least(1.0, greatest(0.0, 1 / ns - nsub / greatest(step, 1)::DOUBLE) * CASE WHEN n_hist > 0 THEN 1.0 ELSE 1 / ns / share END * ns)"""
TUNED = {"w_relevance": 0.35, "w_diversity": 0.25, "w_calibration": 0.25, "w_serendipity": 0.10, "w_fairness": 0.05, "explore_weight": 0.40}
TUNED_SQL = COMPOSITE.format(r=0.35, d=0.25, c=0.25, s=0.10, f=0.05)

# calibrated by the definition: full divergence over all categories for every candidate and step
CALIBRATED = """(1 - {a}) * score - {a} * list_sum(list_transform(range(1, len(tvec) + 1), lambda i: tvec[i] * ln(tvec[i] / ((nvec[i] + CASE WHEN i = ci THEN 1 ELSE 0 END + 0.01) / (step + 1 + 0.01 * len(tvec))))))"""


def calibrated_sql(src: str, alpha: float, weight: float, k: str = "10", name: str = "cal") -> str:
    return f"""{name}_n AS (SELECT category, row_number() OVER (ORDER BY category) AS ci FROM (SELECT DISTINCT category FROM items)),
    {name}_v AS (SELECT l.impression_id, list((1 - {weight}) * CASE WHEN t.hist_total > 0 THEN (coalesce(h.n_hist, 0) + 0.01) / (t.hist_total + 0.01 * (SELECT count(*) FROM {name}_n)) ELSE 1.0 / (SELECT count(*) FROM {name}_n) END
        + {weight} / (SELECT count(*) FROM {name}_n)::DOUBLE ORDER BY n.ci) AS tvec FROM (SELECT DISTINCT impression_id FROM {src}) l CROSS JOIN {name}_n n
        LEFT JOIN fe_h h ON h.impression_id = l.impression_id AND h.category = n.category LEFT JOIN fe_t t ON t.impression_id = l.impression_id GROUP BY 1),
    {name} AS (
        SELECT 0 AS step, s.impression_id, s.item_id, s.score, n.ci, v.tvec, list_transform(v.tvec, lambda x: 0) AS nvec, 0 AS picked
            FROM {src} s JOIN {name}_n n USING (category) JOIN {name}_v v USING (impression_id)
        UNION ALL
        SELECT step + 1, impression_id, item_id, score, ci, tvec, list_transform(range(1, len(nvec) + 1), lambda i: nvec[i] + CASE WHEN i = b_ci THEN 1 ELSE 0 END),
            CASE WHEN item_id = b_item AND picked = 0 THEN step + 1 ELSE picked END
        FROM (SELECT *, first_value(item_id) OVER w AS b_item, first_value(ci) OVER w AS b_ci FROM (SELECT *, {CALIBRATED.format(a=alpha)} AS o FROM {name} WHERE step < {k})
            WINDOW w AS (PARTITION BY impression_id ORDER BY CASE WHEN picked > 0 THEN 1 ELSE 0 END, round(o, 9) DESC, item_id))),
    {name}_out AS (SELECT impression_id, item_id, score, picked::BIGINT AS rank FROM {name} WHERE picked > 0 AND step = {k})"""


def setup(spark, d, n: int = N_CANDIDATES, meta=None):
    """Top-n baseline candidates of every test list and the re-ranking context; both are reused by all methods."""
    model, h = M.prepared(spark, d, meta)
    cands = stage(M.recommend(T.test_lists(spark, d), h, model, n), "candidates")
    return cands, H.Context(model.items, model.vectors, model.popularity, h)


BASE = RANKED_SQL + ",\n" + pool_sql(N_CANDIDATES) + ",\n" + feature_sql()
_OUT = "SELECT impression_id, item_id, rank, round(score, 6) AS score FROM {0}"


def _method(name: str, query: str, oracle: str, method: str, **params):
    def run(spark, d):
        cands, ctx = setup(spark, d)
        return A.rounded(H.rerank(method, cands, ctx, 10, **params))

    run.__name__ = name
    q(name, sql(VIEWS, query, oracle, recursive=True))(run)


_method("rerank_mmr", _OUT.format("g_out"), BASE + ",\n" + greedy_sql("fe", MMR.format(l=0.5)), "mmr", lambda_param=0.5)
_method("rerank_xquad", _OUT.format("g_out"), BASE + ",\n" + greedy_sql("fe", XQUAD.format(l=0.5, e=0.3)), "xquad", lambda_param=0.5, explore_weight=0.3)
_method("rerank_calibrated", _OUT.format("cal_out"), BASE + ",\n" + calibrated_sql("fe", 0.6, 0.3), "calibrated", alpha=0.6, diversity_weight=0.3)
_method("rerank_serendipity", _OUT.format("g_out"), BASE + ",\n" + greedy_sql("fe", SERENDIPITY.format(b=0.4)), "serendipity", beta=0.4)
_method(
    "rerank_composite",
    _OUT.format("g_out"),
    RANKED_SQL + ",\n" + pool_sql(N_CANDIDATES) + ",\n" + feature_sql(explore=0.4) + ",\n" + greedy_sql("fe", TUNED_SQL),
    "composite",
    **TUNED,
)

BOUNDED = """bounded AS (SELECT impression_id, item_id, score, row_number() OVER (PARTITION BY impression_id ORDER BY CASE WHEN j > 2 THEN 1 ELSE 0 END, round(score, 9) DESC, item_id) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY impression_id, category ORDER BY round(score, 9) DESC, item_id) AS j FROM {0}) QUALIFY rank <= {1})"""
COVERED = """cov_h AS (SELECT *, row_number() OVER (PARTITION BY impression_id, category ORDER BY round(score, 9) DESC, item_id) AS j FROM {0}),
    cov_b AS (SELECT impression_id, item_id, row_number() OVER (PARTITION BY impression_id ORDER BY n_hist, round(score, 9) DESC, item_id) AS cr FROM cov_h WHERE j = 1),
    covered AS (SELECT h.impression_id, h.item_id, h.score, row_number() OVER (PARTITION BY h.impression_id ORDER BY b.cr NULLS LAST, round(h.score, 9) DESC, h.item_id) AS rank
        FROM cov_h h LEFT JOIN cov_b b ON b.impression_id = h.impression_id AND b.item_id = h.item_id AND b.cr <= 6 QUALIFY rank <= {1})"""
RANDOM = """shuffled AS (SELECT impression_id, item_id, score, row_number() OVER (PARTITION BY impression_id ORDER BY md5('42|' || impression_id || '|' || item_id), item_id) AS rank FROM {0} QUALIFY rank <= {1})"""

_method("rerank_bounded_greedy", _OUT.format("bounded"), BASE + ",\n" + BOUNDED.format("fe", 10), "bounded_greedy", max_per_category=2)
_method("rerank_max_coverage", _OUT.format("covered"), BASE + ",\n" + COVERED.format("fe", 10), "max_coverage", coverage_budget=0.6)
_method("rerank_random", _OUT.format("shuffled"), BASE + ",\n" + RANDOM.format("fe", 10), "random", seed=42)
_method("rerank_baseline", _OUT.format("(SELECT * FROM rec WHERE rank <= 10)"), RANKED_SQL, "baseline")


# the same methods over a catalogue in which most items have no category
def _partial(name: str, query: str, oracle: str, method: str, **params):
    def run(spark, d):
        cands, ctx = setup(spark, d, meta=T.partial_meta(spark, d))
        return A.rounded(H.rerank(method, cands, ctx, 10, **params))

    run.__name__ = f"{name}_partial"
    q(run.__name__, sql("items_partial " + VIEWS.replace("items ", ""), query, oracle, recursive=True))(run)


_partial("rerank_mmr", _OUT.format("g_out"), BASE + ",\n" + greedy_sql("fe", MMR.format(l=0.5)), "mmr", lambda_param=0.5)
_partial("rerank_serendipity", _OUT.format("g_out"), BASE + ",\n" + greedy_sql("fe", SERENDIPITY.format(b=0.4)), "serendipity", beta=0.4)
_partial(
    "rerank_composite",
    _OUT.format("g_out"),
    RANKED_SQL + ",\n" + pool_sql(N_CANDIDATES) + ",\n" + feature_sql(explore=0.4) + ",\n" + greedy_sql("fe", TUNED_SQL),
    "composite",
    **TUNED,
)
_partial("rerank_random", _OUT.format("shuffled"), BASE + ",\n" + RANDOM.format("fe", 10), "random", seed=42)
_partial("rerank_bounded_greedy", _OUT.format("bounded"), BASE + ",\n" + BOUNDED.format("(SELECT * FROM fe WHERE category IS NOT NULL)", 10), "bounded_greedy", max_per_category=2)


@q(
    "category_pool",
    sql(
        VIEWS,
        "SELECT category, item_id, round(popularity::DOUBLE, 6) AS popularity, row_number() OVER (PARTITION BY category ORDER BY round(popularity::DOUBLE, 9) DESC, item_id) AS place FROM pop",
        RANKED_SQL,
    ),
)
def category_pool(spark, d):
    """All items by popularity within their category."""
    model, h = M.prepared(spark, d)
    ctx = H.Context(model.items, model.vectors, model.popularity, h)
    return A.rounded(H.category_pool(ctx))


@q(
    "inject_pool",
    sql(VIEWS, "SELECT impression_id, item_id, round(score, 6) AS score, injected FROM pool", RANKED_SQL + ",\n" + pool_sql(10)),
)
def inject_pool(spark, d):
    """Top-10 lists with popular unseen items of their absent categories."""
    cands, ctx = setup(spark, d, 10)
    return A.rounded(H.inject(cands, ctx))


_SIMPLE_BASE = (
    RANKED_SQL
    + """,
    sp AS (SELECT l.impression_id, p.item_id, p.category, p.subcategory, p.popularity::DOUBLE AS score, 0 AS injected FROM hl l, pop p
        WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.impression_id = l.impression_id AND s.item_id = p.item_id)),
    """
    + feature_sql("sp")
    + """,
    cs AS (SELECT category, count(*) / (SELECT count(*) FROM items)::DOUBLE AS cshare FROM items GROUP BY 1),
    fs AS (SELECT fe.*, cs.cshare FROM fe JOIN cs USING (category))"""
)
_SIMPLE = {
    "mmr": ("0.5 * score - 0.5 * CASE WHEN ncat > 0 THEN 1 ELSE 0 END", {"lambda_param": 0.5}),
    "xquad": ("0.5 * score + 0.5 * CASE WHEN ncat = 0 THEN 1 ELSE 0.5 / (ncat + 1) END", {"lambda_param": 0.5}),
    "serendipity": ("0.6 * score + CASE WHEN n_hist = 0 THEN 0.4 ELSE 0 END", {"beta": 0.4}),
    "calibrated": ("0.4 * score + 0.6 * greatest(0, CASE WHEN n_hist > 0 THEN n_hist / hist_total ELSE 1 / nc END - (ncat + 1) / (step + 1)::DOUBLE)", {"alpha": 0.6}),
    "composite": (
        """0.4 * score + 0.15 * (1 - ncat / greatest(step, 1)::DOUBLE)
        + 0.15 * least(1.0, greatest(0.0, ((0.7 * CASE WHEN hist_total > 0 THEN n_hist / hist_total ELSE 0 END + 0.3 / nc) - ncat / greatest(step, 1)::DOUBLE) * nc))
        + 0.15 * CASE WHEN ncat > 0 THEN 0 WHEN n_hist > 0 THEN 0.1 ELSE 1 END
        + 0.15 * least(1.0, greatest(0.0, 1 / nc - ncat / greatest(step, 1)::DOUBLE) * CASE WHEN n_hist > 0 THEN 1.0 ELSE 1 / nc / cshare END * nc)""",
        {},
    ),
}


def _simple(method: str, objective: str, params: dict):
    def run(spark, d):
        model, h = M.prepared(spark, d)
        ctx = H.Context(model.items, model.vectors, model.popularity, h)
        pool = H.popular_pool(h.select("impression_id").distinct(), ctx, 10)
        return A.rounded(H.SIMPLE_METHODS[method](pool, ctx, 10, **params))

    run.__name__ = f"simple_{method}"
    q(run.__name__, sql(VIEWS, _OUT.format("g_out"), _SIMPLE_BASE + ",\n" + greedy_sql("fs", objective), recursive=True))(run)


for _name, (_objective, _params) in _SIMPLE.items():
    _simple(_name, _objective, _params)
