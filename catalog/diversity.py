"""Diversity and echo-chamber metrics of histories and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import accuracy as CA, rerank as CR
from catalog.retrieval import RANKED_SQL, SHOWN_SQL
from catalog.views import VIEWS as PARTIAL, Catalog, sql
from lapwing.operators import accuracy as I, aggregates as A, diversity as J, rerank as H
from lapwing.plans import evaluate as E, recommend as M, tables as T
from lapwing.session import stage

CATALOG = Catalog()
q = CATALOG.add
KEY = ["impression_id"]
VIEWS = "items impr hist"


def list_sql(src: str, name: str, key: str = "impression_id", order: str = "item_id", singleton: str = "1.0") -> str:
    """CTEs {name}_g (gini, entropy, counts) and {name}_i (ILD over all pairs) of the lists in `src`."""
    return f"""{name}_c AS (SELECT {key}, category, count(*) AS n FROM {src} JOIN items USING (item_id) GROUP BY ALL),
    {name}_g AS (SELECT {key}, CASE WHEN count(*) = 1 THEN {singleton} ELSE 2 * sum(i * n) / (count(*) * sum(n))::DOUBLE - (count(*) + 1) / count(*)::DOUBLE END AS gini,
        count(*) AS n_categories, sum(n) AS size, -sum(n / t * ln(n / t)) AS entropy_nats, 1 - sum(n * (n - 1)) / nullif(sum(n) * (sum(n) - 1), 0)::DOUBLE AS cild
        FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY n) AS i, sum(n) OVER (PARTITION BY {key})::DOUBLE AS t FROM {name}_c) GROUP BY {key}),
    {name}_e AS (SELECT s.*, i.embedding FROM {src} s JOIN items i USING (item_id)),
    {name}_i AS (SELECT {key}, avg(1 - list_inner_product(a.embedding, b.embedding)) AS ild FROM {name}_e a JOIN {name}_e b USING ({key}) WHERE a.{order} < b.{order} GROUP BY {key})"""


def calibration_sql(rec: str, past: str, name: str, key: str = "impression_id") -> str:
    """CTE `name`: KL(history || recommendations) over the full category grid."""
    return f"""{name}_a AS (SELECT DISTINCT category FROM items),
    {name}_l AS (SELECT {key}, sum(n) AS rt FROM {rec} GROUP BY ALL), {name}_p AS (SELECT impression_id, sum(n) AS ht FROM {past} GROUP BY ALL),
    {name}_d AS (SELECT {key}, (coalesce(h.n, 0) + 0.01) / (ht + 0.01 * (SELECT count(*) FROM {name}_a)) AS p, (coalesce(r.n, 0) + 0.01) / (rt + 0.01 * (SELECT count(*) FROM {name}_a)) AS q
        FROM {name}_l JOIN {name}_p USING (impression_id) CROSS JOIN {name}_a LEFT JOIN {rec} r USING ({key}, category) LEFT JOIN {past} h USING (impression_id, category)),
    {name} AS (SELECT {key}, sum(p * ln(p / q))::DOUBLE AS calibration_error FROM {name}_d GROUP BY {key})"""


_NC = "(SELECT count(DISTINCT category) FROM items)"


def history_ild(spark, d):
    """Mean pairwise distance within the history of every impression."""
    return J.ild_of_sums(T.history_sums(spark, d, T.item_vectors(spark, d)), T.history_lengths(spark, d), KEY)


def history_metrics(spark, d):
    """gini, ild, coverage per history."""
    items = T.item_meta(spark, d)
    counts = stage(T.history_counts(spark, d, items), "counts")
    rows = J.coverage(J.share_metrics(counts, KEY), J.n_categories(items))
    return rows.join(J.gini(counts, KEY), KEY).join(history_ild(spark, d), KEY)


@q("user_gini", sql("items hist", "SELECT impression_id, round(gini, 6) AS gini FROM l_g", list_sql("hist", "l", order="pos")))
def user_gini(spark, d):
    return A.rounded(J.gini(T.history_counts(spark, d, T.item_meta(spark, d)), KEY))


@q(
    "balance_gini",
    sql("items hist", "SELECT impression_id, round(gini, 6) AS gini FROM l_g", list_sql("hist", "l", order="pos", singleton="0.0")),
)
def balance_gini(spark, d):
    """Bare formula: one category counts as balanced."""
    return A.rounded(J.gini(T.history_counts(spark, d, T.item_meta(spark, d)), KEY, singleton=0.0))


@q(
    "user_entropy",
    sql(
        "items hist",
        f"""SELECT impression_id, n_categories, round(abs(entropy_nats), 6) AS entropy_nats, round(abs(entropy_nats) / ln(2), 6) AS entropy_bits,
        round(coalesce(cild, 0), 6) AS category_ild, round(n_categories / {_NC}::DOUBLE, 6) AS coverage, n_categories || '/' || {_NC} AS coverage_str FROM l_g""",
        list_sql("hist", "l", order="pos"),
    ),
)
def user_entropy(spark, d):
    """Entropy in nats and bits, category ILD and coverage of every history."""
    items = T.item_meta(spark, d)
    rows = J.coverage(J.share_metrics(T.history_counts(spark, d, items), KEY), J.n_categories(items))
    return A.rounded(rows.drop("size")).withColumn("entropy_nats", F.abs("entropy_nats")).withColumn("entropy_bits", F.abs("entropy_bits"))


@q(
    "user_ild",
    sql("items hist", "SELECT h.impression_id, round(coalesce(ild, 0), 6) AS ild FROM (SELECT DISTINCT impression_id FROM hist) h LEFT JOIN l_i USING (impression_id)", list_sql("hist", "l", order="pos")),
)
def user_ild(spark, d):
    """Mean pairwise distance within every history."""
    return A.rounded(history_ild(spark, d))


_CAL = """sh AS (SELECT impression_id, category, count(*) AS n FROM impr JOIN items USING (item_id) GROUP BY ALL),
    pa AS (SELECT impression_id, category, count(*) AS n FROM hist JOIN items USING (item_id) GROUP BY ALL),
    """ + calibration_sql("sh", "pa", "kl")


@q("calibration_kl", sql("items impr hist", "SELECT impression_id, round(calibration_error, 6) AS calibration_error FROM kl", _CAL))
def calibration_kl(spark, d):
    """Divergence of the shown items from the history, every impression with a history."""
    items = T.item_meta(spark, d)
    shown = A.category_counts(T.impressions(spark, d), items, KEY)
    past = T.history_counts(spark, d, items)
    return A.rounded(J.calibration_error(shown, past, KEY, J.n_categories(items)))


@q(
    "history_baseline",
    sql(
        "items hist",
        f"""SELECT count(*) AS n_lists, round(avg(gini), 6) AS avg_gini, round(avg(coalesce(ild, 0)), 6) AS avg_ild, round(avg(n_categories / {_NC}::DOUBLE), 6) AS avg_coverage
        FROM l_g LEFT JOIN l_i USING (impression_id)""",
        list_sql("hist", "l", order="pos"),
    ),
)
def history_baseline(spark, d):
    """No-model baseline: concentration of the raw click histories."""
    rows = history_metrics(spark, d)
    return A.rounded(
        rows.agg(F.count(F.lit(1)).alias("n_lists"), F.avg("gini").alias("avg_gini"), F.avg("ild").alias("avg_ild"), F.avg("coverage").alias("avg_coverage"))
    )


@q(
    "system_hhi",
    sql("items impr", "SELECT round(sum(n * n) / (sum(n) * sum(n))::DOUBLE, 6) AS system_hhi FROM (SELECT subcategory, count(*) AS n FROM impr JOIN items USING (item_id) GROUP BY 1)"),
)
def system_hhi(spark, d):
    return A.rounded(J.hhi(A.category_counts(T.impressions(spark, d), T.item_meta(spark, d), [], "subcategory")))


_KL = """c AS (SELECT category, count(*) / (SELECT count(*) FROM doc_items)::DOUBLE AS p FROM doc_items GROUP BY 1),
    r AS (SELECT category, count(*) AS n FROM impr JOIN doc_items USING (item_id) GROUP BY 1)"""


@q(
    "system_kl",
    sql(
        "doc_items impr",
        """SELECT round(sum(p * ln(p / ((coalesce(n, 0) + 1e-9) / ((SELECT sum(n) FROM r) + 1e-9 * (SELECT count(*) FROM c))))), 6) AS system_kl FROM c LEFT JOIN r USING (category)""",
        _KL,
    ),
)
def system_kl(spark, d):
    """Divergence of everything shown from the unbalanced catalogue."""
    items = T.doc_items(spark, d).drop("text")
    corpus = items.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return A.rounded(J.system_kl(corpus, A.category_counts(T.impressions(spark, d), items, [])))


@q(
    "population_gini",
    sql(
        "items hist",
        """SELECT (SELECT round(2 * sum(i * n) / (count(*) * sum(n))::DOUBLE - (count(*) + 1) / count(*)::DOUBLE, 6) FROM (SELECT n, row_number() OVER (ORDER BY n) AS i FROM (SELECT category, sum(n) AS n FROM l_c GROUP BY 1))) AS overall_gini,
        (SELECT count(DISTINCT category) FROM l_c) AS unique_categories, round(avg(gini), 6) AS avg_gini, round(avg(n_categories), 6) AS avg_coverage FROM l_g""",
        list_sql("hist", "l", order="pos", singleton="0.0"),
    ),
)
def population_gini(spark, d):
    return A.rounded(J.population_of(T.history_counts(spark, d, T.item_meta(spark, d)), KEY))


UM_SQL = (
    """lst AS (SELECT impression_id, item_id FROM rec WHERE rank <= 10),
    hrows AS (SELECT impression_id, item_id, pos FROM th),
    """
    + list_sql("lst", "l")
    + ",\n"
    + list_sql("hrows", "h", order="pos")
    + ",\n"
    + calibration_sql("l_c", "h_c", "kl")
    + f""",
    um AS (SELECT g.impression_id, g.gini, coalesce(i.ild, 0) AS ild, g.n_categories / {_NC}::DOUBLE AS coverage, k.calibration_error, abs(g.entropy_nats) AS entropy_nats,
        abs(g.entropy_nats) / ln(2) AS entropy_bits, g.n_categories, h.gini AS history_gini, hl.n_history AS history_length
        FROM l_g g LEFT JOIN l_i i USING (impression_id) JOIN kl k USING (impression_id) JOIN h_g h USING (impression_id) JOIN hl USING (impression_id))"""
)
REC_UM = RANKED_SQL + ",\n" + UM_SQL


def metrics_of(spark, d, method: str | None = None, k: int = 10, **params):
    """Per-user metrics of the recommended (or re-ranked) top-10."""
    if method is None:
        model, h = M.prepared(spark, d)
        recs, ctx = M.recommend(T.test_lists(spark, d), h, model, k), H.Context(model.items, model.vectors, model.popularity, h)
    else:
        cands, ctx = CR.setup(spark, d)
        recs = H.rerank(method, cands, ctx, k, **params)
    items = T.items(spark, d)
    lists = stage(recs.select("impression_id", "item_id"), "lists")
    return J.user_metrics(lists, ctx.history, items, KEY, A.history_lengths(ctx.history))


_UM_COLS = "round(gini, 6) AS gini, round(ild, 6) AS ild, round(coverage, 6) AS coverage, round(calibration_error, 6) AS calibration_error, round(entropy_nats, 6) AS entropy_nats, round(entropy_bits, 6) AS entropy_bits, n_categories, round(history_gini, 6) AS history_gini, history_length"


@q("user_metrics", sql(VIEWS, f"SELECT impression_id, {_UM_COLS} FROM um", REC_UM))
def user_metrics(spark, d):
    """Echo-chamber metrics of every user's recommendations."""
    out = A.rounded(metrics_of(spark, d))
    return out.withColumn("entropy_nats", F.abs("entropy_nats")).withColumn("entropy_bits", F.abs("entropy_bits"))


@q(
    "overall_metrics",
    sql(
        VIEWS,
        """SELECT count(*) AS n_users, round(avg(gini), 6) AS avg_gini, round(quantile_cont(gini, 0.5), 6) AS median_gini, round(avg(ild), 6) AS avg_ild,
        round(quantile_cont(ild, 0.5), 6) AS median_ild, round(avg(coverage), 6) AS avg_coverage, round(avg(calibration_error), 6) AS avg_calibration_error,
        round(avg(entropy_nats), 6) AS avg_entropy_nats, round(avg(n_categories), 6) AS avg_unique_categories FROM um""",
        REC_UM,
    ),
)
def overall_metrics(spark, d):
    return A.rounded(J.overall(stage(metrics_of(spark, d), "metrics")))


_SEG = "CASE WHEN round(gini, 9) > 0.8 THEN 'filter_bubble' WHEN round(gini, 9) BETWEEN 0.4 AND 0.6 THEN 'balanced' WHEN round(gini, 9) < 0.4 THEN 'diverse' ELSE 'other' END"


@q(
    "segments",
    sql(
        VIEWS,
        f"""SELECT s.segment, coalesce(n, 0) AS n_users, round(coalesce(n, 0) * 100.0 / (SELECT count(*) FROM um), 6)::DOUBLE AS pct, round(coalesce(g, 0), 6) AS avg_gini,
        round(coalesce(i, 0), 6) AS avg_ild, round(coalesce(c, 0), 6) AS avg_calibration_error FROM (VALUES ('filter_bubble'), ('balanced'), ('diverse'), ('other')) s(segment)
        LEFT JOIN (SELECT {_SEG} AS segment, count(*) AS n, avg(gini) AS g, avg(ild) AS i, avg(calibration_error) AS c FROM um GROUP BY 1) USING (segment)""",
        REC_UM,
    ),
)
def segments(spark, d):
    return A.rounded(J.segments(stage(metrics_of(spark, d), "metrics")))


@q(
    "percentiles",
    sql(
        VIEWS,
        """SELECT 'gini' AS metric, p::DOUBLE AS share, round(quantile_cont(gini, [0.25, 0.5, 0.75, 0.9])[i], 6) AS value FROM um, (VALUES (1, 0.25), (2, 0.5), (3, 0.75), (4, 0.9)) v(i, p) GROUP BY p, i
        UNION ALL SELECT 'ild', p, round(quantile_cont(ild, [0.25, 0.5, 0.75, 0.9])[i], 6) FROM um, (VALUES (1, 0.25), (2, 0.5), (3, 0.75), (4, 0.9)) v(i, p) GROUP BY p, i""",
        REC_UM,
    ),
)
def percentiles(spark, d):
    return A.rounded(J.percentiles(stage(metrics_of(spark, d), "metrics")))


_LIVE = RANKED_SQL + ",\nlst AS (SELECT impression_id, item_id FROM rec WHERE rank <= 10),\n" + list_sql("lst", "l") + """,
    rare AS (SELECT category FROM items GROUP BY 1 HAVING count(*) / (SELECT count(*) FROM items)::DOUBLE < 0.1),
    mc AS (SELECT impression_id, coalesce(count(DISTINCT r.category) / nullif((SELECT count(*) FROM rare), 0)::DOUBLE, 0) AS minority_coverage FROM lst JOIN items USING (item_id) LEFT JOIN rare r USING (category) GROUP BY 1)"""
_LIVE_BODY = f"""SELECT impression_id, round(gini, 6) AS gini, round(coalesce(ild, 0), 6) AS ild, round(n_categories / {_NC}::DOUBLE, 6) AS coverage, n_categories || '/' || {_NC} AS coverage_str,
    round(abs(entropy_nats) / ln(2), 6) AS entropy, round(minority_coverage, 6) AS minority_coverage FROM l_g LEFT JOIN l_i USING (impression_id) JOIN mc USING (impression_id)"""


def _live(spark, d):
    model, h = M.prepared(spark, d)
    lists = stage(M.recommend(T.test_lists(spark, d), h, model, 10).select("impression_id", "item_id"), "lists")
    return J.live_metrics(lists, T.items(spark, d), KEY, limit=0.1)


@q("live_metrics", sql(VIEWS, _LIVE_BODY, _LIVE))
def live_metrics(spark, d):
    """Metrics shown with a feed; rare categories are those below 10 % of this even catalogue."""
    return A.rounded(_live(spark, d)).withColumn("entropy", F.abs("entropy"))


_UNEVEN = (
    RANKED_SQL
    + ",\nlst AS (SELECT impression_id, item_id FROM rec WHERE rank <= 10),\n"
    + PARTIAL["items_partial"].replace("items AS (", "pitems AS (", 1)
    + ", pcat AS (SELECT * FROM pitems WHERE category IS NOT NULL),\n"
    + list_sql("lst", "l").replace("JOIN items USING", "JOIN pcat USING", 1)
    + """,
    rare AS (SELECT category FROM pitems GROUP BY 1 HAVING count(*) / (SELECT count(*) FROM pitems)::DOUBLE < 0.05),
    mc AS (SELECT impression_id, coalesce(count(DISTINCT r.category) / nullif((SELECT count(*) FROM rare), 0)::DOUBLE, 0) AS minority_coverage FROM lst JOIN pitems USING (item_id) LEFT JOIN rare r USING (category) GROUP BY 1)"""
)


@q("live_metrics_uneven", sql(VIEWS, _LIVE_BODY.replace("FROM items)", "FROM pcat)"), _UNEVEN))
def live_metrics_uneven(spark, d):
    """Metrics shown with a feed over uneven categories with gaps; rare ones are below 5 %."""
    model, h = M.prepared(spark, d)
    lists = stage(M.recommend(T.test_lists(spark, d), h, model, 10).select("impression_id", "item_id"), "lists")
    items = T.partial_meta(spark, d).join(T.item_vectors(spark, d), "item_id")
    return A.rounded(J.live_metrics(lists, items, KEY)).withColumn("entropy", F.abs("entropy"))


@q(
    "metric_flags",
    sql(
        VIEWS,
        "SELECT impression_id, round(gini, 6) < 0.5 AS gini_ok, ild > 0.4 AS ild_ok, coverage > 0.25 AS coverage_ok, entropy > 1.5 AS entropy_ok, minority_coverage >= 0.4 AS minority_coverage_ok FROM (" + _LIVE_BODY + ")",
        _LIVE,
    ),
)
def metric_flags(spark, d):
    return J.flags(_live(spark, d)).select("impression_id", *[f"{c}_ok" for c in J.FLAGS])


# --------------------------------------------------------------------------- all methods

_PARTS = [
    ("mmr", CR.MMR.format(l=0.5), "fe"),
    ("xquad", CR.XQUAD.format(l=0.5, e=0.3), "fe"),
    ("serendipity", CR.SERENDIPITY.format(b=0.4), "fe"),
    ("composite", CR.TUNED_SQL, "fc"),
]


def _with_target(name: str, src: str, explore: float) -> str:
    """Feature CTE `name` equal to `src` but with another exploration weight in the target."""
    return f"""{name} AS (SELECT * REPLACE ((1 - {explore}) * CASE WHEN hist_total > 0 THEN (n_hist + 0.01) / (hist_total + 0.01 * nc) ELSE 1 / nc END + {explore} / nc AS target) FROM {src})"""


def methods_sql() -> str:
    """CTEs mrec (recommendations of all methods) and msc (labelled impression scores of all methods)."""
    longest = "(SELECT max(c) FROM (SELECT count(*) AS c FROM ls GROUP BY impression_id))"
    parts = [RANKED_SQL, CR.pool_sql(100), CR.feature_sql("pool", "fe"), _with_target("fc", "fe", 0.4)]
    parts += [CR.greedy_sql(src, obj, "10", f"r_{m}") for m, obj, src in _PARTS]
    parts += [CR.calibrated_sql("fe", 0.6, 0.3, "10", "r_calibrated"), CR.BOUNDED.format("fe", 10), CR.COVERED.format("fe", 10), CR.RANDOM.format("fe", 10)]
    outs = {"baseline": "(SELECT * FROM rec WHERE rank <= 10)", "random": "shuffled", "bounded_greedy": "bounded", "max_coverage": "covered", "calibrated": "r_calibrated_out"}
    outs |= {m: f"r_{m}_out" for m, _, _ in _PARTS}
    parts.append("mrec AS (" + " UNION ALL ".join(f"SELECT '{m}' AS method, impression_id, item_id, rank FROM {o}" for m, o in outs.items()) + ")")
    parts += [SHOWN_SQL, "ls AS (SELECT s.impression_id, s.item_id, s.category, s.subcategory, p.label, s.score FROM esc s JOIN shown p USING (impression_id, item_id))"]
    parts += [CR.feature_sql("ls", "ge"), _with_target("gc", "ge", 0.4)]
    parts += [CR.greedy_sql("ge" if src == "fe" else "gc", obj, longest, f"e_{m}") for m, obj, src in _PARTS]
    parts += [CR.calibrated_sql("ge", 0.6, 0.3, longest, "e_calibrated")]
    every = "1000000"
    parts += [CR.BOUNDED.format("ge", every).replace("bounded AS", "e_bounded AS")]
    parts += [
        """ecov_h AS (SELECT *, row_number() OVER (PARTITION BY impression_id, category ORDER BY round(score, 9) DESC, item_id) AS j, count(*) OVER (PARTITION BY impression_id) AS sz FROM ge),
        ecov_b AS (SELECT impression_id, item_id, sz, row_number() OVER (PARTITION BY impression_id ORDER BY n_hist, round(score, 9) DESC, item_id) AS cr FROM ecov_h WHERE j = 1),
        e_covered AS (SELECT h.impression_id, h.item_id, row_number() OVER (PARTITION BY h.impression_id ORDER BY b.cr NULLS LAST, round(h.score, 9) DESC, h.item_id) AS rank
            FROM ecov_h h LEFT JOIN ecov_b b ON b.impression_id = h.impression_id AND b.item_id = h.item_id AND b.cr <= floor(0.6 * b.sz))"""
    ]
    ev = {m: f"e_{m}_out" for m, _, _ in _PARTS} | {"calibrated": "e_calibrated_out", "bounded_greedy": "e_bounded", "max_coverage": "e_covered"}
    blends = " UNION ALL ".join(
        f"""SELECT '{m}' AS method, l.impression_id, l.item_id, l.label, l.score * (1 - coalesce((r.rank - 1) / greatest(count(r.rank) OVER (PARTITION BY l.impression_id) - 1, 1)::DOUBLE, 1.0)) AS score
        FROM ls l LEFT JOIN {o} r ON r.impression_id = l.impression_id AND r.item_id = l.item_id"""
        for m, o in ev.items()
    )
    parts.append(
        f"""msc AS (SELECT 'baseline' AS method, impression_id, item_id, label, score FROM ls
        UNION ALL SELECT 'random', impression_id, item_id, label, ('0x' || substr(md5('42|' || impression_id || '|' || item_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE FROM ls UNION ALL {blends})"""
    )
    both = "method, impression_id"
    parts += [list_sql("mrec", "l", key=both), "h_c AS (SELECT impression_id, category, count(*) AS n FROM th JOIN items USING (item_id) GROUP BY ALL)", calibration_sql("l_c", "h_c", "kl", key=both)]
    parts.append(
        f"""mdiv AS (SELECT method, avg(gini) AS avg_gini, avg(coalesce(ild, 0)) AS avg_ild, avg(n_categories / {_NC}::DOUBLE) AS avg_coverage, avg(abs(entropy_nats) / ln(2)) AS avg_entropy,
        avg(calibration_error) AS avg_calibration_error FROM l_g LEFT JOIN l_i USING ({both}) JOIN kl USING ({both}) GROUP BY 1),
        msub AS (SELECT method, sum(n * n) / (sum(n) * sum(n))::DOUBLE AS system_hhi FROM (SELECT method, subcategory, count(*) AS n FROM mrec JOIN items USING (item_id) GROUP BY 1, 2) GROUP BY 1),
        mcp AS (SELECT category, count(*) / (SELECT count(*) FROM items)::DOUBLE AS p FROM items GROUP BY 1), mct AS (SELECT method, category, sum(n) AS n FROM l_c GROUP BY 1, 2),
        mtt AS (SELECT method, sum(n) AS t FROM mct GROUP BY 1),
        mkl AS (SELECT t.method, sum(p * ln(p / ((coalesce(n, 0) + 1e-9) / (t + 1e-9 * (SELECT count(*) FROM mcp))))) AS system_kl FROM mtt t CROSS JOIN mcp LEFT JOIN mct USING (method, category) GROUP BY 1),
        mauc AS (SELECT p.method, avg(CASE WHEN round(p.score, 9) > round(n.score, 9) THEN 1.0 WHEN round(p.score, 9) = round(n.score, 9) THEN 0.5 ELSE 0 END)::DOUBLE AS auc
            FROM msc p JOIN msc n ON p.method = n.method WHERE p.label = 1 AND n.label = 0 GROUP BY 1),
        mrk AS (SELECT *, row_number() OVER (PARTITION BY {both} ORDER BY round(score, 9) DESC, item_id) AS rank, row_number() OVER (PARTITION BY {both} ORDER BY label DESC, item_id) AS ideal FROM msc),
        mli AS (SELECT {both}, sum(label) AS nrel, sum(label) FILTER (WHERE rank <= 10) AS h, min(CASE WHEN label = 1 THEN rank END) AS f, sum(label / log2(rank + 1)) FILTER (WHERE rank <= 10) AS dcg,
            sum(label / log2(ideal + 1)) FILTER (WHERE ideal <= 10) AS idcg FROM mrk GROUP BY ALL HAVING sum(label) > 0),
        macc AS (SELECT method, avg(h / 10.0) AS precision, avg(h / nrel::DOUBLE) AS recall, avg(CASE WHEN f <= 10 THEN 1.0 / f ELSE 0 END) AS mrr, avg(dcg / idcg) AS ndcg FROM mli GROUP BY 1),
        res AS (SELECT * FROM mdiv JOIN msub USING (method) JOIN mkl USING (method) JOIN mauc USING (method) JOIN macc USING (method))"""
    )
    return ",\n".join(parts)


METHODS_SQL = methods_sql()
_RES = ["avg_gini", "avg_ild", "avg_coverage", "avg_entropy", "avg_calibration_error", "system_hhi", "system_kl", "auc", "precision", "recall", "mrr", "ndcg"]
_RES_SQL = ", ".join(f"round({c}, 6)::DOUBLE AS {c}" for c in _RES)


def evaluated(spark, d, params: dict | None = None):
    """Result row per method; recommendations and impression scores are written once each."""
    model, h = M.prepared(spark, d)
    ctx = H.Context(model.items, model.vectors, model.popularity, h)
    profile_table = stage(M.profiles(h, model.vectors), "profiles")
    cands = stage(M.recommend(T.test_lists(spark, d), h, model, 100, profile_table), "candidates")
    shown = T.test(spark, d)
    scores = M.score_candidates(shown, h, model, profile_table)
    scored = stage(shown.select("impression_id", "item_id", "label").join(scores, ["impression_id", "item_id"]), "scored")
    recs = stage(E.recommendations(cands, ctx, 10, params), "recs")
    msc = stage(E.impression_scores(scored, ctx, params), "method_scores")
    return E.evaluate(recs, msc, h, T.items(spark, d))


@q("method_results", sql(VIEWS, f"SELECT method, {_RES_SQL} FROM res", METHODS_SQL, recursive=True))
def method_results(spark, d):
    """Evaluation bundle of the baseline and all eight re-ranking methods."""
    return A.rounded(evaluated(spark, d))


def _best(metric: str, sign: str) -> str:
    return f"""SELECT '{metric}' AS metric, arg_min(method, {sign}round({metric}, 9)) AS method, arg_min({metric}, {sign}round({metric}, 9)) AS value,
        (SELECT {metric} FROM res WHERE method = 'baseline') AS base FROM res WHERE method <> 'baseline'"""


@q(
    "method_comparison",
    sql(
        VIEWS,
        "SELECT metric, method, round(value, 6) AS value, round(base, 6) AS base, round((base - value) / greatest(abs(base), 1e-9) * 100, 6) AS reduction_pct, round(value - base, 6) AS gain FROM ("
        + " UNION ALL ".join(_best(m, "" if s == "min" else "-") for m, s in J.BETTER.items())
        + ")",
        METHODS_SQL,
        recursive=True,
    ),
)
def method_comparison(spark, d):
    """Best re-ranker per diversity metric against the baseline."""
    return A.rounded(J.best_methods(stage(evaluated(spark, d), "results")))


@q(
    "method_trade_off",
    sql(
        VIEWS,
        """SELECT method, round(g, 6) AS gini_reduction_pct, round(n, 6) AS ndcg_cost_pct, round(g / greatest(abs(n), 0.01), 6) AS trade_off_ratio FROM
        (SELECT r.method, (b.avg_gini - r.avg_gini) / greatest(abs(b.avg_gini), 1e-9) * 100 AS g, (b.ndcg - r.ndcg) / greatest(abs(b.ndcg), 1e-9) * 100 AS n
        FROM res r, res b WHERE b.method = 'baseline' AND r.method <> 'baseline' ORDER BY round(r.avg_gini, 9), r.method LIMIT 1)""",
        METHODS_SQL,
        recursive=True,
    ),
)
def method_trade_off(spark, d):
    return A.rounded(J.trade_off(stage(evaluated(spark, d), "results")))


@q(
    "method_thresholds",
    sql(
        VIEWS,
        """SELECT metric, n_pass, (SELECT count(*) - 1 FROM res) AS n_methods FROM (
        SELECT 'avg_gini' AS metric, count(*) FILTER (WHERE avg_gini < 0.6 AND method <> 'baseline') AS n_pass FROM res
        UNION ALL SELECT 'avg_coverage', count(*) FILTER (WHERE avg_coverage > 0.25 AND method <> 'baseline') FROM res
        UNION ALL SELECT 'avg_ild', count(*) FILTER (WHERE avg_ild > 0.45 AND method <> 'baseline') FROM res
        UNION ALL SELECT 'auc', count(*) FILTER (WHERE auc >= 0.55 AND method <> 'baseline') FROM res)""",
        METHODS_SQL,
        recursive=True,
    ),
)
def method_thresholds(spark, d):
    return J.threshold_counts(stage(evaluated(spark, d), "results"))


@q(
    "base_model",
    sql(
        VIEWS,
        """SELECT method, round(auc, 6)::DOUBLE AS auc FROM (SELECT 'hybrid' AS method, auc FROM mauc WHERE method = 'baseline' UNION ALL SELECT 'random', auc FROM mauc WHERE method = 'random') ORDER BY auc DESC LIMIT 1""",
        METHODS_SQL,
        recursive=True,
    ),
)
def base_model(spark, d):
    """The scored table with the higher AUC: hybrid against the random bound."""
    rows, _ = CA.labelled(spark, d)
    both = rows.select(F.lit("hybrid").alias("method"), *rows.columns).unionByName(
        I.random_scores(rows).select(F.lit("random").alias("method"), *rows.columns)
    )
    top = I.auc(both, ["method"]).agg(F.max_by("method", "auc").alias("method"), F.max("auc").alias("auc"))
    return A.rounded(top)


@q(
    "metric_deltas",
    sql(
        VIEWS,
        "SELECT metric, round(o, 6)::DOUBLE AS old, round(n, 6)::DOUBLE AS new, round(n - o, 6)::DOUBLE AS delta FROM ("
        + " UNION ALL ".join(f"SELECT '{c}' AS metric, a.{c} AS o, b.{c} AS n FROM res a, res b WHERE a.method = 'mmr' AND b.method = 'composite'" for c in _RES)
        + ")",
        METHODS_SQL,
        recursive=True,
    ),
)
def metric_deltas(spark, d):
    """Metric by metric difference of two result rows (mmr against composite)."""
    params = {m: E.PARAMS[m] for m in ("mmr", "composite")}
    rows = J.long_form(stage(evaluated(spark, d, params), "results"))
    return A.rounded(J.deltas(rows.where(F.col("method") == "mmr"), rows.where(F.col("method") == "composite")))


@q(
    "recommendations_with_history",
    sql(
        VIEWS,
        """SELECT r.impression_id, r.n_recs, h.n_history, coalesce(o.n_same, 0) AS n_same_category FROM (SELECT impression_id, count(*) AS n_recs FROM rec WHERE rank <= 10 GROUP BY 1) r
        JOIN hl h USING (impression_id) LEFT JOIN (SELECT impression_id, count(*) AS n_same FROM (SELECT * FROM rec WHERE rank <= 10) x
        WHERE EXISTS (SELECT 1 FROM th JOIN items USING (item_id) WHERE th.impression_id = x.impression_id AND items.category = x.category) GROUP BY 1) o USING (impression_id)""",
        RANKED_SQL,
    ),
)
def recommendations_with_history(spark, d):
    """Recommendations joined with the user's own history by key: how many stay in known categories."""
    model, h = M.prepared(spark, d)
    recs = M.recommend(T.test_lists(spark, d), h, model, 10).join(model.items, "item_id")
    known = h.join(model.items, "item_id").select("impression_id", "category").distinct().withColumn("_k", F.lit(1))
    rows = recs.join(known, ["impression_id", "category"], "left").groupBy("impression_id").agg(
        F.count(F.lit(1)).alias("n_recs"), F.count("_k").alias("n_same_category")
    )
    return rows.join(A.history_lengths(h).select("impression_id", "n_history"), "impression_id")


def flagship(spark, d):
    """Recommend, re-rank with a category cap and measure concentration per user."""
    cands, ctx = CR.setup(spark, d)
    lists = H.rerank("bounded_greedy", cands, ctx, 10, max_per_category=2)
    return A.rounded(J.gini(A.category_counts(lists, ctx.items, KEY), KEY))
