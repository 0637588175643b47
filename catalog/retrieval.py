"""Neighbours, candidate pools, signals, hybrid scores and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.aggregates import COCLICK_SQL, POP_SQL
from catalog.views import Catalog, sql
from lapwing.operators import aggregates as A, popularity as P, profiles as PR, retrieve as R, score as S
from lapwing.plans import recommend as M, tables as T
from lapwing.session import stage

CATALOG = Catalog()
q = CATALOG.add


def _profile(name: str, rows: str, weight: str = "1.0") -> str:
    """CTE `name` (impression_id, vec): unit length weighted mean of `rows` (impression_id, embedding, w)."""
    return f"""{name}_d AS (SELECT impression_id, t.i, sum({weight} * embedding[t.i]) / sum({weight}) AS v FROM {rows}, range(1, 65) t(i) GROUP BY 1, 2),
    {name}_l AS (SELECT impression_id, list(v ORDER BY i) AS vec FROM {name}_d GROUP BY 1),
    {name} AS (SELECT impression_id, list_transform(vec, lambda x: x / sqrt(list_inner_product(vec, vec))) AS vec FROM {name}_l)"""


PROFILES_SQL = (
    """th AS (SELECT * FROM hist WHERE bucket = (SELECT max(bucket) FROM log)),
    hl AS (SELECT impression_id, count(*) AS n_history FROM th GROUP BY 1),
    he AS (SELECT h.impression_id, h.pos, h.item_id, i.embedding, row_number() OVER (PARTITION BY impression_id ORDER BY pos DESC) - 1 AS age
        FROM th h JOIN items i USING (item_id)),
    h50 AS (SELECT * FROM he WHERE age < 50), h5 AS (SELECT * FROM he WHERE age < 5),
    m50 AS (SELECT impression_id, list(v ORDER BY i) AS ctx FROM
        (SELECT impression_id, t.i, avg(embedding[t.i]) AS v FROM h50, range(1, 65) t(i) GROUP BY 1, 2) GROUP BY 1),
    hw AS (SELECT impression_id, embedding, exp(-0.3 * age) * (greatest(list_inner_product(embedding, ctx), 0) + 1e-6) AS w FROM h50 JOIN m50 USING (impression_id)),
    """
    + _profile("p1", "hw", "w")
    + ","
    + _profile("p2", "he")
    + ","
    + _profile("p3", "h5")
    + """,
    cq AS (SELECT p1.impression_id, list_transform(range(1, 65), lambda i: 0.45 * p1.vec[i] + 0.20 * p2.vec[i] + 0.15 * p3.vec[i]) AS query
        FROM p1 JOIN p2 USING (impression_id) JOIN p3 USING (impression_id)),
    seen AS (SELECT DISTINCT impression_id, item_id FROM th)"""
)

_UNSEEN = "WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.impression_id = p.impression_id AND seen.item_id = i.item_id)"
_KNN = """SELECT impression_id, item_id, s AS score, row_number() OVER (PARTITION BY impression_id ORDER BY round(s, 9) DESC, item_id) AS rank FROM
    (SELECT p.impression_id, i.item_id, list_inner_product(p.vec, i.embedding) AS s FROM {0} p, items i
     """ + _UNSEEN + """) QUALIFY rank <= {1}"""

POOL_SQL = f"""n1 AS ({_KNN.format("p1", 150)}), n2 AS ({_KNN.format("p2", 75)}),
    n3 AS ({_KNN.format("(SELECT p3.* FROM p3 JOIN hl USING (impression_id) WHERE n_history > 5)", 50)}),
    cand AS (SELECT impression_id, item_id FROM n1 UNION SELECT impression_id, item_id FROM n2 UNION SELECT impression_id, item_id FROM n3)"""


def scores_sql(cand: str, p: str = "") -> str:
    """CTEs up to {p}sc (impression_id, item_id, category, subcategory, score) for the candidates in `cand`."""
    return f"""{p}mm AS (SELECT c.impression_id, c.item_id, max(list_inner_product(ci.embedding, si.embedding)) AS m FROM {cand} c
        JOIN items ci ON ci.item_id = c.item_id JOIN seen s ON s.impression_id = c.impression_id JOIN items si ON si.item_id = s.item_id GROUP BY 1, 2),
    {p}raw AS (SELECT m.impression_id, m.item_id, list_inner_product(cq.query, i.embedding) + 0.2 * m AS r FROM {p}mm m JOIN items i USING (item_id) JOIN cq USING (impression_id)),
    {p}con AS (SELECT impression_id, item_id, CASE WHEN max(r) OVER w > min(r) OVER w THEN (r - min(r) OVER w) / (max(r) OVER w - min(r) OVER w) ELSE r END AS content
        FROM {p}raw WINDOW w AS (PARTITION BY impression_id)),
    {p}aff AS (SELECT impression_id, category, count(*) / sum(count(*)) OVER (PARTITION BY impression_id)::DOUBLE AS affinity FROM th JOIN items USING (item_id) WHERE category IS NOT NULL GROUP BY 1, 2),
    {p}vote AS (SELECT impression_id, b AS item_id, sum(weight) AS v FROM th JOIN coc ON coc.a = th.item_id GROUP BY 1, 2),
    {p}cf AS (SELECT impression_id, item_id, v / max(v) OVER (PARTITION BY impression_id) AS cf FROM {p}vote),
    {p}wt AS (SELECT impression_id, n_history, CASE WHEN n_history <= 3 THEN 0.45 WHEN n_history <= 10 THEN 0.6 ELSE 0.65 END AS wc,
        CASE WHEN n_history <= 3 THEN 0.15 WHEN n_history <= 10 THEN 0.05 ELSE 0.0 END AS wp,
        CASE WHEN n_history <= 3 THEN 0.15 WHEN n_history <= 10 THEN 0.2 ELSE 0.25 END AS wa,
        CASE WHEN n_history <= 3 THEN 0.25 WHEN n_history <= 10 THEN 0.15 ELSE 0.1 END AS wf FROM hl),
    {p}sc AS (SELECT c.impression_id, c.item_id, p.category, p.subcategory,
        (wc * content + wp * p.popularity + wa * coalesce(a.affinity, 0) + wf * coalesce(f.cf, 0))::DOUBLE AS score
        FROM {p}con c JOIN {p}wt USING (impression_id) JOIN pop p ON p.item_id = c.item_id
        LEFT JOIN {p}aff a ON a.impression_id = c.impression_id AND a.category = p.category
        LEFT JOIN {p}cf f ON f.impression_id = c.impression_id AND f.item_id = c.item_id)"""


BASE_SQL = ",\n".join([POP_SQL, COCLICK_SQL, PROFILES_SQL])
REC_SQL = ",\n".join([BASE_SQL, POOL_SQL, scores_sql("cand")])
RANKED_SQL = (
    REC_SQL
    + """,
    tl AS (SELECT impression_id FROM heads WHERE bucket = (SELECT max(bucket) FROM log)),
    popr AS (SELECT *, row_number() OVER (ORDER BY round(popularity::DOUBLE, 9) DESC, item_id) AS rank FROM pop),
    rec AS (SELECT impression_id, item_id, category, subcategory, score, row_number() OVER (PARTITION BY impression_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM sc
        UNION ALL SELECT l.impression_id, p.item_id, p.category, p.subcategory, p.popularity::DOUBLE, p.rank FROM tl l, popr p
        WHERE p.rank <= 100 AND l.impression_id NOT IN (SELECT impression_id FROM cand))"""
)
SHOWN_SQL = (
    "shown AS (SELECT impression_id, item_id, label FROM impr WHERE bucket = (SELECT max(bucket) FROM log) AND item_id IN (SELECT item_id FROM items)),\n" + scores_sql("shown", "e")
)
EVAL_SQL = BASE_SQL + ",\n" + SHOWN_SQL


@q("knn_profile", sql("items hist", f"SELECT impression_id, item_id, rank, round(score, 6) AS score FROM ({_KNN.format('p1', 20)})", PROFILES_SQL))
def knn_profile(spark, d):
    """20 nearest unseen items of every attention profile."""
    h, vec = M.test_history(spark, d), T.item_vectors(spark, d)
    att = stage(PR.attention_profile(h, vec), "profiles")
    queries = att.select(F.col("impression_id").alias("query_id"), F.lit(0).alias("kind"), F.col("profile").alias("vec"), F.lit(20).alias("k"))
    seen = h.select(F.col("impression_id").alias("query_id"), "item_id")
    return A.rounded(R.nearest(queries, vec, 20, seen).drop("kind").withColumnRenamed("query_id", "impression_id"))


@q(
    "item_neighbours",
    sql(
        "items",
        """SELECT a.item_id AS query_id, b.item_id, round(list_inner_product(a.embedding, b.embedding), 6) AS score,
        row_number() OVER (PARTITION BY a.item_id ORDER BY round(list_inner_product(a.embedding, b.embedding), 9) DESC, b.item_id) AS rank
        FROM items a JOIN items b ON a.item_id <> b.item_id QUALIFY rank <= 5""",
    ),
)
def item_neighbours(spark, d):
    return A.rounded(R.item_neighbours(T.item_vectors(spark, d), 5))


@q("item_neighbours_lsh")
def item_neighbours_lsh(spark, d):
    """The approximate option of item_neighbours (an LSH join, so no exact oracle)."""
    vec = T.item_vectors(spark, d)
    queries = vec.select(F.col("item_id").alias("query_id"), F.col("embedding").alias("vec"))
    same = vec.select(F.col("item_id").alias("query_id"), "item_id")
    return A.rounded(R.nearest_approximate(queries, vec, 6, 1.2, excluded=same))


@q("candidate_pool", sql("items hist", "SELECT impression_id, item_id FROM cand", PROFILES_SQL + ",\n" + POOL_SQL))
def candidate_pool(spark, d):
    h, vec = M.test_history(spark, d), T.item_vectors(spark, d)
    return R.candidate_pool(R.profile_queries(stage(M.profiles(h, vec), "profiles")), vec, h)


@q("unseen_candidates", sql("items impr hist", "SELECT impression_id, item_id FROM impr WHERE bucket = (SELECT max(bucket) FROM log) AND (impression_id, item_id) NOT IN (SELECT (impression_id, item_id) FROM hist)"))
def unseen_candidates(spark, d):
    """Shown items that are not in the user's history."""
    seen = M.test_history(spark, d).select("impression_id", "item_id")
    return T.test(spark, d).select("impression_id", "item_id").join(seen, ["impression_id", "item_id"], "left_anti")


@q("content_score", sql("items impr hist", "SELECT impression_id, item_id, round(content, 6) AS content FROM econ", EVAL_SQL))
def content_score(spark, d):
    h, vec = M.test_history(spark, d), T.item_vectors(spark, d)
    query = R.combined_query(M.profiles(h, vec))
    return A.rounded(S.content_scores(T.test(spark, d), query, h, vec))


@q("category_affinity", sql("items impr hist", "SELECT impression_id, category, round(affinity, 6) AS affinity FROM eaff", EVAL_SQL))
def category_affinity(spark, d):
    return A.rounded(S.affinity(M.test_history(spark, d), T.item_meta(spark, d)))


@q("cf_signal", sql("items impr hist", "SELECT impression_id, item_id, round(round(cf, 9), 6) AS cf FROM ecf", EVAL_SQL))
def cf_signal(spark, d):
    model, h = M.prepared(spark, d)
    votes = S.cf_signal(h, model.coclick)
    return A.rounded(A.rounded(votes, 9))


@q(
    "dynamic_weights",
    sql(
        "items impr hist",
        """SELECT impression_id, n_history, wc::DOUBLE AS content, wp::DOUBLE AS popularity, 0.0::DOUBLE AS recency, wa::DOUBLE AS affinity, wf::DOUBLE AS cf FROM ewt""",
        EVAL_SQL,
    ),
)
def dynamic_weights(spark, d):
    rows = A.history_lengths(M.test_history(spark, d))
    return rows.select("impression_id", "n_history", *[c.alias(n) for n, c in S.dynamic_weights(F.col("n_history")).items()])


@q("score_candidates", sql("items impr hist", "SELECT impression_id, item_id, round(score, 6) AS score FROM esc", EVAL_SQL))
def score_candidates(spark, d):
    """Evaluation mode: hybrid scores of the shown items."""
    model, h = M.prepared(spark, d)
    return A.rounded(M.score_candidates(T.test(spark, d), h, model))


@q("recommend_top10", sql("items impr hist", "SELECT impression_id, item_id, rank, round(score, 6) AS score FROM rec WHERE rank <= 10", RANKED_SQL))
def recommend_top10(spark, d):
    """Production mode: retrieve, score and rank for every test list."""
    model, h = M.prepared(spark, d)
    return A.rounded(M.recommend(T.test_lists(spark, d), h, model, 10))


_ALL = RANKED_SQL.replace(" FROM hist WHERE bucket = (SELECT max(bucket) FROM log)", " FROM hist").replace(
    "FROM heads WHERE bucket = (SELECT max(bucket) FROM log)", "FROM heads"
)


@q("recommend_all", sql("items impr hist", "SELECT impression_id, item_id, rank, round(score, 6) AS score FROM rec WHERE rank <= 10", _ALL))
def recommend_all(spark, d):
    """Recommendations for the lists of all buckets: those of the first have no history and get popular items."""
    model, _ = M.fitted(spark, d)
    h = stage(T.history(spark, d), "history")  # every list is scored
    return A.rounded(M.recommend(T.heads(spark, d), h, model, 10))


_READ_TOO = RANKED_SQL.replace(_UNSEEN, "")


@q("recommend_with_history_items", sql("items impr hist", "SELECT impression_id, item_id, rank, round(score, 6) AS score FROM rec WHERE rank <= 10", _READ_TOO))
def recommend_with_history_items(spark, d):
    """Production mode without the exclusion of read items."""
    model, h = M.prepared(spark, d)
    return A.rounded(M.recommend(T.test_lists(spark, d), h, model, 10, exclude_history=False))


@q(
    "score_unseen_candidates",
    sql(
        "items impr hist",
        "SELECT impression_id, item_id, round(score, 6) AS score FROM esc",
        BASE_SQL + ",\n" + SHOWN_SQL.replace("FROM items)),", "FROM items) AND (impression_id, item_id) NOT IN (SELECT (impression_id, item_id) FROM seen)),", 1),
    ),
)
def score_unseen_candidates(spark, d):
    """Evaluation mode with the exclusion of read items."""
    model, h = M.prepared(spark, d)
    return A.rounded(M.score_candidates(T.test(spark, d), h, model, exclude_history=True))


@q(
    "recommend_hydrated",
    sql(
        "items impr hist",
        "SELECT impression_id, rank, item_id, category, subcategory FROM rec WHERE rank <= 10",
        RANKED_SQL,
    ),
)
def recommend_hydrated(spark, d):
    """Recommendations with item metadata, order kept in `rank`."""
    model, h = M.prepared(spark, d)
    recs = M.recommend(T.test_lists(spark, d), h, model, 10)
    return recs.join(T.item_meta(spark, d), "item_id").select("impression_id", "rank", "item_id", "category", "subcategory")


@q(
    "cold_start",
    sql(
        "items impr heads hist",
        """SELECT h.impression_id, p.rank, p.item_id, round(p.popularity::DOUBLE, 6) AS score FROM (SELECT impression_id FROM heads
        WHERE impression_id NOT IN (SELECT impression_id FROM hist)) h, (SELECT item_id, popularity,
        row_number() OVER (ORDER BY round(popularity::DOUBLE, 9) DESC, item_id) AS rank FROM pop QUALIFY rank <= 10) p""",
        POP_SQL,
    ),
)
def cold_start(spark, d):
    """Lists without any history get the most popular items."""
    heads = T.cuts(spark, d).where(F.col("n_history") == 0)
    return A.rounded(S.cold_start(heads, P.popularity_ctr(T.train(spark, d), T.item_meta(spark, d)), 10))


_TOPICS = """tp AS (SELECT user_id, topic, min(pos) AS topic_pos FROM (SELECT user_id, CASE WHEN item_id % 12 < 10 THEN 'c' || (item_id % 12) WHEN item_id % 12 = 10 THEN 'science' ELSE 'music' END AS topic,
        pos FROM clicks WHERE pos < 3) GROUP BY 1, 2),
    al AS (SELECT user_id, CASE WHEN topic = 'science' THEN 'c0' ELSE topic END AS topic, topic_pos FROM tp)"""


def topics(spark, d):
    """Quiz topics of each user: derived from the first three clicks; two of twelve are not in the catalogue."""
    code = F.col("item_id") % 12
    topic = F.when(code < 10, F.concat(F.lit("c"), code.cast("string"))).when(code == 10, "science").otherwise("music")
    first = T.clicks(spark, d).where(F.col("pos") < 3).select("user_id", "pos", topic.alias("topic"))
    return first.groupBy("user_id", "topic").agg(F.min("pos").alias("topic_pos"))


@q("topic_alias", sql("clicks", "SELECT user_id, topic, topic_pos FROM al", _TOPICS))
def topic_alias(spark, d):
    known = T.item_meta(spark, d).select("category").distinct()
    return S.aliased(topics(spark, d), known, {"science": "c0", "technology": "c0", "politics": "c0"})


SEED_SQL = (
    POP_SQL
    + ","
    + _TOPICS
    + """,
    tops AS (SELECT category, item_id, row_number() OVER (PARTITION BY category ORDER BY round(popularity::DOUBLE, 9) DESC, item_id) AS rank FROM pop QUALIFY rank <= 5),
    seed AS (SELECT user_id, topic, topic_pos * 1000 + rank AS pos, item_id FROM al JOIN tops ON tops.category = al.topic)"""
)


def seeds(spark, d, k: int = 5):
    items = T.item_meta(spark, d)
    popular = P.top_in_category(items, P.popularity_ctr(T.train(spark, d), items), k)
    known = items.select("category").distinct()
    return S.seed_history(S.aliased(topics(spark, d), known, {"science": "c0"}), popular)


@q("seed_history", sql("items impr clicks", "SELECT user_id, topic, pos, item_id FROM seed", SEED_SQL))
def seed_history(spark, d):
    """Starting history of new users from their topics, five popular items each."""
    return seeds(spark, d)
