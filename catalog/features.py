"""Vector features, towers and user profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.views import Catalog, sql
from lapwing.functions import vectors as V
from lapwing.operators import aggregates as A, features as X, profiles as P
from lapwing.plans import tables as T

CATALOG = Catalog()
q = CATALOG.add


def last_clicks(spark, d, n):
    """The last n clicks of the history of every impression."""
    return T.prefixes(spark, d, T.history_lengths(spark, d), n)


def ramp_sql(vec: str) -> str:
    return f"list_inner_product({vec}, list_transform(range(1, len({vec}) + 1), lambda i: i::DOUBLE))"


def check_vec(df, keys, vec="vec"):
    """Keys, norm and position-sensitive checksum of a vector column."""
    v = F.col(vec)
    return df.select(*keys, F.round(V.norm(v), 6).alias("norm"), F.round(V.ramp(v), 6).alias("ramp"))


def check_sql(keys: str, src: str, vec: str = "vec") -> str:
    return f"SELECT {keys}, round(sqrt(list_inner_product({vec}, {vec})), 6) AS norm, round({ramp_sql(vec)}, 6) AS ramp FROM {src}"


@q(
    "item_similarity",
    sql(
        "items",
        """SELECT i.item_id, round(list_inner_product(i.embedding, c.vec), 6) AS dot, round(list_cosine_similarity(i.embedding, c.vec), 6) AS cosine
        FROM items i JOIN c USING (category)""",
        """m AS (SELECT category, k, avg(embedding[k]) AS v FROM items, range(1, 65) t(k) GROUP BY 1, 2),
        c AS (SELECT category, list(v ORDER BY k) AS vec FROM m GROUP BY 1)""",
    ),
)
def item_similarity(spark, d):
    """Dot product and cosine of every item with the centroid of its category."""
    items = T.items(spark, d)
    centre = items.groupBy("category").agg(V.mean_vector(F.col("embedding")).alias("c"))
    rows = items.join(centre, "category")
    return rows.select(
        "item_id",
        F.round(V.dot(F.col("embedding"), F.col("c")), 6).alias("dot"),
        F.round(V.cosine(F.col("embedding"), F.col("c")), 6).alias("cosine"),
    )


_IDF = """idf AS (SELECT entity_id, count(*) AS df, ln((1 + (SELECT count(*) FROM articles)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM ae GROUP BY 1)"""


def _idf(spark, d):
    n = T.articles(spark, d).agg(F.count(F.lit(1))).scalar()
    return X.entity_idf(T.article_entities(spark, d), n)


@q("entity_idf", sql("ae articles", "SELECT entity_id, df, round(idf, 6) AS idf FROM idf", _IDF))
def entity_idf(spark, d):
    return A.rounded(_idf(spark, d))


_MEAN = """k AS (SELECT ae.article_id, v.vec, 1.0::DOUBLE AS w FROM ae JOIN evec v USING (entity_id)),
    kd AS (SELECT article_id, t.i, sum(w * vec[t.i]) / sum(w) AS v FROM k, range(1, 65) t(i) GROUP BY 1, 2),
    mv AS (SELECT article_id, list(v ORDER BY i) AS vec FROM kd GROUP BY 1)"""
_WMEAN = _IDF + "," + _MEAN.replace("1.0::DOUBLE AS w FROM ae JOIN evec v USING (entity_id)", "idf.idf AS w FROM ae JOIN evec v USING (entity_id) JOIN idf USING (entity_id)")


@q("entity_mean", sql("ae evec", check_sql("article_id", "mv"), _MEAN))
def entity_mean(spark, d):
    return check_vec(X.entity_means(T.article_entities(spark, d), T.entity_vectors(spark, d)), ["article_id"])


@q("entity_idf_mean", sql("ae evec articles", check_sql("article_id", "mv"), _WMEAN))
def entity_idf_mean(spark, d):
    means = X.entity_means(T.article_entities(spark, d), T.entity_vectors(spark, d), _idf(spark, d))
    return check_vec(means, ["article_id"])


@q(
    "entity_hit_coverage",
    sql(
        "ae evec articles",
        """SELECT count(*) AS n_articles, count(h.article_id) AS n_hit, round(count(h.article_id) * 100.0 / count(*), 6)::DOUBLE AS coverage_pct
        FROM articles LEFT JOIN (SELECT DISTINCT article_id FROM ae JOIN evec USING (entity_id)) h USING (article_id)""",
    ),
)
def entity_hit_coverage(spark, d):
    means = X.entity_means(T.article_entities(spark, d), T.entity_vectors(spark, d), _idf(spark, d))
    return A.rounded(X.hit_coverage(X.entity_features(T.articles(spark, d), means, T.DIM)))


_CAT = """cc AS (SELECT category, row_number() OVER (ORDER BY category) AS r FROM (SELECT DISTINCT category FROM items)),
    ss AS (SELECT DISTINCT subcategory FROM items),
    cv AS (SELECT category, list_transform(range(1, 33), lambda k: CASE WHEN k = r THEN 1.0 ELSE 0.0 END::DOUBLE) AS v FROM cc),
    sv AS (SELECT subcategory, CASE WHEN (SELECT count(*) FROM ss) <= 16
        THEN list_transform(range(1, 17), lambda k: CASE WHEN k = (SELECT count(*) FROM ss z WHERE z.subcategory <= ss.subcategory) THEN 1.0 ELSE 0.0 END::DOUBLE)
        ELSE list_transform(range(0, 16), lambda k: CASE WHEN substr(md5(subcategory || '|' || k), 1, 1) < '8' THEN 0.25 ELSE -0.25 END::DOUBLE) END AS v FROM ss),
    ct AS (SELECT i.item_id, list_concat(cv.v, sv.v) AS vec FROM items i JOIN cv USING (category) JOIN sv USING (subcategory))"""
_CAT = _CAT.replace(
    "CASE WHEN k = (SELECT count(*) FROM ss z WHERE z.subcategory <= ss.subcategory) THEN", "CASE WHEN k = sr THEN"
).replace("ss AS (SELECT DISTINCT subcategory FROM items)", "ss AS (SELECT subcategory, row_number() OVER (ORDER BY subcategory) AS sr FROM (SELECT DISTINCT subcategory FROM items))")


@q("category_tower", sql("items", check_sql("item_id", "ct"), _CAT))
def category_tower(spark, d):
    return check_vec(X.category_tower(T.item_meta(spark, d)), ["item_id"])


def towers(spark, d):
    """Three towers per item: text = stored vectors, entity = IDF-weighted means, category tables."""
    means = X.entity_means(T.article_entities(spark, d), T.entity_vectors(spark, d), _idf(spark, d))
    entity = means.select(F.col("article_id").alias("item_id"), F.col("vec").alias("entity"))
    cat = X.category_tower(T.item_meta(spark, d)).withColumnRenamed("vec", "category")
    text = T.item_vectors(spark, d).withColumnRenamed("embedding", "text")
    return text.join(entity, "item_id", "left").join(cat, "item_id").withColumn("entity", F.coalesce("entity", V.zeros(T.DIM)))


_UNIT = "CASE WHEN list_inner_product({0}, {0}) > 0 THEN list_transform({0}, lambda x: x / sqrt(list_inner_product({0}, {0}))) ELSE {0} END"


def fuse_sql(a: float, b: float, c: float) -> str:
    zero = "list_transform(range(0, 64), lambda z: 0.0::DOUBLE)"
    return (
        _WMEAN
        + ","
        + _CAT
        + f""",
    tw AS (SELECT i.item_id, i.embedding AS t, coalesce(m.vec, {zero}) AS e, ct.vec AS c FROM items i LEFT JOIN mv m ON m.article_id = i.item_id JOIN ct USING (item_id)),
    nn AS (SELECT item_id, list_inner_product(t, t) AS nt, list_inner_product(e, e) AS ne, list_inner_product(c, c) AS nc FROM tw),
    un AS (SELECT item_id, CASE WHEN nt > 0 THEN {a} / sqrt(nt) ELSE 0 END AS ft, CASE WHEN ne > 0 THEN {b} / sqrt(ne) ELSE 0 END AS fe,
        CASE WHEN nc > 0 THEN {c} / sqrt(nc) ELSE 0 END AS fc FROM nn),
    ca AS (SELECT item_id, list_concat(list_concat(list_transform(t, lambda x: x * ft), list_transform(e, lambda x: x * fe)), list_transform(c, lambda x: x * fc)) AS v
        FROM tw JOIN un USING (item_id)),
    fl AS (SELECT item_id, v, sqrt(list_inner_product(v, v)) AS nv FROM ca),
    fu AS (SELECT item_id, list_transform(v, lambda x: x / nv) AS vec FROM fl)"""
    )


@q("fuse_towers", sql("items ae evec articles", check_sql("item_id", "fu"), fuse_sql(0.6, 0.3, 0.1)))
def fuse_towers(spark, d):
    return check_vec(X.fuse(towers(spark, d), ["text", "entity", "category"]), ["item_id"], "fused")


@q("refuse_towers", sql("items ae evec articles", check_sql("item_id", "fu"), fuse_sql(0.4, 0.4, 0.2)))
def refuse_towers(spark, d):
    """The stored towers fused again with other weights."""
    fused = X.fuse(towers(spark, d), ["text", "entity", "category"], {"text": 0.4, "entity": 0.4, "category": 0.2})
    return check_vec(fused, ["item_id"], "fused")


_SHARES = """bn AS (SELECT avg(sqrt(list_inner_product(vec[1:64], vec[1:64]))) AS t, avg(sqrt(list_inner_product(vec[65:128], vec[65:128]))) AS e,
    avg(sqrt(list_inner_product(vec[129:176], vec[129:176]))) AS c FROM fu)"""


@q(
    "tower_shares",
    sql(
        "items ae evec articles",
        """SELECT 'text' AS tower, round(t / (t + e + c) * 100, 6) AS pct FROM bn UNION ALL SELECT 'entity', round(e / (t + e + c) * 100, 6) FROM bn
        UNION ALL SELECT 'category', round(c / (t + e + c) * 100, 6) FROM bn""",
        fuse_sql(0.6, 0.3, 0.1) + "," + _SHARES,
    ),
)
def tower_shares(spark, d):
    """Share of each tower in the fused vector."""
    fused = X.fuse(towers(spark, d), ["text", "entity", "category"])
    return A.rounded(X.block_shares(fused, {"text": 64, "entity": 64, "category": 48}))


_BEFORE = """rw AS (SELECT item_id, list_concat(list_concat(t, e), c) AS r, sqrt(nt + ne + nc) AS nr FROM tw JOIN nn USING (item_id)),
    fu2 AS (SELECT item_id, list_transform(r, lambda x: x / nr) AS vec FROM rw)"""


@q(
    "tower_shares_raw",
    sql(
        "items ae evec articles",
        """SELECT 'text' AS tower, round(t / (t + e + c) * 100, 6) AS pct FROM bn UNION ALL SELECT 'entity', round(e / (t + e + c) * 100, 6) FROM bn
        UNION ALL SELECT 'category', round(c / (t + e + c) * 100, 6) FROM bn""",
        fuse_sql(0.6, 0.3, 0.1) + "," + _BEFORE + "," + _SHARES.replace("FROM fu)", "FROM fu2)"),
    ),
)
def tower_shares_raw(spark, d):
    """The same shares for towers concatenated raw (before the per-tower normalisation)."""
    raw = towers(spark, d).select("item_id", V.unit(F.concat("text", "entity", "category")).alias("fused"))
    return A.rounded(X.block_shares(raw, {"text": 64, "entity": 64, "category": 48}))


@q(
    "text_tower",
    "WITH d AS (SELECT doc_id AS item_id, regexp_extract_all(translate(coalesce(source, '') || '. ' || coalesce(source, '') || '. ' || coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9_]+') AS ws FROM documents),"
    """ w AS (SELECT item_id, unnest(ws) AS w FROM d),
    c AS (SELECT item_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 768 AS slot, count(*) AS tf FROM w GROUP BY 1, 2),
    f AS (SELECT slot, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)::DOUBLE) AS idf FROM c GROUP BY 1),
    x AS (SELECT item_id, slot, tf * idf AS v FROM c JOIN f USING (slot)),
    s AS (SELECT item_id, sqrt(sum(v * v)) AS n, sum((slot + 1) * v) AS r FROM x GROUP BY 1)
    SELECT item_id, CAST(768 AS BIGINT) AS dim, round(CASE WHEN n > 0 THEN 1 ELSE 0 END, 6)::DOUBLE AS norm, round(CASE WHEN n > 0 THEN r / n ELSE 0 END, 6)::DOUBLE AS ramp FROM d LEFT JOIN s USING (item_id)""",
)
def text_tower(spark, d):
    """Hashed TF-IDF vectors of the emphasised text of every document: norm and position-sensitive checksum."""
    from lapwing.sources.behaviours import emphasised_text

    docs = T.doc_items(spark, d).select("item_id", emphasised_text(F.col("subcategory"), F.col("text")).alias("text"))
    out = X.text_tower(docs)
    return check_vec(out.withColumn("dim", F.size("vec").cast("bigint")), ["item_id", "dim"])


def _profile_sql(rows: str, weight: str = "1.0::DOUBLE", unit: bool = True) -> str:
    """CTEs pd (mean per dimension) and pv (profile) from list rows (impression_id, embedding, w)."""
    final = "list_transform(vec, lambda x: x / nullif(n, 0))" if unit else "vec"
    return f"""{rows},
    pd AS (SELECT impression_id, t.i, sum({weight} * embedding[t.i]) / sum({weight}) AS v FROM hr, range(1, 65) t(i) GROUP BY 1, 2),
    pl AS (SELECT impression_id, list(v ORDER BY i) AS vec FROM pd GROUP BY 1),
    pn AS (SELECT impression_id, vec, sqrt(list_inner_product(vec, vec)) AS n FROM pl),
    pv AS (SELECT impression_id, {final} AS vec FROM pn)"""


_ALL_ROWS = "hr AS (SELECT h.impression_id, i.embedding FROM hist h JOIN items i USING (item_id))"
_LAST5 = """hr AS (SELECT h.impression_id, i.embedding FROM (SELECT * FROM hist QUALIFY row_number() OVER (PARTITION BY impression_id ORDER BY pos DESC) <= 5) h JOIN items i USING (item_id))"""
_LAST50 = """h50 AS (SELECT h.impression_id, i.embedding, row_number() OVER (PARTITION BY impression_id ORDER BY pos DESC) - 1 AS age
        FROM (SELECT * FROM hist QUALIFY row_number() OVER (PARTITION BY impression_id ORDER BY pos DESC) <= 50) h JOIN items i USING (item_id)),
    m50 AS (SELECT impression_id, list(v ORDER BY i) AS ctx FROM (SELECT impression_id, t.i, avg(embedding[t.i]) AS v FROM h50, range(1, 65) t(i) GROUP BY 1, 2) GROUP BY 1),
    hr AS (SELECT impression_id, embedding, exp(-0.3 * age) * (greatest(list_inner_product(embedding, ctx), 0) + 1e-6) AS w FROM h50 JOIN m50 USING (impression_id))"""


@q("profile_uniform", sql("items hist", check_sql("impression_id", "pv"), _profile_sql(_ALL_ROWS)))
def profile_uniform(spark, d):
    return check_vec(P.profile_of_sums(T.history_sums(spark, d, T.item_vectors(spark, d))), ["impression_id"], "profile")


@q("profile_centroid", sql("items hist", check_sql("impression_id", "pv"), _profile_sql(_ALL_ROWS, unit=False)))
def profile_centroid(spark, d):
    return check_vec(P.profile_of_sums(T.history_sums(spark, d, T.item_vectors(spark, d)), normalise=False), ["impression_id"], "profile")


@q("profile_recent", sql("items hist", check_sql("impression_id", "pv"), _profile_sql(_LAST5)))
def profile_recent(spark, d):
    return check_vec(P.recent_profile(last_clicks(spark, d, P.RECENT), T.item_vectors(spark, d)), ["impression_id"], "profile")


@q("profile_attention", sql("items hist", check_sql("impression_id", "pv"), _profile_sql(_LAST50, "w")))
def profile_attention(spark, d):
    return check_vec(P.attention_profile(last_clicks(spark, d, P.MAX_HISTORY), T.item_vectors(spark, d)), ["impression_id"], "profile")


_CTX = _LAST50.replace(
    "m50 AS (SELECT impression_id, list(v ORDER BY i) AS ctx FROM (SELECT impression_id, t.i, avg(embedding[t.i]) AS v FROM h50, range(1, 65) t(i) GROUP BY 1, 2) GROUP BY 1)",
    """shown AS (SELECT p.impression_id, i.embedding FROM impr p JOIN items i USING (item_id)),
    m50 AS (SELECT impression_id, list(v ORDER BY i) AS ctx FROM (SELECT impression_id, t.i, avg(embedding[t.i]) AS v FROM shown, range(1, 65) t(i) GROUP BY 1, 2) GROUP BY 1)""",
)


@q("profile_context", sql("items hist impr", check_sql("impression_id", "pv"), _profile_sql(_CTX, "w")))
def profile_context(spark, d):
    """Attention towards the mean of the shown candidates instead of the user's own mean."""
    vectors = T.item_vectors(spark, d)
    shown = T.impressions(spark, d).join(vectors, "item_id").groupBy("impression_id").agg(V.mean_vector(F.col("embedding")).alias("context"))
    return check_vec(P.attention_profile(last_clicks(spark, d, P.MAX_HISTORY), vectors, shown), ["impression_id"], "profile")
