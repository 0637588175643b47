"""Hand-computed cases of the pinned semantics."""

import math

import pytest
from pyspark.sql import functions as F

from lapwing.operators import accuracy as I, aggregates as A, diversity as J, personal as U, popularity as P, profiles as PR, quality as Q
from lapwing.operators import rerank as H, retrieve as R, score as S, shape
from lapwing.sources import behaviours as B

KEY = ["impression_id"]


def counts(spark, *lists):
    rows = [(i, c, n) for i, cs in enumerate(lists) for c, n in cs.items()]
    return spark.createDataFrame(rows, "impression_id long, category string, n long")


def values(df, column, key="impression_id"):
    return {r[key]: r[column] for r in df.collect()}


def test_gini(spark):
    c = counts(spark, {"a": 10}, {"a": 5, "b": 5}, {"a": 1, "b": 3})
    assert values(J.gini(c, KEY), "gini") == pytest.approx({0: 1.0, 1: 0.0, 2: 0.25})
    assert values(J.gini(c, KEY, singleton=0.0), "gini")[0] == 0.0


def test_category_ild_and_entropy(spark):
    rows = J.share_metrics(counts(spark, {"a": 2, "b": 1}, {"a": 2, "b": 2}, {"a": 1}), KEY)
    assert values(rows, "category_ild") == pytest.approx({0: 2 / 3, 1: 2 / 3, 2: 0.0})
    assert values(rows, "entropy_nats")[1] == pytest.approx(math.log(2))
    assert values(rows, "entropy_bits")[1] == pytest.approx(1.0)


def test_calibration_error_equals_definition(spark):
    rec, hist = {"a": 3, "b": 1}, {"a": 1, "c": 2}
    got = J.calibration_error(counts(spark, rec), counts(spark, hist), KEY, F.lit(5)).first()["calibration_error"]
    p = [(hist.get(c, 0) + 0.01) / (3 + 0.05) for c in "abcde"]
    q = [(rec.get(c, 0) + 0.01) / (4 + 0.05) for c in "abcde"]
    assert got == pytest.approx(sum(x * math.log(x / y) for x, y in zip(p, q)))


def test_system_kl_equals_definition(spark):
    corpus = spark.createDataFrame([("a", 6), ("b", 3), ("c", 1)], "category string, n long")
    rec = spark.createDataFrame([("m", "a", 4), ("m", "c", 1)], "method string, category string, n long")
    got = J.system_kl(corpus, rec, ["method"]).first()["system_kl"]
    q = [(n + 1e-9) / (5 + 3e-9) for n in (4, 0, 1)]
    assert got == pytest.approx(sum(p * math.log(p / x) for p, x in zip((0.6, 0.3, 0.1), q)))


def test_ild_without_pairs_and_small_lists(spark):
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "item_id long, embedding array<double>")
    lists = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 1)], "impression_id long, item_id long")
    assert values(J.ild(lists, vec, KEY), "ild") == pytest.approx({0: 2 / 3, 1: 0.0})


def labelled(spark, labels, scores=None):
    scores = scores or [1.0 - 0.1 * i for i in range(len(labels))]
    return spark.createDataFrame([(0, i, lab, s) for i, (lab, s) in enumerate(zip(labels, scores))], "impression_id long, item_id long, label long, score double")


def test_ndcg_and_map(spark):
    first = I.list_metrics(labelled(spark, [0, 1, 0]), (2,)).first()
    assert first["ndcg"] == pytest.approx(1 / math.log2(3))
    assert (first["mrr"], first["precision"], first["recall"], first["hr"]) == (0.5, 0.5, 1.0, 1.0)
    assert I.list_metrics(labelled(spark, [1, 0, 1]), (3,)).first()["map"] == pytest.approx(0.833333, abs=1e-6)


def test_auc_ties_and_one_class(spark):
    assert I.auc(labelled(spark, [1, 0], [0.5, 0.5])).first()["auc"] == 0.5
    assert I.auc(labelled(spark, [1, 1], [0.5, 0.4])).first()["auc"] == 0.0
    assert I.auc(labelled(spark, [1, 0, 0, 1], [0.9, 0.8, -0.2, 0.1])).first()["auc"] == 0.75


def context(spark, cats, vectors=None, history=(), popularity=()):
    items = spark.createDataFrame([(i, c, c + "s") for i, c in cats.items()], "item_id long, category string, subcategory string")
    vectors = vectors or {i: [1.0, float(i)] for i in cats}
    vec = spark.createDataFrame(list(vectors.items()), "item_id long, embedding array<double>")
    pop = spark.createDataFrame([(i, float(p)) for i, p in popularity] or [(i, 0.0) for i in cats], "item_id long, popularity double")
    hist = spark.createDataFrame([(0, 0, 0, p, i) for p, i in enumerate(history)], "impression_id long, user_id long, bucket long, pos long, item_id long")
    return H.Context(items, vec, pop, hist)


def pool(spark, scores):
    return spark.createDataFrame([(0, i, s) for i, s in scores.items()], "impression_id long, item_id long, score double")


def picks(df):
    return [r["item_id"] for r in df.orderBy("rank").collect()]


CATS = {1: "a", 2: "a", 3: "a", 4: "b"}
SCORES = {1: 0.9, 2: 0.8, 3: 0.7, 4: 0.1}


def test_bounded_greedy_cap_then_backfill(spark):
    assert picks(H.bounded_greedy(pool(spark, SCORES), context(spark, CATS), 4)) == [1, 2, 4, 3]


def test_methods_reduce_to_relevance(spark):
    ctx, p = context(spark, CATS, history=[1]), pool(spark, SCORES)
    top = picks(H.baseline(p, ctx, 3))
    assert picks(H.mmr(p, ctx, 3, lambda_param=1.0)) == top
    assert picks(H.xquad(p, ctx, 3, lambda_param=1.0)) == top
    assert picks(H.calibrated(p, ctx, 3, alpha=0.0)) == top
    assert picks(H.serendipity(p, ctx, 3, beta=0.0)) == top
    only = dict(w_relevance=1.0, w_diversity=0.0, w_calibration=0.0, w_serendipity=0.0, w_fairness=0.0)
    assert picks(H.composite(p, ctx, 3, **only)) == top


def test_list_length_is_min_of_k_and_pool(spark):
    ctx, p = context(spark, CATS, history=[2]), pool(spark, SCORES)
    for name, method in H.METHODS.items():
        assert method(p, ctx, 10).count() == 4, name
        assert method(p, ctx, 2).count() == 2, name


def test_injected_score_and_history(spark):
    ctx = context(spark, {**CATS, 5: "c", 6: "c"}, history=[6], popularity=[(5, 0.2), (6, 0.9)])
    rows = H.inject(pool(spark, {1: 0.2, 4: 1.0}), ctx).where("injected = 1").collect()
    assert [(r["item_id"], round(r["score"], 6)) for r in rows] == [(5, 0.44)]


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        H.rerank("nope", None, None, 10)


def test_fallback_to_mmr(spark):
    ctx = context(spark, {9: "z"}, vectors={1: [1.0, 0.0], 2: [1.0, 0.1], 3: [0.0, 1.0]})
    got = picks(H.rerank("xquad", pool(spark, {1: 0.9, 2: 0.8, 3: 0.1}), ctx, 2, inject_candidates=False, fallback=True, lambda_param=0.1))
    assert got == [1, 3]


def test_popularity_of_unshown_and_median(spark):
    items = spark.createDataFrame([(1,), (2,), (3,)], "item_id long")
    shown = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (1, 1)], "item_id long, label long")
    pop = P.popularity_ctr(shown, items)
    assert values(pop, "popularity", "item_id") == pytest.approx({1: 0.7 + 0.2, 2: 0.35 + 0.3, 3: 0.0})
    assert spark.range(1).select(P.default_popularity(pop).alias("m")).first()["m"] == pytest.approx(0.65)


def test_coclick_self_pairs(spark):
    recent = spark.createDataFrame([(1, 0, 7), (1, 1, 8), (1, 2, 7)], "user_id long, pos long, item_id long")
    got = {(r["a"], r["b"]): r["weight"] for r in P.coclick(recent).collect()}
    assert got == {(7, 8): 1.0, (7, 7): 1.0, (8, 7): 1.0}


def test_dynamic_weights(spark):
    df = spark.createDataFrame([(3,), (10,), (11,)], "n long")
    rows = df.select("n", *[c.alias(k) for k, c in S.dynamic_weights(F.col("n")).items()]).orderBy("n").collect()
    assert [tuple(r)[1:] for r in rows] == [(0.45, 0.15, 0.0, 0.15, 0.25), (0.60, 0.05, 0.0, 0.20, 0.15), (0.65, 0.0, 0.0, 0.25, 0.10)]


def test_min_max_flat_list_stays_raw(spark):
    df = spark.createDataFrame([(0, 5.0), (0, 5.0), (1, 1.0), (1, 3.0)], "k long, v double")
    assert sorted(r["o"] for r in shape.min_max(df, ["k"], "v", "o").collect()) == [0.0, 1.0, 5.0, 5.0]


def test_parsers(spark):
    df = spark.createDataFrame([("N1-0  A-b-1", "[]"), (None, None)], "i string, j string")
    rows = df.select(B.parse_impressions(F.col("i")).alias("p"), B.entity_ids(F.col("j")).alias("e")).collect()
    assert [(x["item_id"], x["label"]) for x in rows[0]["p"]] == [("N1", 0), ("A-b", 1)]
    assert rows[1]["p"] == [] and rows[1]["e"] == []
    times = spark.createDataFrame([("11/15/2019 10:22:32 AM",), ("bad",)], "t string").select(B.parse_time(F.col("t")).alias("t")).collect()
    assert str(times[0]["t"]) == "2019-11-15 10:22:32" and times[1]["t"] is None


def test_entity_coverage_without_vectors(spark):
    entities = spark.createDataFrame([(1, 10)], "article_id long, entity_id long")
    none = spark.createDataFrame([], "entity_id long")
    assert Q.entity_coverage(entities, none).first()["coverage_pct"] == 0.0


def test_recent_profile_cuts_before_unknown_items(spark):
    hist = spark.createDataFrame([(0, p, i) for p, i in enumerate([1, 9, 9, 9, 9, 9])], "impression_id long, pos long, item_id long")
    vec = spark.createDataFrame([(1, [3.0, 4.0])], "item_id long, embedding array<double>")
    assert PR.recent_profile(hist, vec).count() == 0
    assert PR.uniform_profile(hist, vec).first()["profile"] == pytest.approx([0.6, 0.8])


def test_nearest_against_brute_force(spark):
    import random

    rng = random.Random(3)
    vecs = {i: [rng.gauss(0, 1) for _ in range(4)] for i in range(60)}
    items = spark.createDataFrame(list(vecs.items()), "item_id long, embedding array<double>")
    queries = spark.createDataFrame([(q, 0, vecs[q], 3) for q in range(10)], "query_id long, kind int, vec array<double>, k int")
    seen = spark.createDataFrame([(q, x) for q in range(10) for x in range(q, q + 20)], "query_id long, item_id long")
    got = {}
    for r in R.nearest(queries, items, 3, seen).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["item_id"])
    for q in range(10):
        ok = [i for i in vecs if not q <= i < q + 20]
        want = sorted(ok, key=lambda i: -sum(a * b for a, b in zip(vecs[q], vecs[i])))[:3]
        assert got[q] == want


def test_positions_are_exact_across_chunks(spark):
    from lapwing.functions.ranking import positions

    df = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    bad = positions(df, ["k"], F.floor(F.col("v") / 37), [F.col("v")]).where("pos <> floor(v / 2)")
    assert bad.count() == 0


def test_segments_keep_all_rows(spark):
    m = spark.createDataFrame([(0.9, 0.1, 1.0), (0.7, 0.1, 1.0), (0.5, 0.2, 1.0)], "gini double, ild double, calibration_error double")
    assert values(J.segments(m), "n_users", "segment") == {"filter_bubble": 1, "balanced": 1, "diverse": 0, "other": 1}


def test_feedback_step(spark):
    ev = spark.createDataFrame([(1, "2024-01-01 00:00:00", 1, "mmr", 0.85)], "user_id long, t string, event_id long, algorithm string, rating double")
    row = U.feedback_weights(ev.withColumn("ts", F.to_timestamp("t"))).first()
    assert (row["lambda"], row["confidence"], row["feedback_count"]) == (pytest.approx(0.5), 0.05, 1)


def test_feedback_in_pieces_equals_one_piece(spark, monkeypatch):
    rows = [(1, f"2024-01-01 {h:02d}:00:00", h, ["mmr", "calibrated", "serendipity"][h % 3], (h * 7 % 10) / 10) for h in range(20)]
    ev = spark.createDataFrame(rows, "user_id long, t string, event_id long, algorithm string, rating double").withColumn("ts", F.to_timestamp("t"))
    whole = U.feedback_weights(ev).first()
    monkeypatch.setattr(U, "PIECE", 6)
    assert list(U.feedback_weights(ev).first()) == pytest.approx(list(whole))


def test_contextual_morning_desktop(spark):
    df = spark.createDataFrame([("morning", "desktop", 0, 0.48, 0.5, 0.3)], "time_of_day string, device string, session_length int, `lambda` double, alpha double, beta double")
    row = U.contextual(df).first()
    assert (row["lambda"], row["beta"]) == (pytest.approx(0.3648), pytest.approx(0.36))


def test_sliders(spark):
    df = spark.createDataFrame([(0.5, 0.25, 0.25, 0.25, 0.25), (0.04, 1.0, 0.0, 0.0, 0.0)], "main_diversity double, diversity double, calibration double, serendipity double, fairness double")
    a, b = U.slider_weights(df).collect()
    assert (a["w_relevance"], a["explore_weight"], a["method"]) == (0.675, 0.325, "composite")
    assert b["method"] == "baseline" and b["w_relevance"] is None


def test_reader_label_of_zero_is_specialist(spark):
    df = spark.createDataFrame([(0.0, 11), (0.5, 4), (0.7, 20)], "preference double, total_interactions long")
    assert [r["label"] for r in U.reader_label(df).collect()] == ["Specialist", None, "Explorer"]


def test_rounded_and_shares(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string")
    assert values(A.rounded(A.shares(df, "c")), "share", "value") == {"a": 0.666667, "b": 0.333333}


def test_ild_keeps_lists_without_vectors(spark):
    from lapwing.operators import diversity

    lists = spark.createDataFrame([(1, 10), (1, 11), (2, 99)], "list_id bigint, item_id bigint")
    vectors = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 1.0])], "item_id bigint, embedding array<double>")
    assert {r["list_id"]: r["ild"] for r in diversity.ild(lists, vectors, ["list_id"]).collect()} == {1: 1.0, 2: 0.0}


def test_nearest_cuts_ties_and_seen_items_before_the_shuffle(spark):
    n, k = 5000, 3
    items = spark.range(n).select(F.col("id").alias("item_id"), F.array(F.lit(0.0), (F.col("id") == 4999).cast("double")).alias("embedding"))
    queries = spark.createDataFrame([(1, 0, [0.0, 1.0], k), (2, 0, [0.0, 1.0], k), (3, 0, [0.0, 1.0], k)], "query_id long, kind int, vec array<double>, k long")
    seen = items.where("item_id <> 17").select(F.lit(2).cast("long").alias("query_id"), "item_id")
    seen = seen.unionByName(seen.where("item_id < 2").withColumn("query_id", F.lit(3).cast("long")))
    got = {}
    for r in R.nearest(queries, items, k, seen).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["item_id"])
    assert got == {1: [4999, 0, 1], 2: [17], 3: [4999, 2, 3]}


def test_best_items_hand_on_at_most_k_rows():
    import pyarrow as pa

    from lapwing.functions import blocks

    asked = pa.table({"query_id": [0, 1, 2], "kind": [0, 0, 0], "k": [4, 4, 4], "seen": pa.array([list(range(i)) for i in range(3)], pa.list_(pa.int64())), "vec": [[1.0]] * 3})
    stock = pa.table({"item_id": list(range(4999, -1, -1)), "vec": [[0.0]] * 5000})
    out = blocks.best_in_cell((0, 0), asked, stock).to_pylist()
    assert [(r["query_id"], r["item_id"]) for r in out] == [(q, q + i) for q in range(3) for i in range(4)]
    assert blocks.best_in_cell((0, 0), asked.slice(0, 0), stock).num_rows == blocks.best_in_cell((0, 0), asked, stock.slice(0, 0)).num_rows == 0


def test_injection_takes_items_with_a_vector_only(spark):
    items = spark.createDataFrame([(1, "a", "s"), (2, "b", "s"), (3, "b", "s"), (4, None, None)], "item_id long, category string, subcategory string")
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.6, 0.8])], "item_id long, embedding array<double>")
    pop = spark.createDataFrame([(1, 0.1), (2, 0.9), (3, 0.2), (4, 0.3)], "item_id long, popularity double")
    past = spark.createDataFrame([], "impression_id long, item_id long, pos long")
    ctx = H.Context(items, vec, pop, past)
    cands = spark.createDataFrame([(7, 1, 0.9), (7, 4, 0.8)], "impression_id long, item_id long, score double")
    assert {r["item_id"] for r in H.inject(cands, ctx).collect()} == {1, 3, 4}
    for method in ("mmr", "serendipity", "composite"):
        assert {r["item_id"] for r in H.rerank(method, cands, ctx, 5, inject_candidates=False).collect()} == {1, 4}
    bare = H.rerank("xquad", cands.where("item_id = 4"), ctx, 5, inject_candidates=False, fallback=True).collect()
    assert [r["item_id"] for r in bare] == [4]


def test_codes_of_sparse_and_like_ids(spark):
    ids = sorted((i * 0x9E3779B97F4A7C15) % (1 << 63) for i in range(1, 800))
    wide = spark.createDataFrame([(i,) for i in reversed(ids)] * 2, "v long")
    assert values(shape.sorted_codes(wide, "v"), "code", "v") == {v: i for i, v in enumerate(ids)}
    like = [f"user_{i:05d}" for i in range(500)]
    named = spark.createDataFrame([(v, ids[499 - i]) for i, v in enumerate(like)] + [(None, 0)], "v string, n long")
    assert values(shape.sorted_codes(named, "v"), "code", "v") == {v: i for i, v in enumerate(like)}
    assert values(shape.first_seen_codes(named, "v", "n"), "code", "v") == {v: 499 - i for i, v in enumerate(like)}
    assert shape.sorted_codes(named.where("n < 0"), "v").count() == 0


def test_neighbours_use_all_cores_with_one_group(spark):
    """One group of items, no broadcast: the queries are dealt to many cells, and the result is that of the full product."""
    import numpy as np

    from lapwing.functions import blocks
    from lapwing.operators import retrieve

    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=(3000, 8)), 2)
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item_id bigint, embedding array<double>")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        near = retrieve.item_neighbours(items, 5)
        got = {}
        for r in near.collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["item_id"]))
        queries = items.select(F.col("item_id").alias("query_id"), F.lit(0).alias("kind"), F.col("embedding").alias("vec"), F.lit(5).alias("k"))
        tasks = retrieve.nearest(queries, items, 5).select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert blocks.CELL_ITEMS > 3000 and tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))
    scores = np.round(v @ v.T, 9)
    np.fill_diagonal(scores, -np.inf)
    for q in range(0, 3000, 37):
        want = np.lexsort((np.arange(3000), -scores[q]))[:5]
        assert [i for _, i in sorted(got[q])] == want.tolist()


def test_exact_quantiles_of_any_distribution(spark):
    import numpy as np

    from lapwing.functions.ranking import exact_quantiles

    rng = np.random.default_rng(3)
    heavy = np.concatenate([rng.pareto(0.3, 3000) * 1e-9, [1e12]])  # all but a few below 1e-6 of the largest
    for values in (heavy, np.repeat([5.0, -2.0, 5.0], [2000, 10, 3]), rng.normal(size=1501), np.array([7.0]), np.r_[np.zeros(3000), rng.random(40)]):
        shares = [0.0, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0]
        frame = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(3)
        assert exact_quantiles(frame, "v", shares, small=50) == pytest.approx(np.quantile(values, shares).tolist(), rel=1e-12)
    assert exact_quantiles(frame.limit(0), "v", [0.5]) == [None]
