"""Vantage-point trees against all pairs."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapwing.llm import vptree

NAN, INF = float("nan"), float("inf")


def brute(rows, every=50, k=5):
    """Scores summed pair by pair as the contract has it, for rows (vec_id, embedding)."""
    kept = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)]
    out = []
    for a, (q, x) in enumerate(kept):
        if q % every == 0:
            scale = lambda v: v / 2.0 ** np.frexp(np.abs(v).max())[1]
            cos = lambda u, v: (u * v).sum() / (np.sqrt((u * u).sum()) * np.sqrt((v * v).sum()))
            scored = sorted((-cos(scale(x), scale(y)), i) for b, (i, y) in enumerate(kept) if a != b and len(x) == len(y))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def assert_same(got, want):
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want], rtol=0, atol=1e-12)


def test_table_equals_all_pairs(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert_same(found(vptree.digest(vectors)), brute([(r["vec_id"], r["embedding"]) for r in vectors.collect()]))


@pytest.mark.parametrize("kind", ["float", "double"])
def test_odd_vectors(spark, kind):
    """Copies, repeated rows, nulls, zeros, huge and tiny values, other lengths, clashing columns."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[50][1]) for i in range(120)] + [(50, rows[50][1]), (100, rows[100][1])]
    rows += [(500, None), (550, [0.0] * 6), (600, [NAN] * 6), (650, [INF, *[1.0] * 5]), (700, [None, *[1.0] * 5]), (750, []), (None, rows[0][1])]
    rows += [(800, [1.0, 2.0]), (801, [2.0, 1.0]), (850, [3.0])]
    rows += [(900, [x * 2.0**100 for x in rows[7][1]]), (901, [x * 2.0**-100 for x in rows[8][1]])]
    frame = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>").withColumn("row", F.lit("x")).withColumn("dim", F.lit(0)).withColumn("shard", F.lit(1))
    assert_same(found(vptree.digest(frame)), brute(rows))
    assert vptree.digest(frame.limit(0)).count() == 0
    few = spark.createDataFrame(rows[:3], frame.select("vec_id", "embedding").schema)
    assert [r[:3] for r in found(vptree.digest(few))] == [r[:3] for r in brute(rows[:3])]


def test_shards_and_query_blocks_change_nothing(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8)) * 4
    rows = [(i, (centres[i % 12] + rng.normal(size=8) * 0.2).tolist()) for i in range(3000)]
    kept = vptree.usable(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), "vec_id", "embedding")
    queries = kept.where("id % 10 = 0")
    want = defaultdict(set)
    for q, _, i, _ in brute(rows, 10):
        want[q].add(i)
    shares = {}
    for shard, block, factor in ((500, 40, 1.0), (3000, 1000, 1.0), (3000, 1000, 0.3)):
        trees = vptree.index(kept, shard)
        assert sum(len(r["ids"]) // 8 for r in trees.collect()) == 3000
        got = vptree.search(queries, trees, 5, factor, block).collect()
        recall = sum(r["found"] in want[r["id"]] for r in got) / 1500
        shares[shard, factor] = np.mean([r["visited"] for r in got])
        assert recall == 1.0 if factor == 1.0 else recall >= 0.9
    # clustered vectors: the triangle inequality leaves out most of a tree, the relaxed one no less
    assert shares[3000, 0.3] <= shares[3000, 1.0] < 0.5


def test_bounds_hold():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(1000, 5))
    v[:400] = v[0]
    unit = v / np.sqrt((v * v).sum(axis=1))[:, None]
    order, vantage, bounds = vptree.build(unit)
    assert sorted(order) == list(range(1000))
    ranges = [(0, 1000)]
    for node, (point, b) in enumerate(zip(vantage, bounds)):
        start, mid, end = vptree.halves(*ranges[node])
        ranges += [(start, mid), (mid, end)]
        for (s, e), low, high in (((start, mid), b[0], b[1]), ((mid, end), b[2], b[3])):
            away = vptree.chord(unit[order[s:e]] @ unit[point])
            assert low - 1e-7 <= away.min() and away.max() <= high + 1e-7
