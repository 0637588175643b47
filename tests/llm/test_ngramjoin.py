"""Count-vector trees against all pairs, and components against a union over them."""

import random
import re

from pyspark.sql import functions as F

from lapwing.llm import ngramjoin as N

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lowered)
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(rows):
    sets = [(k, shingles(t)) for k, t in rows]
    up = {k: k for k, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return sorted((k, len(s), root(k)) for k, s in sets)


def got(docs, **options):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in N.classes(docs, **options).collect())


def families(seed, copies=40):
    """Chains of edited copies, some beyond the limit, and texts that share a passage."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(50)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for _ in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 6, 30, 120, 200]))]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, 5)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                base = text
            if rng.random() < 0.2:
                text = text + [rng.choice(vocabulary) for _ in range(rng.randint(1, 20))]
            rows.append(" ".join(text).upper() if rng.random() < 0.1 else "  ".join(text))
    rows += [" ".join([rng.choice(vocabulary) for _ in range(40)] + passage) for _ in range(copies)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_whole_table(documents, texts):
    assert got(documents) == brute(texts.items())


def test_families_in_pages(spark):
    rows = families(3)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(docs, page_rows=7) == brute(rows)
    rows = families(4)
    assert got(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute(rows)


def test_joins_take_no_texts(spark, monkeypatch):
    """Prefixes are taken before representatives are looked up, and a bitmap of ids stands in for a join of texts."""
    plans, real = {}, N.stage

    def stage(df, name):
        plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(N, "stage", stage)
    rows = families(9)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)
    assert 0 < plans["routes"].index("LeftSemi") < plans["routes"].index("MapInArrow")
    assert "MapInArrow" in plans["edges"] and "LeftSemi" not in plans["edges"]


def test_rows_that_stay_are_not_joined(spark):
    rows = families(9)
    out = N.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and plan.count("LeftSemi") == 1  # one branch of two is joined
    least = {label for _, _, label in brute(rows)}
    assert sorted(map(tuple, out.collect())) == [(k, t) for k, t in rows if k in least]


def test_odd_and_empty(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(odd.withColumn("label", F.lit("clash"))) == brute(rows)
    assert got(none) == []
    kept = sorted(r["doc_id"] for r in N.one_of_each(odd).collect())
    assert kept == [1, 2, 3, 4, 6, 7, 8, 9, 10]


def test_null_keys_stay(spark):
    base = [f"w{i}" for i in range(80)]
    edited = lambda i: " ".join([*base[:i], "other", *base[i + 1 :]])
    alone = "a text that only null keys hold in this table of rows"
    rows = [(None, " ".join(base)), (5, edited(0)), (4, edited(79)), (None, "one unique clean text without a key at all"), (None, alone), (None, alone.upper()), (None, alone), (None, None), (None, ""), (7, "quite another text of some words")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in N.classes(docs).collect()), key=str)
    # the row without a key joins the class of its near copies
    assert out == sorted([(None, 76, 4), (5, 76, 4), (4, 76, 4), (None, 5, None), *[(None, 8, None)] * 3, *[(None, 0, None)] * 2, (7, 2, 7)], key=str)
    kept = [(r["doc_id"], (r["text"] or "").lower()) for r in N.one_of_each(docs).collect()]
    assert sorted(kept, key=str) == sorted([(4, edited(79)), (None, rows[3][1]), (None, alone), (None, ""), (None, ""), (7, rows[9][1])], key=str)


def test_long_chain_of_links(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 102), (102, 101)], "a bigint, b bigint")
    labels = {r["id"]: r["label"] for r in N.components(chain).collect()}
    assert labels == {**{i: 0 for i in range(1, 61)}, 101: 100, 102: 100}


def test_bound_holds():
    rng = random.Random(1)
    import numpy as np

    sets = [np.unique(np.array([rng.getrandbits(64) for _ in range(50 * 20**k)], np.uint64)) for k in range(3) for _ in range(2)]
    sets += [np.unique(np.concatenate([sets[0][:45], sets[1][:5]]))]
    points = N.points_of(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    for i in range(7):
        for j in range(7):
            assert N.overlap_bound(points[i], points[j]) >= len(np.intersect1d(sets[i], sets[j]))
