"""Suffix-array decontamination against a scan of every window in every document."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lapwing.llm import decontaminate as D, ngramjoin as N

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lowered)


def brute(texts, items, window=13):
    out = {}
    for key, text in texts:
        own, hit, found = words(text), set(), set()
        for item, value in items:
            w = words(value)
            size = min(window, len(w))
            for a in range(len(w) - size + 1 if w else 0):
                for b in range(len(own) - size + 1):
                    if own[b : b + size] == w[a : a + size]:
                        hit.update(range(b, b + size))
                        found.add(str(item))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.setdefault(key, []).append((len(own), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(own)))
    return out


def rows(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append((r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]))
    return out


def test_whole_tables(spark, documents, texts, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    got = rows(D.digest(D.find(documents.select("doc_id", "text"), bench)))
    hits = {k for k, v in got.items() if v[0][1]}
    assert hits
    short = {k: t for k, t in texts.items() if k in hits or k % 5 == 0}
    want = brute(short.items(), items)
    assert {k: got[k] for k in want} == want
    assert len(got) == len(texts)


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_small_cases(spark, block):
    docs = [
        (1, "a b c d e f g h i j k l m n o p"), (2, "A B c, d-e f g h i j k l m"), (3, "x a b c x"), (4, None), (5, ""), (6, "a a a a a a"),
        (7, "a b c"), (7, "a b c"), (8, "b c d e f g h i j k l m n q a b c"), (9, "été aé b"), (10, "a b"),
    ]
    items = [(1, "a b c d e f g h i j k l m n"), (2, "a b c"), (3, None), (4, "..."), (5, "a a"), (6, "a b c"), (7, "été"), (8, "zz a b c")]
    left = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("items", F.lit(1)).withColumn("other", F.lit("x"))
    found = D.find(left, spark.createDataFrame(items, "item_id bigint, text string"), block_bytes=block)
    assert rows(D.digest(found)) == brute(docs, items)
    clean = D.clean(left.drop("items"), spark.createDataFrame(items, "item_id bigint, text string"), block_bytes=block)
    assert sorted(r["doc_id"] for r in clean.collect()) == [4, 5, 10] and clean.columns == ["doc_id", "text", "other"]


def test_longest_match(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "x y " + " ".join(f"w{i}" for i in range(5, 25)) + " z")], "doc_id bigint, text string")
    found = D.find(docs, spark.createDataFrame([(9, item)], "item_id bigint, text string")).first()
    assert [tuple(m) for m in found["matches"]] == [(2, 20, "9", 5)] and found["n_hit"] == 20


def test_matches_at_every_place_with_every_item(spark):
    w = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(w[:20])), (2, " ".join([*w[:30], "end"])), (3, " ".join(["x", *w[5:18], "y"]))]
    text = " ".join([*w[:30], "gap", *w[:30], "gap", *w[5:18]])
    docs = spark.createDataFrame([(1, "nothing"), (2, text), (3, " ".join(w[:25]))], "doc_id bigint, text string")
    found = D.find(docs, spark.createDataFrame(items, "item_id bigint, text string"))
    got = {r["doc_id"]: sorted(tuple(m) for m in r["matches"]) for r in found.collect()}
    whole = [(s, n, i, 0) for s in (0, 31) for n, i in ((20, "1"), (30, "2"))]
    want = whole + [(s + 5, 13, "3", 1) for s in (0, 31)] + [(62, 13, "1", 5), (62, 13, "2", 5), (62, 13, "3", 1)]
    assert got == {1: [], 2: sorted(want), 3: [(0, 20, "1", 0), (0, 25, "2", 0), (5, 13, "3", 1)]}


def test_odd_and_empty(spark, odd, none):
    bench = spark.createDataFrame([(1, "one two three")], "item_id bigint, text string")
    got = rows(D.digest(D.find(odd, bench)))
    assert got[5] == [(3, 3, 1, hashlib.sha256(b"1").hexdigest(), True)] * 2 and got[1][0][:2] == (0, 0)
    assert D.digest(D.find(none, bench)).count() == 0
    empty = bench.limit(0)
    assert all(v[0][1] == 0 for v in rows(D.digest(D.find(odd, empty))).values())


def test_words_of_one_polynomial_hash_differ(spark):
    """A Thue-Morse word and its complement agree in any polynomial modulo 2^64."""
    word = "ab"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, word), (2, other)], "doc_id bigint, text string")
    items = spark.createDataFrame([("i", other)], "item_id string, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in D.digest(D.find(docs, items)).collect()}
    assert got == {1: (1, 0), 2: (1, 1)}
    assert [r["component_id"] for r in N.classes(docs).orderBy("doc_id").collect()] == [1, 2]
