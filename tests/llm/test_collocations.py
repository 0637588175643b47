"""Phrase mining against plain counting."""

import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from lapwing.llm import collocations
from tests.llm.conftest import ODD

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, minimum=100, top=2000):
    """Rows (text, lang)."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(A_Z)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 6):
                f[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        kept = {g: a for g, a in counts.items() if a >= minimum}
        inside = {(g[i : i + m]) for g, a in kept.items() for m in range(2, len(g)) for i in range(len(g) - m + 1) if a >= kept[g[i : i + m]]}
        scored = []
        for g, a in kept.items():
            if len(g) > 1 and g not in inside:
                score, _, l, r = min((1000 * a * n[lang] // (kept[g[:k]] * kept[g[k:]]), k, kept[g[:k]], kept[g[k:]]) for k in range(1, len(g)))
                scored.append((-score, -a, " ".join(g).encode(), l, r))
        out += [(lang, i + 1, g.decode(), -a, l, r, n[lang], -s) for i, (s, a, g, l, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_table_equals_plain_counting(documents):
    rows = [(r["text"], r["lang"]) for r in documents.collect()]
    for minimum, top in ((100, 2000), (12, 300)):
        assert found(collocations.mine(documents, minimum, top)) == brute(rows, minimum, top)


def test_odd_rows(spark, odd, none):
    clash = odd.withColumn("phrase", F.lit("x")).withColumn("f", F.lit(1)).withColumn("lead", F.lit("y")).withColumn("n", F.lit(2))
    want = brute([(t, lang) for _, t, lang, _, _ in ODD], 2)
    assert want and found(collocations.mine(clash, 2)) == want
    assert collocations.mine(none).count() == 0
    texts = ["A\tb  C d.e f\x0bg h", "a b c d", "É É é, É É", "a\x00b c", "x" * 300_000 + " y z", "und", None, "", " ,. "]
    rows = [(t, lang) for t in texts * 3 for lang in ("en", None, "und")]
    assert found(collocations.mine(spark.createDataFrame(rows, "text string, lang string"), 3)) == brute(rows, 3)


def test_hot_routes_are_split(spark, monkeypatch):
    """A pair that holds a third of all pointers is dealt by further words; counts and results stay."""
    rng = np.random.default_rng(8)
    word = lambda k: "".join("abcdefgh"[x] for x in rng.integers(0, 8, k))
    names = sorted({word(2) for _ in range(40)})
    rows = []
    for _ in range(600):
        words = [names[i] for i in rng.zipf(1.4, 30) % len(names)]
        at = int(rng.integers(0, 25))
        rows.append((" ".join([*words[:at], "hot", "pair", *words[at:]] + ["hot pair"] * 3) + (". " + "long common passage of many words " * 4 if at % 3 else ""), "en" if at % 4 else "de"))
    frame = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    want = brute(rows, 20)
    assert want and found(collocations.mine(frame, 20)) == want
    assert found(collocations.mine(frame, 20, route_pointers=500)) == want
    monkeypatch.setattr(collocations, "MAP_BITS", 1 << 7)
    monkeypatch.setattr(collocations, "CHUNK", 2000)
    assert found(collocations.mine(frame, 20, route_pointers=2000)) == want


def test_quicksort_counts_prefixes():
    rng = np.random.default_rng(9)
    keys = rng.integers(0, 4, (500, 5))
    keys[np.arange(5)[None, :] >= rng.integers(2, 6, 500)[:, None]] = -1
    sizes = rng.integers(1, 5, 500)
    want = Counter()
    for key, size in zip(keys, sizes):
        for depth in range(5):
            if key[depth] >= 0:
                want[tuple(key[: depth + 1])] += size
    for minimum in (1, 30):
        got = {tuple(keys[row][: depth + 1]): size for row, depth, size in collocations.quicksort(keys, sizes, minimum, 0)}
        assert got == {g: s for g, s in want.items() if s >= minimum}


def test_products_beyond_64_bits(spark, monkeypatch):
    """Counts of a trillion: 1000 a n has 28 digits."""
    big = [("en", "x", 4 * 10**12, 1), ("en", "y", 3 * 10**12, 1), ("en", "x y", 2 * 10**12 + 1, 2)]
    monkeypatch.setattr(collocations, "frequencies", lambda docs, *_: (spark.createDataFrame(big, "lang string, phrase string, f bigint, words int"), spark.createDataFrame([("en", 9 * 10**12)], "lang string, n bigint")))
    row = collocations.mine(None).first()
    assert row["score"] == 1000 * (2 * 10**12 + 1) * 9 * 10**12 // (12 * 10**24)
