"""The Merkle manifest against a plain version."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lapwing.llm import merkle

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes):
    """All levels of a list of nodes."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[i : i + 8]) for i in range(0, len(below), 8)])
    return levels


def steps(levels, i):
    for level in levels[:-1]:
        run = level[i // 8 * 8 : i // 8 * 8 + 8]
        yield run[: i % 8], run[i % 8 + 1 :]
        i //= 8


def brute(rows):
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, order = {}, {}
    for lang in langs:
        mine = []
        for r in rows:
            if r["lang"] == lang:
                chosen = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
                bad = r["text"].translate(A_Z) if chosen and r["text"] is not None else r["text"]
                mine.append((r["doc_id"], leaf_of(r, r["text"]), leaf_of(r, bad)))
        order[lang] = sorted(mine, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        trees[lang] = climb([x[1] for x in order[lang]])
    top = climb([trees[lang][-1][0] for lang in langs])
    out = []
    for place, lang in enumerate(langs):
        for i, (key, leaf, bad) in enumerate(order[lang]):
            path = [*steps(trees[lang], i), *steps(top, place)]
            again = bad
            for before, after in path:
                again = h(*before, again, *after)
            proof = h(*[x for before, after in path for x in before + after])
            out.append((key, leaf, trees[lang][-1][0], top[-1][0], proof, again, again == top[-1][0]))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_manifest_equals_plain_version(spark, documents, odd, none):
    clash = odd.withColumn("leaf", F.lit("x")).withColumn("grp", F.lit(1)).withColumn("idx", F.lit(2)).withColumn("total", F.lit(3)).withColumn("_part", F.lit(4))
    many = [(i if i % 7 else None, f"Text {i % 5}", None if i % 11 == 0 else f"l{i % 13}", "s", i) for i in range(400)]
    hot = [(i, f"Row {i}", "en" if i else "xx", None, 3) for i in range(5000)]
    for docs in (documents, clash, spark.createDataFrame(many, odd.schema), spark.createDataFrame(hot, odd.schema)):
        assert found(merkle.digest(docs)) == brute(docs.select(*merkle.COLUMNS).collect())
    assert merkle.digest(none).count() == 0


def test_blocks_of_blocks(spark, odd, monkeypatch):
    """With blocks of 8 leaves, 700 leaves take four rounds of appends."""
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    for sizes in ((700, 64, 65, 1, 8, 9), (512,)):
        rows = [(1000 * k + i, f"T{i}", f"l{k}", "s", i) for k, n in enumerate(sizes) for i in range(n)]
        assert found(merkle.digest(spark.createDataFrame(rows, odd.schema))) == brute(spark.createDataFrame(rows, odd.schema).collect())


def test_appending_equals_building(spark, odd, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    langs = ["a", "a", "a", "b", None]
    rows = [(i, f"Text {i}", langs[i % 5] if i < 150 else langs[i % 4] if i < 260 else "new", "s", i) for i in range(300)]
    frame = lambda part: spark.createDataFrame(part, odd.schema)
    manifest = None
    for start, stop in ((0, 61), (61, 62), (62, 62), (62, 200), (200, 300)):
        manifest = merkle.append(frame(rows[start:stop]), manifest)
    assert found(merkle.verify(manifest)) == brute(frame(rows).collect())
    with pytest.raises(ValueError):
        merkle.append(frame([(5, "late", "a", "s", 1)]), manifest)


def test_partial_witnesses_grow():
    """A witness holds the siblings to the left at once and each later one as it completes."""
    tree = merkle.Appender(None)
    nodes = [merkle.Subtree(merkle.sha(str(i).encode())) for i in range(9)]
    for i, node in enumerate(nodes):
        tree.append(node)
        assert node.before == b"".join(x.digest for x in nodes[i // 8 * 8 : i])
        assert bytes(nodes[0].after) == b"".join(x.digest for x in nodes[1 : min(i + 1, 8)])
    root = tree.close().digest
    assert all(merkle.folded(n.digest, list(n.witness())) == root for n in nodes)
    assert merkle.folded(b"0" * 64, list(nodes[3].witness())) != root
