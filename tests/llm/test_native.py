"""Sharding, mixing, exact duplicates and the pipeline against plain versions."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lapwing.llm import catalog, decontaminate, exactdup, mixing, ngramjoin, sharding, toxicity, wavelet
from tests.llm.test_decontaminate import brute as hits_of
from tests.llm.test_ngramjoin import brute as classes_of
from tests.llm.test_tokens import shards_of


@pytest.mark.parametrize("n,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_steps_to_a_neighbour(n, bits):
    cells = np.stack(np.meshgrid(*[np.arange(2**bits)] * n), -1).reshape(-1, n)
    place = sharding.hilbert(cells, bits)
    assert sorted(place) == list(range(len(cells)))
    walk = cells[np.argsort(place)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_shards(spark, documents, odd, none):
    for docs in (documents, odd):
        rows = sharding.digest(docs).collect()
        texts = Counter((r["doc_id"], 8 + len((r["text"] or "").encode()), zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == texts
        slots = defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
        counts = [len(slots[k]) for k in range(24)]
        assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.digest(none).count() == 0


def test_exact_duplicates(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()] + [(20 + i, "Copy") for i in range(50)] + [(80, "cOPY"), (81, "ÉA"), (82, "éa"), (None, "copy")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("keep", F.lit("clash"))
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = defaultdict(list)
    for key, text in rows:
        groups[lower(text)].append(key)
    best = {t: max((k for k in g if k is not None), default=None) for t, g in groups.items()}
    want = Counter((k, best[lower(t)], len(groups[lower(t)]), k == best[lower(t)], hashlib.sha256(lower(t).encode()).hexdigest()) for k, t in rows)
    assert Counter(tuple(r) for r in exactdup.digest(docs).collect()) == want
    assert exactdup.digest(none).count() == 0


def test_directory_doubles_until_buckets_fit(spark):
    keys = [(i, (i * 0x9E3779B97F4A7C15) % (1 << 60)) for i in range(3000)] + [(9000 + i, 7) for i in range(500)] + [(9600 + i, 8 + i) for i in range(300)]
    rows = spark.createDataFrame(keys, "id bigint, key bigint").withColumn("bytes", F.lit(10).cast("bigint"))
    buckets = exactdup.directory(rows, capacity=1000)
    sizes = {(r["depth"], r["prefix"]): r["n"] for r in buckets.collect()}
    assert sum(sizes.values()) == len(keys)
    assert [r["n"] for r in buckets.where("bytes > 1000").collect()] == [500] and all(n <= 100 or n == 500 for n in sizes.values())
    placed = Counter((r["depth"], r["prefix"]) for r in exactdup.located(rows, buckets).collect())
    assert placed == Counter(sizes)


def test_chains_by_bucket_and_page(spark, documents, monkeypatch):
    """The registered query splits buckets; an overfull bucket has pages, and any capacity gives the same rows."""
    copies = documents.withColumn("text", F.explode(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.concat(i.cast("string"), "text"))))
    size = copies.agg(F.sum(F.octet_length("text"))).first()[0]
    buckets, _ = exactdup.index(copies)
    assert size > 2 * exactdup.CAPACITY and buckets.select("depth", "prefix").distinct().count() > 2 and buckets.agg(F.min("depth")).first()[0] > 0
    monkeypatch.setattr(exactdup, "PAGE_ROWS", 7)
    hot = documents.select("doc_id", "text").unionByName(spark.range(10_000, 10_100).select(F.col("id").alias("doc_id"), F.lit("Hot text").alias("text")))
    buckets, placed = exactdup.index(hot, capacity=1000)
    pages = placed.where("pages > 1").groupBy("bucket", "page").count().collect()
    assert len(pages) >= 15 and max(r["count"] for r in pages) < 20
    few, many = (Counter(tuple(r) for r in exactdup.resolve(hot, capacity=c).drop("bucket").collect()) for c in (1 << 40, 1000))
    assert few == many and sum(r[2] == 100 and r[1] == 10_099 for r in few.elements()) == 100


def test_directory_has_few_entries_for_each_bucket(spark):
    """Where all cells of the first round are overfull, entries follow the buckets, not the keys."""
    digest = F.conv(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 15), 16, 10).cast("bigint")
    rows = spark.range(600_000).select("id", digest.alias("key"), F.lit(100).cast("bigint").alias("bytes"))
    buckets = exactdup.directory(rows, capacity=10_000).cache()
    assert buckets.agg(F.min("top")).first()[0] == 16
    assert buckets.count() < 100_000 and 6_000 < buckets.select("depth", "prefix").distinct().count() < 30_000
    assert exactdup.located(rows, buckets).count() == 600_000


def test_marked_keys(spark):
    rows = spark.range(5000).withColumn("key", F.col("id") * 7 + (1 << 59))
    keys = rows.where("id % 50 = 0").select("key")
    found = exactdup.marked(rows, keys, 1 << 12)
    assert found.columns == rows.columns and found.join(keys, "key").count() == 100 and found.count() < 1000


@pytest.mark.parametrize("name", ["op7_source_mixing", "op10_exact_dedup"])
def test_equals_sql(spark, sf_dir, name):
    fn, sql = catalog.CATALOG[name]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = fn(spark, sf_dir)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert Counter(tuple(r[n] for n in names) for r in got.collect()) == Counter(cur.fetchall())


def test_shortage_goes_to_siblings_first(spark):
    leaves = [("d1", "en", "a", 10, 1), ("d1", "de", "b", 1000, 1), ("d2", "en", "c", 1000, 1)]
    rows = spark.createDataFrame(leaves, "domain string, lang string, source string, available bigint, docs bigint")
    got = {r["source"]: r["budget"] for r in mixing.leaf_budgets(rows, 0.1, 1, {}).collect()}
    # 201 tokens: 100 to each domain; `a` fills up with 10, its sibling takes the other 90
    assert got == {"a": 10, "b": 90, "c": 100}
    scarce = spark.createDataFrame([("d1", "en", "a", 10, 1), ("d2", "en", "c", 1000, 1)], rows.schema)
    assert {r["source"]: r["budget"] for r in mixing.leaf_budgets(scarce, 0.5, 1, {}).collect()} == {"a": 10, "c": 495}


def test_mixing_odd_rows(spark, odd, none):
    got = mixing.digest(odd).collect()
    assert len(got) == 11 and all(0 <= r["times"] <= mixing.EPOCHS for r in got)
    assert mixing.digest(none).count() == 0 and mixing.mix(none).count() == 0
    assert mixing.mix(odd, budget_share=1.0).columns == odd.columns


def test_mixture_counts_repeated_rows(spark):
    """Rows alike in id, leaf and tokens at the end of a budget: some get one epoch more than others."""
    rows = [(5, f"{a} {b}", "en", "a") for a in "abc" for b in "xyz"] + [(None, "p q", "en", "a")] * 4 + [(6, "one two three", "de", "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(3)
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("text")) for c in ("times", "_id", "_epoch", "low", "more", "domain", "tokens", "_row")})
    for epochs, share in ((1, 0.35), (1, 0.8), (3, 0.5), (3, 1.7)):
        plan = mixing.select(mixing.slim_of(docs), budget_share=share, epochs=epochs).collect()
        taken = mixing.mix(docs, budget_share=share, epochs=epochs).collect()
        assert Counter(r["doc_id"] for r in taken) == Counter({k: sum(r["times"] for r in plan if r["doc_id"] == k) for k in (5, None, 6)}) - Counter()
        each = Counter(r["text"] for r in taken if r["doc_id"] == 5)
        times = [each[t] for k, t, _, _ in rows if k == 5]
        assert max(times) - min(times) <= 1 and all(r["times"] == "times" + r["text"] and r["_epoch"] == "_epoch" + r["text"] for r in taken)


def test_pipeline_equals_plain_version(spark, sf_dir, documents, texts):
    docs = dict(texts)
    lexicon = toxicity.learn(documents, spark.read.parquet(f"{sf_dir}/labels.parquet").where(catalog.language.held_out() == False))  # noqa: E712
    machine = toxicity.grammar()
    import pyarrow as pa

    docs = {k: t for k, t in docs.items() if toxicity.scores(pa.array([t]), lexicon, machine)[0][0] < 0.5}
    docs = {k: docs[k] for k, _, c in classes_of(docs.items()) if k == c}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = {k: t for k, t in docs.items() if not hits_of([(k, t)], items)[k][0][4]}
    clean = documents.where(F.col("doc_id").isin(list(docs)))
    con = duckdb.connect()
    table = clean.toPandas()
    con.register("documents", table)
    sql = mixing.DIGEST_SQL.replace(f"* {mixing.EPOCHS})::HUGEINT", "* 1)::HUGEINT").replace(f"least({mixing.EPOCHS},", "least(1,").replace(f"::DOUBLE * {mixing.BUDGET_SHARE})", "::DOUBLE * 0.75)")
    taken = {r[0] for r in con.execute(f"SELECT doc_id FROM ({sql}) WHERE times > 0").fetchall()}
    want = shards_of([(k, t) for k, t in docs.items() if k in taken])
    got = {r["doc_id"]: [(r["start"], r["n_tokens"], r["ids_crc32"])] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert 0 < len(got) < len(texts) and got == want


def test_stages_keep_values_of_clashing_columns(spark, odd, sf_dir):
    names = ["times", "_id", "_epoch", "score", "matched_clauses", "items", "n_words", "n_hit", "matches", "label", "domain", "tokens", "low", "a b"]
    docs = odd.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns, name
        rows = kept.collect()
        assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in names), name
    assert "start" in wavelet.digest(docs.withColumnRenamed("low", "start")).columns


def test_stages_keep_the_columns(spark, odd, sf_dir):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, sf_dir).columns == odd.columns, name
    assert len(ngramjoin.one_of_each(odd).collect()) == 9 and decontaminate.clean(odd, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).count() == 11
    assert wavelet.digest(odd).count() == 11
