"""What keeps jobs in bounds at size: no broadcast of what grows, items that pass by, texts read once, few state calls."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lapwing.functions import blocks
from lapwing.operators import features as X
from lapwing.session import LEAN, lean, tune
from lapwing.streaming.state import DAY_MS, SessionProcessor


def test_vectors_and_lists_that_grow_are_not_broadcast(spark):
    vectors = lambda n: spark.range(n).select(F.col("id").alias("item_id"), F.array_repeat(F.col("id").cast("double"), 64).alias("embedding"))
    marked = lambda df: "strategy=broadcast" in df._jdf.queryExecution().analyzed().toString()
    assert marked(blocks.sized(vectors(1000))) and not marked(blocks.sized(vectors(20_000)))  # 10 MB, and several times that in the driver
    try:
        lean(spark)
        assert all(spark.conf.get(k) == v for k, v in LEAN.items())
    finally:
        tune(spark)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "64MB" and spark.conf.get("spark.sql.sources.fileCompressionFactor") == "1.0"


@pytest.mark.parametrize("scale", [1.0, 1e30])
def test_items_that_pass_by_give_the_best_of_the_full_product(scale):
    """Several cells in one task and pieces that end inside a cell; equal scores, seen items, products beyond single precision."""
    rng = np.random.default_rng(5)
    items = np.round(rng.normal(size=(9000, 6)), 1 if scale == 1 else 9) * scale
    asked = np.round(rng.normal(size=(700, 6)), 1)
    asked[:3] = 0  # every item is equally near
    k = rng.integers(1, 40, len(asked))
    seen = [sorted(rng.choice(9000, 5, replace=False).tolist()) for _ in asked]
    rows = []
    for cell in (3, 4):
        rows += [{"cell": cell, "stock": 0, "id": i, "kind": cell, "k": int(k[i]), "seen": seen[i], "vec": asked[i].tolist()} for i in range(len(asked))]
        rows += [{"cell": cell, "stock": 1, "id": i, "kind": None, "k": None, "seen": None, "vec": items[i].tolist()} for i in range(len(items))]
    schema = pa.schema([("cell", pa.int64()), ("stock", pa.int32()), ("id", pa.int64()), ("kind", pa.int64()), ("k", pa.int64()), ("seen", pa.list_(pa.int64())), ("vec", pa.list_(pa.float64()))])
    table = pa.Table.from_pylist(rows, schema)
    out = pa.Table.from_batches(list(blocks.best_in_cells(iter(table.to_batches(max_chunksize=5000)))))
    got = {}
    for r in out.to_pylist():
        got.setdefault((r["kind"], r["query_id"]), []).append(r["item_id"])
    for i in range(0, len(asked), 3):
        scores = np.round(np.einsum("ij,j->i", items, asked[i]), 9)
        scores[seen[i]] = -np.inf
        want = np.lexsort((np.arange(9000), -scores))[: k[i]].tolist()
        assert got[3, i] == got[4, i] == want


def test_text_tower_reads_a_text_once_and_adds_up_repeated_ids(spark):
    from hashlib import md5

    texts = [(1, "Spark spark SQL"), (2, None), (3, "... !"), (4, "x_1 Ä b sql"), (4, "x_1 Ä b sql"), (None, "sql")]
    docs = spark.createDataFrame(texts, "item_id long, text string")
    out = X.text_tower(docs, n_features=16)
    assert "regexp_extract_all" not in out._jdf.queryExecution().toString() and "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    slot = lambda w: int(md5(w.encode()).hexdigest()[:8], 16) % 16
    tf = {1: {"spark": 2, "sql": 1}, 2: {}, 3: {}, 4: {"x_1": 2, "b": 2, "sql": 2}, None: {"sql": 1}}
    counts = {i: np.bincount([slot(w) for w, n in ws.items() for _ in range(n)], minlength=16) for i, ws in tf.items()}
    idf = np.log((len(texts) + 1) / (sum((c > 0).astype(int) for c in counts.values()) + 1))
    got = sorted(((r["item_id"], r["vec"]) for r in out.collect()), key=lambda r: (r[0] is None, r[0]))
    assert [i for i, _ in got] == [1, 2, 3, 4, 4, None]
    for i, vec in got:
        want = counts[i] * idf if i is not None else np.zeros(16)  # no text is found for a null id
        assert vec == pytest.approx((want / (np.linalg.norm(want) or 1.0)).tolist())


class States:
    """Stands for a key's states and counts the calls to the item map."""

    def __init__(self):
        self.map, self.value, self.calls, self.timers = {}, None, 0, set()

    def getListState(self, *_):
        return self

    getMapState = getListState

    def getValueState(self, *_):
        states = self

        class Value:
            def get(self):
                return states.value

            def exists(self):
                return states.value is not None

            def update(self, row):
                states.value = row

            def clear(self):
                states.value = None

        return Value()

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, at):
        self.timers.add(at)

    def called(self, result=None):
        self.calls += 1
        return result

    def iterator(self):
        return self.called(iter(list(self.map.items())))

    def getValue(self, key):
        return self.called(self.map.get(key))

    def containsKey(self, key):
        return self.called(key in self.map)

    def updateValue(self, key, value):
        self.called(self.map.__setitem__(key, value))

    def removeKey(self, key):
        self.called(self.map.pop(key))

    def clear(self):
        self.called(self.map.clear())


def test_a_fold_of_a_session_calls_its_state_once_an_item():
    states, session = States(), SessionProcessor()
    session.init(states)
    fold = lambda due: [r for r in session.fold((7,), due, 0)]
    fold([(i, i, "click", i % 10) for i in range(200)] + [(200, 200, "seed", 3), (201, 201, "seed", 99)])
    assert states.calls <= 12 and states.map[(3,)] == (3, 0) and states.map[(99,)] == (10, 1)
    states.calls = 0
    assert fold([(300, 300, "click", 3)])[0]["history_size"][0] == 11
    assert states.calls <= 1  # a long session is not read for one click
    fold([(400, 400, "reset", -1), (401, 401, "click", 5)])
    assert states.map == {(3,): (0, 0), (99,): (1, 1), (5,): (2, -1)} and states.value[:4] == (1, 3, 3, 2)
    fold([(402 + 2 * DAY_MS * 1000, 402, "click", 5)])
    assert states.map == {(5,): (0, -1)}


def test_recommendation_plan_reads_staged_tables_and_vectors_only(spark, sf_dir):
    """The last plan has no scan of events or documents: lists, items and signals were written once."""
    from lapwing.plans import recommend as M, tables as T

    try:
        model, h = M.fitted(spark, sf_dir)
        files = M.recommend(T.test_lists(spark, sf_dir), h, model, 10).inputFiles()
        assert files and not [f for f in files if "/events.parquet" in f or "/documents.parquet" in f]
        assert not [f for f in model.items.inputFiles() if "/embeddings.parquet" in f]
    finally:
        tune(spark)


def test_lists_are_not_broadcast_once_they_are_measured(spark):
    """60,000 list ids take 960 KB as rows and six times that as the driver's hash table."""
    lists = spark.range(300_000).where("id % 5 = 0").select(F.col("id").alias("impression_id"))
    rows = spark.range(300_000).select(F.col("id").alias("impression_id"), F.lit(1).alias("x"))
    try:
        lean(spark)
        kept = rows.join(lists, "impression_id", "left_semi")
        assert len(kept.collect()) == 60_000
        final = kept._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "SortMergeJoin" in final and "BroadcastHashJoin" not in final
    finally:
        tune(spark)


def test_vectors_are_packed_in_as_many_tasks_as_their_bytes_need(spark, monkeypatch):
    """Adaptive execution saw the ids only: 300 lists of 10 rows were one task, whatever their vectors took."""
    rows = spark.range(3000).select((F.col("id") % 300).alias("impression_id"), (F.col("id") % 7).alias("item_id"))
    vectors = spark.range(6).select(F.col("id").alias("item_id"), F.array_repeat(F.col("id").cast("double"), 64).alias("embedding"))

    def tasks_and_rows():
        lists = blocks.packed_vectors(rows, vectors, ["impression_id"], ["item_id", "vec"], "cands")
        rdd = lists.rdd
        return rdd.getNumPartitions(), sorted((r["impression_id"], sorted((c["item_id"], c["vec"][0], len(c["vec"])) for c in r["cands"])) for r in rdd.collect())

    few, want = tasks_and_rows()
    monkeypatch.setattr(blocks, "PACKED_BYTES", 3000 * 68 * 8 // 20, raising=False)
    many, got = tasks_and_rows()
    assert few <= 4 and many >= 20 and got == want
    assert len(got) == 300 and got[5] == (5, sorted((i % 7, float(i % 7), 64) for i in range(5, 3000, 300) if i % 7 < 6))


def test_profiles_are_cut_to_the_lists_before_they_are_written(spark, monkeypatch):
    from lapwing.plans import recommend as M

    class Written(Exception):
        pass

    def stage(df, name):
        if name == "profiles":
            raise Written(sorted(r["impression_id"] for r in df.collect()))
        return df

    monkeypatch.setattr(M, "stage", stage)
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "item_id bigint, embedding array<double>")
    history = spark.createDataFrame([(i, i, 0, p, p + 1) for i in (7, 8, 9) for p in (0, 1)], "impression_id bigint, user_id bigint, bucket bigint, pos bigint, item_id bigint")
    lists = spark.createDataFrame([(7,), (9,), (9,), (10,), (None,)], "impression_id bigint")
    with pytest.raises(Written) as found:
        M.recommend(lists, history, M.Model(vectors, vectors, None, None, None), 5)
    assert found.value.args[0] == [7, 9]


def lists_and_catalogue(spark):
    """Vectors (one item twice), candidates, history and queries with odd rows: unknown items, no history, no query, null ids."""
    rng = np.random.default_rng(5)
    unit = lambda: [float(np.float32(x)) for x in rng.normal(size=4)]
    vectors = spark.createDataFrame([*[(i, unit()) for i in [*range(30), 7]], (None, unit())], "item_id bigint, embedding array<double>")
    cands = [(u, i) for u in [*range(6), None] for i in [*range(u or 0, 36, 2), None]] + [(1, 3), (1, 3)]
    seen = [(u, p, int(rng.integers(0, 36))) for u in (0, 1, 2, 5) for p in range(9)] + [(3, 0, 99), (None, 0, 2), (1, 9, None)]
    queries = [(u, unit()) for u in (0, 1, 3, 4, 5)]
    return (
        vectors,
        spark.createDataFrame(cands, "impression_id bigint, item_id bigint"),
        spark.createDataFrame(seen, "impression_id bigint, pos bigint, item_id bigint"),
        spark.createDataFrame(queries, "impression_id bigint, query array<double>"),
    )


def test_content_scores_send_no_vector_for_an_entry(spark, monkeypatch):
    """Lists come to the catalogue as ids, in batches of any size; a catalogue too large for a task gives the same scores."""
    from lapwing.operators import score as S

    vectors, cands, seen, queries = lists_and_catalogue(spark)
    found = lambda bounded: S.content_scores(cands, queries, seen, vectors, bounded)
    rows = lambda df: sorted((*r[:2], round(r[2], 9)) for r in df.collect())
    flat = found(True)
    plan = flat._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Join" not in plan
    want = rows(flat)
    assert {r[0] for r in want} == {0, 1, 3, 4, 5} and len(want) > 60
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert rows(found(True)) == rows(found(False)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(blocks, "LEAST_ROWS", 10)
    assert rows(found(True)) == want
    monkeypatch.setattr(blocks.catalogue, "__defaults__", (0,))
    assert "collect_list" in found(True)._jdf.queryExecution().optimizedPlan().toString()
    assert rows(found(True)) == rows(found(False)) == want


def test_greedy_methods_send_no_vector_for_a_candidate(spark, monkeypatch):
    from lapwing.operators import rerank as H

    vectors, cands, seen, _ = lists_and_catalogue(spark)
    items = spark.range(33).select(
        F.col("id").alias("item_id"),
        F.when(F.col("id") % 5 > 0, F.concat(F.lit("c"), F.col("id") % 5)).alias("category"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), F.col("id") % 3)).alias("subcategory"),
    )
    popularity = spark.range(20).select(F.col("id").alias("item_id"), (F.col("id") / 40).alias("popularity"))
    ctx = H.Context(items, vectors, popularity, seen)
    pool = cands.where("impression_id is not null and item_id is not null").distinct().withColumn("score", F.round(F.rand(3), 3))
    pool = spark.createDataFrame(pool.collect(), "impression_id bigint, item_id bigint, score double")

    def picks(method, k):
        df = H.METHODS[method](pool, ctx, k)
        return df._jdf.queryExecution().optimizedPlan().toString(), sorted(tuple(r) for r in df.collect())

    ways = [("mmr", 5), ("serendipity", 5), ("composite", None)]
    want = {}
    for way in ways:
        plan, want[way] = picks(*way)
        assert "collect_list" not in plan and {r[0] for r in want[way]} == set(range(6))
    monkeypatch.setattr(blocks.catalogue, "__defaults__", (0,))
    for way in ways:
        plan, rows = picks(*way)
        assert "collect_list" in plan and rows == want[way]


def test_buckets_are_not_joined_row_by_row(spark, monkeypatch):
    """The rows of Spark's LSH join, without its pairs: repeated rows, an item with two vectors, null ids, small shares."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    from lapwing.functions.ranking import by_score, top_k
    from lapwing.operators import retrieve as R

    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(300, 6))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [rows[3], rows[4], (5, rows[6][1]), (None, rows[7][1])]
    items = spark.createDataFrame(rows, "item_id bigint, embedding array<double>")
    queries = items.select(F.col("item_id").alias("query_id"), F.col("embedding").alias("vec"))
    same = spark.createDataFrame([(i, i) for i in range(300)], "query_id bigint, item_id bigint")
    left, right = (df.withColumn("v", array_to_vector(c)) for df, c in ((queries, "vec"), (items, "embedding")))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=0.5, numHashTables=3, seed=7).fit(right)
    pairs = model.approxSimilarityJoin(left.select("query_id", "v"), right.select("item_id", "v"), 0.7, "dist")
    scores = pairs.select("datasetA.query_id", "datasetB.item_id", (1 - F.col("dist") * F.col("dist") / 2).alias("score"))
    scores = scores.join(same, ["query_id", "item_id"], "left_anti").where("query_id is not null")
    plain = lambda df: sorted((r["query_id"], r["rank"], -1 if r["item_id"] is None else r["item_id"], round(r["score"], 8)) for r in df.collect())
    want = plain(top_k(scores, ["query_id"], by_score(), 4))
    found = lambda: R.in_buckets(model.transform(left).drop("v"), model.transform(right).drop("v"), 4, 0.7, same)
    assert plain(found()) == want and len(want) > 800
    monkeypatch.setattr(blocks, "CELL_ITEMS", 1)
    monkeypatch.setattr(blocks, "LEAST_QUERIES", 100)
    assert plain(found()) == want
