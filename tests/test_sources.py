"""Readers, writers and round trips."""

import pytest
from pyspark.sql import functions as F

from lapwing.operators import features as X, shape
from lapwing.sources import behaviours as B, sinks, vectors as VS


def test_read_behaviors_and_news(spark, tmp_path):
    (tmp_path / "behaviors.tsv").write_text("1\tU1\t11/15/2019 10:22:32 AM\tN1 N2\tN3-1 N4-0\n2\tU2\tnever\t\tN1-0\n")
    rows = B.read_behaviors(spark, str(tmp_path / "behaviors.tsv")).orderBy("impression_id").collect()
    assert rows[0]["history"] == ["N1", "N2"] and rows[1]["history"] == [] and rows[1]["time"] is None
    assert B.explode_impressions(B.read_behaviors(spark, str(tmp_path / "behaviors.tsv")), "impression_id").count() == 3
    assert B.test_set(B.read_behaviors(spark, str(tmp_path / "behaviors.tsv")), 5).count() == 1
    entity = '[{"WikidataId": "Q1"}, {"WikidataId": "Q2"}]'
    (tmp_path / "news.tsv").write_text(f'N1\tsports\tgolf\tTitle\tText "quoted\tu\t{entity}\t[{{"WikidataId": "Q2"}}]\nN2\tnews\tx\t\t\tu\toops\t\n')
    news = B.read_news(spark, str(tmp_path / "news.tsv")).orderBy("news_id").collect()
    assert news[0]["all_entities"] == ["Q1", "Q2"] and news[0]["combined_text"] == 'Title Text "quoted'
    assert news[1]["all_entities"] == [] and news[1]["combined_text"] == " "
    assert B.metadata(B.read_news(spark, str(tmp_path / "news.tsv"))).columns == ["news_id", "category", "subcategory"]


def test_legacy_features_and_required_columns(spark, tmp_path):
    (tmp_path / "f.csv").write_text("news_id,all_entities\nN1,\"['Q1', 'Q2']\"\nN2,[]\n")
    rows = B.read_features(spark, str(tmp_path / "f.csv"), "csv", ("news_id",)).orderBy("news_id").collect()
    assert [r["all_entities"] for r in rows] == [["Q1", "Q2"], []]
    with pytest.raises(ValueError):
        B.read_features(spark, str(tmp_path / "f.csv"), "csv", ("title",))


def test_read_vec(spark, tmp_path):
    (tmp_path / "e.vec").write_text("Q1 0.5 -1.5\nQ2\n\nQ3\t1 2\n")
    rows = {r["id"]: r["vec"] for r in VS.read_vec(spark, str(tmp_path / "e.vec")).collect()}
    assert rows == {"Q1": [0.5, -1.5], "Q3": [1.0, 2.0]}
    assert VS.read_vec(spark, str(tmp_path / "missing.vec")).count() == 0


def test_embedding_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 1.0])], "item_id long, embedding array<double>")
    VS.save_embeddings(df, str(tmp_path / "emb"))
    assert VS.same_rows(df, VS.load_embeddings(spark, str(tmp_path / "emb")))


def test_model_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5)], "item_id long, popularity double")
    sinks.save_model({"popularity": df}, str(tmp_path / "m"))
    assert sinks.load_model(spark, str(tmp_path / "m"), ("popularity",))["popularity"].collect() == df.collect()
    with pytest.raises(ValueError):
        sinks.save_model({"x": df}, str(tmp_path / "m"))
    sinks.write_report(df, df, str(tmp_path / "r"))
    sinks.write_sample(df.withColumn("impression_id", F.lit(1)), str(tmp_path / "s"), 1)
    sinks.write_table(df, str(tmp_path / "t"), "json")
    assert spark.read.json(str(tmp_path / "r/rows")).count() == spark.read.json(str(tmp_path / "s")).count() == 1


def test_upsert_and_metadata(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "method string, v int")
    new = spark.createDataFrame([("b", 3)], "method string, v int")
    assert [tuple(r) for r in sinks.upsert(old, new).orderBy("ord").collect()] == [("b", 3, 0), ("a", 1, 1)]
    assert shape.fix_metadata(old, dedup=True, min_history=1).first()["fixes"]["min_history"] == 1


def test_category_table_forms_and_weight_warning(spark):
    items = spark.createDataFrame([(i, f"c{i}", f"s{i}") for i in range(20)], "item_id long, category string, subcategory string")
    rows = X.category_tower(items).collect()
    assert all(len(r["vec"]) == 48 for r in rows)
    assert all(sum(x * x for x in r["vec"][32:]) == pytest.approx(1.0) for r in rows)
    assert X.weights_warning({"text": 0.5}) and not X.weights_warning(X.TOWER_WEIGHTS)


def test_text_tower_hook(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "item_id long, text string")
    assert X.text_tower(docs, lambda df: df.select("item_id", F.array(F.lit(1.0)).alias("vec"))).count() == 2
    assert all(len(r["vec"]) == 16 for r in X.text_tower(docs, n_features=16).collect())


def test_revive_list_keeps_the_other_quote(spark):
    rows = spark.createDataFrame([("""["O'Brien", 'b', 'say "x"']""",), ("[]",), (None,), ("['']",)], "t string")
    got = [r[0] for r in rows.select(B.revive_list(F.col("t"))).collect()]
    assert got == [["O'Brien", "b", 'say "x"'], [], [], [""]]


def test_read_vec_only_forgives_a_missing_file(spark, tmp_path):
    assert VS.read_vec(spark, str(tmp_path / "none.vec")).count() == 0


def test_upsert_touches_only_its_folders(spark, tmp_path):
    path = str(tmp_path / "keyed")
    key = lambda i: None if i == 0 else f"user {i}"
    old = spark.createDataFrame([(key(i), i, "old") for i in range(200)], "name string, n int, state string")
    sinks.write_keyed(old, path, "name", 16)
    files = lambda: {str(f): f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")}
    before = files()
    new = spark.createDataFrame([(None, -1, "new"), ("user 7", -2, "new"), ("user 7", -3, "new"), ("user 900", 9, "new")], old.schema)
    touched = {r[0] for r in new.select(sinks.bucket_of("name", 16)).collect()}
    sinks.upsert_keyed(new, path, "name", 16)
    after = files()
    bucket = lambda f: int(f.split(f"{sinks.BUCKET}=")[1].split("/")[0])
    assert {bucket(f) for f in before if f not in after} <= touched < {bucket(f) for f in before}
    assert all(after[f] == at for f, at in before.items() if bucket(f) not in touched)
    want = [(key(i), i, "old") for i in range(200) if i not in (0, 7)] + [tuple(r) for r in new.collect()]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in sinks.read_keyed(spark, path).collect())
    sinks.upsert_keyed(new.limit(0), path, "name", 16)
    assert files() == after
