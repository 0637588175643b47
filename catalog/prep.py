"""Parsing, filters, encodings and scalar shaping over the whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.views import Catalog, sql
from lapwing.functions import vectors as V
from lapwing.operators import shape
from lapwing.plans import tables as T
from lapwing.session import stage, stage_dir
from lapwing.sources import behaviours as B, sinks, vectors as VS

CATALOG = Catalog()
q = CATALOG.add


@q("parse_impressions", sql("impr", "SELECT impression_id, CAST(item_id AS VARCHAR) AS item_id, label FROM impr"))
def parse_impressions(spark, d):
    """Serialise every impression as `item-label` text, then parse it back."""
    text = F.array_join(
        F.transform("impressions", lambda x: F.concat_ws("-", x["item_id"].cast("string"), x["label"].cast("string"))), " "
    )
    rows = T.behaviours(spark, d).select("impression_id", text.alias("impressions"))
    parsed = rows.select("impression_id", B.parse_impressions(F.col("impressions")).alias("impressions"))
    return B.explode_impressions(parsed, "impression_id").withColumn("label", F.col("label").cast("bigint"))


@q(
    "parse_history",
    """WITH t AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_items, w[1] AS first_item, w[-1] AS last_item FROM t WHERE len(w) > 0""",
)
def parse_history(spark, d):
    w = B.parse_history(F.col("text"))
    rows = T.table(spark, d, "documents").select("doc_id", w.alias("w")).where(F.size("w") > 0)
    return rows.select(
        "doc_id",
        F.size("w").cast("bigint").alias("n_items"),
        F.element_at("w", 1).alias("first_item"),
        F.element_at("w", -1).alias("last_item"),
    )


def _entity_json(spark, d):
    k = F.col("item_id").cast("string")
    one = F.concat(F.lit('[{"WikidataId": "Q'), k, F.lit('"}]'))
    two = F.concat(F.lit('[{"WikidataId": "Q'), k, F.lit('"}, {"Label": "x", "WikidataId": "E'), k, F.lit('"}]'))
    raw = (
        F.when(F.col("event_type") == "click", one)
        .when(F.col("event_type") == "view", two)
        .when(F.col("event_type") == "error", F.concat(F.lit('{"k": '), k, F.lit("}")))
        .when(F.col("event_type") == "signup", F.lit("[not json"))
    )
    return T.events(spark, d).select("event_id", raw.alias("title_entities"), one.alias("abstract_entities"))


@q(
    "parse_entities",
    sql(
        "ev",
        """SELECT event_id, CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 0 END AS BIGINT) AS n_entities,
        CASE WHEN event_type IN ('click','view') THEN 'Q' || item_id END AS first_entity FROM ev""",
    ),
)
def parse_entities(spark, d):
    ids = B.entity_ids(F.col("title_entities"))
    return _entity_json(spark, d).select(
        "event_id", F.size(ids).cast("bigint").alias("n_entities"), F.get(ids, F.lit(0)).alias("first_entity")
    )


@q(
    "merge_entities",
    sql(
        "ev",
        """SELECT event_id, 'Q' || item_id AS entity FROM ev
        UNION ALL SELECT event_id, 'E' || item_id FROM ev WHERE event_type = 'view'""",
    ),
)
def merge_entities(spark, d):
    rows = _entity_json(spark, d)
    return rows.select("event_id", F.explode(B.merged_entities(F.col("title_entities"), F.col("abstract_entities"))).alias("entity"))


@q(
    "parse_vec",
    "SELECT CAST(vec_id AS VARCHAR) AS id, CAST(i - 1 AS BIGINT) AS pos, CAST(CAST(embedding[i] AS VARCHAR) AS DOUBLE) AS value "
    "FROM embeddings, range(1, 65) t(i)",
)
def parse_vec(spark, d):
    """Vector text lines (`id f1 f2 ...`) parsed back to arrays."""
    values = F.array_join(F.transform("embedding", lambda x: x.cast("string")), " ")
    lines = T.table(spark, d, "embeddings").select(F.concat_ws(" ", F.col("vec_id").cast("string"), values).alias("line"))
    key, vec = VS.parse_vec_line(F.col("line"))
    rows = lines.select(key.alias("id"), vec.alias("vec")).select("id", F.posexplode("vec").alias("pos", "value"))
    return rows.select("id", F.col("pos").cast("bigint").alias("pos"), "value")


@q("training_interactions", sql("impr", "SELECT impression_id, item_id, label FROM impr WHERE bucket < (SELECT max(bucket) FROM log)"))
def training_interactions(spark, d):
    rows = T.behaviours(spark, d).where(F.col("bucket") < T.last_bucket(spark, d))
    return B.explode_impressions(rows, "impression_id")


@q(
    "test_impressions",
    sql(
        "impr hist",
        """SELECT i.impression_id, h.n_history, i.n_impressions FROM
        (SELECT impression_id, count(*) AS n_impressions FROM impr WHERE bucket = (SELECT max(bucket) FROM log) GROUP BY 1) i
        JOIN (SELECT impression_id, count(*) AS n_history FROM hist GROUP BY 1) h USING (impression_id)""",
    ),
)
def test_impressions(spark, d):
    last = T.behaviours(spark, d).where(F.col("bucket") == T.last_bucket(spark, d))
    rows = B.test_set(last, n_history=F.col("n_history"))
    return rows.select("impression_id", "n_history", F.size("impressions").cast("bigint").alias("n_impressions"))


def written(df, name):
    """Write lines of text to the shared folder."""
    path = f"{stage_dir(df.sparkSession)}/lapwing/{name}-{uuid.uuid4().hex}"
    df.write.text(path)
    return path


@q(
    "read_behaviors",
    sql(
        "impr hist heads",
        """SELECT h.impression_id, 'U' || h.user_id AS user_id, strftime(h."time", '%Y-%m-%d %H:%M:%S') AS "time", coalesce(p.n, 0) AS n_history, first_item, last_item, i.n_shown, i.n_clicks
        FROM (SELECT * FROM heads WHERE bucket = (SELECT max(bucket) FROM log)) h LEFT JOIN (SELECT impression_id, count(*) AS n, 'N' || arg_min(item_id, pos) AS first_item, 'N' || arg_max(item_id, pos) AS last_item FROM hist GROUP BY 1) p USING (impression_id)
        JOIN (SELECT impression_id, count(*) AS n_shown, sum(label)::BIGINT AS n_clicks FROM impr GROUP BY 1) i USING (impression_id)""",
    ),
)
def read_behaviors(spark, d):
    """The last bucket's impressions written as a header-less TSV and read back."""
    n = lambda c: F.concat(F.lit("N"), c.cast("string"))
    past = T.history(spark, d, T.last_bucket(spark, d)).groupBy("impression_id").agg(F.sort_array(F.collect_list(F.struct("pos", "item_id"))).alias("h"))
    shown = F.array_join(F.transform("impressions", lambda x: F.concat(n(x["item_id"]), F.lit("-"), x["label"].cast("string"))), " ")
    rows = T.behaviours(spark, d).where(F.col("bucket") == T.last_bucket(spark, d)).join(T.heads(spark, d).select("impression_id", "time"), "impression_id").join(past, "impression_id", "left")
    read_ = F.array_join(F.transform("h", lambda x: n(x["item_id"])), " ")
    line = F.concat_ws("\t", F.col("impression_id").cast("string"), F.concat(F.lit("U"), F.col("user_id").cast("string")), F.date_format("time", "M/d/yyyy h:mm:ss a"), F.coalesce(read_, F.lit("")), shown)
    back = B.read_behaviors(spark, written(rows.select(line.alias("value")), "behaviors"))
    size = lambda c: F.size(c).cast("bigint")
    clicks = F.filter("impressions", lambda x: x["label"] == 1)
    return back.select(
        "impression_id", "user_id", F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("time"), size("history").alias("n_history"),
        F.try_element_at("history", F.lit(1)).alias("first_item"), F.try_element_at("history", F.lit(-1)).alias("last_item"), size("impressions").alias("n_shown"), size(clicks).alias("n_clicks"),
    )


@q(
    "read_features_fallback",
    r"""SELECT 'N' || doc_id AS news_id, lang AS category, CASE WHEN cut THEN NULL ELSE coalesce(source, '') END AS subcategory, CASE WHEN cut THEN '' ELSE t END AS title, CASE WHEN cut THEN ' ' ELSE t || ' ' END AS combined_text,
    CAST(CASE WHEN cut THEN 0 ELSE 2 END AS BIGINT) AS n_entities, CASE WHEN NOT cut THEN 'Q' || doc_id END AS first_entity
    FROM (SELECT doc_id, coalesce(lang, '') AS lang, source, doc_id % 11 = 5 AS cut, coalesce(regexp_replace(substr(text, 1, 40), '[^A-Za-z0-9]', '_', 'g'), '') AS t FROM documents)""",
)
def read_features_fallback(spark, d):
    """No processed table: the raw item TSV is read, where one line in eleven is cut after the second field."""
    docs = T.table(spark, d, "documents")
    text = lambda c: F.coalesce(c, F.lit(""))
    title = text(F.regexp_replace(F.substring("text", 1, 40), "[^A-Za-z0-9]", "_"))
    key = F.col("doc_id").cast("string")
    entity = F.concat(F.lit('[{"WikidataId": "Q'), key, F.lit('"}, {"WikidataId": "R'), key, F.lit('"}]'))
    start = F.concat_ws("\t", F.concat(F.lit("N"), key), text(F.col("lang")))
    whole = F.concat_ws("\t", start, text(F.col("source")), title, F.lit(""), F.lit("url"), entity, F.lit("[]"))
    raw = written(docs.select(F.when(F.col("doc_id") % 11 == 5, start).otherwise(whole).alias("value")), "news")
    rows = B.read_features_or_raw(spark, raw + "-processed", raw)
    return rows.select(
        "news_id", text(F.col("category")).alias("category"), F.when(F.size("all_entities") > 0, text(F.col("subcategory"))).alias("subcategory"), "title", text(F.col("combined_text")).alias("combined_text"),
        F.size("all_entities").cast("bigint").alias("n_entities"), F.try_element_at("all_entities", F.lit(1)).alias("first_entity"),
    )


@q("item_metadata", sql("items", "SELECT item_id, category, subcategory FROM items"))
def item_metadata(spark, d):
    return T.item_meta(spark, d)


@q(
    "upsert_results",
    """WITH o AS (SELECT event_type AS method, round(avg(value), 6) AS score FROM events GROUP BY 1),
    n AS (SELECT event_type AS method, round(max(value), 6) AS score FROM events WHERE event_type = 'click' GROUP BY 1)
    SELECT method, score, CAST(0 AS BIGINT) AS ord FROM n
    UNION ALL SELECT method, score, 1 FROM o WHERE method NOT IN (SELECT method FROM n)""",
)
def upsert_results(spark, d):
    ev = T.events(spark, d).select(F.col("event_type").alias("method"), "value")
    old = ev.groupBy("method").agg(F.round(F.avg("value"), 6).alias("score"))
    new = ev.where(F.col("method") == "click").groupBy("method").agg(F.round(F.max("value"), 6).alias("score"))
    return sinks.upsert(old, new)


@q(
    "upsert_in_place",
    """WITH c AS (SELECT max(ts) - INTERVAL 1 HOUR AS cut FROM events),
    o AS (SELECT user_id, count(*) AS n_events, max(event_id) AS last_event FROM events, c WHERE ts < cut GROUP BY 1),
    n AS (SELECT user_id, count(*) AS n_events, max(event_id) AS last_event FROM events, c GROUP BY 1 HAVING max(ts) >= max(cut)),
    t AS (SELECT * FROM n UNION ALL SELECT * FROM o WHERE user_id NOT IN (SELECT user_id FROM n)),
    b AS (SELECT *, ('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8))::BIGINT % 256 AS bucket FROM t)
    SELECT user_id, n_events, last_event, bucket IN (SELECT bucket FROM b JOIN n USING (user_id)) AS rewritten FROM b""",
)
def upsert_in_place(spark, d):
    """Event counts of all users, kept in a keyed table; users of the last hour are replaced. `rewritten` tells whether the
    row's file is younger than the upsert."""
    ev = T.events(spark, d).select("user_id", "event_id", "ts")
    cut = ev.agg(F.max("ts") - F.expr("INTERVAL 1 HOUR")).first()[0]
    counts = lambda rows: rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"), F.max("event_id").alias("last_event"), F.max("ts").alias("ts"))
    path = f"{stage_dir(spark)}/keyed-{uuid.uuid4().hex}"
    sinks.write_keyed(counts(ev.where(F.col("ts") < cut)).drop("ts"), path, "user_id")
    file = F.col("_metadata.file_path").alias("file")
    before = stage(spark.read.parquet(path).select(file).distinct().withColumn("old", F.lit(True)), "files")
    sinks.upsert_keyed(counts(ev).where(F.col("ts") >= cut).drop("ts"), path, "user_id")
    rows = spark.read.parquet(path).select("user_id", "n_events", "last_event", file).join(before, "file", "left")
    return rows.select("user_id", "n_events", "last_event", F.col("old").isNull().alias("rewritten"))


_KEPT = """SELECT count(*) AS n_before, count(*) FILTER (WHERE {0}) AS n_kept, count(*) FILTER (WHERE NOT {0}) AS n_removed,
    round(count(*) FILTER (WHERE NOT {0}) * 100.0 / count(*), 6)::DOUBLE AS removed_pct FROM b"""
_BEHAV = """b AS (SELECT i.impression_id, i.clicked, coalesce(h.n, 0) AS n_history FROM
    (SELECT impression_id, max(label) AS clicked FROM impr GROUP BY 1) i
    LEFT JOIN (SELECT impression_id, count(*) AS n FROM hist GROUP BY 1) h USING (impression_id))"""


@q("filter_short_history", sql("impr hist", _KEPT.format("n_history >= 1"), _BEHAV))
def filter_short_history(spark, d):
    return shape.removal_report(T.behaviours(spark, d), F.col("n_history") >= 1)


@q("filter_no_click", sql("impr hist", _KEPT.format("clicked = 1"), _BEHAV))
def filter_no_click(spark, d):
    return shape.removal_report(T.behaviours(spark, d), F.exists("impressions", lambda x: x["label"] == 1))


@q(
    "kept_impressions",
    sql("impr hist", "SELECT impression_id FROM b WHERE n_history >= 1 AND clicked = 1", _BEHAV),
)
def kept_impressions(spark, d):
    rows = shape.filter_short_history(T.behaviours(spark, d), 1, F.col("n_history"))
    return shape.filter_no_click(rows).select("impression_id")


@q(
    "combined_text",
    """SELECT doc_id, md5(concat(lang, ' ', coalesce(text, ''))) AS combined,
    md5(concat(lang, '. ', lang, '. ', coalesce(text, ''))) AS emphasised,
    CAST(length(concat(lang, ' ', coalesce(text, ''))) AS BIGINT) AS n_chars FROM documents""",
)
def combined_text(spark, d):
    """Combined and title-emphasised text of every document, hashed whole."""
    both = B.combined_text(F.col("lang"), F.col("text"))
    return T.table(spark, d, "documents").select(
        "doc_id",
        F.md5(both).alias("combined"),
        F.md5(B.emphasised_text(F.col("lang"), F.col("text"))).alias("emphasised"),
        F.length(both).cast("bigint").alias("n_chars"),
    )


@q(
    "fill_missing",
    """SELECT p.p_partkey, coalesce(d.source, '') AS source, coalesce(d.lang, 'unknown') AS lang, coalesce(l.quality, 0)::BIGINT AS quality
    FROM part p LEFT JOIN documents d ON p.p_partkey = d.doc_id LEFT JOIN labels l ON l.doc_id = p.p_partkey""",
)
def fill_missing(spark, d):
    """Outer-joined metadata with text and number defaults for the gaps."""
    part = T.table(spark, d, "part").select("p_partkey")
    docs = T.table(spark, d, "documents").select(F.col("doc_id").alias("p_partkey"), "source", "lang")
    labels = T.table(spark, d, "labels").select(F.col("doc_id").alias("p_partkey"), F.col("quality").cast("bigint").alias("quality"))
    return part.join(docs, "p_partkey", "left").join(labels, "p_partkey", "left").fillna({"source": "", "lang": "unknown", "quality": 0})


@q(
    "parse_time",
    """SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F','O') THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS parsed FROM orders""",
)
def parse_time(spark, d):
    """Mixed timestamp formats, unreadable text gives null."""
    ts = F.col("o_orderdate").cast("timestamp")
    raw = (
        F.when(F.col("o_orderstatus") == "F", F.date_format(ts, "M/d/yyyy h:mm:ss a"))
        .when(F.col("o_orderstatus") == "O", F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.lit("n/a"))
    )
    rows = T.table(spark, d, "orders").select("o_orderkey", B.parse_time(raw).alias("t"))
    return rows.select("o_orderkey", F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@q(
    "encode_first_seen",
    """SELECT source AS value, row_number() OVER (ORDER BY min(doc_id)) - 1 AS code FROM documents GROUP BY source""",
)
def encode_first_seen(spark, d):
    codes = shape.first_seen_codes(T.table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id")
    return codes.withColumnRenamed("source", "value")


@q("encode_sorted", "SELECT source AS value, row_number() OVER (ORDER BY source) - 1 AS code FROM (SELECT DISTINCT source FROM documents)")
def encode_sorted(spark, d):
    return shape.sorted_codes(T.table(spark, d, "documents"), "source").withColumnRenamed("source", "value")


@q("user_codes", "SELECT user_id, row_number() OVER (ORDER BY min(event_id)) - 1 AS user_idx FROM events GROUP BY user_id")
def user_codes(spark, d):
    """Dense user index by first event."""
    return shape.first_seen_codes(T.events(spark, d).select("user_id", "event_id"), "user_id", "event_id", "user_idx")


@q("item_codes", "SELECT l_partkey, row_number() OVER (ORDER BY l_partkey) - 1 AS item_idx FROM (SELECT DISTINCT l_partkey FROM lineitem)")
def item_codes(spark, d):
    """Dense item index in id order over the whole fact table."""
    return shape.sorted_codes(T.table(spark, d, "lineitem").select("l_partkey"), "l_partkey", "item_idx")


@q(
    "text_lengths",
    """SELECT doc_id, CAST(2 AS BIGINT) AS entity_count, CAST(1 AS BIGINT) AS title_length,
    CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS abstract_length FROM documents""",
)
def text_lengths(spark, d):
    rows = T.table(spark, d, "documents")
    out = shape.text_lengths(rows, "source", "text", F.array("lang", "source"))
    return out.select("doc_id", "entity_count", "title_length", "abstract_length")


@q(
    "history_indices",
    sql(
        "hist",
        """SELECT h.impression_id, h.pos, c.item_idx FROM hist h JOIN c ON c.item_id = h.item_id""",
        "c AS (SELECT doc_id AS item_id, row_number() OVER (ORDER BY doc_id) - 1 AS item_idx FROM labels)",
    ),
)
def history_indices(spark, d):
    """Known items are those with a label; the others fall out of the history."""
    known = T.table(spark, d, "labels").select(F.col("doc_id").alias("item_id"))
    return shape.history_indices(T.history(spark, d), shape.sorted_codes(known, "item_id"))


@q(
    "known_interactions",
    sql("impr", "SELECT impression_id, user_id, item_id, label FROM impr WHERE item_id IN (SELECT doc_id FROM labels)"),
)
def known_interactions(spark, d):
    known = T.table(spark, d, "labels").select(F.col("doc_id").alias("item_id"))
    return shape.known_interactions(T.impressions(spark, d), known).select("impression_id", "user_id", "item_id", "label")


@q(
    "min_max_scores",
    sql(
        "ev",
        """SELECT user_id, item_id, round(CASE WHEN max(v) OVER w > min(v) OVER w
            THEN (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) ELSE v END, 6) AS score
        FROM s WINDOW w AS (PARTITION BY user_id)""",
        "s AS (SELECT user_id, item_id, max(value) AS v FROM ev GROUP BY 1, 2)",
    ),
)
def min_max_scores(spark, d):
    s = T.events(spark, d).groupBy("user_id", "item_id").agg(F.max("value").alias("v"))
    return shape.min_max(s, ["user_id"], "v", "score").select("user_id", "item_id", F.round("score", 6).alias("score"))


@q("first_items", sql("doc_items", "SELECT item_id, category FROM doc_items ORDER BY item_id LIMIT 100"))
def first_items(spark, d):
    """The sampling knob: first 100 items in id order."""
    return shape.first_rows(T.doc_items(spark, d).select("item_id", "category"), "item_id", 100)


@q(
    "vectors_for_ids",
    """SELECT d.doc_id AS item_id, CASE WHEN e.vec_id IS NULL THEN 0 ELSE 1 END::BIGINT AS known,
    round(coalesce(list_sum(list_transform(list_zip(e.embedding::DOUBLE[], range(1, 65)), lambda p: p[1] * p[2])), 0.0), 6) AS ramp
    FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""",
)
def vectors_for_ids(spark, d):
    """Stored vectors realigned to the document ids; unknown ids get zeros."""
    ids = T.table(spark, d, "documents").select(F.col("doc_id").alias("item_id"))
    rows = shape.vectors_for(ids, T.item_vectors(spark, d), "item_id", T.DIM)
    return rows.select("item_id", "known", F.round(V.ramp(F.col("embedding")), 6).alias("ramp"))


@q(
    "dedup_latest",
    """SELECT user_id, item_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id
    ORDER BY ts DESC, event_id DESC) AS rn FROM (SELECT *, CAST(json_extract_string(props,'$.k') AS BIGINT) AS item_id FROM events)) WHERE rn = 1""",
)
def dedup_latest(spark, d):
    """Latest event per user and item."""
    ev = T.events(spark, d).withColumn("key", F.struct("user_id", "item_id"))
    rows = shape.latest_rows(ev, "key", [F.col("ts").desc(), F.col("event_id").desc()])
    return rows.select("user_id", "item_id", "event_id", "event_type")
