"""Readers and parsers for impression logs and item metadata."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BEHAVIOUR_SCHEMA = "impression_id BIGINT, user_id STRING, time STRING, history STRING, impressions STRING"
NEWS_SCHEMA = (
    "news_id STRING, category STRING, subcategory STRING, title STRING, abstract STRING, url STRING, "
    "title_entities STRING, abstract_entities STRING"
)
# fixed values: accepted timestamp formats, tried in order
TIME_FORMATS = ("M/d/yyyy h:mm:ss a", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")
ENTITY_TYPE = "array<struct<WikidataId:string>>"


def words(text: Column) -> Column:
    """Whitespace-separated tokens of a text; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")


def parse_history(text: Column) -> Column:
    return words(text)


def parse_impressions(text: Column) -> Column:
    """`N1-0 N2-1` to [(item_id, label)]; the label follows the last dash."""
    return F.transform(
        words(text),
        lambda t: F.struct(
            F.regexp_extract(t, r"^(.*)-(\d+)$", 1).alias("item_id"),
            F.regexp_extract(t, r"^(.*)-(\d+)$", 2).try_cast("int").alias("label"),
        ),
    )


def parse_time(text: Column) -> Column:
    """Timestamp in any of the accepted formats; anything else is null."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS])


def entity_ids(json: Column) -> Column:
    """Ids of a JSON list of entity objects; malformed or non-list text gives an empty array."""
    clean = F.when(F.trim(json).startswith("["), json)
    parsed = F.coalesce(F.from_json(clean, ENTITY_TYPE), F.array().cast(ENTITY_TYPE))
    return F.array_compact(F.transform(parsed, lambda e: e["WikidataId"]))


def merged_entities(title_json: Column, abstract_json: Column) -> Column:
    return F.array_union(entity_ids(title_json), entity_ids(abstract_json))


def combined_text(title: Column, abstract: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit("")))


def emphasised_text(title: Column, abstract: Column) -> Column:
    """Title twice, then the abstract: `{t}. {t}. {a}`."""
    t, a = F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit(""))
    return F.concat(t, F.lit(". "), t, F.lit(". "), a)


def _tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").option("header", "false").csv(path)


def read_behaviors(spark: SparkSession, path: str) -> DataFrame:
    """Header-less TSV of impressions to typed columns with native arrays."""
    raw = _tsv(spark, path, BEHAVIOUR_SCHEMA)
    return raw.select(
        "impression_id",
        "user_id",
        parse_time(F.col("time")).alias("time"),
        parse_history(F.col("history")).alias("history"),
        parse_impressions(F.col("impressions")).alias("impressions"),
    )


def read_news(spark: SparkSession, path: str) -> DataFrame:
    """Header-less TSV of item metadata plus combined_text and all_entities."""
    raw = _tsv(spark, path, NEWS_SCHEMA).fillna("", ["abstract"]).fillna("[]", ["title_entities", "abstract_entities"])
    return raw.select(
        *[f.name for f in raw.schema.fields],
        combined_text(F.col("title"), F.col("abstract")).alias("combined_text"),
        merged_entities(F.col("title_entities"), F.col("abstract_entities")).alias("all_entities"),
    )


def read_features(spark: SparkSession, path: str, fmt: str = "parquet", required: tuple[str, ...] = ()) -> DataFrame:
    """Processed features: Parquet with native arrays, or legacy CSV with stringified lists (`['a', 'b']`)."""
    if fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        df = spark.read.option("header", "true").option("quote", '"').option("escape", '"').option("multiLine", "true").csv(path)
        if "all_entities" in df.columns:
            df = df.withColumn("all_entities", revive_list(F.col("all_entities")))
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


#: Columns that a feature table has at least; the first three default to empty.
FEATURE_COLUMNS = ("title", "abstract", "all_entities", "news_id", "category", "subcategory")


def read_features_or_raw(spark: SparkSession, path: str, raw: str) -> DataFrame:
    """Processed features (legacy CSV) or, where there is no such file, the raw item TSV.

    Damaged lines are kept: fields that a line lacks are null, or empty for title, abstract and the entity list. A processed
    file without an entity column gets empty lists; any other missing column is an error.
    """
    try:
        df = read_features(spark, path, "csv")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        df = read_news(spark, raw)
    none = F.array().cast("array<string>")
    if "all_entities" not in df.columns:
        df = df.withColumn("all_entities", none)
    missing = [c for c in FEATURE_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df.fillna("", ["title", "abstract"]).withColumn("all_entities", F.coalesce("all_entities", none))


def revive_list(text: Column) -> Column:
    """`['a', "b's"]` written as text back to an array of strings; either kind of quote may hold the other."""
    quoted = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("'[^']*'|\"[^\"]*\""), 0)
    return F.transform(quoted, lambda q: F.substring(q, F.lit(2), F.length(q) - 2))


def explode_impressions(behaviours: DataFrame, *keep: str) -> DataFrame:
    """Training interactions: one row per shown item. The history array is not carried along."""
    return behaviours.select(*keep, F.inline("impressions"))


def test_set(behaviours: DataFrame, n: int | None = None, n_history: Column | None = None) -> DataFrame:
    """Impressions with a non-empty history (its array, or its length `n_history`) and non-empty candidates, optionally
    the first n of them."""
    length = F.size("history") if n_history is None else n_history
    rows = behaviours.where((length > 0) & (F.size("impressions") > 0))
    return rows.orderBy("impression_id").limit(n) if n is not None else rows


def metadata(news: DataFrame) -> DataFrame:
    return news.select("news_id", "category", "subcategory")

