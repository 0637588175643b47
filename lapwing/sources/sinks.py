"""Writers for features, model state, reports and keyed results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lapwing.session import stage

MODEL_TABLES = ("popularity", "recency", "coclick", "categories", "params")
#: Partition column of keyed tables, and how many partitions they have unless told otherwise.
BUCKET, BUCKETS = "key_bucket", 256


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode("overwrite").format(fmt)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_sample(df: DataFrame, path: str, n: int = 1000, order: str = "impression_id") -> None:
    """The sample file of first n rows that accompanies the full table."""
    df.orderBy(order).limit(n).write.mode("overwrite").json(path)


def save_model(tables: dict[str, DataFrame], path: str) -> None:
    """Model state as a folder of Parquet tables (popularity, recency, coclick, categories, params)."""
    unknown = set(tables) - set(MODEL_TABLES)
    if unknown:
        raise ValueError(f"unknown model tables: {sorted(unknown)}")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str, names: tuple[str, ...] = MODEL_TABLES) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def write_report(summary: DataFrame, rows: DataFrame, path: str) -> None:
    """Summary without raw rows; per-user rows separately."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    rows.write.mode("overwrite").json(f"{path}/rows")


def upsert(old: DataFrame, new: DataFrame, key: str = "method") -> DataFrame:
    """Replace the rows of `old` whose key occurs in `new`; the new rows come first (`ord` 0)."""
    kept = old.join(new.select(key), key, "left_anti").withColumn("ord", F.lit(1).cast("bigint"))
    return new.withColumn("ord", F.lit(0).cast("bigint")).unionByName(kept)


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    """The partition of a key in a keyed table; that of null is 0."""
    digest = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10)
    return F.coalesce(F.pmod(digest.cast("bigint"), F.lit(buckets)), F.lit(0)).cast("int")


def write_keyed(df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """A table that `upsert_keyed` can change: one folder per bucket of the key."""
    dealt = df.withColumn(BUCKET, bucket_of(key, buckets))
    dealt.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def upsert_keyed(new: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Replace all rows of the keys of `new` in a keyed table, in place; null is a key like others.

    Only folders with such a key are read and written (dynamic partition overwrite); all other files stay as they are. The
    merged rows are staged first, so a job that fails leaves the table as it was. `buckets` is that of `write_keyed`; no rows
    change nothing.
    """
    spark = new.sparkSession
    new = stage(new.withColumn(BUCKET, bucket_of(key, buckets)), "upsert")
    touched = [r[0] for r in new.select(BUCKET).distinct().collect()]  # at most `buckets` numbers
    if not touched:
        return
    old = spark.read.parquet(path).where(F.col(BUCKET).isin(touched))
    keys = new.select(F.col(key).alias("_key")).distinct()
    kept = old.join(keys, F.col(key).eqNullSafe(F.col("_key")), "left_anti")
    merged = stage(new.unionByName(kept), "merged")
    merged.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def with_defaults(users: DataFrame, snapshot: DataFrame, defaults: dict, key: str = "user_id") -> DataFrame:
    """Snapshot values per user, with defaults for users the snapshot does not know."""
    joined = users.join(snapshot, key, "left")
    return joined.select(
        *[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in joined.columns]
    )
