"""Shards as runs of a Hilbert curve through several metadata columns, so that filters on any of them skip files.

Columns are quantised by their own quantiles (strings by their first bytes, which keeps their order), the cells become
positions on the curve, rows are sorted by position and cut into runs of equal row count.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lapwing.session import stage

SHARDS = 24
BITS = 6


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of each row of cells (n, dimensions) on the curve; every cell is below 2**bits.

    Reflects and swaps coordinates from the top bit down, so that each quadrant is entered where the last one was left,
    then undoes the Gray code and interleaves the bits.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(n):
            upper = (x[i] >> level) & 1 == 1
            swap = np.where(upper, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(upper, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap if i else 0
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flips = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flips ^= np.where((x[n - 1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= flips
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> level) & 1)
    return out


def ordinal(df: DataFrame, column: str) -> Column:
    """A number that grows with the column: itself, or the first 7 bytes of a string."""
    if dict(df.dtypes)[column] == "string":
        return F.conv(F.rpad(F.substring(F.hex(F.encode(F.col(column), "UTF-8")), 1, 14), 14, "0"), 16, 10).cast("double")
    return F.col(column).cast("double")


def curve_position(df: DataFrame, dimensions: list[str], bits: int = BITS, name: str = "position") -> DataFrame:
    """Add the Hilbert position of each row. Nulls share the lowest cell."""
    measures = [ordinal(df, c) for c in dimensions]
    shares = [i / 2**bits for i in range(1, 2**bits)]
    # percentile_approx keeps a sketch of fixed size in each task
    cuts = df.agg(*[F.percentile_approx(m, shares, 10_000).alias(f"c{i}") for i, m in enumerate(measures)]).first()
    edges = [np.unique(np.array(c if c is not None else [], float)) for c in cuts]

    @F.pandas_udf("bigint")
    def position(*columns: pd.Series) -> pd.Series:
        cells = [np.where(np.isnan(v), 0, np.searchsorted(e, np.nan_to_num(v), "right")) for e, v in zip(edges, (c.to_numpy(float) for c in columns))]
        return pd.Series(hilbert(np.stack(cells, 1), bits))

    return df.withColumn(name, position(*measures))


def runs(df: DataFrame, order: list[str], shards: int = SHARDS) -> DataFrame:
    """Add shard and slot: `shards` runs of the rows in `order`, row counts at most one apart.

    Range partitions are sorted and staged; the place of a row is its number in the partition plus the rows of earlier
    partitions, of which there are as many as shuffle partitions.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the id holds the partition above bit 33 and the row number in it below
    ordered = stage(ordered.withColumn("_id", F.monotonically_increasing_id()), "shards")
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    rows = ordered.select(*df.columns, part.alias("_part"), place.alias("_place"))
    sizes = sorted((r["_part"], r["n"]) for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    total = sum(n for _, n in sizes)
    before = dict(zip((p for p, _ in sizes), np.cumsum([0, *(n for _, n in sizes)]).tolist()))
    offsets = spark.createDataFrame(list(before.items()) or [(0, 0)], "_part bigint, _before bigint")
    rows = rows.join(F.broadcast(offsets), "_part").withColumn("_at", F.col("_before") + F.col("_place"))
    # shard k begins at row floor(k * total / shards)
    shard = F.expr(f"cast(((_at + 1) * {shards} - 1) div {max(total, 1)} as int)")
    rows = rows.withColumn("shard", shard)
    return rows.withColumn("slot", F.col("_at") - F.expr(f"(shard * {max(total, 1)}L) div {shards}")).drop("_part", "_place", "_before", "_at")


def shard(docs: DataFrame, dimensions: list[str], tie: list[str], shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """Give every row a shard (0 to shards - 1) and a gapless slot in it, along a Hilbert curve through `dimensions`.

    Null metadata sorts lowest; equal positions follow `tie`, rows that are equal there too come in any order; empty
    tables stay empty; with fewer rows than shards some shards are empty. Columns named position, shard or slot are
    replaced. Row counts differ by one at most however many rows share a cell, as ties are part of the sort key.
    """
    rows = curve_position(docs.drop("position", "shard", "slot"), dimensions, bits)
    return runs(rows, ["position", *tie], shards)


def write(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in curve order, so that min and max of every dimension are narrow in each file."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def digest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Result columns of the contract: law `rows`."""
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(
        "doc_id",
        "source",
        "lang",
        "n_chars",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    out = shard(slim, ["source", "lang", "n_chars", "doc_id"], ["text_crc32", "doc_id"], shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
