"""Ordering helpers that stay distributed when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SCORE_DIGITS = 9


def by_score(score: str = "score", item: str = "item_id") -> list[Column]:
    """The one ranking order used everywhere: score (9 digits) descending, then item id."""
    return [F.round(F.col(score), SCORE_DIGITS).desc(), F.col(item).asc()]


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key. Spark prunes each map task to k rows per key before the shuffle."""
    ranked = df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("bigint"))


def positions(df: DataFrame, keys: list[str], chunk: Column, order: list[Column], name: str = "pos") -> DataFrame:
    """0-based position per key without sorting a whole key in one task.

    `chunk` must grow with `order` and split each key into pieces of workable size. Rows are numbered
    inside (key, chunk); the offset of a chunk comes from a prefix sum over the small table of chunk sizes.
    """
    piece = [*keys, "_chunk"]
    rows = df.withColumn("_chunk", chunk)
    sizes = rows.groupBy(*piece).agg(F.count(F.lit(1)).alias("_size"))
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*piece, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    local = F.row_number().over(W.partitionBy(*piece).orderBy(*order))
    return (
        rows.withColumn("_local", local)
        .join(offsets, piece)
        .withColumn(name, (F.col("_offset") + F.col("_local") - 1).cast("bigint"))
        .drop("_chunk", "_local", "_offset")
    )


#: Ranges of no more values than this are brought to the driver and sorted.
SMALL_RANGE = 10_000
CUTS = 64


def exact_quantiles(df: DataFrame, column: str, shares: list[float], small: int = SMALL_RANGE) -> list[float | None]:
    """Exact quantiles with linear interpolation, as numbers; nulls do not count, without values all are null.

    Selection by rank: a range of values is cut at some of its own values (approximate quantiles), rows are counted in
    each piece in one pass, and only the pieces that hold a wanted rank are looked at again, until such a piece is one
    value or small. The shape of the distribution does not matter: a round leaves about 1/64 of the rows of a range.
    `df` is read in every round: stage what is costly.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull())
    n = values.count()
    if not n:
        return [None] * len(shares)
    places = [(n - 1) * float(p) for p in shares]
    wanted = sorted({rank for x in places for rank in (int(x), min(int(x) + 1, n - 1))})
    found: dict[int, float] = {}
    open_ = [(None, None, 0, n, wanted)]  # between two values, rows before, rows, ranks
    while open_:
        low, high, before, rows, ranks = open_.pop()
        part = values
        if low is not None:
            part = part.where(F.col("v") > low)
        if high is not None:
            part = part.where(F.col("v") < high)
        if rows <= small:
            inside = sorted(r[0] for r in part.collect())
            found |= {rank: inside[rank - before] for rank in ranks}
            continue
        cuts = sorted(set(part.agg(F.percentile_approx("v", [i / CUTS for i in range(1, CUTS)], 10_000)).first()[0]))
        # even numbers are the open pieces between cuts, odd ones the cuts themselves
        piece = sum((F.when(F.col("v") > c, 2).when(F.col("v") == c, 1).otherwise(0) for c in cuts), F.lit(0))
        sizes = dict(part.groupBy(piece.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
        for p in range(2 * len(cuts) + 1):
            size = sizes.get(p, 0)
            here = [rank for rank in ranks if before <= rank < before + size]
            if here and p % 2:
                found |= dict.fromkeys(here, cuts[p // 2])
            elif here:
                open_.append((cuts[p // 2 - 1] if p else low, cuts[p // 2] if p // 2 < len(cuts) else high, before, size, here))
            before += size
    return [found[int(x)] + (found[min(int(x) + 1, n - 1)] - found[int(x)]) * (x - int(x)) for x in places]
