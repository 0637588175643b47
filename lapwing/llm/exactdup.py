"""Exact duplicates through an extendible-hash index in the shared folder; DataFrame functions only.

A record is (id, key, sha256, bytes), the key 60 bits of the digest of the normalised text. The directory doubles as long
as a bucket is overfull, that is, has texts of more than a megabyte: rounds of a few more bits count the cells of buckets that
still need a split, and each cell takes the smallest depth at which its prefix fits. Rows of one key cannot be split; such
a bucket overflows into pages. Records are written to the shared folder by bucket and page. Each bucket has one owner task,
which chains the texts of its keys; each page has one, which looks its records up in the chain. Where a key occurs twice in
a bucket, whole texts are compared: copies collapse map-side before they are sent.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lapwing.session import lean, stage

KEY_BITS = 60
#: Bits that a cell has in each round. Steps are small where the bytes of a corpus may make all cells overfull, so that there are
#: a few cells for each bucket, not one for each key; later rounds see the few keys that agree in 20 bits and more.
ROUNDS = (12, 16, 20, 28, 44, 60)
#: Entries of a round beyond this join by shuffle.
BROADCAST_ENTRIES = 100_000
#: Bits that mark keys which occur twice; a wrong one costs a text in a shuffle. The driver holds no more than bits / 64 rows.
MARK_BITS = 1 << 23
CAPACITY = 1 << 20  # bytes of text in a bucket
PAGE_ROWS = 10_000  # records in a page of an overfull bucket


def normalised(text: str | Column = "text") -> Column:
    """A-Z in lower case, all else as it is; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def records(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One slim record per row: (id, sha, bytes, key); bytes counts 8 for the record itself."""
    sha = F.sha2(normalised(text), 256)
    size = F.octet_length(F.coalesce(text, F.lit(""))).cast("bigint") + 8
    rows = docs.select(F.col(key).alias("id"), sha.alias("sha"), size.alias("bytes"))
    return rows.withColumn("key", F.conv(F.substring("sha", 1, KEY_BITS // 4), 16, 10).cast("bigint"))


def prefix(key: str, depth: Column | int) -> Column:
    bits = F.lit(KEY_BITS) - depth if isinstance(depth, Column) else F.lit(KEY_BITS - depth)
    return F.call_function("shiftright", F.col(key), bits.cast("int"))


def directory(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Entries of the directory: (top, cell, depth, prefix, n, bytes, pages). An entry points from the first `top` bits of
    a key to its bucket; each key that occurs has one entry. Buckets cover every key, and no two overlap.

    A bucket of more bytes than the capacity has one key: equal texts, which no split parts; its records go to pages.
    An empty table has no bucket.
    """
    # a third of all rows is one row here
    done, open_ = [], rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    open_ = stage(open_, "keys")
    for base, top in zip((0, *ROUNDS), ROUNDS):
        cells = stage(open_.groupBy(prefix("key", top).alias("cell")).agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("keys")), "cells")
        # rows under the prefix of each depth of this round
        own = cells.select("cell", "n", "bytes", "keys", F.explode(F.sequence(F.lit(base), F.lit(top))).alias("depth"))
        own = own.withColumn("prefix", F.expr(f"cast(shiftright(cell, {top} - depth) as bigint)"))
        sizes = own.groupBy("depth", "prefix").agg(*[F.sum(c).alias(c) for c in ("n", "bytes", "keys")])
        fits = sizes.where((F.col("bytes") <= capacity) | (F.col("keys") == 1))
        chosen = own.select("cell", "depth", "prefix").join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min(F.struct("depth", "prefix", "n", "bytes", "keys")).alias("b"))
        pages = F.when(F.col("b.bytes") > capacity, F.ceil(F.col("b.n") / PAGE_ROWS)).otherwise(1).cast("bigint")
        entries = chosen.select(F.lit(top).alias("top"), "cell", "b.*", pages.alias("pages"))
        done.append(stage(entries, "entries"))
        overfull = cells.where((F.col("bytes") > capacity) & (F.col("keys") > 1)).select("cell")
        if top == KEY_BITS or overfull.isEmpty():
            break
        open_ = stage(open_.withColumn("cell", prefix("key", top)).join(overfull, "cell", "left_semi").drop("cell"), "keys")
    return reduce(DataFrame.unionByName, done).drop("keys")


def located(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """Records with the bucket that the directory gives them, as the first key of its range, and their page in it.

    A bucket covers keys from prefix << (60 - depth) on. Each round of the directory is looked up once, and a record is
    found in one of them.
    """
    tops = sorted(tuple(r) for r in buckets.groupBy("top").count().collect()) or [(ROUNDS[0], 0)]  # at most one of each round

    def entries(top: int, n: int) -> DataFrame:
        own = buckets.where(F.col("top") == top).select("cell", "depth", "prefix", "pages")
        return F.broadcast(own) if n <= BROADCAST_ENTRIES else own

    found = reduce(DataFrame.unionByName, [rows.withColumn("cell", prefix("key", top)).join(entries(top, n), "cell") for top, n in tops]).drop("cell")
    found = found.withColumn("bucket", F.call_function("shiftleft", F.col("prefix"), F.lit(KEY_BITS) - F.col("depth")))
    return found.withColumn("page", F.monotonically_increasing_id() % F.col("pages"))


def index(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """The directory and the record file, which is written once to the shared folder in order of bucket, page and key."""
    rows = stage(records(docs, key, text), "records")
    buckets = stage(directory(rows, capacity), "directory")
    placed = located(rows, buckets)
    return buckets, stage(placed.repartitionByRange("bucket", "page").sortWithinPartitions("bucket", "page", "key"), "index")


def marked(rows: DataFrame, keys: DataFrame, bits: int = MARK_BITS) -> DataFrame:
    """Rows whose key is among `keys`, and few others: those whose last bits agree with one of them."""
    place = F.col("key").bitwiseAND(F.lit(bits - 1))
    word, bit = F.call_function("shiftright", place, F.lit(6)), F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int"))
    word = F.coalesce(word, F.lit(0).cast("bigint"))  # never null: else a filter on it would digest every text once more
    words = keys.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    found = rows.withColumn("_word", word).join(F.broadcast(words), "_word").where(F.col("_bits").bitwiseAND(bit) != 0)
    return found.drop("_word", "_bits")


def chains(index_: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The chains of all buckets: (bucket, pages, key, sha, keep, group_size) of each text whose key occurs twice.

    Only texts whose key is marked as one that occurs twice are read again, and whole texts are compared. Copies collapse in
    the map tasks; then the few keys that a wrong bit let pass fall out, the rest is dealt by bucket, and its owner links the
    texts of a key. Two texts with one digest would make two links of the same (key, sha); that stops the job.
    """
    twice = index_.groupBy("bucket", "key").agg(F.count(F.lit(1)).alias("n"), F.max("pages").alias("pages")).where("n > 1").drop("n")
    twice = stage(twice, "twice")
    sha = F.sha2(normalised(text), 256)
    rows = docs.select(F.col(key).alias("id"), sha.alias("sha"), normalised(text).alias("whole"))
    rows = marked(rows.withColumn("key", F.conv(F.substring("sha", 1, KEY_BITS // 4), 16, 10).cast("bigint")), twice)
    same = rows.groupBy("key", "sha", "whole").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("group_size")).drop("whole").join(twice, "key")
    return same.repartition("bucket").groupBy("bucket", "pages", "key", "sha").agg(
        F.max("keep").alias("keep"),
        F.max("group_size").alias("group_size"),
        F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("two texts with one digest"))).alias("clash"),
    )


def resolve(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per row of `docs`: (key, keep, group_size, kept, sha, bucket).

    The owner of a page looks its records up in the bucket's chain, of which each page has a copy.

    Texts are equal when their bytes are after lower-casing A-Z; null equals empty. The largest id stays; of repeated rows
    with that id, all are marked kept. A null id stays only in a group without other ids. An empty table stays empty;
    other columns are not read.
    """
    lean(docs.sparkSession)
    _, placed = index(docs, key, text, capacity)
    chain = stage(chains(placed, docs, key, text), "chains")
    chain = chain.withColumn("page", F.explode(F.sequence(F.lit(0), F.col("pages") - 1))).drop("pages", "clash")
    owned = ["bucket", "page"]
    rows = placed.drop("pages").repartition(*owned).join(chain.repartition(*owned), [*owned, "key", "sha"], "left")
    alone = F.col("group_size").isNull()
    return rows.select(
        F.col("id").alias(key),
        F.when(alone, F.col("id")).otherwise(F.col("keep")).alias("keep"),
        F.when(alone, F.lit(1)).otherwise(F.col("group_size")).cast("bigint").alias("group_size"),
        F.coalesce(alone | F.col("id").eqNullSafe(F.col("keep")), F.lit(False)).alias("kept"),
        "sha",
        "bucket",
    )


def digest(docs: DataFrame) -> DataFrame:
    """Result columns of the contract."""
    found = resolve(docs)
    return found.select("doc_id", F.col("keep").alias("keep_id"), "group_size", "kept", F.col("sha").alias("text_sha256"))


DIGEST_SQL = """WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)"""
