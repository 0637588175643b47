"""Nearest neighbours by cosine: a vantage-point tree per shard, searched with the triangle inequality.

The distance is the chord between unit vectors, sqrt(2 - 2 cos), which grows as the cosine falls and obeys the triangle
inequality. A node splits its vectors by their distance from a vantage point into a near and a far half and keeps the
smallest and largest distance of each. A search leaves a half out when no vector there can be nearer than `factor` times the
distance of the k-th best so far: factor 1 is exact, smaller factors leave out more.

Vectors are dealt to shards of bounded size; each tree is built once and written. Query blocks meet trees in tasks of one
tree and one block: a tree is sent once per query block and a query once per shard, no key holds more than that, and each
task returns k rows a query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lapwing.functions.ranking import top_k
from lapwing.session import stage

K = 5
FACTOR = 1.0
SHARD_ROWS = 16_384
QUERY_ROWS = 32_768
#: A table too small for a shard of that size on every core has smaller shards, down to this.
LEAST_ROWS = 512
LEAF = 64
#: Rounding of a distance near 0 (a cosine of 1 - 1e-16 is a chord of 1e-8) and of a product.
SLACK, NEAR = 1e-7, 1e-9
SEED = 11


def units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in double precision divided by a power of two (exact, and no square overflows), and their norms."""
    vectors = vectors.astype(float)
    _, power = np.frexp(np.abs(vectors).max(axis=1, initial=0))
    vectors = np.ldexp(vectors, -power[:, None])
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    return vectors, norms


def chord(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosines, 0))


def halves(start: int, end: int) -> tuple[int, int, int]:
    return start, (start + end) // 2, end


def build(units_: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, vantage, bounds): a balanced tree over ranges of `order`, node i with the halves 2i+1 and 2i+2.

    `vantage` is the row of a node's vantage point, chosen as the one of a few that spreads a few others most; bounds are
    the smallest and largest distance from it in the near and in the far half.
    """
    order = np.arange(len(units_))
    depth = max(0, int(np.ceil(np.log2(max(len(units_), 1) / LEAF))))
    vantage, bounds = np.zeros(2**depth - 1, np.int64), np.zeros((2**depth - 1, 4))
    draw = np.random.default_rng(seed)
    ranges = [(0, len(units_))]
    for node in range(2**depth - 1):
        start, end = ranges[node]
        rows = order[start:end]
        tried, others = (draw.choice(rows, min(n, len(rows)), replace=False) for n in (8, 64))
        best = tried[chord(units_[tried] @ units_[others].T).std(axis=1).argmax()]
        far = chord(units_[rows] @ units_[best])
        ranked = np.argsort(far, kind="stable")
        order[start:end] = rows[ranked]
        far = far[ranked]
        start, mid, end = halves(start, end)
        vantage[node], bounds[node] = best, (far[0], far[mid - start - 1], far[mid - start], far[-1])
        ranges += [(start, mid), (mid, end)]
    return order, vantage, bounds


class Best:
    """The k best rows so far of every query: score descending, then id, then row number."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.id, self.row = np.full((n, k), -np.inf), np.zeros((n, k), np.int64), np.full((n, k), -1, np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, id_: np.ndarray, row: np.ndarray) -> None:
        """Take further candidates, one per entry."""
        touched = np.unique(query)
        query = np.concatenate([np.repeat(touched, self.k), query])
        score, id_, row = (np.concatenate([old[touched].ravel(), new]) for old, new in ((self.score, score), (self.id, id_), (self.row, row)))
        order = np.lexsort((row, id_, -score, query))
        place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        kept = order[place < self.k].reshape(len(touched), self.k)
        self.score[touched], self.id[touched], self.row[touched] = score[kept], id_[kept], row[kept]

    def reach(self, queries: np.ndarray) -> np.ndarray:
        """Distance within which a row can still count."""
        return chord(np.maximum(self.score[queries, -1], -1))


class Tree:
    """A tree with its vectors in tree order."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, vantage: np.ndarray, bounds: np.ndarray):
        self.ids, self.rows, self.vantage, self.bounds = ids, rows, vantage, bounds
        self.vectors, self.norms = units(vectors)
        self.units = self.vectors / self.norms[:, None]
        self.visited = 0

    def search(self, rows: np.ndarray, vectors: np.ndarray, k: int, factor: float) -> Best:
        """The k best for each query (row number, vector), without the query's own row."""
        best = Best(len(rows), k)
        own, norms = units(vectors)
        unit = own / norms[:, None]

        def leaf(start: int, end: int, active: np.ndarray) -> None:
            self.visited += len(active) * (end - start)
            near = unit[active] @ self.units[start:end].T >= best.score[active, -1][:, None] - NEAR
            near &= rows[active][:, None] != self.rows[start:end]
            q, at = np.nonzero(near)
            q, at = active[q], at + start
            # summed again pair by pair, so that equal vectors have equal scores
            score = (own[q] * self.vectors[at]).sum(axis=1) / (norms[q] * self.norms[at])
            best.add(q, score, self.ids[at], self.rows[at])

        def visit(node: int, start: int, end: int, active: np.ndarray) -> None:
            if not len(active):
                return
            if node >= len(self.vantage):
                return leaf(start, end, active)
            away = chord(unit[active] @ self.units[self.vantage[node]])
            start, mid, end = halves(start, end)
            low, high = self.bounds[node, ::2], self.bounds[node, 1::2]
            # no vector of a half is nearer than this
            least = np.maximum(low - away[:, None], away[:, None] - high)
            first = away <= (high[0] + low[1]) / 2
            for second in (False, True):
                for half, (s, e) in enumerate(((start, mid), (mid, end))):
                    turn = first == ((half == 0) != second)
                    open_ = least[turn, half] <= factor * best.reach(active[turn]) + SLACK
                    visit(2 * node + 1 + half, s, e, active[turn][open_])

        visit(0, 0, len(self.ids), np.arange(len(rows)))
        return best


def usable(vectors: DataFrame, key: str, vec: str) -> DataFrame:
    """(row, id, vec) of the rows that take part, each row with a number of its own, written once. Floats stay floats."""
    value = F.col(vec) if dict(vectors.dtypes)[vec] == "array<float>" else F.col(vec).cast("array<double>")
    whole = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0)
    rows = vectors.where(F.col(key).isNotNull() & whole)
    return stage(rows.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("bigint").alias("id"), value.alias("vec")), "vectors")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


TREE = "dim int, shard bigint, ids binary, rows binary, vectors binary, vantage binary, bounds binary"


def index(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One tree a shard, written once: numpy arrays as bytes. Every row is in one tree; vectors of other lengths have trees of their own."""

    def tree(table: pa.Table) -> pa.Table:
        vectors = matrix(table.column("vec"))
        scaled, norms = units(vectors)
        order, vantage, bounds = build(scaled / norms[:, None])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        arrays = [table.column("id").to_numpy()[order], table.column("row").to_numpy()[order], vectors[order], place[vantage], bounds]
        columns = [pa.array([vectors.shape[1]], pa.int32()), pa.array([table.column("shard")[0].as_py()], pa.int64()), *[pa.array([a.tobytes()], pa.binary()) for a in arrays]]
        return pa.Table.from_arrays(columns, names=["dim", "shard", "ids", "rows", "vectors", "vantage", "bounds"])

    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-n // shard_rows), min(cores, n // LEAST_ROWS))
    dealt = rows.withColumn("dim", F.size("vec")).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    return stage(dealt.groupBy("dim", "shard").applyInArrow(tree, TREE), "trees")


def search(queries: DataFrame, trees: DataFrame, k: int = K, factor: float = FACTOR, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The k best rows of the index for each query (row, id, vec), but for the query itself: (row, id, found, score, rank, visited).

    Queries of a length that no tree has find nothing. `visited` is the share of its tree that the search of a task looked at.
    """

    def find(key: tuple, asked: pa.Table, tree: pa.Table) -> pa.Table:
        schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("found", pa.int64()), ("score", pa.float64()), ("visited", pa.float64())])
        if not asked.num_rows or not tree.num_rows:
            return schema.empty_table()
        stored = {c: tree.column(c)[0].as_buffer() for c in ("ids", "rows", "vectors", "vantage", "bounds")}
        ids, rows, vantage = (np.frombuffer(stored[c], np.int64) for c in ("ids", "rows", "vantage"))
        own, names, vectors = asked.column("row").to_numpy(), asked.column("id").to_numpy(), matrix(asked.column("vec"))
        built = Tree(ids, rows, np.frombuffer(stored["vectors"], vectors.dtype).reshape(len(ids), -1), vantage, np.frombuffer(stored["bounds"]).reshape(-1, 4))
        best = built.search(own, vectors, k, factor)
        q, place = np.nonzero(best.row >= 0)
        share = built.visited / (len(own) * len(ids))
        return pa.Table.from_arrays([pa.array(x) for x in (own[q], names[q], best.id[q, place], best.score[q, place], np.full(len(q), share))], schema=schema)

    blocks = max(1, -(-queries.count() // query_rows))
    asked = queries.select("row", "id", "vec", F.size("vec").alias("dim"), F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"))
    asked = asked.join(trees.groupBy("dim").agg(F.collect_set("shard").alias("shards")), "dim").withColumn("shard", F.explode("shards")).drop("shards")
    sent = trees.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    keys = ["dim", "shard", "block"]
    found = asked.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(find, "row bigint, id bigint, found bigint, score double, visited double")
    return top_k(found, ["row"], [F.col("score").desc(), F.col("found").asc()], k)


def digest(vectors: DataFrame, every: int = 50, k: int = K, factor: float = FACTOR) -> DataFrame:
    """Neighbours of the rows whose id `every` divides, among all others: (query_id, rank, vec_id, score).

    Vectors that are null, all zero or hold a null, NaN or infinite component take no part, nor do rows without an id. A
    repeated row is a row of its own: it finds its copies, and is searched for once more if it is a query. Vectors of
    different lengths are not compared. Equal scores go by the smaller id. An empty table has no rows; other
    columns are not read.
    """
    rows = usable(vectors, "vec_id", "embedding")
    found = search(rows.where(F.col("id") % every == 0), index(rows), k, factor)
    return found.select(F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("found").alias("vec_id"), "score")


DIGEST_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) AS score
  FROM u q JOIN u c ON q.vec_id % 50 = 0 AND q.r <> c.r AND len(q.e) = len(c.e))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""
