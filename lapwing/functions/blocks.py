"""Blocked matrix products: Spark packs, joins and shuffles blocks of rows, Arrow tasks multiply them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lapwing.functions.ranking import SCORE_DIGITS
from lapwing.session import small_rows

BLOCK_ITEMS = 4096
BLOCK_QUERIES = 512
BLOCK_LIST = 512
#: A cell is a group of items and a share of the queries; one task holds no more queries than this, and items block by block.
CELL_ITEMS = 16_384
CELL_QUERIES = 32_768
#: A cell is made no smaller than this to keep all cores busy.
LEAST_QUERIES = 128
#: Rows of scores that are computed exactly at a time.
PIECE = 65_536
#: Values beyond this are multiplied in double precision only.
LARGE = 1e15
#: The driver holds a broadcast table several times over: larger tables of vectors join by shuffle.
BROADCAST_BYTES = 8 * 1024 * 1024
#: Vectors that one task packs: a task holds its packed lists on the heap, several times over.
PACKED_BYTES = 64 * 1024 * 1024
#: A catalogue of vectors up to this passes through a task whole, and lists come to it as ids.
CATALOGUE_BYTES = 192 * 1024 * 1024
#: Rows of lists that a task takes beside the catalogue: at most so many bytes of them are sorted, and no fewer rows without need.
LIST_BYTES = 96 * 1024 * 1024
LEAST_ROWS = 20_000


def sized(vectors: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Measure a vector table and mark it for broadcast if its values fit the limit; larger tables join by shuffle."""
    n, dim = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    return F.broadcast(vectors) if n * (dim + 4) * 8 <= limit else vectors


def in_chunks(df: DataFrame, key: str, size: int = BLOCK_LIST, item: str = "item_id") -> DataFrame:
    """Add `chunk`: pieces of about `size` rows per key, so that packing never gathers a long list whole."""
    sizes = df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / size).alias("_c"))
    return df.join(sizes, key).withColumn("chunk", F.pmod(F.hash(item), F.col("_c").cast("int"))).drop("_c")


def packed(df: DataFrame, keys: list[str], columns: list[str], name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.collect_list(F.struct(*columns)).alias(name))


def packed_vectors(df: DataFrame, vectors: DataFrame, keys: list[str], columns: list[str], name: str) -> DataFrame:
    """Pack rows with their vectors. Rows move to their list by id first; while the vector table is broadcast,
    vectors join in place and never cross the network. `df` is counted: stage what is costly."""
    small_rows(df.sparkSession, False)
    rows = dealt(df, vectors, keys).join(vectors.withColumnRenamed("embedding", "vec"), "item_id")
    return packed(rows, keys, columns, name)


def dealt(df: DataFrame, vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Place rows by `keys`, in as many tasks as pack PACKED_BYTES of vectors each. Adaptive execution merges tasks by the
    size of the ids, which says little about the vectors: with more tasks than cores the number is fixed. It is never below
    the number of shuffle partitions, so that no join deals packed rows out again."""
    spark = df.sparkSession
    dim = vectors.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()[0]
    tasks = ceil(df.count() * (dim + 4) * 8 / PACKED_BYTES)
    n = [max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))] if tasks > spark.sparkContext.defaultParallelism else []
    return df.repartition(*n, *[F.col(k) for k in keys])


# --------------------------------------------------------------------------- lists beside the whole catalogue


@dataclass
class Catalogue:
    """Vectors that a task can hold at once; `single` says that single precision holds every value as it is."""

    vectors: DataFrame
    single: bool


def catalogue(vectors: DataFrame, limit: int = CATALOGUE_BYTES) -> Catalogue | None:
    """Measure the vectors (item_id, embedding); None if a task cannot hold them."""
    wide = F.exists("embedding", lambda x: x.cast("float").cast("double") != x)
    n, dim, double = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0)), F.coalesce(F.max(wide), F.lit(False))).first()
    return Catalogue(vectors, not double) if n * (dim + 4) * (8 if double else 4) <= limit else None


def beside(lists: DataFrame, stock: Catalogue, run: Callable, schema: str, order: tuple[str, ...] = (), n: int | None = None, width: int = 64) -> DataFrame:
    """`run(held, rows)` for the rows of whole lists, where `held` has all vectors.

    `lists` has a row for each entry of a list: (list, kind, item, ...). Rows are dealt to shares by list; a share gets the
    catalogue first, then its lists one after the other in order of (list, kind, item, *order). So vectors are sent once
    for each share and not for each entry, nothing is packed, and a task holds the catalogue and a few lists. `n` is the
    number of rows if known, `width` the bytes of one.
    """
    small_rows(lists.sparkSession)
    n = lists.count() if n is None else n
    wanted = 4 * lists.sparkSession.sparkContext.defaultParallelism
    shares = max(1, min(wanted, ceil(n / LEAST_ROWS)), ceil(n * width / LIST_BYTES))
    none = lambda c: F.lit(None).cast(lists.schema[c].dataType)
    kind = "array<float>" if stock.single else "array<double>"
    rows = lists.select(
        F.pmod(F.xxhash64("list"), F.lit(shares).cast("bigint")).alias("cell"), F.lit(0).alias("rows"), F.lit(None).cast(kind).alias("vec"), *lists.columns
    )
    items = stock.vectors.where(F.col("item_id").isNotNull() & F.col("embedding").isNotNull()).select(
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shares - 1).cast("bigint"))).alias("cell"),
        F.lit(-1).alias("rows"),
        F.col("embedding").cast(kind).alias("vec"),
        *[F.col("item_id").cast("bigint").alias(c) if c == "item" else none(c).alias(c) for c in lists.columns],
    )
    placed = rows.unionByName(items).repartition(2 * shares, "cell").sortWithinPartitions("cell", "rows", "list", "kind", "item", *order)
    return placed.mapInArrow(_beside(run), schema)


class Held:
    """The vectors of a catalogue by item; an item may have several."""

    def __init__(self):
        self.ids, self.parts = [], []

    def add(self, rows: pa.Table) -> None:
        self.ids.append(rows.column("item").to_numpy())
        self.parts.append(matrix(rows.column("vec")))

    def find(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the vectors of all items, and which entry of `items` each belongs to."""
        if self.parts:
            self.all, self.vectors = np.concatenate(self.ids), np.concatenate(self.parts)
            self.ids, self.parts = [], []
        elif not hasattr(self, "all"):
            self.all, self.vectors = np.zeros(0, np.int64), np.zeros((0, 0))
        first, last = np.searchsorted(self.all, items, "left"), np.searchsorted(self.all, items, "right")
        size = last - first
        entry = np.repeat(np.arange(len(items)), size)
        return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(len(entry)), entry

    def take(self, places: np.ndarray) -> np.ndarray:
        return self.vectors[places].astype(np.float64)


def heads(rows: pa.Table) -> np.ndarray:
    """Where lists begin in rows sorted by list; null is a list of its own."""
    column = rows.column("list").combine_chunks()
    ids, none = column.fill_null(0).to_numpy(), column.is_null().to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero((ids[1:] != ids[:-1]) | (none[1:] != none[:-1])) + 1])


def _beside(run: Callable):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, rest = None, None, []

        def done() -> Iterator[pa.RecordBatch]:
            if rest:
                yield run(held, pa.concat_tables(rest))
                rest.clear()

        for batch in batches:
            table = pa.Table.from_batches([batch])
            cells, stock = (table.column(c).to_numpy() for c in ("cell", "rows"))
            cuts = [0, *(np.flatnonzero((cells[1:] != cells[:-1]) | (stock[1:] != stock[:-1])) + 1).tolist(), len(cells)]
            for start, stop in zip(cuts, cuts[1:]):
                if start == stop:
                    continue
                if cells[start] != at:
                    yield from done()
                    at, held = cells[start], Held()
                part = table.slice(start, stop - start)
                if stock[start]:
                    held.add(part)
                    continue
                # the last list may go on in the next batch, and the first may go on from the one before
                last = int(heads(part)[-1])
                if rest and len(heads(pa.concat_tables([rest[-1].slice(rest[-1].num_rows - 1), part.slice(0, 1)]))) > 1:
                    yield from done()
                if last:
                    rest.append(part.slice(0, last))
                    yield from done()
                rest.append(part.slice(last))
        yield from done()

    return task


MATCHED = "impression_id bigint, item_id bigint, base double, match double"


def matched(candidates: DataFrame, queries: DataFrame, seen: DataFrame, stock: Catalogue) -> DataFrame:
    """Per candidate (impression_id, item_id) the largest dot with a query of its list (impression_id, query) and with an item the
    list has seen; null if it has seen no known item. Candidates without a vector and lists without a query fall out."""
    key = F.col("impression_id").cast("bigint").alias("list")
    entry = lambda df, kind: df.select(key, F.lit(kind).alias("kind"), F.col("item_id").cast("bigint").alias("item"), F.lit(None).cast("array<double>").alias("query"))
    asked = queries.select(key, F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("item"), "query")
    rows = asked.unionByName(entry(seen, 1)).unionByName(entry(candidates, 2)).where(F.col("list").isNotNull())
    return beside(rows, stock, _match, MATCHED, n=candidates.count() + seen.count())


def _match(held: Held, rows: pa.Table) -> pa.RecordBatch:
    starts = heads(rows)
    number = np.repeat(np.arange(len(starts)), np.diff([*starts, rows.num_rows]))
    kind, item = rows.column("kind").to_numpy(), rows.column("item").fill_null(0).to_numpy()
    known = rows.column("item").is_valid().to_numpy()
    asked = np.flatnonzero(kind == 0)
    queries = matrix(rows.column("query").take(pa.array(asked))) if len(asked) else np.zeros((0, 0))

    def entries(which: int):
        at = np.flatnonzero((kind == which) & known)
        places, entry = held.find(item[at])
        return places, item[at][entry], np.searchsorted(number[at][entry], np.arange(len(starts) + 1))

    past, _, past_cuts = entries(1)
    cands, ids, cuts = entries(2)
    query_cuts = np.searchsorted(number[asked], np.arange(len(starts) + 1))
    base, match = np.full(len(cands), np.nan), np.full(len(cands), np.nan)
    has_base, has_match = np.zeros(len(cands), bool), np.zeros(len(cands), bool)
    for i in range(len(starts)):
        query = queries[query_cuts[i] : query_cuts[i + 1]]
        if not len(query):
            continue
        for a in range(cuts[i], cuts[i + 1], BLOCK_ITEMS):
            b = min(a + BLOCK_ITEMS, cuts[i + 1])
            vectors = held.take(cands[a:b])
            base[a:b], has_base[a:b] = (vectors @ query.T).max(axis=1), True
            for c in range(past_cuts[i], past_cuts[i + 1], BLOCK_LIST):
                best = (vectors @ held.take(past[c : min(c + BLOCK_LIST, past_cuts[i + 1])]).T).max(axis=1)
                match[a:b], has_match[a:b] = np.maximum(match[a:b], best) if has_match[a] else best, True
    owner = rows.column("list").to_numpy()[starts][np.repeat(np.arange(len(starts)), np.diff(cuts))]
    columns = [pa.array(owner), pa.array(ids), pa.array(base), pa.array(match, mask=~has_match)]
    out = pa.RecordBatch.from_arrays(columns, names=["impression_id", "item_id", "base", "match"])
    return out.filter(pa.array(has_base))


# --------------------------------------------------------------------------- packed lists


def struct_block(scalar: pa.ListScalar, field: str) -> np.ndarray:
    return scalar.values.field(field).to_numpy(zero_copy_only=False)


def vector_block(scalar: pa.ListScalar, field: str = "vec") -> np.ndarray:
    """Matrix of the vectors in a packed list, one row per entry."""
    vectors = scalar.values.field(field)
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a vector column."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class BestItems:
    """The k best items so far of each query of a block, by score (9 digits) descending, then item id.

    Scores are first taken in single precision, with a bound on their error; only what may be among the k best by that bound
    is scored in double precision and compared.
    """

    def __init__(self, k: np.ndarray, vectors: np.ndarray, seen: pa.ListArray):
        self.k, self.vectors = k, vectors
        self.seen, self.seen_row = seen.flatten().to_numpy(), np.repeat(np.arange(len(k)), seen.value_lengths().to_numpy())
        self.row, self.item, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.edge = np.full(len(k), -np.inf)  # what an item must pass
        self.waiting: list[tuple] = []
        self.slim = single(vectors)
        self.norms = lengths(vectors)

    def add(self, ids: np.ndarray, vectors: np.ndarray, slim: np.ndarray | None = None, longest: float | None = None) -> None:
        """Take items in order of their ids, with `single(vectors)` and the largest length if known."""
        slim = single(vectors) if slim is None else slim
        both = self.slim is not None and slim is not None
        rough = self.slim @ slim.T if both else self.vectors @ vectors.T
        if not both:
            rough[np.isnan(rough)] = -np.inf
        place = np.minimum(np.searchsorted(ids, self.seen), len(ids) - 1)
        read = ids[place] == self.seen
        rough[self.seen_row[read], place[read]] = -np.inf
        error = (vectors.shape[1] + 8) * np.finfo(rough.dtype).eps * self.norms * (lengths(vectors).max() if longest is None else longest) + 2 * 10.0**-SCORE_DIGITS
        floor = self.edge - error
        if not np.isfinite(self.edge).all():
            k = min(max(int(self.k.max()), 1), len(ids))  # none but a block's own k best
            floor = np.maximum(floor, np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k] - 2 * error)
        # in the type of the scores and rounded down; seen items stay below it
        floor = np.maximum(np.nextafter(floor.astype(rough.dtype), rough.dtype.type(-np.inf)), np.finfo(rough.dtype).min)
        row, col = np.divmod(np.flatnonzero(rough >= floor[:, None]), len(ids))
        for at in range(0, len(row), PIECE):
            r, c = row[at : at + PIECE], col[at : at + PIECE]
            score = np.einsum("ij,ij->i", self.vectors[r], vectors[c])
            better = np.round(score, SCORE_DIGITS) > self.edge[r]  # later items have larger ids: at the edge they lose
            self.waiting.append((r[better], ids[c[better]], score[better]))
            if sum(len(x[0]) for x in self.waiting) > max(len(self.row) // 2, PIECE // 16):
                self.settle()

    def settle(self) -> None:
        """Bring the k best of each query up to date."""
        if not self.waiting:
            return
        row, item, score = (np.concatenate(x) for x in zip((self.row, self.item, self.score), *self.waiting))
        self.waiting = []
        rounded = np.round(score, SCORE_DIGITS)
        order = np.lexsort((item, -rounded, row))
        row, item, score, rounded = row[order], item[order], score[order], rounded[order]
        starts = np.searchsorted(row, np.arange(len(self.k)))
        place = np.arange(len(row)) - starts[row]
        keep, last = place < self.k[row], place == self.k[row] - 1
        self.edge[row[last]] = rounded[last]
        self.row, self.item, self.score = row[keep], item[keep], score[keep]


def single(vectors: np.ndarray) -> np.ndarray | None:
    """The vectors in single precision, if no product of theirs can leave its range."""
    return vectors.astype(np.float32) if np.abs(vectors).max(initial=0) < LARGE else None


def lengths(vectors: np.ndarray) -> np.ndarray:
    """Length of each row; what is no number does not count."""
    return np.linalg.norm(np.where(np.isfinite(vectors), vectors, 0.0), axis=1)


FOUND = "query_id bigint, kind bigint, k bigint, item_id bigint, score double"


class Cell:
    """The queries of a cell in blocks, each with its best items so far."""

    def __init__(self):
        self.asked, self.blocks = [], []

    def ask(self, queries: pa.Table) -> None:
        for start in range(0, queries.num_rows, BLOCK_QUERIES):
            block = queries.slice(start, BLOCK_QUERIES)
            ids, kinds, k = (block.column(c).to_numpy() for c in ("query_id", "kind", "k"))
            self.asked.append((ids, kinds, k))
            self.blocks.append(BestItems(k, matrix(block.column("vec")), block.column("seen").combine_chunks()))

    def offer(self, items: pa.Table) -> None:
        """Items come in order of their ids."""
        if not self.blocks:
            return
        ids, stock = items.column("item_id").to_numpy(), matrix(items.column("vec"))
        for at in range(0, len(ids), BLOCK_ITEMS):
            part, vectors = ids[at : at + BLOCK_ITEMS], stock[at : at + BLOCK_ITEMS]
            slim, longest = single(vectors), lengths(vectors).max()
            for best in self.blocks:
                best.add(part, vectors, slim, longest)

    def found(self) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("query_id", pa.int64()), ("kind", pa.int64()), ("k", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64())])
        for (ids, kinds, k), best in zip(self.asked, self.blocks):
            best.settle()
            columns = (ids[best.row], kinds[best.row], k[best.row], best.item, best.score)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=schema)


def best_in_cell(key: tuple, queries: pa.Table, items: pa.Table) -> pa.Table:
    """Per query of a cell the k best items of its group, without those it has seen."""
    cell = Cell()
    cell.ask(queries)
    if items.num_rows:
        cell.offer(items.sort_by("item_id"))
    none = pa.RecordBatch.from_pylist([], pa.schema([("query_id", pa.int64()), ("kind", pa.int64()), ("k", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64())]))
    return pa.Table.from_batches([none, *cell.found()])


def best_in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`best_in_cell` of the cells of a task one after the other: rows are sorted by cell, its queries (stock 0) before its
    items (stock 1), items by id. The items pass by, no more than a batch of them is held."""
    at, cell = None, Cell()
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        cells, stock = (rows.column(c).to_numpy() for c in ("cell", "stock"))
        cuts = [0, *(np.flatnonzero((cells[1:] != cells[:-1]) | (stock[1:] != stock[:-1])) + 1).tolist(), len(cells)]
        for start, stop in zip(cuts, cuts[1:]):
            if start == stop:
                continue
            if cells[start] != at:
                yield from cell.found()
                at, cell = cells[start], Cell()
            part = rows.slice(start, stop - start)
            if stock[start]:
                cell.offer(part.rename_columns({"id": "item_id"}))
            else:
                cell.ask(part.rename_columns({"id": "query_id"}))
    yield from cell.found()


def best_match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per candidate of a packed list: dot with the query and the largest dot with a packed history piece."""
    for batch in batches:
        for key, query, cands, seen in zip(*(batch.column(c) for c in ("impression_id", "query", "cands", "seen"))):
            c = vector_block(cands)
            base = c @ query.values.to_numpy(zero_copy_only=False)
            match = (c @ vector_block(seen).T).max(axis=1) if seen.is_valid else np.zeros(len(c))
            ids = struct_block(cands, "item_id")
            columns = [np.full(len(ids), key.as_py()), ids, base, match]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["impression_id", "item_id", "base", "match"])
