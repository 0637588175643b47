"""Documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more, with count-vector R-trees.

A set becomes a point: its shingles are hashed into groups and the point holds the count of each group. The overlap of two
sets is at most the sum of the smaller counts, and the same sum over the largest counts of two tree nodes bounds all pairs
below them. Random texts of one length lie so near to each other in these coordinates that one tree over the whole corpus
would visit nearly every leaf, so trees are built over parts that cannot lose a pair:

1. Equal sets collapse to one representative.
2. Shingles get one global order (those repeated inside a shard of the corpus last, then by hash). Two linked sets share
   one of the first n - ceil(0.8 n) + 1 shingles of each. All sets that share one are routed to the smallest of them.
3. The points of each part make an R-tree that is joined with itself: node bounds, then point bounds. Larger parts are cut
   into pages, and each pair of pages is a task of its own. Points that the surviving pairs connect are a cluster; only
   they go on.
4. The sets of a cluster are fetched and its surviving pairs verified, sparing pairs that are connected already.
5. Links make components by repeated minimum labels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from lapwing.llm import arrays as A
from lapwing.llm.columns import as_before, by_place
from lapwing.session import stage

WORDS = 5
NEAR = (80, 100)
GROUPS = 128
LEAF = 16
PAGE_ROWS = 1_000
REPEATED = 8
BITMAP_BITS = 1 << 25
#: Bytes of text that a task takes apart at a time: shingles and their temporaries take several times that.
PIECE = 1 << 20
#: White space of the contract.
BLANKS = np.r_[9:14, 32]


def blank_table() -> np.ndarray:
    """Bytes to nonzero codes, blanks to 0; byte 0 is a word byte here and takes a code that UTF-8 never uses."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[0] = 0xFF
    table[BLANKS] = 0
    return table


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in a row, and where each text begins."""
    raw, offsets = A.joined(texts)
    codes = blank_table()[raw]
    starts, ends, first = A.spans(codes, offsets)
    words = A.word_hashes(codes, starts, ends)
    count = np.diff(first)
    n = np.where(count > 0, np.maximum(count - WORDS + 1, 1), 0)
    doc = np.repeat(np.arange(len(n)), n)
    at = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    shingle = np.zeros(len(doc), np.uint64)
    size = np.minimum(count, WORDS)
    for k in range(WORDS):
        has = size[doc] > k
        word = words[np.minimum(at + k, max(len(words) - 1, 0))] if len(words) else shingle
        shingle = np.where(has, A.mixed(shingle * np.uint64(A.MULTIPLIER) + word), shingle)
    order = np.lexsort((shingle, doc))
    doc, shingle = doc[order], shingle[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])
    doc, shingle = doc[keep], shingle[keep]
    return shingle, np.r_[0, np.cumsum(np.bincount(doc, minlength=len(n)))]


def points_of(sets: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Counts of each set's shingles by group. Larger sets have more groups, powers of two, about four shingles each;
    a point folds to fewer groups by adding, so any two points can be compared."""
    n = np.diff(first)
    width = GROUPS << np.ceil(np.log2(np.maximum(n / (4 * GROUPS), 1))).astype(np.int64)
    start = np.r_[0, np.cumsum(width)]
    owner = np.repeat(np.arange(len(n)), n)
    group = (sets >> np.uint64(32)).astype(np.int64) & (width[owner] - 1)
    counts = np.bincount(start[owner] + group, minlength=start[-1]).astype(np.uint16)
    return [counts[x:y] for x, y in zip(start[:-1], start[1:])]


def folded(point: np.ndarray, width: int) -> np.ndarray:
    return point.reshape(-1, width).sum(0, dtype=np.int64)


def overlap_bound(a: np.ndarray, b: np.ndarray) -> int:
    """Most shingles that two sets can share: the sum of the smaller counts, in as many groups as both have."""
    width = min(len(a), len(b))
    return int(np.minimum(folded(a, width), folded(b, width)).sum())


def _signatures(key: str, text: str):
    """(key, keyed, n, two 64-bit digests of the set, its point)."""

    def run(batches):
        for whole in batches:
            for batch in A.pieces(whole, text, PIECE):
                sets, first = shingle_sets(batch.column(text))
                salted = [A.mixed(sets ^ np.uint64(s)) for s in (0x51ED270B7F4A7C15, 0xA24BAED4963EE407)]
                # sums over a set do not depend on order
                sums = [np.r_[np.uint64(0), np.cumsum(x)] for x in salted]
                ab = [(s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums]
                point = [x.tobytes() for x in points_of(sets, first)]
                columns = [batch.column(key), batch.column("keyed"), pa.array(np.diff(first)), pa.array(ab[0]), pa.array(ab[1]), pa.array(point, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "keyed", "n", "sig_a", "sig_b", "point"])

    return run


def _repeated(text: str, least: int, bits: int):
    """Per task: bits of the bitmap for shingles that at least `least` texts of one shard hold."""

    def run(batches):
        words: dict[int, int] = {}
        held, size = [], 0

        def close():
            kinds, times = np.unique(np.concatenate(held), return_counts=True)
            for bit in (kinds[times >= least] % np.uint64(bits)).tolist():
                words[bit >> 6] = words.get(bit >> 6, 0) | 1 << (bit & 63)

        for whole in batches:
            for batch in A.pieces(whole, text, PIECE):
                sets, _ = shingle_sets(batch.column(text))
                held.append(sets)
                size += len(sets)
                if size > 4_000_000:
                    close()
                    held, size = [], 0
        if held:
            close()
        values = np.array(list(words.values()), np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.int64()), pa.array(values, pa.int64())], names=["place", "word"])

    return run


def bitmap(docs: DataFrame, text: str, least: int = REPEATED, bits: int = BITMAP_BITS) -> np.ndarray:
    """Bitmap of repeated shingles, of a fixed number of bits. It only steers the order: a wrong bit loses no pair."""
    parts = docs.select(text).mapInArrow(_repeated(text, least, bits), "place bigint, word bigint")
    rows = parts.groupBy("place").agg(F.bit_or("word").alias("word")).toPandas()  # at most bits / 64 rows
    out = np.zeros(bits >> 6, np.uint64)
    out[rows["place"].to_numpy(np.int64)] = rows["word"].to_numpy(np.int64).view(np.uint64)
    return out


def id_bits(ids: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """Bitmap of the places of `ids` (one column), see `id_place`, of a fixed number of bits."""
    place = ids.select(id_place(ids.columns[0], bits).alias("_p"))
    word = F.expr("shiftleft(1L, cast(_p & 63 as int))")
    rows = place.groupBy(F.shiftright("_p", 6).alias("place")).agg(F.bit_or(word).alias("word")).toArrow()  # at most bits / 64 rows
    out = np.zeros(bits >> 6, np.uint64)
    out[rows.column("place").to_numpy()] = rows.column("word").to_numpy().view(np.uint64)
    return out


def id_place(column: str = "id", bits: int = BITMAP_BITS) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(bits).cast("bigint"))


def marked(marks: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """1 where a bit of the bitmap is set, else 0."""
    return (marks[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)


def _held(sent):
    """Column function: whether a place is set in the bitmap sent."""

    @F.pandas_udf("boolean")
    def held(place: pd.Series) -> pd.Series:
        return pd.Series(marked(sent.value, place.to_numpy(np.uint64)) == 1)

    return held


def _routes(key: str, text: str, sent):
    """(id, shingles): the first 20 % of each set in the global order."""

    def run(batches):
        marks = sent.value
        bits = np.uint64(len(marks) * 64)
        for whole in batches:
            for batch in A.pieces(whole, text, PIECE):
                sets, first = shingle_sets(batch.column(text))
                n = np.diff(first)
                doc = np.repeat(np.arange(len(n)), n)
                late = marked(marks, sets % bits)
                order = np.lexsort((sets, late, doc))
                take = np.minimum(n - -(-n * NEAR[0] // NEAR[1]) + 1, n)
                place = np.arange(len(doc)) - first[doc]
                chosen = order[place < take[doc]]
                yield pa.RecordBatch.from_arrays([batch.column(key), A.lists(pa.array(sets[chosen].view(np.int64)), take)], names=["id", "shingles"])

    return run


def _sets(key: str, text: str, sent):
    """(id, shingles) of the texts whose `place` is set in the bitmap sent."""

    def run(batches):
        for whole in batches:
            place = whole.column("place").to_numpy(zero_copy_only=False).view(np.uint64)
            for batch in A.pieces(whole.filter(pa.array(marked(sent.value, place) == 1)), text, PIECE):
                sets, first = shingle_sets(batch.column(text))
                values = [sets[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(values, pa.binary())], names=["id", "shingles"])

    return run


class Tree:
    """Packed R-tree over count vectors: points in order of size, leaves of a few points, one level of boxes above them.

    Boxes and the first bound use the coarsest groups, the bound of a pair all that both points have.
    """

    def __init__(self, whole: list[np.ndarray]):
        self.whole = whole
        self.points = points = np.stack([folded(p, GROUPS) for p in whole])
        self.sizes = points.sum(1)
        # points of one family stand together: by size, then by their first coordinates
        order = np.lexsort((*points[:, :4].T, self.sizes))
        self.leaves = [order[c : c + LEAF] for c in range(0, len(points), LEAF)]
        self.tops = np.array([points[x].max(0) for x in self.leaves])
        self.small = np.array([self.sizes[x].min() for x in self.leaves])
        self.large = np.array([self.sizes[x].max() for x in self.leaves])


def needed(a, b):
    """Least overlap of linked sets of sizes a and b: 0.8 / 1.8 of the sum, rounded up."""
    return -(-NEAR[0] * (a + b) // (NEAR[0] + NEAR[1]))


class Union:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return int(x)

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def near_pairs(left: Tree, right: Tree, groups: Union):
    """Pairs (index left, index right) whose bound reaches the overlap of linked sets; of one tree with itself, each once.

    Pairs that `groups` has connected by then are left out. Members of the right tree follow those of the left in
    `groups`, unless it is the same tree.
    """
    same = left is right
    shift = 0 if same else len(left.points)
    for i, leaf in enumerate(left.leaves):
        near = np.arange(i if same else 0, len(right.leaves))
        bound = np.minimum(left.tops[i], right.tops[near]).sum(1)
        fits = (100 * right.small[near] <= 125 * left.large[i]) & (100 * left.small[i] <= 125 * right.large[near])
        for j in near[fits & (bound >= needed(left.small[i], right.small[near]))]:
            other = right.leaves[j]
            roots = [np.array([groups.root(int(x) + s) for x in side]) for side, s in ((leaf, 0), (other, shift))]
            pairs = roots[0][:, None] != roots[1][None]
            if same and i == j:
                pairs = np.triu(pairs, 1)
            if pairs.any():
                overlap = np.minimum(left.points[leaf][:, None], right.points[other][None]).sum(2)
                pairs &= overlap >= needed(left.sizes[leaf][:, None], right.sizes[other][None])
            for a, b in np.argwhere(pairs):
                x, y = int(leaf[a]), int(other[b])
                if groups.root(x) != groups.root(y + shift) and overlap_bound(left.whole[x], right.whole[y]) >= needed(left.sizes[x], right.sizes[y]):
                    yield x, y, shift


def by_key(batches, keys: list[str], values: list[str]):
    """(key, rows) for runs of rows with one key, across Arrow batches."""
    now, rows = None, []
    for batch in batches:
        own = zip(*(batch.column(c).to_pylist() for c in keys))
        for key, row in zip(own, zip(*(batch.column(c).to_pylist() for c in values))):
            if key != now:
                if rows:
                    yield now, rows
                now, rows = key, []
            rows.append(row)
    if rows:
        yield now, rows


PART = ["leader", "page", "with_page"]


def _clusters(batches):
    """Rows (part, side, id, point) to those that a surviving pair holds, with the cluster of connected ones."""
    for key, rows in by_key(batches, PART, ["side", "id", "point"]):
        sides = [[r for r in rows if r[0] == side] for side in (0, 1)]
        trees = [Tree([np.frombuffer(r[2], np.uint16) for r in side]) for side in sides if side]
        if key[1] != key[2] and len(trees) < 2:
            continue
        groups, met = Union(len(rows)), set()
        for x, y, shift in near_pairs(trees[0], trees[-1], groups):
            groups.join(x, y + shift)
            met.update((x, y + shift))
        if met:
            order = sides[0] + sides[1]
            kept = sorted(met)
            columns = [[key[0]] * len(kept), [key[1]] * len(kept), [key[2]] * len(kept), [groups.root(x) for x in kept], [order[x][0] for x in kept], [order[x][1] for x in kept]]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*PART, "cluster", "side", "id"])


def _links(batches):
    """Rows (part, cluster, side, id, shingles) to links (a, b), enough to connect all that are linked."""
    for _, rows in by_key(batches, [*PART, "cluster"], ["side", "id", "shingles"]):
        sides = [[r for r in rows if r[0] == side] for side in (0, 1)]
        ids, sets = [[[r[1] for r in side] for side in sides], [[np.frombuffer(r[2], np.uint64) for r in side] for side in sides]]
        points = [points_of(np.concatenate(x), np.cumsum([0, *map(len, x)])) for x in sets if x]
        trees = [Tree(x) for x in points]
        groups, out = Union(len(rows)), []
        ids_r, sets_r = (ids[1], sets[1]) if len(trees) > 1 else (ids[0], sets[0])
        for x, y, shift in near_pairs(trees[0], trees[-1], groups):
            a, b = sets[0][x], sets_r[y]
            both = len(np.intersect1d(a, b, assume_unique=True))
            if NEAR[1] * both >= NEAR[0] * (len(a) + len(b) - both):
                groups.join(x, y + shift)
                out.append((ids[0][x], ids_r[y]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def parts_of(members: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """Cut parts (leader, id, n) into pages by size and give each pair of pages whose sizes can link a part of its own."""
    sizes = members.groupBy("leader").agg(F.count(F.lit(1)).alias("m"))
    rows = members.join(sizes, "leader").where("m > 1")
    small = rows.where(F.col("m") <= page_rows).select("leader", F.lit(0).alias("page"), F.lit(0).alias("with_page"), F.lit(0).alias("side"), "id")
    large = rows.where(F.col("m") > page_rows)
    place = F.row_number().over(W.partitionBy("leader").orderBy("n", "id")) - 1
    paged = large.withColumn("_p", place)
    paged = paged.withColumn("page", F.floor(F.col("_p") / page_rows).cast("int"))
    pages = paged.groupBy("leader", "page").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    other = pages.select("leader", F.col("page").alias("with_page"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    meet = pages.join(other, "leader").where("page <= with_page and 4 * low2 <= 5 * high").select("leader", "page", "with_page")
    left = paged.join(meet, ["leader", "page"]).select("leader", "page", "with_page", F.lit(0).alias("side"), "id")
    right = paged.withColumnRenamed("page", "with_page").join(meet.where("page < with_page"), ["leader", "with_page"])
    return small.unionByName(left).unionByName(right.select("leader", "page", "with_page", F.lit(1).alias("side"), "id"))


def components(links: DataFrame) -> DataFrame:
    """(id, label): smallest id of each component of the links (a, b).

    Each round links every vertex to the smallest one near it and drops links inside settled stars, so long chains
    shrink by large factors; each round is written to the shared folder.
    """
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        # large star: all larger neighbours of a vertex point to the smallest of its neighbourhood
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a vertex and its smaller neighbours point to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        edges = stage(small, "edges")
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("label"))
        before = state


def row_id(docs: DataFrame, key: str, text: str):
    """A bigint for each row: its key, or for a null key a number of its text that no key and no other such text has."""
    own = F.col(key).cast("bigint")
    nulls = docs.where(F.col(key).isNull()).select(F.col(text).alias("text"))
    if nulls.isEmpty():
        return own
    seed = 0
    while True:
        number = lambda c: F.xxhash64(F.lit(seed), F.coalesce(F.concat(F.lit("t"), c), F.lit("")))  # noqa: E731, B023
        taken = nulls.distinct().select(number(F.col("text")).alias("id"))
        if taken.count() == taken.distinct().count() and taken.join(docs.select(own.alias("id")), "id", "left_semi").isEmpty():
            return F.coalesce(own, number(F.col(text)))
        seed += 1


def _labelled(docs: DataFrame, key: str, text: str, page_rows: int):
    """(id, keyed, n, label, name) for every row of `docs` and the column of the ids: label is the smallest id or
    representative of the class, name the smallest key in it."""
    spark = A.small_batches(docs.sparkSession)
    inner = row_id(docs, key, text)
    numbered = docs.select(inner.alias("id"), F.col(key).isNotNull().alias("keyed"), F.col(text).alias("text"))
    rows = numbered.select("id", "text")
    every = stage(numbered.mapInArrow(_signatures("id", "text"), "id bigint, keyed boolean, n bigint, sig_a bigint, sig_b bigint, point binary"), "signatures")
    # a set is represented by a key where it has one
    heads = every.where("n > 0").groupBy("sig_a", "sig_b", "n").agg(F.min(F.when(F.col("keyed"), F.col("id"))).alias("name"), F.min("id").alias("rep"))
    heads = heads.withColumn("rep", F.coalesce("name", "rep"))
    heads = stage(heads, "representatives")
    marks = spark.sparkContext.broadcast(bitmap(rows, "text"))
    # joins take what was made of a text, a few times shorter than the text itself
    routes = rows.mapInArrow(_routes("id", "text", marks), "id bigint, shingles array<bigint>")
    routes = routes.join(heads.select(F.col("rep").alias("id")), "id", "left_semi").select(F.explode("shingles").alias("shingle"), "id")
    leader = F.min("id").over(W.partitionBy("shingle"))
    pairs = routes.withColumn("leader", leader).where("leader < id").select("leader", "id").distinct()
    pairs = stage(pairs, "routes")
    members = pairs.union(pairs.select("leader", F.col("leader").alias("id")).distinct())
    members = members.join(heads.select(F.col("rep").alias("id"), "n"), "id")
    placed = parts_of(members, page_rows).join(every.select("id", "point").hint("merge"), "id")  # points compress well: their file size would pass for a broadcast
    placed = placed.repartition(*PART).sortWithinPartitions(*PART).select(*PART, "side", "id", "point")
    near = stage(placed.mapInArrow(_clusters, "leader bigint, page int, with_page int, cluster int, side int, id bigint"), "clusters")
    # a bitmap of ids spares nearly all other texts; the join below drops what it lets through
    clustered = spark.sparkContext.broadcast(id_bits(near.select("id")))
    wanted = rows.withColumn("place", id_place()).mapInArrow(_sets("id", "text", clustered), "id bigint, shingles binary")
    keys = [*PART, "cluster"]
    grouped = near.join(wanted, "id").repartition(*keys).sortWithinPartitions(*keys).select(*keys, "side", "id", "shingles")
    links = grouped.mapInArrow(_links, "a bigint, b bigint")
    found = components(links)
    labels = heads.join(found.withColumnRenamed("id", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    names = labels.groupBy("label").agg(F.min("name").alias("name"))
    labels = labels.drop("name").join(names, "label").select("sig_a", "sig_b", "n", "label", "name")
    out = every.join(labels, ["sig_a", "sig_b", "n"], "left")
    name = F.when(F.col("label").isNull() & F.col("keyed"), F.col("id")).otherwise(F.col("name"))
    return out.select("id", "keyed", "n", F.coalesce("label", "id").alias("label"), name.alias("name")), inner


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", page_rows: int = PAGE_ROWS) -> DataFrame:
    """(key, n_shingles, component_id) for every row of `docs`; key is a bigint.

    Null and empty texts and texts of blanks have no shingles and link with nothing; shorter texts than five words are one
    shingle; equal texts are one class; repeated rows give repeated results. component_id is the smallest key that
    links lead to. Rows with a null key link like others but never name a class: one of null keys only has a null
    component_id. Other columns are not read; an empty table stays empty. No set is cut and no number of partners capped.
    """
    found, _ = _labelled(docs, key, text, page_rows)
    return found.select(F.when(F.col("keyed"), F.col("id")).alias(key), F.col("n").alias("n_shingles"), F.col("name").alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", page_rows: int = PAGE_ROWS) -> DataFrame:
    """Rows of `docs` that are the smallest key of their class; of repeated rows with that key, all stay. Same columns
    and values, whatever their names.

    A class of null keys only keeps one row; rows with a null key and no word are classes of their own and all stay.
    """
    rows, (key, text) = by_place(docs, key, text)
    found, inner = _labelled(rows, key, text, page_rows)
    first = F.when(F.col("keyed"), F.col("id") == F.col("name")).otherwise(F.col("name").isNull() & (F.col("id") == F.col("label")))
    first = F.coalesce(first, F.lit(False))
    whole = [F.max(F.when(first, F.col(c))).alias(f"_{c}") for c in ("keyed", "n")]
    ids = stage(found.groupBy(F.col("id").alias("_id")).agg(F.max(first).alias("_first"), *whole), "kept")
    keep = ids.where("_first")
    # rows whose id is not in the bitmap of those that go stay where they are; only the others are joined
    gone = docs.sparkSession.sparkContext.broadcast(id_bits(ids.where("not _first").select("_id")))
    rows = rows.withColumn("_id", inner).withColumn("_doubt", _held(gone)(id_place("_id")))
    kept = rows.where("not _doubt").unionByName(rows.where("_doubt").join(keep.select("_id"), "_id", "left_semi")).drop("_doubt")
    if keep.where("not _keyed").isEmpty():
        return as_before(kept, docs)
    once = keep.where("not _keyed and _n > 0").select("_id")
    alone = kept.join(once, "_id", "left_semi").dropDuplicates(["_id"])
    return as_before(kept.join(once, "_id", "left_anti").unionByName(alone), docs)


def digest(docs: DataFrame) -> DataFrame:
    """Result columns of the contract."""
    return classes(docs)
