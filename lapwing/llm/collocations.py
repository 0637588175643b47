"""Collocations: phrases of two to five words that occur together more often than their parts do, per language.

Counts come from sorting suffix pointers. A pointer stands at a word and reaches to the end of its piece, five words at
most. Pointers are cut before any word or pair that the whole corpus holds too rarely (no longer phrase through it can be
frequent), equal ones collapse in their task, and the rest are routed over the cluster by their leading pair. Each route is
sorted by multikey three-way quicksort: the size of an equal partition is the count of its phrase, and a partition below the
minimum is abandoned with everything under it. The leading words themselves are counted by the two passes that cut.

What tasks know of frequent words and pairs is a bit map of fixed size, over hashes: it may keep a pointer too long,
never cut one too short, so counts are exact. Pairs that hold more than their share of the corpus are routed by
further words as well, and their triples added up afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zlib
from pyspark.sql import Column, DataFrame, functions as F

from lapwing.functions.ranking import top_k
from lapwing.llm import arrays as A
from lapwing.session import stage

MINIMUM = 100
LONGEST = 5
TOP = 2000
#: Bits of a map of frequent words or pairs: 4 MB for each task, whatever the corpus.
MAP_BITS = 1 << 25
PAIR_FACTOR = 40503
#: Pointers that one quicksort is dealt on average, before equal ones collapse.
ROUTE_POINTERS = 1_000_000
#: A pair with more than this share of all pointers is routed by further words; at most 10,000 pairs can have it.
HOT_SHARE = 1e-4
CHUNK = 16 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANKS, ENDS = list(b" \t"), list(b".,;:!?\n\x0b\x0c\r")
COUNTS = "lang string, phrase string, f bigint"


@dataclass
class Words:
    """Words of a run of texts: numbers of distinct (language, word), and which are followed by a word of their piece."""

    ids: np.ndarray
    joined: np.ndarray
    langs: pa.Array
    words: pa.Array

    def hashes(self) -> np.ndarray:
        """crc32 of each distinct (language, word), as `word_hash` has it."""
        seeds = {lang: zlib.crc32(lang.encode() + b"\0") for lang in pc.unique(self.langs).to_pylist()}
        pairs = zip(self.langs.to_pylist(), self.words.cast(pa.binary()).to_pylist())
        return np.array([zlib.crc32(word, seeds[lang]) for lang, word in pairs], np.int64)


def words_of(batch: pa.RecordBatch) -> Words:
    """Words of the columns (text, lang) of a batch; null texts are empty, null languages `und`."""
    raw, offsets = A.joined(batch.column("text"))
    blank, end = np.zeros(256, bool), np.zeros(256, bool)
    blank[BLANKS + ENDS], end[ENDS] = True, True
    inside = ~blank[raw]
    starts, stops, first = A.spans(inside, offsets)
    ends = np.concatenate([[0], np.cumsum(end[raw], dtype=np.int64)])
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    joined = np.zeros(len(starts), bool)
    joined[:-1] = (doc[1:] == doc[:-1]) & (ends[starts[1:]] == ends[stops[:-1]])
    data = LOWER[raw[inside]]
    bounds = np.concatenate([[0], np.cumsum(stops - starts)])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
    langs = pc.fill_null(batch.column("lang"), "und").dictionary_encode()
    distinct = max(len(words.dictionary), 1)
    spoken = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[doc]
    ids, keys = pd.factorize(spoken * distinct + words.indices.to_numpy(zero_copy_only=False))
    return Words(ids, joined, langs.dictionary.cast(pa.string()).take(keys // distinct), words.dictionary.cast(pa.large_string()).take(keys % distinct))


def word_hash(word: str) -> Column:
    return F.crc32(F.concat("lang", F.lit("\0"), F.col(word) if isinstance(word, str) else word))


def pair_hash(first: np.ndarray | Column, second: np.ndarray | Column):
    return (first * PAIR_FACTOR + second) % MAP_BITS


def bit_map(bits: DataFrame) -> np.ndarray:
    """Map of the numbers in column `bit`: words of 64 bits are put together in Spark, at most MAP_BITS / 64 rows come back."""
    block = F.floor(F.col("bit") / 64).cast("bigint").alias("block")
    mask = F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("mask")
    rows = bits.select("bit").groupBy(block).agg(mask).toArrow()
    out = np.zeros(MAP_BITS // 64, np.int64)
    out[rows.column("block").to_numpy()] = rows.column("mask").to_numpy()
    return out.view(np.uint64)


def spaced(columns: list[pa.Array]) -> pa.Array:
    """The words of each row with a blank between them; null words are left out."""
    return pc.binary_join_element_wise(*columns, pa.scalar(" ", columns[0].type), null_handling="skip")


def marked(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


def counted(langs: pa.Array, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([langs, phrases.cast(pa.string()), pa.array(counts, pa.int64())], names=["lang", "phrase", "f"])


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    for batch in batches:
        for piece in A.pieces(batch, limit=CHUNK):
            yield words_of(piece)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each word of a run of texts, and of all its words under a null phrase."""
    for w in runs(batches):
        sizes = np.bincount(w.ids, minlength=len(w.words))
        yield counted(w.langs, w.words, sizes)
        yield counted(w.langs, pa.nulls(len(w.words), pa.string()), sizes)


def count_pairs(frequent: Callable[[], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = frequent()
        for w in runs(batches):
            keep = marked(bits, w.hashes() % MAP_BITS)[w.ids]
            at = np.flatnonzero(w.joined[:-1] & keep[:-1] & keep[1:])
            codes, keys = pd.factorize(w.ids[at] * len(w.words) + w.ids[at + 1])
            first, second = keys // max(len(w.words), 1), keys % max(len(w.words), 1)
            yield counted(w.langs.take(first), spaced([w.words.take(first), w.words.take(second)]), np.bincount(codes, minlength=len(keys)))

    return run


def collect_pointers(frequent: Callable[[], np.ndarray]):
    """Distinct suffixes of three to five words, each cut before its first rare pair, with their number in a run of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = frequent()
        for w in runs(batches):
            hashes, n, distinct = w.hashes(), len(w.ids), len(w.words)
            if n < 3:
                continue
            good = np.zeros(n + LONGEST, bool)
            good[: n - 1] = w.joined[:-1] & marked(bits, pair_hash(hashes[w.ids[:-1]], hashes[w.ids[1:]]))
            at = np.flatnonzero(good[:-1] & good[1:])
            padded = np.concatenate([w.ids, np.full(LONGEST, distinct)])
            code, known, reached = padded[at], np.arange(distinct)[:, None], np.ones(len(at), bool)
            for depth in range(1, LONGEST):  # number the distinct prefixes, one word longer each time
                reached = reached & good[at + depth - 1]
                code, keys = pd.factorize(code * (distinct + 1) + np.where(reached, padded[at + depth], distinct))
                known = np.concatenate([known[keys // (distinct + 1)], (keys % (distinct + 1))[:, None]], axis=1)
            words = pa.concat_arrays([w.words, pa.nulls(1, w.words.type)])
            columns = [words.take(pa.array(known[:, d])) for d in range(LONGEST)]
            phrases = spaced(columns)
            yield counted(w.langs.take(pa.array(known[:, 0])), phrases, np.bincount(code, minlength=len(known)))

    return run


def quicksort(keys: np.ndarray, sizes: np.ndarray, minimum: int, whole: int) -> Iterator[tuple[int, int, int]]:
    """Multikey three-way quicksort of rows of `keys` (-1 after the end of a row): (a row, depth, size) of every equal
    partition of at least `minimum`. Partitions of depth `whole` come with any size, as parts of them lie elsewhere."""
    stack = [(np.arange(len(keys)), 0)]
    while stack:
        rows, depth = stack.pop()
        if not len(rows) or (depth >= whole and sizes[rows].sum() < minimum):
            continue
        column = keys[rows, depth]
        pivot = column[len(column) // 2]
        less, more = column < pivot, column > pivot
        stack += [(rows[less], depth), (rows[more], depth)]
        equal = rows[~(less | more)]
        if pivot < 0:
            continue
        size = int(sizes[equal].sum())
        if size >= minimum or depth < whole:
            yield equal[0], depth, size
            if depth + 1 < keys.shape[1]:
                stack.append((equal, depth + 1))


def sort_routes(minimum: int):
    """Phrases of three and more words of each route with their counts; of routes that are split, triples in parts."""

    def sorted_rows(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for split in (False, True):
            part = table.filter(pc.equal(table.column("split"), split)).combine_chunks()
            if not part.num_rows:
                continue
            phrases = pc.split_pattern(part.column("phrase").combine_chunks(), " ")
            counts = phrases.value_lengths().to_numpy()
            words = phrases.flatten().dictionary_encode()
            keys = np.full((part.num_rows, LONGEST + 1), -1, np.int32)
            langs = part.column("lang").combine_chunks().dictionary_encode()
            keys[:, 0] = langs.indices
            keys[np.repeat(np.arange(part.num_rows), counts), 1 + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)] = words.indices
            # depth 0 is the language, so a triple lies at depth 3
            found = [x for x in quicksort(keys, part.column("f").to_numpy(), minimum, 4 if split else 0) if x[1] >= 3]
            if found:
                row, depth, size = np.array(found).T
                texts = [words.dictionary.take(pa.array(keys[row, d], mask=depth < d)) for d in range(1, LONGEST + 1)]
                yield counted(langs.dictionary.take(pa.array(keys[row, 0])), spaced(texts), size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = [], None
        for batch in batches:
            buckets = batch.column("bucket").to_numpy()
            edges = np.r_[0, np.flatnonzero(np.diff(buckets)) + 1, len(buckets)] if len(buckets) else []
            for start, stop in zip(edges[:-1], edges[1:]):
                if held and buckets[start] != bucket:
                    yield from sorted_rows(pa.Table.from_batches(held))
                    held = []
                bucket = buckets[start]
                held.append(batch.slice(start, stop - start))
        if held:
            yield from sorted_rows(pa.Table.from_batches(held))

    return run


def frequencies(docs: DataFrame, minimum: int = MINIMUM, text: str = "text", lang: str = "lang", route_pointers: int = ROUTE_POINTERS) -> tuple[DataFrame, DataFrame]:
    """All phrases of one to five words that occur `minimum` times or more: (lang, phrase, f, words), and the words of each
    language: (lang, n). Occurrences overlap, and lie within one piece of one text."""
    spark = A.small_batches(docs.sparkSession)
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))

    def summed(counts: DataFrame) -> DataFrame:
        return counts.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= minimum) | F.col("phrase").isNull())

    def shared(bits: np.ndarray) -> Callable[[], np.ndarray]:
        sent = spark.sparkContext.broadcast(bits)
        return lambda: sent.value

    every = stage(summed(rows.mapInArrow(count_words, COUNTS)), "words")
    words, totals = every.where(F.col("phrase").isNotNull()), every.where(F.col("phrase").isNull()).select("lang", F.col("f").alias("n"))
    seen = shared(bit_map(words.select((word_hash("phrase") % MAP_BITS).alias("bit"))))
    pairs = stage(summed(rows.mapInArrow(count_pairs(seen), COUNTS)), "pairs")
    first, second = (F.substring_index("phrase", " ", i) for i in (1, -1))
    seen = shared(bit_map(pairs.select(pair_hash(word_hash(first), word_hash(second)).alias("bit"))))
    total = pairs.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    buckets = max(1, total // route_pointers)
    hot = pairs.where(F.col("f") > max(total * HOT_SHARE, route_pointers / 4)).select("lang", F.col("phrase").alias("lead"), (1 + F.floor(F.col("f") * 4 / route_pointers)).alias("parts"))
    # the further words that split a hot route: up to the fourth, so that only its triples are cut apart
    lead, four = F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", 4)
    pointers = rows.mapInArrow(collect_pointers(seen), COUNTS).withColumn("lead", lead).join(F.broadcast(hot), ["lang", "lead"], "left")
    route = F.xxhash64("lang", "lead", F.when(F.col("parts") > 1, F.pmod(F.xxhash64(four), "parts")).otherwise(0))
    routed = pointers.select("lang", "phrase", "f", F.pmod(route, F.lit(buckets)).alias("bucket"), F.coalesce(F.col("parts") > 1, F.lit(False)).alias("split"))
    routed = routed.repartition("bucket").sortWithinPartitions("bucket")
    longer = stage(summed(routed.mapInArrow(sort_routes(minimum), COUNTS)), "phrases")
    size = [part.withColumn("words", n) for part, n in ((words, F.lit(1)), (pairs, F.lit(2)), (longer, F.size(F.split("phrase", " "))))]
    return size[0].unionByName(size[1]).unionByName(size[2]), totals


def mine(docs: DataFrame, minimum: int = MINIMUM, top: int = TOP, text: str = "text", lang: str = "lang", route_pointers: int = ROUTE_POINTERS) -> DataFrame:
    """The best phrases of each language: (lang, rank, phrase, a, l, r, n, score).

    Texts are lower-cased (A-Z only), cut into pieces at punctuation and line ends, pieces into words at blanks and tabs. A
    null or empty text has no words; a null language is `und`; repeated rows count as often as they stand; an empty table
    has no phrases; other columns are not read. score is floor(1000 a n / (l r)) at the cut of a phrase where it is
    smallest (the first of equal cuts), in decimals of 38 digits. A phrase that only occurs inside one longer phrase is
    left out. Equal scores: larger a, then the phrase in byte order.
    """
    found, totals = frequencies(docs, minimum, text, lang, route_pointers)
    phrases = found.where("words >= 2")
    # if a longer phrase has the same count, so has the one longer by a word between them
    parts = F.array(F.regexp_replace("phrase", " [^ ]*$", ""), F.regexp_replace("phrase", "^[^ ]* ", ""))
    inner = found.where("words >= 3").select("lang", F.explode(parts).alias("phrase"), F.col("f").alias("outer")).groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    free = phrases.join(inner, ["lang", "phrase"], "left").where(F.col("outer").isNull() | (F.col("outer") < F.col("f")))
    cuts = free.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.concat_ws(" ", F.slice("w", 1, F.col("k"))).alias("left"), F.concat_ws(" ", F.slice("w", F.col("k") + 1, LONGEST)).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(found.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    wide = lambda x: x.cast("decimal(19,0)")
    score = F.call_function("div", wide(F.col("a") * 1000) * wide(F.col("n")), wide(F.col("l")) * wide(F.col("r")))
    scored = cuts.join(totals, "lang").withColumn("score", score)
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "n", "b.l", "b.r", "b.score")
    ranked = top_k(best, ["lang"], [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()], top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


DIGEST_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM t),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p WHERE len(w) > 0),
grams AS (SELECT lang, w[i : i + m - 1] AS g, m FROM spots, range(1, 6) AS lengths(m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, g, m, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
inner_ AS (SELECT lang, g, max(a) AS o FROM (SELECT lang, g[1 : m - 1] AS g, a FROM f WHERE m >= 3 UNION ALL SELECT lang, g[2 : m] AS g, a FROM f WHERE m >= 3) GROUP BY lang, g),
free AS (SELECT f.* FROM f LEFT JOIN inner_ USING (lang, g) WHERE m >= 2 AND (o IS NULL OR 100 * o < 100 * a)),
cut AS (SELECT free.lang, free.g, free.a, k, x.a AS l, y.a AS r, n, (1000::HUGEINT * free.a * n) // (x.a::HUGEINT * y.a) AS score
  FROM free, range(1, 5) AS cuts(k), f AS x, f AS y, totals
  WHERE k < free.m AND x.lang = free.lang AND y.lang = free.lang AND totals.lang = free.lang AND x.g = free.g[1 : k] AND y.g = free.g[k + 1 : free.m]),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS c FROM cut),
ranked AS (SELECT *, array_to_string(g, ' ') AS phrase FROM best WHERE c = 1)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked) WHERE rank <= 2000"""
