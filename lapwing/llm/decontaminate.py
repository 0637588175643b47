"""Benchmark decontamination with suffix arrays of the documents.

Every Arrow task keeps one shard of whole documents at a time, sorts its word suffixes and binary-searches each suffix of
the benchmark in them. That gives the longest verbatim match and all places of each 13-word window. A suffix that cannot
hold a window, because a word within reach occurs nowhere in the benchmark, is left out of the array: no search can end
there. Documents never move, so no key can be hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lapwing.llm import arrays as A
from lapwing.llm.columns import as_before, by_place

WINDOW = 13
SHARD_WORDS = 2_000_000
#: Pairs of a place and an item suffix that are compared at once.
PAIRS = 1 << 20
#: Text of one block of items, which is sent to all tasks; more items take further passes.
BLOCK_BYTES = 32 << 20
#: All bytes but 0-9, a-z (A-Z become these) and those of non-ASCII characters.
SEPARATORS = np.r_[0x00:0x30, 0x3A:0x41, 0x5B:0x61, 0x7B:0x80]
SPAN = "struct<start:int,length:int,item:string,item_start:int>"


class Items:
    """The benchmark as one row of word codes: suffixes to search, windows, and the items of each distinct window."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        codes, offsets = A.joined(pa.array(texts, pa.large_string()))
        codes = A.byte_table(SEPARATORS)[codes]
        starts, ends, first = A.spans(codes, offsets)
        self.vocabulary, words = np.unique(A.word_hashes(codes, starts, ends), return_inverse=True)
        count = np.diff(first)
        self.words = np.full(len(words) + len(ids), -1, np.int64)  # -1 ends an item and equals no word
        place = np.arange(len(words)) + np.repeat(np.arange(len(ids)), count)
        self.words[place] = words + 1
        self.item = np.repeat(np.arange(len(ids)), count)
        self.ids = np.array(ids, object)
        offset = np.arange(len(words)) - np.repeat(first[:-1], count)
        size = np.minimum(window, count[self.item])
        full = offset + size <= count[self.item]
        self.suffix, self.item, self.offset, self.size = place[full], self.item[full], offset[full], size[full]
        self.shortest = int(self.size.min()) if len(self.size) else window


def common(shard: np.ndarray, a: np.ndarray, words: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words the suffixes at `a` of the shard and `b` of the items share, up to `most`."""
    got, live = np.zeros(len(a), np.int64), np.flatnonzero(most > 0)
    while len(live):
        reach = got[live]
        left, right = shard[a[live] + reach], words[b[live] + reach]
        same = (left == right) & (left > 0)
        live = live[same]
        got[live] += 1
        live = live[got[live] < most[live]]
    return got


def suffix_array(shard: np.ndarray, longest: int) -> np.ndarray:
    """Starts of all suffixes in order; 0 ends a suffix. Ranks by 1, 2, 4, ... words until all differ."""
    at = np.flatnonzero(shard)
    if not len(at):
        return at
    rank = np.zeros(len(shard) + 1, np.int64)
    rank[:-1] = shard
    reach = 1
    while True:
        after = np.minimum(at + reach, len(shard))
        second = np.where(rank[at] > 0, rank[after], 0)
        # a suffix that ended within `reach` words has a 0 there: its first rank holds what it has
        key = rank[at] * (len(shard) + int(rank.max()) + 2) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.cumsum(np.r_[True, ordered[1:] != ordered[:-1]])
        ranks = np.zeros(len(at), np.int64)
        ranks[order] = new
        rank[at] = ranks
        reach *= 2
        if new[-1] == len(at) or reach >= longest:
            return at[order]


def insertion(shard, array, items: Items, most: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of all item suffixes, cut to `most` words: the first place not before them, or past all that equal them."""
    low, high = np.zeros(len(most), np.int64), np.full(len(most), len(array), np.int64)
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) // 2
        a, b = array[middle], items.suffix[open_]
        same = common(shard, a, items.words, b, most[open_])
        full = same == most[open_]
        less = ~full & (shard[a + same] < np.where(full, 0, items.words[b + np.minimum(same, most[open_])]))
        right = less | (full & after)
        low[open_] = np.where(right, middle + 1, low[open_])
        high[open_] = np.where(right, high[open_], middle)
    return low


def search(words: np.ndarray, first: np.ndarray, items: Items) -> dict:
    """Hits of all items in one shard of documents. words: code of every word, 0 if no item has it."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    out = {"hit": np.zeros(len(words), bool), "doc": doc, "pairs": np.zeros((0, 2), np.int64), "matches": np.zeros((0, 4), np.int64)}
    if not len(items.size) or not len(words):
        return out
    # runs of known words inside a document, at least as long as the shortest window
    known = np.r_[False, words > 0, False]
    edge = np.zeros(len(words) + 1, bool)
    edge[first] = True
    begin = np.flatnonzero(known[1:] & (edge | ~known[:-1]))
    end = np.flatnonzero(known[:-1] & (edge | ~known[1:]))
    wide = end - begin >= items.shortest
    begin, end = begin[wide], end[wide]
    if not len(begin):
        return out
    size = end - begin
    total = int(size.sum())
    source = np.repeat(begin, size) + np.arange(total) - np.repeat(np.cumsum(size) - size, size)
    place = np.arange(total) + np.repeat(np.arange(len(size)), size)
    shard = np.zeros(total + len(size) + 1, np.int64)
    shard[place] = words[source]
    origin = np.zeros(len(shard), np.int64)
    origin[place] = source
    array = suffix_array(shard, int(size.max()))
    # longest match of every item suffix: it stands next to where the suffix would go
    rest = np.flatnonzero(items.words == -1)
    whole = rest[items.item] - items.suffix
    at = insertion(shard, array, items, whole, False)
    best = np.zeros(len(at), np.int64)
    for near in (at - 1, at):
        inside = (near >= 0) & (near < len(array))
        got = np.zeros(len(at), np.int64)
        got[inside] = common(shard, array[near[inside]], items.words, items.suffix[inside], whole[inside])
        best = np.maximum(best, got)
    found = np.flatnonzero(best >= items.size)
    if not len(found):
        return out
    some = Some(items, found)
    low, high = insertion(shard, array, some, some.size, False), insertion(shard, array, some, some.size, True)
    # equal windows of equal length have equal intervals: mark each interval once
    spots, index = np.unique(np.stack([low, high, some.size], 1), axis=0, return_inverse=True)
    index = index.reshape(-1)
    wide = spots[:, 1] - spots[:, 0]
    which = np.repeat(np.arange(len(spots)), wide)
    start = origin[array[np.repeat(spots[:, 0], wide) + np.arange(len(which)) - np.repeat(np.cumsum(wide) - wide, wide)]]
    ends = start + spots[which, 2]
    out["hit"] = np.cumsum(np.bincount(start, minlength=len(words) + 1) - np.bincount(ends, minlength=len(words) + 1))[:-1] > 0
    # (document, window) once, then the items of the window
    seen = np.unique(np.stack([doc[start], which], 1), axis=0)
    owners = np.unique(np.stack([index, some.item], 1), axis=0)
    lo, hi = np.searchsorted(owners[:, 0], seen[:, 1], "left"), np.searchsorted(owners[:, 0], seen[:, 1], "right")
    each = hi - lo
    owner_of = owners[np.repeat(lo, each) + np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each), 1]
    out["pairs"] = np.unique(np.stack([np.repeat(seen[:, 0], each), owner_of], 1), axis=0)
    where = np.full(len(words), -1, np.int64)
    where[source] = place
    out["matches"] = longest(shard, where, start, which, index, items, found, whole, first, doc)
    return out


def longest(shard, where, start, which, index, items: Items, found, whole, first, doc, step: int = PAIRS) -> np.ndarray:
    """Rows (document, start, length, item suffix): every place of a window continued along every item suffix that has it.

    A pair whose words before also agree continues an earlier one, so only the first of a run is measured. Of one item, what
    lies inside a longer match is no match of its own.
    """
    by_window = np.argsort(index, kind="stable")
    low = np.searchsorted(index[by_window], np.arange(index.max() + 2))
    each = np.diff(low)[which]
    upto = np.cumsum(each)
    kept, at = [], 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + step, "right")))
        size = each[at:to]
        begin = np.repeat(start[at:to], size)
        own = np.arange(len(begin)) - np.repeat(np.cumsum(size) - size, size)
        suffix = found[by_window[np.repeat(low[which[at:to]], size) + own]]
        left, right = shard[where[begin] - 1], items.words[items.suffix[suffix] - 1]
        head = ~((left == right) & (left > 0))
        begin, suffix = begin[head], suffix[head]
        length = common(shard, where[begin], items.words, items.suffix[suffix], whole[suffix])
        kept.append(np.stack([begin, length, suffix], 1))
        at = to
    rows = np.concatenate(kept)
    owner, item, end = doc[rows[:, 0]], items.item[rows[:, 2]], rows[:, 0] + rows[:, 1]
    order = np.lexsort((rows[:, 2], -rows[:, 1], rows[:, 0], item, owner))
    rows, owner, item, end = rows[order], owner[order], item[order], end[order]
    group = np.cumsum(np.r_[False, (owner[1:] != owner[:-1]) | (item[1:] != item[:-1])])
    reach = np.maximum.accumulate(end + group * (len(doc) + 1))  # ends of earlier groups stay below
    outer = np.r_[True, (group[1:] != group[:-1]) | (end[1:] + group[1:] * (len(doc) + 1) > reach[:-1])]
    rows, owner = rows[outer], owner[outer]
    return np.stack([owner, rows[:, 0] - first[owner], rows[:, 1], rows[:, 2]], 1)


class Some:
    """The items, with only some of their suffixes."""

    def __init__(self, items: Items, keep: np.ndarray):
        self.words, self.suffix, self.item, self.size = items.words, items.suffix[keep], items.item[keep], items.size[keep]


def flat(batches: list[pa.RecordBatch], items: Items, text: str) -> Iterator[pa.RecordBatch]:
    """Search one shard: consecutive batches whose words are coded together."""
    coded, firsts, total = [], [np.zeros(1, np.int64)], 0
    table = A.byte_table(SEPARATORS)
    for batch in batches:
        raw, offsets = A.joined(batch.column(text))
        codes = table[raw]
        starts, ends, first = A.spans(codes, offsets)
        hashes = A.word_hashes(codes, starts, ends)
        if len(items.vocabulary):
            place = np.minimum(np.searchsorted(items.vocabulary, hashes), len(items.vocabulary) - 1)
            coded.append(np.where(items.vocabulary[place] == hashes, place + 1, 0))
        else:
            coded.append(np.zeros(len(hashes), np.int64))
        firsts.append(first[1:] + total)
        total += len(hashes)
    first = np.concatenate(firsts)
    found = search(np.concatenate(coded), first, items)
    summed = np.r_[0, np.cumsum(found["hit"])]
    lengths = np.diff(first)
    # hit words as runs, so that several blocks of items can be united
    hit = np.r_[False, found["hit"], False]
    edge = np.zeros(len(hit) - 1, bool)
    edge[first] = True
    begin, end = np.flatnonzero(hit[1:] & (edge | ~hit[:-1])), np.flatnonzero(hit[:-1] & (edge | ~hit[1:]))
    at = 0
    for batch in batches:
        rows = slice(at, at + batch.num_rows)
        lo, hi = first[at], first[at + batch.num_rows]
        own = (begin >= lo) & (begin < hi)
        owner = np.searchsorted(first, begin[own], "right") - 1
        runs = pa.StructArray.from_arrays([pa.array((begin[own] - first[owner]).astype(np.int32)), pa.array((end[own] - first[owner]).astype(np.int32))], names=["start", "end"])
        pairs = found["pairs"][(found["pairs"][:, 0] >= at) & (found["pairs"][:, 0] < rows.stop)]
        m = found["matches"][(found["matches"][:, 0] >= at) & (found["matches"][:, 0] < rows.stop)]
        matches = pa.StructArray.from_arrays(
            [pa.array(m[:, 1].astype(np.int32)), pa.array(m[:, 2].astype(np.int32)), pa.array(items.ids[items.item[m[:, 3]]], pa.string()), pa.array(items.offset[m[:, 3]].astype(np.int32))],
            names=["start", "length", "item", "item_start"],
        )
        count = lambda docs: np.bincount(docs - at, minlength=batch.num_rows)
        yield A.of_rows(
            batch,
            _words=pa.array(lengths[rows].astype(np.int64)),
            _hit=pa.array((summed[first[at + 1 : rows.stop + 1]] - summed[first[at : rows.stop]]).astype(np.int64)),
            _runs=A.lists(runs, count(owner)),
            _items=A.lists(pa.array(items.ids[pairs[:, 1]], pa.string()), count(pairs[:, 0])),
            _matches=A.lists(matches, count(m[:, 0])),
        )
        at = rows.stop


def _pass(items: Items, text: str, shard_words: int, slim: bool):
    def run(batches):
        held, size = [], 0

        def out():
            for batch in flat(held, items, text):
                yield batch.drop_columns([text]) if slim else batch

        for whole in batches:
            for batch in A.pieces(whole, text):
                held.append(batch)
                size += int(A.joined(batch.column(text))[1][-1]) // 5
                if size >= shard_words:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    return run


def blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[tuple[list, list]]:
    """Items of a stated query set in blocks of bounded text, streamed to the driver one partition at a time."""
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.col(item).cast("string"), F.col(text)).where(F.col(text).isNotNull()).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1])
        if size >= block_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
    yield ids, texts


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    window: int = WINDOW,
    shard_words: int = SHARD_WORDS,
    block_bytes: int = BLOCK_BYTES,
    keep_text: bool = False,
) -> DataFrame:
    """Documents with what the benchmark left in them.

    Adds n_words, n_hit (words inside an occurrence of any window), items (ids whose windows occur, sorted) and matches
    (longest verbatim matches, every place with every item: start, length, item, item_start, in words). A null or empty text has no words and no hits;
    null or empty items are ignored, equal items are all reported; repeated documents are judged row by row; an empty
    table gives an empty result and an empty benchmark no hits. Other columns of `docs` are kept, `text` on request only;
    columns of these result names are replaced, and extra columns of `benchmark` are not read. A text of any length is
    searched whole; one text must fit a task.
    """
    A.small_batches(docs.sparkSession)
    added = ["n_words", "n_hit", "items", "matches"]
    rows = docs.drop(*added)
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    slim = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text)
    found = f"_words bigint, _hit bigint, _runs array<struct<start:int,end:int>>, _items array<string>, _matches array<{SPAN}>"
    parts = [Items(ids, texts, window) for ids, texts in blocks(benchmark, item, "text", block_bytes)]
    if len(parts) == 1:
        out = rows.mapInArrow(_pass(parts[0], text, shard_words, not keep_text), f"{shape if keep_text else slim}, {found}")
        out = out.withColumnsRenamed({"_words": "n_words", "_hit": "n_hit", "_matches": "matches"}).withColumn("items", F.array_sort(F.array_distinct("_items")))
        return out.drop("_runs", "_items")
    for i, part in enumerate(parts):
        out = rows.mapInArrow(_pass(part, text, shard_words, False), f"{shape}, {found}")
        if i:
            out = out.withColumns({c: F.concat(f"{c}_all", c) for c in ("_runs", "_items", "_matches")}).drop("_runs_all", "_items_all", "_matches_all")
        last = i == len(parts) - 1
        rows = out if last else out.withColumnsRenamed({c: f"{c}_all" for c in ("_runs", "_items", "_matches")}).drop("_words", "_hit")
        shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    # words in the union of the runs: each adds what reaches past all before it
    union = F.aggregate(
        F.array_sort("_runs"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")),
        lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0), r["end"] - F.greatest(s["reach"], r["start"]))).alias("n"), F.greatest(s["reach"], r["end"]).alias("reach")),
    )
    out = rows.withColumn("n_hit", union["n"].cast("bigint")).withColumn("items", F.array_sort(F.array_distinct("_items")))
    out = out.withColumnsRenamed({"_words": "n_words", "_matches": "matches"}).drop("_runs", "_items", "_hit")
    return out if keep_text else out.drop(text)


def contaminated(share: int = 20):
    """A document is contaminated if any word is hit and hits are at least 1 / share of its words."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents without those that are contaminated; same columns and values, same defined cases as `find`."""
    rows, (text,) = by_place(docs, options.pop("text", "text"))
    return as_before(find(rows, benchmark, text=text, keep_text=True, **options).where(~contaminated()), docs)


def digest(found: DataFrame) -> DataFrame:
    """Result columns of the contract."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )
