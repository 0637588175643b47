"""Quality by a generalised additive model with pairwise interactions.

Numbers that describe a text are cut into bins. Boosting goes round the features and fits a shallow tree to one feature at a
time; the trees of a feature add up to a lookup table. Then tables of the pairs that explain most of what is left are
boosted in the same way. A score is the logistic of the sum of one entry per table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lapwing.llm import arrays as A
from lapwing.session import stage

FEATURES = [
    "log_words", "word_length", "symbols", "stops", "pipes", "marks", "distinct", "top_word", "upper", "digits",
    "lines", "repeated_lines", "repeated_trigrams", "single_letters", "symbol_words",
]
SAMPLE_ROWS = 20_000
BINS = 32
COARSE = 8
ROUNDS = 60
RATE = 0.2
LEAVES = 4
PAIRS = 5
#: Bytes that part words.
BLANKS = np.r_[0:33]


def repeats(doc: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document: distinct values, and rows of the most frequent one."""
    order = np.lexsort((value, doc))
    d, v = doc[order], value[order]
    new = np.r_[True, (d[1:] != d[:-1]) | (v[1:] != v[:-1])] if len(d) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    times = np.diff(np.r_[at, len(d)])
    most = np.zeros(n, np.int64)
    np.maximum.at(most, d[at], times)
    return np.bincount(d[at], minlength=n), most


def features(texts: pa.Array) -> np.ndarray:
    """One row of numbers per text, in the order of FEATURES; null and empty texts give zeros."""
    raw, offsets = A.joined(texts)
    n, size = len(offsets) - 1, np.maximum(np.diff(offsets), 1)
    share = lambda table: (s := np.r_[0, np.cumsum(table[raw])], (s[offsets[1:]] - s[offsets[:-1]]) / size)[1]

    def bytes_of(values) -> np.ndarray:
        table = np.zeros(256, np.int64)
        table[np.frombuffer(values, np.uint8) if isinstance(values, bytes) else values] = 1
        return table

    odd = np.array([b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"()-?!"])
    codes = raw.copy()
    codes[np.isin(codes, BLANKS.astype(np.uint8))] = 0
    starts, ends, first = A.spans(codes, offsets)
    words = A.word_hashes(codes, starts, ends)
    count = np.diff(first)
    some = np.maximum(count, 1)
    doc = np.repeat(np.arange(n), count)
    distinct, top = repeats(doc, words, n)
    tri_doc = doc[:-2][doc[:-2] == doc[2:]] if len(doc) > 2 else doc[:0]
    tri = (A.mixed(words[:-2] * np.uint64(A.MULTIPLIER) + words[1:-1]) * np.uint64(A.MULTIPLIER) + words[2:])[doc[:-2] == doc[2:]] if len(doc) > 2 else words[:0]
    tri_distinct, _ = repeats(tri_doc, tri, n)
    tri_count = np.bincount(tri_doc, minlength=n)
    ended = raw.copy()
    ended[raw == 0] = 1
    ended[raw == 10] = 0
    line_start, line_end, line_first = A.spans(ended, offsets)
    lines = np.diff(line_first)
    line_doc = np.repeat(np.arange(n), lines)
    line_distinct, _ = repeats(line_doc, A.word_hashes(ended, line_start, line_end), n)
    by_doc = lambda flags: np.bincount(doc[flags], minlength=n) / some
    is_odd = np.zeros(256, bool)
    is_odd[odd] = True
    last = raw[ends - 1] if len(ends) else raw[:0]
    columns = [
        np.log1p(count), np.diff(offsets) / some, share(bytes_of(odd)), share(bytes_of(b".,")), share(bytes_of(b"|")), share(bytes_of(b"!")),
        distinct / some, top / some, share(bytes_of(np.arange(65, 91))), share(bytes_of(np.arange(48, 58))),
        lines / some, 1 - line_distinct / np.maximum(lines, 1), 1 - tri_distinct / np.maximum(tri_count, 1), by_doc(ends - starts == 1), by_doc(is_odd[last]),
    ]
    out = np.stack(columns, 1).astype(float)
    out[count == 0] = 0
    return out


def _described(text: str):
    def run(batches):
        for whole in batches:
            for batch in A.pieces(whole, text):
                values = features(batch.column(text))
                yield A.of_rows(batch.drop_columns([text]), **{f: pa.array(values[:, i]) for i, f in enumerate(FEATURES)})

    return run


def describe(docs: DataFrame, text: str = "text") -> DataFrame:
    """Columns of `docs` but the text, with one column per feature; columns called like features are replaced."""
    A.small_batches(docs.sparkSession)
    rows = docs.drop(*FEATURES)
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text)
    return rows.mapInArrow(_described(text), shape + "".join(f", {f} double" for f in FEATURES))


class Model:
    """Intercept, bin edges and lookup tables; scores are sums of table entries."""

    def __init__(self, intercept: float, edges: list, tables: list, pairs: list):
        self.intercept, self.edges, self.tables, self.pairs = intercept, edges, tables, pairs

    def bins(self, values: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, values[:, i], "right") for i, e in enumerate(self.edges)], 1)

    def score(self, values: np.ndarray) -> np.ndarray:
        bins, total = self.bins(values), np.full(len(values), self.intercept)
        for i, table in enumerate(self.tables):
            total += table[bins[:, i]]
        for i, j, table in self.pairs:
            total += table[bins[:, i] * COARSE // BINS, bins[:, j] * COARSE // BINS]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def tree_1d(gradient: np.ndarray, weight: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Best-first tree over bins in order: a value per bin. Splits where the gain in squared gradient is largest."""
    g, h = np.r_[0, np.cumsum(gradient)], np.r_[0, np.cumsum(weight)]
    worth = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)
    parts = [(0, len(gradient))]
    while len(parts) < leaves:
        best = (1e-6, None, None)
        for a, b in parts:
            cut = np.arange(a + 1, b)
            if len(cut):
                gain = worth(a, cut) + worth(cut, b) - worth(a, b)
                if gain.max() > best[0]:
                    best = (gain.max(), (a, b), int(cut[gain.argmax()]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(gradient))
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return out


def fit(values: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE, pairs: int = PAIRS) -> Model:
    """Boost tables on one bounded sample. Without rows or with one label only, the model is the prior alone."""
    prior = (y.sum() + 1) / (len(y) + 2)
    # half of the cuts by rows, half by distinct values, as most texts have none of some characters
    shares = np.linspace(0, 1, BINS // 2 + 1)[1:-1]
    cuts = lambda v: np.unique(np.concatenate([np.quantile(v, shares), np.quantile(np.unique(v), shares)]))
    edges = [cuts(values[:, i]) if len(y) else np.zeros(0) for i in range(len(FEATURES))]
    model = Model(float(np.log(prior / (1 - prior))), edges, [np.zeros(BINS) for _ in FEATURES], [])
    if not 0 < y.sum() < len(y):
        return model
    bins, total = model.bins(values), np.full(len(y), model.intercept)
    slope = lambda: (p := 1 / (1 + np.exp(-total)), (y - p, p * (1 - p)))[1]
    for _ in range(rounds):
        for i in range(len(FEATURES)):
            g, h = slope()
            step = rate * tree_1d(np.bincount(bins[:, i], g, BINS), np.bincount(bins[:, i], h, BINS))
            model.tables[i] += step
            total += step[bins[:, i]]
    coarse = bins * COARSE // BINS
    cell = lambda i, j: coarse[:, i] * COARSE + coarse[:, j]

    def gains(i, j):
        g, h = slope()
        a, b = np.bincount(cell(i, j), g, COARSE**2), np.bincount(cell(i, j), h, COARSE**2)
        return (a**2 / (b + 1.0)).sum()

    ranked = sorted(((gains(i, j), i, j) for i in range(len(FEATURES)) for j in range(i)), reverse=True)[:pairs]
    model.pairs = [(i, j, np.zeros((COARSE, COARSE))) for _, i, j in ranked]
    for _ in range(rounds // 2):
        for i, j, table in model.pairs:
            g, h = slope()
            a, b = (np.bincount(cell(i, j), x, COARSE**2).reshape(COARSE, COARSE) for x in (g, h))
            step = rate * quadrants(a, b)
            table += step
            total += step.reshape(-1)[cell(i, j)]
    return model


def quadrants(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Depth-two tree over two axes: the pair of cuts whose four quadrants gain most."""
    size = len(gradient)
    g, h = (np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for x in (gradient, weight))
    best, out = -1.0, np.zeros_like(gradient)
    for a in range(1, size):
        for b in range(1, size):
            value, gain = np.zeros((2, 2)), 0.0
            for r, (lo, hi) in enumerate(((0, a), (a, size))):
                for c, (left, right) in enumerate(((0, b), (b, size))):
                    sums = [x[hi, right] - x[lo, right] - x[hi, left] + x[lo, left] for x in (g, h)]
                    value[r, c] = sums[0] / (sums[1] + 1.0)
                    gain += sums[0] ** 2 / (sums[1] + 1.0)
            if gain > best:
                best, out = gain, value[np.ix_((np.arange(size) >= a).astype(int), (np.arange(size) >= b).astype(int))]
    return out


def learn(described: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most `sample_rows` labelled rows, the first by a digest of the key; all of them where there are fewer.

    Null labels teach nothing; a key with several labels counts once for each.
    """
    chosen = labels.select(F.col(key).alias("_key"), F.col(label).alias("_label")).where("_key is not null and _label is not null")
    chosen = chosen.orderBy(F.xxhash64("_key"), "_key").limit(sample_rows)
    rows = described.select(F.col(key).alias("_key"), *FEATURES).join(F.broadcast(chosen), "_key")  # at most sample_rows pairs of numbers
    sample = rows.orderBy("_key", *FEATURES).limit(4 * sample_rows).toPandas()
    return fit(sample[FEATURES].to_numpy(float), sample["_label"].to_numpy(float))


def score(described: DataFrame, model: Model) -> DataFrame:
    """Described rows with score (0 to 1); features are dropped. Null and empty texts get the score of all-zero features."""

    @F.pandas_udf("double")
    def of(*columns: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack([c.to_numpy(float) for c in columns], 1)))

    return described.withColumn("score", of(*FEATURES)).drop(*FEATURES)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Columns of `docs` but the text, with score. `labels` holds only what may be learned from.

    Texts are read once; their features are staged. Repeated rows are scored each; an empty table stays empty; columns
    called like features or `score` are replaced.
    """
    described = stage(describe(docs.drop("score"), text), "features")
    return score(described, learn(described, labels, key, label, sample_rows))
