"""Language identification with hyperdimensional profiles.

Each letter has a random +-1 vector that depends on its code point alone. A letter vector is rotated by its place in an
n-gram, the rotated vectors are multiplied (bound) into one n-gram vector, and the n-gram vectors of a text are added
(bundled). The prototype of a language is the sum of its texts' unit vectors; a text gets the language whose prototype has
the largest cosine with it. Bundling is linear, so prototypes merge map-side by plain vector sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from lapwing.llm import arrays as A

DIMENSIONS = 1024
GRAM = 3
SEED = 17
ROWS = 64  # texts per matrix product
STEP = 8192  # n-grams per matrix product
HELD = 16_384  # n-gram vectors that a task keeps
BITS = 18  # code points that are letters get dense codes below 2^18


class Codebook:
    """Codes of letters, vectors of letters and n-grams, made on demand from code points."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        self.code = np.zeros(0x110000, np.int32)  # 0: not seen yet, 1: no letter
        self.letters = np.stack([np.ones(dimensions, np.int8), self.letter(ord(" "))])
        self.rows, self.vectors = {}, np.zeros((0, dimensions), np.float32)

    def letter(self, point: int) -> np.ndarray:
        bits = np.random.Generator(np.random.PCG64([self.seed, point])).integers(0, 2, self.dimensions)
        return (2 * bits - 1).astype(np.int8)

    def codes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the lower-case letters, each stretch of other characters as one blank, a blank at each end of a text;
        where each text begins; whether it has a letter. A text is lower-cased by itself."""
        lowered = [t.lower() if t else "" for t in texts.to_pylist()]
        n = len(lowered)
        points = np.frombuffer((" " + "  ".join(lowered) + " ").encode("utf-32-le"), np.uint32)
        starts = np.r_[0, np.cumsum(np.array([len(t) + 2 for t in lowered], np.int64))]
        code = self.code[points]
        if not code.all():
            new = np.unique(points[code == 0]).tolist()
            found = [p for p in new if chr(p).isalpha()]
            self.code[new] = 1
            self.code[found] = len(self.letters) + np.arange(len(found))
            if found:
                self.letters = np.concatenate([self.letters, np.stack([self.letter(p) for p in found])])
            code = self.code[points]
        keep = np.ones(len(code), bool)
        keep[1:] = (code[1:] != 1) | (code[:-1] != 1)
        keep[starts[:-1]] = True
        bounds = np.r_[0, np.cumsum(np.add.reduceat(keep, starts[:-1], dtype=np.int64))]
        return code[keep], bounds, np.maximum.reduceat(code, starts[:-1]) > 1

    def grams(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text and n-gram (as a place among the distinct ones) of each occurrence, the distinct n-grams, which texts have letters."""
        code, bounds, has = self.codes(texts)
        gram = np.zeros(max(len(code) - GRAM + 1, 0), np.int64)
        inside = np.ones(len(gram) + GRAM, bool)
        for k in range(GRAM):
            gram = (gram << BITS) | code[k : k + len(gram)]
            if k:
                inside[np.maximum(bounds[1:] - k, 0)] = False  # would reach into the next text
        count = np.where(has, np.maximum(np.diff(bounds) - GRAM + 1, 0), 0)
        inside = inside[: len(gram)]
        if not has.all():
            inside &= np.repeat(has, np.diff(bounds))[: len(gram)]
        coded = pa.array(gram[inside]).dictionary_encode()
        return np.repeat(np.arange(len(has)), count), coded.indices.to_numpy(), coded.dictionary.to_numpy(), has

    def bound(self, grams: np.ndarray) -> np.ndarray:
        """One row per n-gram: the product of its letters' vectors, each rotated by its place."""
        if len(self.rows) + len(grams) > HELD:
            self.rows = {}
        new = np.array([g for g in grams.tolist() if g not in self.rows], np.int64)
        if len(new):
            made = np.ones((len(new), self.dimensions), np.int8)
            for k in range(GRAM):
                letter = (new >> (BITS * (GRAM - 1 - k))) & ((1 << BITS) - 1)
                made *= np.roll(self.letters[letter], k, axis=1)
            held, size = len(self.rows), len(self.rows) + len(new)
            if size > len(self.vectors):
                larger = np.empty((min(HELD, 2 * size), self.dimensions), np.float32)
                larger[:held] = self.vectors[:held]
                self.vectors = larger
            self.vectors[held:size] = made
            self.rows.update(zip(new.tolist(), range(held, size)))
        return self.vectors[[self.rows[g] for g in grams.tolist()]]

    def bundle(self, row: np.ndarray, column: np.ndarray, grams: np.ndarray, n: int, weight: np.ndarray | None = None) -> np.ndarray:
        """Sums of n-gram vectors by row, each occurrence with its weight."""
        out = np.zeros((n, self.dimensions), np.float32 if weight is None else np.float64)
        for low in range(0, len(grams), STEP):
            width = min(STEP, len(grams) - low)
            cell, own = row * width + column - low, weight
            if len(grams) > STEP:
                part = (column >= low) & (column < low + width)
                cell, own = cell[part], None if weight is None else weight[part]
            counts = np.bincount(cell, own, n * width).reshape(n, width)
            out += counts.astype(np.float32) @ self.bound(grams[low : low + width])
        return out

    def documents(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Unit vector of each text (0 without letters), and whether it has a letter."""
        row, column, grams, has = self.grams(texts)
        out = self.bundle(row, column, grams, len(has))
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, size, out=np.zeros_like(out), where=size > 0), has


def _sums(text: str, lang: str, dimensions: int, seed: int):
    def run(batches):
        book, sums = Codebook(dimensions, seed), {}
        for batch in batches:
            for part in A.pieces(batch, text):
                row, column, grams, has = book.grams(part.column(text))
                langs, own = np.unique(np.array(part.column(lang).to_pylist(), object), return_inverse=True)
                share = 1 / np.maximum(np.bincount(row, minlength=len(has)), 1)
                totals = book.bundle(own[row], column, grams, len(langs), share[row])
                texts = np.bincount(own[has], minlength=len(langs))
                for name, total, n in zip(langs, totals, texts.tolist()):
                    if n:
                        before, count = sums.get(name, (0, 0))
                        sums[name] = (before + total, count + n)
        names = list(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([sums[x][0] for x in names], pa.list_(pa.float64())), pa.array([sums[x][1] for x in names], pa.int64())],
            names=["lang", "total", "n"],
        )

    return run


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """One prototype vector per language: (lang, prototype, n). Each task sends one sum for each of its languages.

    Rows without language, text or letter teach nothing; an empty table gives no prototypes.
    """
    A.small_batches(docs.sparkSession)
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    parts = rows.mapInArrow(_sums("text", "lang", dimensions, seed), "lang string, total array<double>, n bigint")
    merged = parts.groupBy("lang").agg(Summarizer.sum(array_to_vector("total")).alias("total"), F.sum("n").alias("n"))
    return merged.select("lang", vector_to_array("total").alias("prototype"), "n")


def _cosines(text: str, names: list, prototypes: np.ndarray, dimensions: int, seed: int):
    def run(batches):
        book = Codebook(dimensions, seed)
        for batch in batches:
            for part in (piece.slice(at, ROWS) for piece in A.pieces(batch, text) for at in range(0, piece.num_rows, ROWS)):
                best, score = np.full(part.num_rows, None, object), np.zeros(part.num_rows)
                vectors, has = book.documents(part.column(text))
                if names:
                    cosines = vectors @ prototypes.T
                    first = cosines.argmax(1)
                    best = np.array(names, object)[first]
                    score = np.clip(cosines[np.arange(len(first)), first], 0, 1).astype(float)
                best[~has], score[~has] = "und", 0.0
                kept = part.drop_columns([text])
                yield A.of_rows(kept, lang_pred=pa.array(best, pa.string()), score=pa.array(score, pa.float64()))

    return run


def predict(docs: DataFrame, prototypes: DataFrame, text: str = "text", dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """Columns of `docs` but the text, with lang_pred and score (cosine with the nearest prototype, 0 to 1).

    A text that is null or has no letter is `und` with score 0; ties go to the first language by name; without any
    prototype, texts with letters get null. Columns that are called like the results are replaced. The driver and the
    tasks hold one vector per language.
    """
    A.small_batches(docs.sparkSession)
    learned = sorted((r["lang"], r["prototype"]) for r in prototypes.select("lang", "prototype").collect())
    vectors = np.array([p for _, p in learned], np.float32).reshape(len(learned), dimensions)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    rows = docs.drop("lang_pred", "score")
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text)
    return rows.mapInArrow(_cosines(text, [x for x, _ in learned], vectors, dimensions, seed), f"{shape}, lang_pred string, score double")


def held_out(key: str = "doc_id", folds: int = 5) -> Column:
    """Rows that no model may learn from: crc32 of the id as text divides evenly."""
    return F.crc32(F.col(key).cast("string")) % folds == 0
