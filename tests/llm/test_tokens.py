"""Token counts and token shards against the library on whole texts."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lapwing.llm import tokencount, wavelet

BYTES = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
WORDS = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
SPECIAL = [
    "it's we'll they'd DON'T 'sx ''s 's' it'sx I'M x're", "a  b\n\n c \t d\n", "  ", " \n", "İstanbul ﬁ ½ ² 12 345a", "a\u0000b \x1c \x85 é",
    "'", " 's", "\n's", "x\t's", "don''t", "́ x", "é", "\U0001f642\U0001f642 a\U0001f642b", "<|endof", "text|>", "a￿b", "　x　", "ẞǅ",
]


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def shards_of(rows):
    out, start = {}, 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        own = np.array([*ids(WORDS, text), 1], "<u4")
        out.setdefault(key, []).append((start, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    return out


def test_counts_of_odd_texts(spark, odd, none):
    rows = [(i, t) for i, t in enumerate(SPECIAL)] + [(r["doc_id"] + 100, r["text"]) for r in odd.collect()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_tokens", F.lit("clash"))
    got = sorted((r["doc_id"], r["n_tokens"], r["n_bytes"], r["over_limit"]) for r in tokencount.digest(docs).collect())
    want = sorted((k, len(ids(BYTES, t)), len((t or "").encode()), len(ids(BYTES, t)) > 1024) for k, t in rows)
    assert got == want and tokencount.digest(none).count() == 0


def test_counts_of_whole_table(documents, texts):
    got = {r["doc_id"]: r["n_tokens"] for r in tokencount.digest(documents).collect()}
    assert got == {k: len(ids(BYTES, t)) for k, t in texts.items()}


@pytest.mark.parametrize("shard_tokens", [500, 1_000_000])
def test_round_trip(spark, documents, odd, tmp_path, shard_tokens):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()] + [(r["doc_id"] + 1000, r["text"]) for r in odd.collect()] + [(2000 + i, t) for i, t in enumerate(SPECIAL)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    path = str(tmp_path / "tokens")
    wavelet.write(docs, path, shard_tokens=shard_tokens)
    got = {}
    for r in wavelet.read(spark, path).orderBy("start").collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["n_tokens"], r["ids_crc32"]))
    assert got == shards_of(rows)
    value = ids(WORDS, "the")[0]
    whole = np.concatenate([np.array([*ids(WORDS, t), 1]) for _, t in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or ""))])
    places = sorted(r["place"] for r in wavelet.occurrences(spark, path, value).collect())
    assert places == np.flatnonzero(whole == value).tolist()


def test_null_keys_and_empty_table(spark, none, tmp_path):
    rows = [(None, "b"), (3, None), (3, "c"), (1, "a")]
    wavelet.write(spark.createDataFrame(rows, "doc_id bigint, text string"), str(tmp_path / "a"))
    got = {}
    for r in wavelet.read(spark, str(tmp_path / "a")).orderBy("start").collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["n_tokens"], r["ids_crc32"]))
    assert got == shards_of(rows)
    wavelet.write(none, str(tmp_path / "b"))
    assert wavelet.read(spark, str(tmp_path / "b")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 512, 5000])
def test_wavelet_matrix(n):
    rng = np.random.default_rng(n)
    row = rng.integers(0, 37, n).astype(np.uint16)
    m = wavelet.WaveletMatrix.unpack(n, 6, wavelet.WaveletMatrix.of(row, 6).pack())
    assert np.array_equal(m.all(), row)
    if n:
        at = rng.integers(0, n, 50)
        assert np.array_equal(m.access(at), row[at])
    for value in (0, 5, 36, 50):
        places = np.flatnonzero(row == value)
        assert m.count(value) == len(places) and np.array_equal(m.occurrences(value), places)
        for end in (0, n // 3, n):
            assert m.rank(value, end) == (row[:end] == value).sum()
        if len(places):
            assert m.select(value, len(places) - 1) == places[-1]


@pytest.mark.parametrize("bits", [1, 6, 16, 17])
def test_whole_rows_come_back_and_no_places_are_carried_along(bits):
    """Planes of zeros or of ones only, and mixed ones."""
    rng = np.random.default_rng(bits)
    rows = [np.zeros(0), np.zeros(700), np.full(700, (1 << bits) - 1), rng.integers(0, 1 << bits, 5000), rng.integers(0, 1 << bits, 513) | 1]
    for row in rows:
        row = row.astype(np.uint32)
        m = wavelet.WaveletMatrix.unpack(len(row), bits, wavelet.WaveletMatrix.of(row, bits).pack())
        assert np.array_equal(m.all(), row)
    # np.compress is what parts rows of places: none is called on the way back
    calls, compress = [], np.compress
    try:
        np.compress = lambda *a, **b: calls.append(1) or compress(*a, **b)
        m.all()
    finally:
        np.compress = compress
    assert not calls
