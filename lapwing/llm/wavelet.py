"""Token ids in wavelet matrices, one for each shard of documents in key order.

A shard file holds the ids of whole documents as one bit plane per bit of the vocabulary, top bit first. Each plane is the
ids' bits in the order that the planes above it leave (zeros first, then ones), with a count of ones every 512 bits. From
the planes alone come access to any place, the number of occurrences of an id up to a place (rank), the place of its k-th
occurrence (select) and the ids of whole documents. Files are Parquet rows written by Spark, so any file system will do.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lapwing.llm import arrays as A
from lapwing.llm.pretoken import Encoder
from lapwing.session import stage_dir

END = 1
SHARD_TOKENS = 1_000_000
BLOCK = 512
MAGIC = b"LWM1"
HEAD = "<4sIQI"


def parted(row: np.ndarray, one: np.ndarray) -> np.ndarray:
    """The row's entries without a mark, then those with one, each in their order."""
    out, ones = np.empty_like(row), int(np.count_nonzero(one))
    np.compress(~one, row, out=out[: len(row) - ones])
    np.compress(one, row, out=out[len(row) - ones :])
    return out


class WaveletMatrix:
    """Bit planes over unsigned integers below 2**bits."""

    def __init__(self, n: int, planes: list[np.ndarray]):
        self.n, self.planes = n, planes  # packed bits, first bit lowest
        self.ones = [np.r_[0, np.cumsum(self._per_block(p))] for p in planes]
        self.zeros = [n - int(o[-1]) for o in self.ones]

    @staticmethod
    def _per_block(plane: np.ndarray) -> np.ndarray:
        wide = np.zeros(-(-len(plane) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
        wide[: len(plane)] = plane
        return np.bitwise_count(wide.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.int64)

    @classmethod
    def of(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        planes, now = [], ids
        for bit in range(bits - 1, -1, -1):
            one = (now & now.dtype.type(1 << bit)).astype(bool)
            planes.append(np.packbits(one, bitorder="little"))
            now = parted(now, one)
        return cls(len(ids), planes)

    def _rank1(self, level: int, place: np.ndarray) -> np.ndarray:
        """Ones before each place of a plane: the directory, then the words of one block."""
        plane, block = self.planes[level], place // BLOCK
        out = self.ones[level][block].copy()
        for byte in range(BLOCK // 8):
            at = block * (BLOCK // 8) + byte
            whole = at < place // 8
            value = plane[np.minimum(at, max(len(plane) - 1, 0))] if len(plane) else np.zeros(len(place), np.uint8)
            out += np.where(whole, np.bitwise_count(value), 0)
            part = (at == place // 8) & (place % 8 > 0)
            out += np.where(part, np.bitwise_count(value & ((1 << (place % 8)) - 1).astype(np.uint8)), 0)
        return out

    def access(self, places) -> np.ndarray:
        at, out = np.atleast_1d(np.asarray(places, np.int64)).copy(), 0
        for level, plane in enumerate(self.planes):
            one = (plane[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            ones = self._rank1(level, at)
            at = np.where(one == 1, self.zeros[level] + ones, at - ones)
            out = (out << 1) | one.astype(np.int64)
        return out

    def _interval(self, value: int, end: int) -> tuple[int, int]:
        """Where the occurrences of a value before `end` lie below the last plane."""
        lo, hi = np.array([0]), np.array([end])
        for level in range(len(self.planes)):
            if (value >> (len(self.planes) - 1 - level)) & 1:
                lo, hi = self.zeros[level] + self._rank1(level, lo), self.zeros[level] + self._rank1(level, hi)
            else:
                lo, hi = lo - self._rank1(level, lo), hi - self._rank1(level, hi)
        return int(lo[0]), int(hi[0])

    def rank(self, value: int, end: int) -> int:
        """Occurrences of a value before a place."""
        lo, hi = self._interval(value, end)
        return hi - lo

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def bits_of(self, level: int) -> np.ndarray:
        return np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)

    def occurrences(self, value: int) -> np.ndarray:
        """All places of a value, in order: its interval below the last plane, taken back up through the planes."""
        lo, hi = self._interval(value, self.n)
        at = np.arange(lo, hi)
        for level in range(len(self.planes) - 1, -1, -1):
            one = (value >> (len(self.planes) - 1 - level)) & 1
            bits = self.bits_of(level)
            at = np.flatnonzero(bits)[at - self.zeros[level]] if one else np.flatnonzero(~bits)[at]
        return np.sort(at)

    def select(self, value: int, k: int) -> int:
        """Place of the k-th occurrence, from 0."""
        return int(self.occurrences(value)[k])

    def all(self) -> np.ndarray:
        """The whole row of ids, from the last plane up: the bits known so far go back to where they stood above a plane."""
        kind, last = np.uint16 if len(self.planes) <= 16 else np.uint32, len(self.planes) - 1
        now = np.zeros(self.n, kind)
        for level in range(last, -1, -1):
            one, zeros = self.bits_of(level), self.zeros[level]
            now[zeros:] |= kind(1 << (last - level))
            if 0 < zeros < self.n:
                above = np.empty_like(now)
                above[np.flatnonzero(~one)] = now[:zeros]
                above[np.flatnonzero(one)] = now[zeros:]
                now = above
        return now

    def pack(self) -> bytes:
        """The directory of counts is made again on reading."""
        return b"".join(p.tobytes() for p in self.planes)

    @classmethod
    def unpack(cls, n: int, bits: int, data: bytes) -> WaveletMatrix:
        size = -(-n // 8)
        raw = np.frombuffer(data, np.uint8)
        return cls(n, [raw[i * size : (i + 1) * size] for i in range(bits)])


def encode_shard(keys: np.ndarray, valid: np.ndarray, lengths: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    """Header, keys, lengths, planes; keys and lengths are deflated, planes of ids do not shrink."""
    kind = np.uint16 if bits <= 16 else np.uint32
    meta = zlib.compress(keys.astype("<i8").tobytes() + valid.astype(np.uint8).tobytes() + lengths.astype("<u4").tobytes(), 1)
    planes = WaveletMatrix.of(ids.astype(kind), bits).pack()
    return struct.pack(HEAD, MAGIC, bits, len(ids), len(keys)) + struct.pack("<I", len(meta)) + meta + planes


def decode_shard(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, WaveletMatrix]:
    """Keys, whether each is given, lengths of documents, the ids' wavelet matrix."""
    magic, bits, n, docs = struct.unpack_from(HEAD, blob)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    at = struct.calcsize(HEAD)
    (size,) = struct.unpack_from("<I", blob, at)
    meta = zlib.decompress(blob[at + 4 : at + 4 + size])
    keys, valid = np.frombuffer(meta, "<i8", docs), np.frombuffer(meta, np.uint8, docs, 8 * docs)
    return keys, valid == 1, np.frombuffer(meta, "<u4", docs, 9 * docs), WaveletMatrix.unpack(n, bits, blob[at + 4 + size :])


def _encode(tokenizer: str, key: str, text: str, shard_tokens: int):
    def run(batches):
        from pyspark import TaskContext

        encoder = Encoder(tokenizer, drops_space=True)
        bits = max(1, int(encoder.tokenizer.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        part, number, ahead = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []
        size = 0

        def close():
            keys, valid, lengths, ids = (np.concatenate(x) for x in zip(*held))
            blob = encode_shard(keys, valid, lengths, ids, bits)
            columns = [[part], [number], [len(keys)], [len(ids)], [ahead], [blob]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "number", "docs", "tokens", "ahead", "blob"])

        for whole in batches:
            for batch in A.pieces(whole, text):
                ids, n = encoder.ids(batch.column(text))
                ends = np.cumsum(n)
                with_end = np.insert(ids, ends, END)
                keys = batch.column(key)
                held.append((keys.fill_null(0).to_numpy(zero_copy_only=False), np.array(keys.is_valid()), n + 1, with_end))
                size += len(with_end)
                if size >= shard_tokens:
                    yield close()
                    held, size, number, ahead = [], 0, number + 1, ahead + size
        if held:
            yield close()

    return run


def write(docs: DataFrame, path: str, tokenizer: str | None = None, key: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode every text, append the end id, and write shards in ascending key order to `path`, one row of a file each.

    Null texts are empty; null keys come first; repeated rows are written each, rows with one key in order of their texts;
    special strings inside a text are encoded as the library does it. `key` is a bigint; no other column is read. An
    empty table writes no shard. `tokenizer` must be a path that executors can read; one text must fit a task.
    """
    spark = A.small_batches(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("bigint").alias(key), text)
    rows = rows.repartitionByRange(parts, key).sortWithinPartitions(key, text)
    shape = "part int, number int, docs bigint, tokens bigint, ahead bigint, blob binary"
    shards = rows.mapInArrow(_encode(tokenizer or public_tokenizers.path("word_bpe_49k.json"), key, text, shard_tokens), shape)
    shards.write.option("maxRecordsPerFile", 8).parquet(path)


def _decode(key: str):
    def run(batches):
        for batch in batches:
            for blob, start in zip(batch.column("blob"), batch.column("start")):
                keys, valid, lengths, matrix = decode_shard(blob.as_py())
                ids = matrix.all().astype("<u4")
                ends = np.cumsum(lengths, dtype=np.int64)
                begins = ends - lengths
                view = memoryview(ids.view(np.uint8))
                crc = np.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, mask=~valid), pa.array(begins + start.as_py()), pa.array(lengths.astype(np.int64)), pa.array(crc)],
                    names=[key, "start", "n_tokens", "ids_crc32"],
                )

    return run


def shards(spark: SparkSession, path: str) -> DataFrame:
    """Shards of a folder with `start`: tokens in all shards before. Parts come in key order, and a shard knows the tokens
    ahead of it in its part, so only the offsets of parts, one small row each, are sent; no shard is."""
    rows = spark.read.parquet(path)
    sizes = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.sum("tokens").alias("n")).collect())
    ahead = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    offsets = spark.createDataFrame([(p, a) for (p, _), a in zip(sizes, ahead)] or [(0, 0)], "part int, _ahead bigint")
    return rows.join(F.broadcast(offsets), "part").withColumn("start", F.col("_ahead") + F.col("ahead"))


def read(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Per document of a folder: key, start (tokens of all documents before it), n_tokens with the end id, ids_crc32."""
    slim = shards(spark, path).select("blob", "start")
    return slim.mapInArrow(_decode(key), f"{key} bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _lookup(value: int):
    def run(batches):
        for batch in batches:
            for blob, start in zip(batch.column("blob"), batch.column("start")):
                at = decode_shard(blob.as_py())[3].occurrences(value)
                yield pa.RecordBatch.from_arrays([pa.array(at + start.as_py())], names=["place"])

    return run


def occurrences(spark: SparkSession, path: str, value: int) -> DataFrame:
    """Places of a token id in the whole row of ids."""
    return shards(spark, path).select("blob", "start").mapInArrow(_lookup(value), "place bigint")


def digest(docs: DataFrame) -> DataFrame:
    """Write the shards to the shared folder, read them back: result columns of the contract."""
    spark = docs.sparkSession
    path = f"{stage_dir(spark)}/lapwing/tokens-{uuid.uuid4().hex}"
    write(docs, path)
    return read(spark, path)
