"""Token ids in files: one wavelet matrix (Claude, Navarro and Ordonez, 2015) for each shard.

A shard is one row of a Parquet table: its documents' ids and lengths, and the ids of all their tokens as 16 bit
planes, from the highest bit down; each plane lists the tokens as the planes above have sorted them, zeros first.
With the counts of ones every 512 bits, which the file holds too, any token (token_at), the count of an id (count_tokens)
and the place of its k-th occurrence (find_tokens) are found from the planes, without decoding the others.  Parquet's
zstd shrinks the planes.  Files are in ascending doc_id order by name, and so are the shards in them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, shared_path, staged, table, text_of
from .words import VOCABULARY, encoder, forget

BITS = 16
#: Tokens of a shard; it ends with the document that reaches this.
SHARD = 1 << 17
#: Tokens of a file, about.
FILE = 1 << 23
#: Bytes of a row group: a reader holds one at a time.
GROUP = 4 << 20
END = 2


class WaveletMatrix:
    """Access, counting and occurrence lookup over a sequence of 16-bit ids."""

    STEP = 64  # bytes of a plane between two counts

    def __init__(self, n: int, planes: bytes, ranks: bytes):
        self.n, self.width = n, -(-n // 8)
        self.planes = np.frombuffer(planes, np.uint8).reshape(BITS, self.width)
        self.counts = np.frombuffer(ranks, "<i8").reshape(BITS, -1)
        self.zeros = n - self.counts[:, -1]

    @classmethod
    def build(cls, ids: np.ndarray) -> tuple[bytes, bytes]:
        """The planes, and for each the ones before every STEP-th byte and in all."""
        planes, x = [], ids.astype(np.uint16)
        for level in range(BITS - 1, -1, -1):
            one = (x & np.uint16(1 << level)) != 0
            planes.append(np.packbits(one, bitorder="little").tobytes())
            x = np.concatenate([np.compress(~one, x), np.compress(one, x)])
        width = -(-len(ids) // 8)
        padded = np.zeros((BITS, -(-width // cls.STEP) * cls.STEP), np.uint8)
        padded[:, :width] = np.frombuffer(b"".join(planes), np.uint8).reshape(BITS, width)
        sums = np.bitwise_count(padded).reshape(BITS, -1, cls.STEP).sum(2, dtype=np.int64)
        ranks = np.concatenate([np.zeros((BITS, 1), np.int64), np.cumsum(sums, 1)], 1)
        return b"".join(planes), ranks.astype("<i8").tobytes()

    def ids(self) -> np.ndarray:
        """The whole sequence."""
        x = np.zeros(self.n, np.uint16)
        for k in range(BITS - 1, -1, -1):
            one = np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)
            before = np.empty_like(x)
            before[np.flatnonzero(~one)] = x[: self.zeros[k]]
            before[np.flatnonzero(one)] = x[self.zeros[k] :] | np.uint16(1 << (BITS - 1 - k))
            x = before
        return x

    def _ones(self, k: int, i: int) -> int:
        """Ones of plane k before place i."""
        block, byte = i // (8 * self.STEP), i // 8
        found = self.counts[k, block] + int(np.bitwise_count(self.planes[k, block * self.STEP : byte]).sum())
        return int(found) + (int(self.planes[k, byte] & ((1 << i % 8) - 1)).bit_count() if i % 8 else 0)

    def _select(self, k: int, bit: int, j: int) -> int:
        """Place of the j-th (from 0) `bit` of plane k."""
        at = np.arange(self.counts.shape[1]) * 8 * self.STEP
        before = self.counts[k] if bit else np.minimum(at, self.n) - self.counts[k]
        block = int(np.searchsorted(before, j, side="right")) - 1
        part = np.unpackbits(self.planes[k, block * self.STEP : (block + 1) * self.STEP], bitorder="little")[: self.n - block * 8 * self.STEP]
        return block * 8 * self.STEP + int(np.flatnonzero(part == bit)[j - before[block]])

    def __getitem__(self, i: int) -> int:
        value = 0
        for k in range(BITS):
            one, before = int(self.planes[k, i // 8]) >> i % 8 & 1, self._ones(k, i)
            value, i = value << 1 | one, int(self.zeros[k]) + before if one else i - before
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        lo, hi = 0, end
        for k in range(BITS):
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo, hi = (int(self.zeros[k]) + a, int(self.zeros[k]) + b) if token >> (BITS - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, end: int | None = None) -> int:
        """Occurrences of token before place `end`."""
        lo, hi = self._range(token, self.n if end is None else end)
        return hi - lo

    def find(self, token: int, j: int) -> int:
        """Place of the j-th occurrence, from 0; -1 if there are fewer."""
        lo, hi = self._range(token, self.n)
        if j >= hi - lo:
            return -1
        i = lo + j
        for k in range(BITS - 1, -1, -1):
            one = token >> (BITS - 1 - k) & 1
            i = self._select(k, one, i - int(self.zeros[k]) if one else i)
        return i


def _tokens(batches: Iterator[pa.RecordBatch], vocabulary: str, end: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, n = encoder(vocabulary).encode(b["text"])
        to = np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)
        out = np.full(len(ids) + len(n), end, "<u2")
        out[to] = ids
        offsets = np.concatenate([[0], np.cumsum(2 * (n + 1))]).astype(np.int64)
        data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(out)])
        yield pa.RecordBatch.from_arrays([b["doc_id"], data.cast(pa.binary())], ["doc_id", "ids"])


SHARDS = "file int, shard int, before long, n long, doc_ids array<long>, lengths array<long>, planes binary, ranks binary"
NAMES = [x.split()[0] for x in SHARDS.split(", ")]
TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by doc_id.  A shard ends with the document that fills it; no more than one is held."""
    forget()
    file, shard, before, docs, parts, size = TaskContext.get().partitionId(), 0, 0, [], [], 0

    def shard_row() -> pa.RecordBatch:
        row = (file, shard, before, size, docs, [len(x) // 2 for x in parts], *WaveletMatrix.build(np.frombuffer(b"".join(parts), "<u2")))
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, TYPES, strict=True)], NAMES)

    for b in batches:
        for doc, x in zip(b["doc_id"].to_pylist(), b["ids"], strict=True):
            if size >= SHARD:
                yield shard_row()
                shard, before, docs, parts, size = shard + 1, before + size, [], [], 0
            ids = x.as_buffer().to_pybytes()
            docs.append(doc)
            parts.append(ids)
            size += len(ids) // 2
    if parts:
        yield shard_row()


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = END, file_tokens: int = FILE) -> None:
    """Encodes each whole text, adds the id `end` and writes all ids at path in ascending doc_id order.

    docs needs doc_id and text; other columns are ignored.  A null text is empty, and so only the end id.  A null
    doc_id sorts first; rows of one doc_id are in order of a hash of their ids, so many rows of one (or no) doc_id
    are split over files like any others.  An empty table gives an empty file.
    """
    cut = docs.select("doc_id", text_of(docs).alias("text"))
    tokens = staged(cut.mapInArrow(partial(_tokens, vocabulary=vocabulary, end=end), "doc_id long, ids binary"), "encoded")
    total = tokens.agg(F.sum(F.octet_length("ids") / 2).alias("n")).first()["n"] or 0
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("ids"), F.col("ids")]
    ordered = tokens.repartitionByRange(max(1, -(-int(total) // file_tokens)), *order[:2]).sortWithinPartitions(*order)
    ordered.mapInArrow(_shards, SHARDS).write.option("compression", "zstd").option("parquet.block.size", GROUP).parquet(path)
    discard(tokens)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for b in batches:
        for file, before, n, docs, lengths, planes, ranks in zip(*(b[c] for c in ("file", "before", "n", "doc_ids", "lengths", "planes", "ranks")), strict=True):
            ids = WaveletMatrix(n.as_py(), planes.as_buffer(), ranks.as_buffer()).ids().astype("<u4").tobytes()
            size = np.asarray(lengths.values, np.int64)
            ends = 4 * np.cumsum(size)
            crc = [zlib.crc32(memoryview(ids)[hi - 4 * k : hi]) for k, hi in zip(size.tolist(), ends.tolist(), strict=True)]
            start = before.as_py() + ends // 4 - size
            yield pa.RecordBatch.from_arrays([pa.array([file.as_py()] * len(size), pa.int32()), docs.values, pa.array(start), pa.array(size), pa.array(crc, pa.int64())], ["file", "doc_id", "start", "n_tokens", "ids_crc32"])


def _earlier(files: DataFrame) -> DataFrame:
    """(file, earlier): the tokens of all files before it.  As many rows as there are files."""
    sizes = files.groupBy("file").agg(F.sum("n").alias("n"))
    return sizes.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("earlier"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """From the files: one row for each document: doc_id, start, n_tokens, ids_crc32.

    Null ids and repeated rows come as they were written; of equal ids the order is that of the files, and start tells it.
    Files of an empty table give no row.
    """
    files = spark.read.parquet(path)
    rows = files.mapInArrow(_read, "file int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(_earlier(files), "file").select("doc_id", (F.col("start") + F.col("earlier")).alias("start"), "n_tokens", "ids_crc32")


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards with questions (token, at): the token there if token is null, else the place of the at-th occurrence of token."""
    for b in batches:
        for n, planes, ranks, start, asked in zip(*(b[c] for c in ("n", "planes", "ranks", "start", "asked")), strict=True):
            matrix, start = WaveletMatrix(n.as_py(), planes.as_buffer(), ranks.as_buffer()), start.as_py()
            rows = [(q["token"], q["at"], q["key"], matrix[q["at"]] if q["token"] is None else start + matrix.find(q["token"], q["at"])) for q in asked.as_py()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["token", "at", "key", "answer"])


def _answers(files: DataFrame, questions: DataFrame) -> DataFrame:
    """questions (file, shard, token, at, key), distinct.  A shard's questions are no more than its tokens: one row for each shard."""
    asked = questions.groupBy("file", "shard").agg(F.collect_list(F.struct("token", "at", "key")).alias("asked"))
    rows = files.join(asked, ["file", "shard"]).join(_earlier(files), "file").withColumn("start", F.col("before") + F.col("earlier"))
    return rows.select("n", "planes", "ranks", "start", "asked").mapInArrow(_asked, "token long, at long, key long, answer long")


def token_at(files: DataFrame, places: DataFrame) -> DataFrame:
    """files: what write_tokens wrote.  places (place).  (place, token) of each distinct place; null past the end."""
    shards = files.select("file", "shard", "before", "n").join(_earlier(files), "file").select("file", "shard", (F.col("before") + F.col("earlier")).alias("start"), "n")
    blocks = F.sequence(F.floor(F.col("start") / SHARD), F.floor((F.col("start") + F.col("n") - 1) / SHARD))
    shards = shards.where("n > 0").withColumn("block", F.explode(blocks))
    wanted = places.select("place").where("place IS NOT NULL").distinct().withColumn("block", F.floor(F.col("place") / SHARD))
    inside = (wanted["place"] >= shards["start"]) & (wanted["place"] < shards["start"] + shards["n"])
    found = wanted.join(shards, (wanted["block"] == shards["block"]) & inside)
    asked = found.select("file", "shard", F.lit(None).cast("long").alias("token"), (F.col("place") - F.col("start")).alias("at"), F.col("place").alias("key"))
    return wanted.join(_answers(files, asked).select(F.col("key").alias("place"), F.col("answer").alias("token")), "place", "left").select("place", "token")


def _counted(batches: Iterator[pa.RecordBatch], tokens: list[int]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for file, shard, n, planes, ranks in zip(*(b[c] for c in ("file", "shard", "n", "planes", "ranks")), strict=True):
            matrix = WaveletMatrix(n.as_py(), planes.as_buffer(), ranks.as_buffer())
            some = [(file.as_py(), shard.as_py(), t, k) for t in tokens if (k := matrix.count(t))]
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["file", "shard", "token", "n"])


def _shard_counts(files: DataFrame, tokens: DataFrame) -> DataFrame:
    """(file, shard, token, n) of the tokens that a shard has.  There are 2^16 different ids at most."""
    few = [r["token"] for r in tokens.where(f"token BETWEEN 0 AND {(1 << BITS) - 1}").select(F.col("token").cast("long").alias("token")).distinct().collect()]
    return files.select("file", "shard", "n", "planes", "ranks").mapInArrow(partial(_counted, tokens=few), "file int, shard int, token long, n long")


def count_tokens(files: DataFrame, tokens: DataFrame) -> DataFrame:
    """files: what write_tokens wrote.  tokens (token).  (token, n): occurrences in all files of each distinct token."""
    found = _shard_counts(files, tokens).groupBy("token").agg(F.sum("n").alias("n"))
    wanted = tokens.select(F.col("token").cast("long").alias("token")).where("token IS NOT NULL").distinct()
    return wanted.join(found, "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))


def find_tokens(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """files: what write_tokens wrote.  wanted (token, k), k from 0.  (token, k, place) of each distinct pair; null if there are fewer."""
    wanted = wanted.select(F.col("token").cast("long").alias("token"), F.col("k").cast("long").alias("k")).dropna().distinct()
    order = Window.partitionBy("token").orderBy("file", "shard")
    shards = _shard_counts(files, wanted).withColumn("earlier", F.sum("n").over(order) - F.col("n"))
    found = wanted.join(shards, "token").where("k >= earlier AND k < earlier + n")
    asked = found.select("file", "shard", "token", (F.col("k") - F.col("earlier")).alias("at"), F.col("k").alias("key"))
    return wanted.join(_answers(files, asked).select("token", F.col("key").alias("k"), F.col("answer").alias("place")), ["token", "k"], "left")


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path)
