"""Token ids in shard files, each a few wavelet matrices (Claude, Navarro and Ordóñez, 2015).

A matrix keeps one bit-plane per bit of the ids, highest first, each in the order that stably sorting by the
planes above gives, and beside each plane its counts of ones by superblocks and blocks. Rank and select on the planes
answer which token stands at a place, how often a token occurs before it, and where its k-th occurrence is, without
unpacking the rest. ``access``, ``count`` and ``occurrence`` ask that of the files of all shards and read the
matrices that they need, and of them no documents.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestay.llm.common import text_slices
from lodestay.llm.tokens import UnitEncoder

_MAGIC = b"WVMX0002"
_HEAD = struct.Struct("<8sQB")  # magic, ids, planes
#: Ids at which a task closes one matrix and begins the next.
MATRIX_TOKENS = 1 << 19
#: Bits of a block and of a superblock; counts are 16 bits within a superblock and 64 bits before it.
_BLOCK, _SUPER = 512, 1 << 14
#: Masks that keep the first 0 to 64 bits of a big-endian word.
_HIGH = np.array([((1 << n) - 1) << (64 - n) for n in range(65)], np.uint64)


class WaveletMatrix:
    """Bit-planes of ``n`` ids with rank and select, which take arrays of places.

    ``planes`` are packed bits in whole blocks, ``zeros`` the zero bits of each, ``supers`` and ``blocks`` the ones
    before each superblock, and before each block since its superblock.
    """

    def __init__(self, n: int, planes: np.ndarray, zeros: np.ndarray, supers: np.ndarray, blocks: np.ndarray):
        self.n, self.planes, self.zeros, self.supers, self.blocks = n, planes, zeros, supers, blocks
        self.words = planes.view(">u8")

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        depth = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        now = ids.astype(np.uint16 if depth <= 16 else np.uint32)
        length = (len(ids) // _BLOCK + 1) * _BLOCK // 8
        planes, zeros = np.zeros((depth, length), np.uint8), np.zeros(depth, np.int64)
        for row, level in enumerate(reversed(range(depth))):
            bits = (now >> now.dtype.type(level)) & now.dtype.type(1)
            ones = bits.view(np.uint8)[:: now.itemsize].astype(bool)
            planes[row, : (len(ids) + 7) // 8] = np.packbits(ones)
            low = now[~ones]
            zeros[row] = len(low)
            now = np.concatenate([low, now[ones]])
        ones = np.bitwise_count(planes.reshape(depth, -1, _BLOCK // 8)).sum(2, dtype=np.int64)
        before = np.cumsum(ones, 1) - ones
        supers = before[:, :: _SUPER // _BLOCK]
        blocks = before - np.repeat(supers, _SUPER // _BLOCK, 1)[:, : before.shape[1]]
        return cls(len(ids), planes, zeros, supers, blocks.astype(np.uint16))

    def to_array(self) -> np.ndarray:
        """All ids, undoing the sorts from the lowest plane up."""
        now = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level, (plane, zeros) in enumerate(zip(self.planes[::-1], self.zeros[::-1].tolist(), strict=True)):
            ones = np.unpackbits(plane, count=self.n).view(bool)
            before = np.empty_like(now)
            before[~ones] = now[:zeros]
            before[ones] = now[zeros:] | now.dtype.type(1 << level)
            now = before
        return now

    def _rank1(self, level: int, places: np.ndarray) -> np.ndarray:
        """Ones among the first ``places`` bits of a plane."""
        block = places // _BLOCK
        first = block * (_BLOCK // 64)
        beyond = np.clip((places - block * _BLOCK)[:, None] - 64 * np.arange(_BLOCK // 64), 0, 64)
        words = self.words[level][first[:, None] + np.arange(_BLOCK // 64)].astype(np.uint64) & _HIGH[beyond]
        return self.supers[level][places // _SUPER] + self.blocks[level][block] + np.bitwise_count(words).sum(1, dtype=np.int64)

    def access(self, places: np.ndarray) -> np.ndarray:
        """The tokens at places from 0 to n - 1."""
        places = np.asarray(places, np.int64)
        out = np.zeros(len(places), np.int64)
        for level in range(len(self.planes)):
            one = (self.planes[level][places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1
            ones = self._rank1(level, places)
            places = np.where(one, self.zeros[level] + ones, places - ones)
            out = out << 1 | one
        return out

    def _walk(self, tokens: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each token's run begins in the last order, and how far it goes for the first ``places`` ids."""
        depth, begin = len(self.planes), np.zeros(len(tokens), np.int64)
        for level in range(depth):
            a, b = self._rank1(level, begin), self._rank1(level, places)
            one = tokens >> (depth - 1 - level) & 1 == 1
            begin = np.where(one, self.zeros[level] + a, begin - a)
            places = np.where(one, self.zeros[level] + b, places - b)
        return begin, places

    def count(self, tokens: np.ndarray, places: np.ndarray | None = None) -> np.ndarray:
        """Occurrences of each token among the first ``places`` ids, or among all."""
        tokens = np.asarray(tokens, np.int64)
        inside = (tokens >= 0) & (tokens >> len(self.planes) == 0)
        begin, end = self._walk(np.where(inside, tokens, 0), np.full(len(tokens), self.n) if places is None else np.asarray(places, np.int64))
        return np.where(inside, end - begin, 0)

    def _select(self, level: int, one: bool, k: np.ndarray) -> np.ndarray:
        """Places of the k-th (from 0) bits of a kind in a plane."""
        lo, hi = np.zeros(len(k), np.int64), np.full(len(k), self.n, np.int64)
        while (lo < hi).any():
            middle = (lo + hi) // 2
            ones = self._rank1(level, middle + 1)
            enough = (ones if one else middle + 1 - ones) > k
            lo, hi = np.where(enough | (lo >= hi), lo, middle + 1), np.where(enough & (lo < hi), middle, hi)
        return lo

    def occurrence(self, token: int, k: np.ndarray) -> np.ndarray:
        """Places of the k-th (from 0) occurrences of a token, or -1."""
        k = np.asarray(k, np.int64)
        there = (k >= 0) & (k < self.count(np.array([token]))[0])
        out = np.full(len(k), -1, np.int64)
        if there.any():
            places = self._walk(np.array([token]), np.zeros(1, np.int64))[0] + k[there]
            for level in reversed(range(len(self.planes))):
                one = bool(token >> (len(self.planes) - 1 - level) & 1)
                places = self._select(level, one, places - self.zeros[level] if one else places)
            out[there] = places
        return out

    def to_bytes(self) -> bytes:
        """The head, then zeros, counts and planes, compressed by zstandard."""
        parts = [self.zeros.astype("<i8"), self.supers.astype("<i8"), self.blocks.astype("<u2"), self.planes]
        return _HEAD.pack(_MAGIC, self.n, len(self.planes)) + zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in parts))

    @classmethod
    def from_bytes(cls, blob: bytes) -> WaveletMatrix:
        magic, n, depth = _HEAD.unpack_from(blob)
        if magic != _MAGIC:
            raise ValueError("not a wavelet matrix")
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[_HEAD.size :]), np.uint8)
        blocks = n // _BLOCK + 1
        supers = -(-blocks * _BLOCK // _SUPER)
        zeros, of_super, of_block, bits = np.split(raw, np.cumsum([8 * depth, 8 * depth * supers, 2 * depth * blocks]))
        return cls(n, bits.reshape(depth, -1), zeros.view("<i8"), of_super.view("<i8").reshape(depth, -1), of_block.view("<u2").reshape(depth, -1))


def _pack_documents(doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """The documents of a matrix in order: id, whether it has one, length."""
    known = np.array([d is not None for d in doc_ids], np.uint8)
    parts = [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array(lengths, "<i8").tobytes(), known.tobytes()]
    return struct.pack("<Q", len(doc_ids)) + zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack_documents(blob: bytes) -> tuple[list[int | None], np.ndarray]:
    n = struct.unpack_from("<Q", blob)[0]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:]), np.uint8)
    doc_ids, lengths, known = np.split(raw, [8 * n, 16 * n])
    return [d if k else None for d, k in zip(doc_ids.view("<i8").tolist(), known.tolist(), strict=True)], lengths.view("<i8")


def _build(tokenizer: str, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = UnitEncoder(tokenizer), TaskContext.get().partitionId()
        part, begin = 0, 0
        held: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        lengths: list[int] = []

        def close() -> pa.RecordBatch:
            nonlocal part, begin
            ids = np.concatenate(held)
            blobs = [_pack_documents(doc_ids, lengths), WaveletMatrix.build(ids).to_bytes()]
            row = [pa.array([shard], pa.int32()), pa.array([part], pa.int32()), pa.array([begin], pa.int64()), pa.array([len(ids)], pa.int64())]
            part, begin = part + 1, begin + len(ids)
            for x in (held, doc_ids, lengths):
                x.clear()
            return pa.RecordBatch.from_arrays([*row, *(pa.array([x], pa.binary()) for x in blobs)], ["shard", "part", "begin", "tokens", "documents", "matrix"])

        for batch in batches:
            for rows in text_slices(batch, "text"):
                ids, n = encoder.encode(rows.column(1))
                held.append(np.insert(ids, np.cumsum(n), end_id))
                doc_ids += rows.column(0).to_pylist()
                lengths += (n + 1).tolist()
                if sum(map(len, held)) >= MATRIX_TOKENS:
                    yield close()
        if held:
            yield close()

    return run


_SCHEMA = "shard int, part int, begin long, tokens long, documents binary, matrix binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shards: int | None = None) -> None:
    """Write the ids of ``docs`` (doc_id, text) in ascending doc_id order, one file of matrices per shard.

    Null and empty texts are the end id alone; null doc_ids come first; rows that repeat a doc_id all count, in the
    order of their texts. An empty table gives files without matrices. There are as many shards as the input has splits, which
    Spark cuts by size, unless ``shards`` says otherwise; a task holds one matrix in memory at a time. Further
    columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    count = shards or max(1, rows.rdd.getNumPartitions())
    rows = rows.repartitionByRange(count, "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(_build(tokenizer, end_id), _SCHEMA).write.option("compression", "uncompressed").parquet(path)


def _parts(spark: SparkSession, path: str) -> DataFrame:
    """The matrices of all shards (shard, part, first, tokens, documents, matrix); first counts all ids before one."""
    files = spark.read.schema(_SCHEMA).parquet(path)
    # One row per shard: few, and no texts or ids among them.
    totals = files.groupBy("shard").agg(F.sum("tokens").alias("shard_tokens"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", F.coalesce(F.sum("shard_tokens").over(before), F.lit(0)).alias("shard_first"))
    return files.join(starts, "shard").select("shard", "part", (F.col("shard_first") + F.col("begin")).alias("first"), "tokens", "documents", "matrix")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, documents, blob in zip(*(batch.column(i) for i in range(3)), strict=True):
            doc_ids, lengths = _unpack_documents(documents.as_py())
            ids = WaveletMatrix.from_bytes(blob.as_py()).to_array().astype("<u4")
            ends = np.cumsum(lengths)
            raw = memoryview(ids).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
            columns = [pa.array(doc_ids, pa.int64()), pa.array(first.as_py() + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files; start counts all ids before it."""
    return _parts(spark, path).select("first", "documents", "matrix").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _ask(question: Callable[[WaveletMatrix, np.ndarray, int], np.ndarray], schema: str) -> Callable:
    """For rows (first, asked, matrix): each number asked, and the answer of the matrix, as two columns."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, asked, blob in zip(*(batch.column(i) for i in range(3)), strict=True):
                asked = np.array(asked.as_py(), np.int64)
                found = question(WaveletMatrix.from_bytes(blob.as_py()), asked, first.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(found)], names)

    return run


def access(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """(position, token) for the distinct positions (position) among all ids in the files; those beyond give no row.

    Positions meet the matrices that cover them by ranges of equal width; only these are read.
    """
    width = F.lit(MATRIX_TOKENS)
    covered = F.sequence(F.floor(F.col("first") / width), F.floor((F.col("first") + F.col("tokens") - 1) / width))
    places = _parts(spark, path).select("shard", "part", "first", "tokens", F.explode(covered).alias("range"))
    wanted = positions.select(F.col("position").cast("long").alias("position")).where("position >= 0").distinct().withColumn("range", F.floor(F.col("position") / width))
    met = wanted.join(places, "range").where("position >= first and position < first + tokens")
    asked = met.groupBy("shard", "part", "first").agg(F.collect_list("position").alias("asked"))
    matrices = spark.read.schema(_SCHEMA).parquet(path).select("shard", "part", "matrix")
    schema = "position long, token long"
    return matrices.join(asked, ["shard", "part"]).select("first", "asked", "matrix").mapInArrow(_ask(lambda m, x, first: m.access(x - first), schema), schema)


def count(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """(token, occurrences) of each of a few ``tokens`` among all ids in the files."""
    schema = "token long, occurrences long"
    asked = spark.read.schema(_SCHEMA).parquet(path).select(F.lit(0).alias("first"), F.array(*map(F.lit, sorted(set(tokens)))).alias("asked"), "matrix")
    found = asked.mapInArrow(_ask(lambda m, x, first: m.count(x), schema), schema)
    return found.groupBy("token").agg(F.sum("occurrences").alias("occurrences"))


def occurrence(spark: SparkSession, path: str, token: int, ks: list[int]) -> DataFrame:
    """(k, position) of the k-th (from 0) occurrences of a token for a few ``ks``; those beyond the last give no row.

    Counts of the matrices say which of them hold the occurrences; only these are asked where.
    """
    parts = _parts(spark, path)
    schema = "first long, n long"
    number = lambda m, x, first: m.count(np.full(len(x), token))
    counted = parts.select("first", F.array("first").alias("asked"), "matrix").mapInArrow(_ask(number, schema), schema)
    counted = parts.select("shard", "part", "first").join(counted, "first").where("n > 0")
    totals = counted.groupBy("shard").agg(F.sum("n").alias("shard_n"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("shard", F.coalesce(F.sum("shard_n").over(upto(Window.orderBy("shard"))), F.lit(0)).alias("shard_before"))
    before = F.col("shard_before") + F.coalesce(F.sum("n").over(upto(Window.partitionBy("shard").orderBy("part"))), F.lit(0))
    counted = counted.join(totals, "shard").withColumn("before", before)
    mine = F.filter(F.array(*(F.lit(int(k)).cast("long") for k in sorted(set(ks)))), lambda k: (k >= F.col("before")) & (k < F.col("before") + F.col("n")))
    asked = counted.withColumn("asked", mine).where("size(asked) > 0").select("shard", "part", "first", "before", "asked")
    matrices = spark.read.schema(_SCHEMA).parquet(path).select("shard", "part", "matrix").join(asked, ["shard", "part"])
    within = F.transform("asked", lambda k: k - F.col("before"))
    schema = "k long, position long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, begun, asked, blob in zip(*(batch.column(i) for i in range(4)), strict=True):
                k = np.array(asked.as_py(), np.int64)
                found = first.as_py() + WaveletMatrix.from_bytes(blob.as_py()).occurrence(token, k)
                yield pa.RecordBatch.from_arrays([pa.array(k + begun.as_py()), pa.array(found)], ["k", "position"])

    return matrices.select("first", "before", within.alias("asked"), "matrix").mapInArrow(run, schema)
