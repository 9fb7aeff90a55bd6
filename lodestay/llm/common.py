"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that one numpy pass works on at a time.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(names: Iterable[str]) -> list[Column]:
    """Columns of these very names, dots and all."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def by_place(df: DataFrame) -> DataFrame:
    """``df`` with columns called c0, c1 and so on, so that no name can clash with a new one or hold dots."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def with_field(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    """``schema`` with one more field."""
    return T.StructType([*schema.fields, T.StructField(name, kind)])


#: Keys up to which ``keep_keys`` broadcasts them; a table with more is joined by shuffling.
BROADCAST_KEYS = 1 << 20


def keep_keys(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` is in the one-column, already written table ``keys``.

    The keys are counted first: a bounded number of them is broadcast, so that wide rows need no shuffle.
    """
    small = keys.count() <= BROADCAST_KEYS
    return df.join(F.broadcast(keys) if small else keys, column, "left_semi")


def crc_of_id(id_column: str) -> Column:
    """crc32 of the id written as text."""
    return F.crc32(F.col(id_column).cast("string").cast("binary"))


def held_out(id_column: str) -> Column:
    """True for the third of the rows that no model may learn from; false for a null id."""
    return F.coalesce(crc_of_id(id_column) % 3 == 1, F.lit(False))


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that hold at most ``limit`` bytes of text each, one row at least."""
    if batch.num_rows == 0:
        return
    ends = text_buffers(batch.column(batch.schema.get_field_index(column)))[1]
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows and the int64 row offsets into them; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def list_array(values: np.ndarray, lengths: Iterable[int]) -> pa.ListArray:
    ends = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows with equal keys as one table each, from batches sorted by those keys; runs may cross batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        bounds = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            key = tuple(c[lo] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)
