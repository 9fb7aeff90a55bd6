"""Vectors in tasks: whole rows as matrices, queries in tiles against blocks of candidates, and the best of each query."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Candidates of one block and queries of one tile, about.
BLOCK, TILE = 4096, 512


def usable(df: DataFrame, zero: bool) -> DataFrame:
    """(vec_id long, vector array<double>, dims) of rows with an id and a finite vector, an all-zero one only if asked for."""
    vector = F.col("embedding").cast("array<double>")
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where("vec_id is not null and size(vector) > 0")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(finite if zero else finite & F.exists("vector", lambda x: x != 0))
    return rows.withColumn("dims", F.size("vector"))


def matrix(table: pa.Table | pa.RecordBatch, column: str) -> np.ndarray:
    values = table.column(column)
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return values.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 0))


def into_tiles(queries: DataFrame, key: str, tile: int = TILE) -> DataFrame:
    """``queries`` with a tile each, so many that one has about ``tile`` of them."""
    return queries.withColumn("tile", F.pmod(F.xxhash64(F.lit(7), key), F.lit(max(1, -(-queries.count() // tile)))).cast("int"))


def against_blocks(queries: DataFrame, candidates: DataFrame, search: Callable, schema: str) -> DataFrame:
    """Run ``search(queries, candidates)`` on Arrow tables for each tile of queries and each block that one of them must see.

    ``queries`` have dims, a tile and a block, one row for each block of a query; ``candidates`` have dims and a block.
    Neither side of a group grows with the input; a block is copied for the tiles that need it, and for no others.
    """
    keys = ("dims", "block", "tile")
    queries = queries.toDF(*queries.columns)  # both sides may come from one table, and need columns of their own
    copies = candidates.join(queries.select(*keys).distinct().toDF(*keys), ["dims", "block"])
    return queries.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(search, schema)


def best(found: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """The first k rows of each query by ``order``, with their rank from 1."""
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def result(rows: list[tuple[np.ndarray, ...]], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    columns = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [np.zeros(0) for _ in names]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
