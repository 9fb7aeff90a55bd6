"""Exact top-k inner products over norm-sorted blocks with SVD-rotated partial sums (after LEMP and FEXIPRO).

Vectors are dealt into blocks by descending length. The longest ones give every query a threshold; later blocks
see only queries whose length times the block's greatest length reaches it. Inside a block both sides are rotated
by singular vectors, so that a few leading coordinates carry most of a product; Cauchy-Schwarz bounds on the rest
discard vectors chunk by chunk, for a whole tile of queries at a time, and what is left is computed in whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestay.llm.vectors import BLOCK, against_blocks, best, into_tiles, matrix, result, usable
from lodestay.storage import Scratch

#: Vectors from which the rotation is taken at most; any rotation gives the same results.
SAMPLE = 4096
#: Norm bins at most; a bin of more vectors than a block is dealt into several blocks of the same lengths. Vectors of
#: the first bin go to blocks that are so many times smaller, for all queries must see them.
BINS, HEAD = 64, 8
_STEPS = (0.25, 0.5)
_CHUNK = 512


def _whole_products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products (row, query) of whole numbers; doubles hold them if no sum can pass 2^53."""
    if x.size and q.size and np.abs(x).max() * np.abs(q).max() * x.shape[1] < 2**53:
        return (x @ q.T).astype(np.int64)
    return x.astype(np.int64) @ q.astype(np.int64).T


class Tops:
    """The k best (score, id) of each query of a tile so far; of equal scores the smaller id is the better."""

    def __init__(self, queries: int, k: int, threshold: np.ndarray):
        self.k, self.threshold = k, threshold
        self.ids = [np.zeros(0, np.int64)] * queries
        self.scores = [np.zeros(0, np.int64)] * queries

    def offer(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids[query], ids]), np.concatenate([self.scores[query], scores])
        first = np.lexsort((ids, -scores))[: self.k]
        self.ids[query], self.scores[query] = ids[first], scores[first]
        if len(first) == self.k:
            self.threshold[query] = max(self.threshold[query], float(scores[first[-1]]))


def _search(turn_of, k: int) -> Callable:
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        names, kinds = ["query_id", "vec_id", "score"], [pa.int64()] * 3
        if not queries.num_rows or not candidates.num_rows:
            return result([], names, kinds)
        x = matrix(candidates, "vector")
        order = np.argsort(-np.linalg.norm(x, axis=1), kind="stable")
        x, ids = x[order], candidates.column("vec_id").to_numpy()[order]
        q, query_ids = matrix(queries, "vector"), queries.column("vec_id").to_numpy()
        tops = Tops(len(q), k, queries.column("threshold").to_numpy(zero_copy_only=False).copy())
        dims = x.shape[1]
        turn = turn_of.value.get(dims, np.eye(dims))
        tx, tq = x @ turn, q @ turn
        length, of_query = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
        slack = 1e-9 * (1 + of_query * length[0])
        cuts = [0, *sorted({max(1, int(dims * s)) for s in _STEPS}), dims]
        rest = [(np.linalg.norm(tx[:, c:], axis=1), np.linalg.norm(tq[:, c:], axis=1)) for c in cuts]
        for lo in range(0, len(x), _CHUNK):
            asking = np.flatnonzero(of_query * length[lo] + slack >= tops.threshold)
            if not len(asking):
                break
            rows = np.arange(lo, min(lo + _CHUNK, len(x)))
            partial = np.zeros((len(rows), len(asking)))
            for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                partial = partial + tx[rows, a:b] @ tq[asking, a:b].T
                open_pairs = partial + np.outer(rest[i + 1][0][rows], rest[i + 1][1][asking]) + slack[asking] >= tops.threshold[asking]
                some, any_of = open_pairs.any(1), open_pairs.any(0)
                rows, asking, partial, open_pairs = rows[some], asking[any_of], partial[some][:, any_of], open_pairs[some][:, any_of]
            if not len(rows):
                continue
            score = _whole_products(x[rows], q[asking])
            wanted = open_pairs & (score >= tops.threshold[asking]) & (ids[rows][:, None] != query_ids[asking])
            for j in np.flatnonzero(wanted.any(0)):
                found = wanted[:, j]
                tops.offer(asking[j], ids[rows[found]], score[found, j])
        found = [(np.full(len(i), query_id), i, s) for query_id, i, s in zip(query_ids, tops.ids, tops.scores, strict=True)]
        return result(found, names, kinds)

    return run


def _bin(edges: list[float]) -> Column:
    """The bin of a length: how many of the descending edges it lies below."""
    return F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)), lambda e: F.col("norm") < e)) if edges else F.lit(0)


def top_products(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products for each vec_id divisible by ``every``.

    Components become floor(scale * x) in double precision and scores are whole numbers. All rows (vec_id,
    embedding) are searched, but for the query's own vec_id. Vectors that are null, empty or hold null or
    non-finite numbers take no part; vectors meet those of their own length only. Ties go to the smaller vec_id,
    rows that repeat a vec_id count each as candidates, and once as a query. An empty table gives no rows. Further
    columns are ignored. Scores are 64-bit: vectors of lengths whose square reaches 2^63 after scaling are an error.
    """
    with Scratch(vectors.sparkSession) as scratch:
        return scratch.keep(_top_products(usable(vectors, zero=True), scratch, every, k, scale, block), "products")


def _top_products(rows: DataFrame, scratch: Scratch, every: int, k: int, scale: int, block: int) -> DataFrame:
    spark = scratch.spark
    rows = rows.withColumn("vector", F.transform("vector", lambda x: F.floor(x * scale).cast("double")))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    rows = scratch.write(rows.withColumn("norm", norm), "scaled")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toArrow().column(0).to_pylist()
    turns = {d: np.linalg.svd(np.array([v for v in sample if len(v) == d]), full_matrices=True)[2].T for d in {len(v) for v in sample}}
    turn = spark.sparkContext.broadcast(turns)
    bins = min(BINS, max(1, -(-rows.count() // block)))
    edges = rows.approxQuantile("norm", [i / bins for i in range(bins - 1, 0, -1)], 0.1 / bins) if bins > 1 else []
    edges = sorted(set(edges), reverse=True)
    # Vectors of one length may be more than a block: those of a bin are dealt on by their ids.
    sized = rows.withColumn("bin", _bin(edges)).groupBy("dims", "bin").agg(F.count("*").alias("rows"), F.max("norm").alias("most")).collect()
    if any(r["most"] ** 2 >= 2.0**63 for r in sized):
        raise ValueError("inner products of these vectors do not fit 64 bits")
    numbers, base, first = [], 0, {}
    for r in sorted(sized):
        head = first.setdefault(r["dims"], r["bin"]) == r["bin"]
        parts = -(-r["rows"] * (HEAD if head else 1) // block)
        numbers.append((r["dims"], r["bin"], base, parts, r["most"], head))
        base += parts
    table = spark.createDataFrame(numbers, "dims int, bin int, base int, parts int, most double, head boolean")
    numbered = rows.withColumn("bin", _bin(edges)).join(F.broadcast(table), ["dims", "bin"])
    candidates = numbered.select("vec_id", "vector", "dims", "head", (F.col("base") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int").alias("block"))
    schema = "query_id long, vec_id long, score long"
    search = _search(turn, k)

    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("vector", "dims", "norm")).alias("q"))
    asked = into_tiles(asked.select("vec_id", "q.vector", "q.dims", "q.norm"), "vec_id")
    ask = lambda queries, bins: queries.join(F.broadcast(bins), "dims").select(
        "vec_id", "vector", "dims", "tile", "threshold", "norm", "most", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("parts") - 1)).alias("block")
    )
    opening = ask(asked.withColumn("threshold", F.lit(float("-inf"))), table.where("head"))
    head = against_blocks(opening, candidates.where("head").drop("head"), search, schema)
    order = [F.col("score").desc(), F.col("vec_id")]
    head = scratch.write(best(head, k, order), "head")
    known = head.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("threshold"))
    later = asked.join(known, "vec_id", "left").withColumn("threshold", F.coalesce("threshold", F.lit(float("-inf"))))
    reach = ask(later, table.where("not head")).where(F.col("norm") * F.col("most") * (1 + 1e-9) + 1e-6 >= F.col("threshold"))
    rest = against_blocks(reach, candidates.where("not head").drop("head"), search, schema)
    return best(head.drop("rank").unionByName(rest), k, order)
