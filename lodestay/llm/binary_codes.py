"""Approximate nearest neighbours by randomly rotated one-bit codes (RaBitQ: Gao and Long, 2024).

Vectors less a centre are padded, rotated by one random orthogonal matrix and reduced to the signs of their
coordinates, packed as bits, with correction scalars: the vector's length, and the inner product of its
direction with its code. From a query's few-bit rotated coordinates, bit counts give an unbiased estimate of each
inner product with an error bound; vectors whose bound reaches the best distances are ranked by exact distances.

The index holds codes and vectors in cells around centroids. A query looks through its nearest cells first; of the
others it then sees those that, by the distance to the plane between the centroids and by the cell's radius, can hold
something nearer than its k-th neighbour so far, and in them it ranks only vectors whose bound does.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestay.llm.vectors import BLOCK, TILE, against_blocks, best, matrix, result, usable
from lodestay.storage import Scratch

#: Vectors from which the centre and the centroids are taken at most, bits of a query coordinate, width of the error bound.
SAMPLE, QUERY_BITS, EPSILON = 4096, 4, 2.4
#: Rows for each centroid at least, centroids at most, and rows that the first cells of a query hold together.
CELL_ROWS, CELLS, FIRST_ROWS = 1024, 256, 2048


#: Components beyond which vectors are scaled down before they are squared.
LARGE = 2.0**400


def code_length(dims: int) -> int:
    """Bits of a code: four for each dimension, in whole words of 64."""
    return 64 * -(-4 * dims // 64)


def rotation(dims: int, length: int, seed: int = 11) -> np.ndarray:
    """``dims`` orthonormal rows of a random orthogonal matrix of ``length``; the padding needs no rows."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(length, dims)))
    return (q * np.sign(np.diag(r))).T


class Codes:
    """Packed sign codes of rows with their correction scalars: length, agreement with the code, ones."""

    def __init__(self, bits: np.ndarray, norm: np.ndarray, agree: np.ndarray):
        self.bits, self.norm, self.agree = bits, norm, agree
        self.length = 64 * bits.shape[1]
        self.ones = np.bitwise_count(bits).sum(1).astype(np.float64)

    @classmethod
    def of(cls, vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> Codes:
        moved = vectors - centre
        norm = np.linalg.norm(moved, axis=1)
        turned = moved @ turn / np.maximum(norm, 1e-300)[:, None]
        return cls(np.packbits(turned > 0, axis=1).view(np.uint64), norm, np.maximum(np.abs(turned).sum(1) / np.sqrt(turn.shape[1]), 1e-9))

    def bounds(self, query: np.ndarray, norm: float, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances to a query, given as its rotated unit vector and length."""
        low, width = query.min(), max(query.max() - query.min(), 1e-12) / (2**QUERY_BITS - 1)
        level = np.floor((query - low) / width + random.random(self.length)).clip(0, 2**QUERY_BITS - 1).astype(np.uint8)
        dot = np.zeros(len(self.bits))
        for b in range(QUERY_BITS):
            plane = np.packbits(level >> b & 1).view(np.uint64)
            dot += (1 << b) * np.bitwise_count(self.bits & plane).sum(1)
        signed = 2 * (width * dot + low * self.ones) - (width * level.sum() + low * self.length)
        estimate = signed / np.sqrt(self.length) / self.agree
        spread = np.sqrt(np.maximum(1 - self.agree**2, 0)) / self.agree / np.sqrt(max(self.length - 1, 1))
        error = EPSILON * (spread + width / (2 * self.agree))
        near = self.norm**2 + norm**2 - 2 * self.norm * norm * np.minimum(estimate + error, 1)
        far = self.norm**2 + norm**2 - 2 * self.norm * norm * np.maximum(estimate - error, -1)
        return near, far


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances (row, centroid)."""
    return np.maximum((x**2).sum(1)[:, None] + (centroids**2).sum(1) - 2 * x @ centroids.T, 0)


def centroids_of(sample: np.ndarray, count: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """At most ``count`` distinct centroids of a bounded sample by Lloyd's rounds."""
    start = np.unique(sample, axis=0)
    out = start[np.random.default_rng(seed).permutation(len(start))[:count]]
    for _ in range(rounds if len(out) > 1 else 0):
        nearest = _distances(sample, out).argmin(1)
        sums = np.stack([np.bincount(nearest, sample[:, d], len(out)) for d in range(sample.shape[1])], 1)
        some = np.bincount(nearest, minlength=len(out))
        out = np.where(some[:, None] > 0, sums / np.maximum(some, 1)[:, None], out)
    return np.unique(out, axis=0)


def _encode(shared) -> Callable:
    """(rid, vec_id, vector, dims, cell, from_centroid, bits, norm, agree) of rows (rid, vec_id, vector, dims)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_dims = batch.column(3).to_numpy()
            for dims in np.unique(of_dims).tolist():
                rows = batch.filter(pa.array(of_dims == dims))
                x = matrix(rows, "vector")
                centroids = shared.value.get(dims, np.zeros((1, dims)))
                codes = Codes.of(x, centroids.mean(0), rotation(dims, code_length(dims)))
                far = _distances(x, centroids)
                cell = far.argmin(1)
                columns = [*rows.columns, pa.array(cell, pa.int32()), pa.array(np.sqrt(far.min(1)))]
                columns += [pa.array([b.tobytes() for b in codes.bits], pa.binary()), pa.array(codes.norm), pa.array(codes.agree)]
                yield pa.RecordBatch.from_arrays(columns, ["rid", "vec_id", "vector", "dims", "cell", "from_centroid", "bits", "norm", "agree"])

    return run


def _plan(shared, cells) -> Callable:
    """Queries (rid, vec_id, vector, dims) with their first cells, and the others with the squares of their lower bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, later, bounds = [], [], []
            for vector in batch.column(2).to_pylist():
                q = np.array(vector)[None]
                centroids = shared.value.get(q.shape[1], np.zeros((1, q.shape[1])))
                rows, radius = cells.value[q.shape[1]]
                far = _distances(q, centroids)[0]
                order = np.argsort(far, kind="stable")
                order = order[rows[order] > 0]
                enough = 1 + int(np.searchsorted(np.cumsum(rows[order]), FIRST_ROWS))
                rest, nearest = order[enough:], far.argmin()
                apart = np.sqrt(_distances(centroids[nearest][None], centroids[rest])[0])
                plane = (far[rest] - far[nearest]) / np.maximum(2 * apart, 1e-300)
                ball = np.sqrt(far[rest]) - radius[rest]
                first.append(order[:enough].tolist())
                later.append(rest.tolist())
                bounds.append((np.maximum(np.maximum(plane, ball), 0) ** 2).tolist())
            added = [pa.array(first, pa.list_(pa.int32())), pa.array(later, pa.list_(pa.int32())), pa.array(bounds, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "first", "later", "bounds"])

    return run


def _search(shared, k: int) -> Callable:
    """Of each query and block the k nearest rows, among those whose lower bound reaches the k-th upper bound and the query's limit."""

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        rows = []
        if queries.num_rows and candidates.num_rows:
            bits = np.frombuffer(b"".join(candidates.column("bits").to_pylist()), np.uint64).reshape(candidates.num_rows, -1)
            codes = Codes(bits, *(candidates.column(c).to_numpy() for c in ("norm", "agree")))
            x, ids = matrix(candidates, "vector"), candidates.column("vec_id").to_numpy()
            q = matrix(queries, "vector")
            centre = shared.value.get(q.shape[1], np.zeros((1, q.shape[1]))).mean(0)
            turned = (q - centre) @ rotation(q.shape[1], codes.length)
            norms = np.linalg.norm(q - centre, axis=1)
            random = np.random.default_rng(5)
            limits = queries.column("limit").to_numpy() ** 2 * (1 + 1e-9)
            for i, vec_id in enumerate(queries.column("vec_id").to_numpy()):
                near, far = codes.bounds(turned[i] / max(norms[i], 1e-300), norms[i], random)
                other = np.flatnonzero(ids != vec_id)
                near, far = near[other], far[other]
                limit = min(limits[i], np.partition(far, k - 1)[k - 1] if len(far) > k else np.inf)
                picked = other[near <= limit]
                distance = np.sqrt(((x[picked] - q[i]) ** 2).sum(1))
                first = np.lexsort((ids[picked], distance))[:k]
                rows.append((np.full(len(first), vec_id), ids[picked][first], distance[first]))
        return result(rows, ["query_id", "vec_id", "score"], [pa.int64(), pa.int64(), pa.float64()])

    return run


def _tiles(counts: list) -> list[tuple[int, int, int, int]]:
    """(dims, cell, first tile, tiles) for the cells' counts of queries: small cells share a tile, large ones have several."""
    out, base, held = [], 0, 0
    for r in sorted(counts):
        if held and held + r["queries"] > TILE:
            base, held = base + 1, 0
        parts = -(-r["queries"] // TILE)
        out.append((r["dims"], r["own"], base, parts))
        base, held = (base, held + r["queries"]) if parts == 1 else (base + parts, 0)
    return out


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found by Euclidean distance for each vec_id divisible by ``every``.

    All rows (vec_id, embedding) are indexed; a query's own vec_id is no candidate. Vectors that are null, empty,
    all zero or hold null or non-finite numbers take no part; vectors are compared with those of their own length
    only. Equal distances go to the smaller vec_id, rows that repeat a vec_id count each. Of equal vectors only those
    of the k + 1 smallest vec_ids can be results, and only they get codes. An empty table gives no rows. Further
    columns are ignored.
    """
    with Scratch(vectors.sparkSession) as scratch:
        rows = usable(vectors, zero=False)
        most = rows.agg(F.max(F.greatest(F.array_max("vector"), -F.array_min("vector")))).first()[0] or 1.0
        # A power of two changes no digit of a distance, but keeps the squares of very long vectors finite.
        unit = 2.0 ** (math.frexp(most)[1] - 400) if most > LARGE else 1.0
        if unit != 1.0:
            rows = rows.withColumn("vector", F.transform("vector", lambda x: x / unit))
        found = _nearest(rows, scratch, every, k, block)
        return scratch.keep(found.withColumn("score", F.col("score") * unit), "nearest")


def _nearest(rows: DataFrame, scratch: Scratch, every: int, k: int, block: int) -> DataFrame:
    spark = scratch.spark
    rows = scratch.write(rows.withColumn("rid", F.monotonically_increasing_id()).select("rid", "vec_id", "vector", "dims"), "rows")
    sample = rows.orderBy(F.xxhash64("vec_id"), "rid").limit(SAMPLE).select("vector").toArrow().column(0).to_pylist()
    sizes = {r["dims"]: r["rows"] for r in rows.groupBy("dims").agg(F.count("*").alias("rows")).collect()}
    by_dims = {d: np.array([v for v in sample if len(v) == d]) for d in {len(v) for v in sample}}
    centroids = {d: centroids_of(x, min(CELLS, 1 + sizes[d] // CELL_ROWS)) for d, x in by_dims.items()}
    shared = spark.sparkContext.broadcast(centroids)

    same = Window.partitionBy(F.xxhash64("vector"), "vector").orderBy("vec_id")
    distinct = rows.withColumn("n", F.dense_rank().over(same)).where(F.col("n") <= k + 1).drop("n")
    schema = "rid long, vec_id long, vector array<double>, dims int, cell int, from_centroid double, bits binary, norm double, agree double"
    codes = scratch.write(distinct.mapInArrow(_encode(shared), schema), "codes")
    stats = codes.groupBy("dims", "cell").agg(F.count("*").alias("rows"), F.max("from_centroid").alias("radius")).collect()
    cells = {d: (np.zeros(len(centroids.get(d, [0])), np.int64), np.zeros(len(centroids.get(d, [0])))) for d in sizes}
    numbers, base = [], 0
    for r in sorted(stats):
        cells[r["dims"]][0][r["cell"]], cells[r["dims"]][1][r["cell"]] = r["rows"], r["radius"]
        numbers.append((r["dims"], r["cell"], base, -(-r["rows"] // block)))
        base += numbers[-1][3]
    blocks = spark.createDataFrame(numbers, "dims int, cell int, base int, parts int")
    dealt = codes.join(F.broadcast(blocks), ["dims", "cell"]).withColumn("block", F.col("base") + F.pmod(F.xxhash64(F.lit(9), "rid"), "parts").cast("int"))
    dealt = dealt.select("vec_id", "vector", "dims", "bits", "norm", "agree", "block")

    # Rows that repeat a query's vec_id ask once.
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("rid", "vector", "dims")).alias("q"))
    asked = asked.select(F.col("q.rid").alias("rid"), "vec_id", F.col("q.vector").alias("vector"), F.col("q.dims").alias("dims"))
    schema = "rid long, vec_id long, vector array<double>, dims int, first array<int>, later array<int>, bounds array<double>"
    planned = asked.mapInArrow(_plan(shared, spark.sparkContext.broadcast(cells)), schema).withColumn("own", F.get("first", F.lit(0)))
    planned = scratch.write(planned, "planned")
    # Queries of one cell, or of a few small ones, make a tile, so that a block is copied for the few tiles that are near it.
    tiles = spark.createDataFrame(_tiles(planned.groupBy("dims", "own").agg(F.count("*").alias("queries")).collect()), "dims int, own int, tile0 int, tiles int")
    planned = planned.join(F.broadcast(tiles), ["dims", "own"]).withColumn("tile", (F.col("tile0") + F.pmod(F.xxhash64(F.lit(7), "rid"), "tiles")).cast("int"))
    into_blocks = F.explode(F.sequence(F.col("base"), F.col("base") + F.col("parts") - 1)).alias("block")
    columns = ["vec_id", "vector", "dims", "tile", "limit"]
    near_cells = planned.withColumn("limit", F.lit(float("inf"))).withColumn("cell", F.explode("first"))
    near_cells = near_cells.join(F.broadcast(blocks), ["dims", "cell"]).select(*columns, into_blocks)
    schema, order = "query_id long, vec_id long, score double", [F.col("score"), F.col("vec_id")]
    found = scratch.write(best(against_blocks(near_cells, dealt, _search(shared, k), schema), k, order), "near-cells")

    limits = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("limit"))
    known = planned.join(limits, "vec_id", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
    open_cells = known.withColumn("c", F.explode(F.arrays_zip("later", "bounds"))).where(F.col("c.bounds") <= F.col("limit") * F.col("limit"))
    open_cells = open_cells.withColumn("cell", F.col("c.later")).join(F.broadcast(blocks), ["dims", "cell"]).select(*columns, into_blocks)
    return best(found.drop("rank").unionByName(against_blocks(open_cells, dealt, _search(shared, k), schema)), k, order)
