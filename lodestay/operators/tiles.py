"""Joins that make far more rows than they read: keys are cut into tiles, so that what one task makes is bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestay.storage import Scratch

#: Rows of a key on one side of a tile: a tile makes at most the square of it, and a row is copied once for each so many that it meets.
TILE = 1 << 14
#: Rows of one task of a shuffle that ``shares`` sizes.
SHARE = 1 << 20


def width(spark: SparkSession) -> int:
    """Partitions of a shuffle. Given as a number they stay as many, though Spark would merge them by the little that they read."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shares(rows: DataFrame, times: int = 1) -> int:
    """Partitions of about ``SHARE`` rows each of ``times`` a table, so that what a task holds does not grow with it; one for each core at least."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() * times // SHARE))


def tiled_join(left: DataFrame, right: DataFrame, on: list[str], tile: int = TILE) -> DataFrame:
    """The inner join of ``left`` and ``right`` on ``on``, in which no task has to meet all rows of a key.

    The rows of a key are dealt by hash into tiles of about ``tile`` rows on either side, and each tile of one side meets each of the
    other. A row is copied once for each tile of the other side, one copy for each ``tile`` of its results.
    """
    n = width(left.sparkSession)
    count = lambda rows, name: rows.groupBy(*on).agg(F.ceil(F.count("*") / tile).cast("int").alias(name))
    sizes = count(left, "_lefts").join(count(right, "_rights"), on).withColumn("_id", F.monotonically_increasing_id())
    # Written, so that both sides have the same numbers. Joined on what they were dealt by and no more: else Spark would deal again.
    sizes = Scratch(left.sparkSession).keep(sizes, "tiles")
    dealt = lambda rows, own, other, mine, theirs: (
        rows.join(sizes, on)
        .withColumns({mine: F.pmod(F.xxhash64(*rows.columns), F.col(own)).cast("int"), theirs: F.explode(F.sequence(F.lit(0), F.col(other) - 1))})
        .drop("_lefts", "_rights")
        .repartition(n, "_id", "_i", "_j")
    )
    a, b = dealt(left, "_lefts", "_rights", "_i", "_j"), dealt(right, "_rights", "_lefts", "_j", "_i")
    return a.hint("shuffle_merge").join(b.drop(*on), ["_id", "_i", "_j"]).drop("_id", "_i", "_j")
