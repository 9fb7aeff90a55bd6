"""What changed between two versions of a table, reading only the buckets of keys whose digests differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 256


def bucket(key: str, buckets: int = BUCKETS) -> Column:
    """The bucket of a key; tables that are compared are stored partitioned by it."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def with_bucket(rows: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    return rows.withColumn("bucket", bucket(key, buckets))


def _row_hash(columns: list[str], seed: int) -> Column:
    """A hash of all columns and of which of them are null, as a hash function may skip nulls."""
    return F.xxhash64(F.lit(seed), *columns, *(F.col(c).isNull() for c in columns))


def fingerprint(rows: DataFrame) -> DataFrame:
    """(bucket, n, digest) of a table with ``bucket``: the digest does not depend on the order of rows.

    Two sums of row hashes, so that neither equal rows nor a swap of values between rows can cancel out.
    """
    columns = sorted(c for c in rows.columns if c != "bucket")
    parts = [F.sum(_row_hash(columns, seed).cast("decimal(38,0)")).alias(f"s{seed}") for seed in (1, 2)]
    sums = rows.groupBy("bucket").agg(F.count("*").alias("n"), *parts)
    return sums.select("bucket", "n", F.concat_ws(":", F.col("s1").cast("string"), F.col("s2").cast("string")).alias("digest"))


def changed_buckets(old: DataFrame, new: DataFrame) -> list[int]:
    """Buckets whose fingerprints (bucket, n, digest) differ or that only one has: as many numbers as there are buckets at most."""
    a, b = old.toDF("bucket", "n", "digest"), new.toDF("bucket", "n2", "digest2")
    differ = ~(F.col("n").eqNullSafe(F.col("n2")) & F.col("digest").eqNullSafe(F.col("digest2")))
    return sorted(r.bucket for r in a.join(b, "bucket", "full").where(differ).select("bucket").collect())


def changes(old: DataFrame, new: DataFrame, key: str, buckets: list[int]) -> DataFrame:
    """(key, change) of rows of the named buckets: inserted, deleted or updated. Keys are unique in each table.

    The buckets are partitions of the tables' folders, so those that are not named are not read.
    """
    columns = sorted(c for c in old.columns if c not in ("bucket", key))
    side = lambda rows, mark: rows.where(F.col("bucket").isin(buckets)).select(F.col(key), F.struct(*columns).alias(mark))
    both = side(old, "old").join(side(new, "new"), key, "full")
    kind = F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull(), "deleted").otherwise("updated")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select(key, kind.alias("change"))
