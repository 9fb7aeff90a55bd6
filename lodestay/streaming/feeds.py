"""Streams of posts and runs: first sightings, quotas, sessions, dangling starts and earliest-time merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How late a row may come; state older than this is dropped.
DELAY = "2 hours"


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of ``folder`` as a stream of files; its schema is read from the files that are there.

    Watermarks need an instant, so times without a zone are taken in the session's one.
    """
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return stream.select(*(F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name) for f in schema))


def first_sightings(stream: DataFrame, keys: list[str], ts: str, delay: str = DELAY) -> DataFrame:
    """Rows whose key was not seen within ``delay``; state is bounded by the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def quota_counts(stream: DataFrame, ts: str, model: str, delay: str = DELAY) -> DataFrame:
    """Calls per model and quota day, which begins at ten in the morning."""
    day = F.window(ts, "1 day", "1 day", "10 hours")
    counted = stream.withWatermark(ts, delay).groupBy(day.alias("day"), F.col(model).alias("model")).agg(F.count("*").alias("calls"))
    return counted.select(F.to_date("day.start").cast("string").alias("quota_day"), "model", "calls")


def sessions(stream: DataFrame, key: str, ts: str, gap: str = "30 minutes", delay: str = DELAY) -> DataFrame:
    """Sessions of a key, which end after a pause of ``gap``."""
    grouped = stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("s"), F.col(key))
    return grouped.agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start_ts"), "n")


def dangling(starts: DataFrame, ends: DataFrame, key: str, delay: str = DELAY, patience: str = "2 hours") -> DataFrame:
    """Starts (key, ts) that no end of the same key follows within ``patience``; each comes once that is certain."""
    a = starts.select(F.col(key), F.col("ts").alias("start_ts")).withWatermark("start_ts", delay).alias("a")
    b = ends.select(F.col(key).alias("end_key"), F.col("ts").alias("end_ts")).withWatermark("end_ts", delay).alias("b")
    near = (F.col(key) == F.col("end_key")) & F.expr(f"end_ts >= start_ts AND end_ts <= start_ts + INTERVAL {patience}")
    return a.join(b, near, "left_outer").where("end_key is null").select(key, "start_ts")


def merge_earliest(posts: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The archive ``posts`` (key, posted_at, first_seen) after a micro-batch of the same columns.

    The first sighting of a key stays; its publication time only moves back. One of the batch that is after the first
    sighting is refused, and what the archive has is kept. A batch may hold a key many times, and the same batch may
    come again: the result is the same.
    """
    old = posts.select(key, "posted_at", "first_seen", F.lit(True).alias("archived"))
    rows = old.unionByName(batch.select(key, "posted_at", "first_seen", F.lit(False).alias("archived")))
    seen = rows.groupBy(key).agg(F.min("first_seen").alias("first_seen"))
    kept = rows.select(key, "posted_at", "archived").join(seen, key).groupBy(key, "first_seen")
    fits = F.when(F.col("archived") | (F.col("posted_at") <= F.col("first_seen")), F.col("posted_at"))
    return kept.agg(F.min(fits).alias("posted_at")).select(key, "posted_at", "first_seen")


def drain(result: DataFrame, path: str, state: str, mode: str) -> DataFrame:
    """Run a stream over what its source holds now and give what it wrote.

    In complete mode every micro-batch replaces the table at ``path``; in append mode Spark's file sink adds to it.
    """
    spark, schema = result.sparkSession, result.schema
    writer = result.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", path).start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(path)
