"""Alerts that were owed and not delivered: rows to tell, a ledger of attempts, and retries until each has gone out once."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestay.operators.search import pending_alerts

#: Takes rows with ``token``, the same at every attempt of a key, and ``attempt`` from 1; says for each whether it was delivered.
Send = Callable[[pd.DataFrame], list[bool]]
_LEDGER = "key string, attempt long, delivered boolean, sent_at timestamp"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """(key, attempt, delivered, sent_at) of all attempts; none if the ledger is new."""
    spark.createDataFrame([], _LEDGER).write.mode("append").parquet(f"{path}/run=none")
    return spark.read.schema(_LEDGER).parquet(path)


def attempts(spark: SparkSession, path: str) -> DataFrame:
    """(key, attempts, delivered) of every key that was tried."""
    return ledger(spark, path).groupBy("key").agg(F.max("attempt").alias("attempts"), F.max("delivered").alias("delivered"))


def _sender(send: Send, now: str) -> Callable:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                try:
                    told = list(send(part))
                except Exception:  # noqa: BLE001 - a sink that breaks has not delivered; its rows stay owed
                    told = [False] * len(part)
                yield pd.DataFrame({"key": part["key"], "attempt": part["attempt"], "delivered": told, "sent_at": pd.Timestamp(now)})

    return run


def deliver(spark: SparkSession, rows: DataFrame, path: str, send: Send, now: str, most: int | None = None) -> DataFrame:
    """Send the ``rows`` (key, ...) that the ledger at ``path`` does not have as delivered; returns the attempts of this run.

    Every run adds a folder to the ledger when all its attempts are known. A run that dies before that has told nobody
    it was there: its rows are sent again with the same token, by which a sink drops what it has. Rows of one key
    are one message. With ``most``, a run sends the first rows by score and key and leaves the others owed.
    """
    tried = attempts(spark, path)
    done = tried.where("delivered").select("key")
    owed = rows.dropDuplicates(["key"]).join(done, "key", "left_anti").join(tried.select("key", "attempts"), "key", "left")
    if most is not None:
        owed = owed.orderBy(F.desc_nulls_last("score"), "key").limit(most)
    owed = owed.withColumns({"attempt": F.coalesce("attempts", F.lit(0)) + 1, "token": F.sha2("key", 256)}).drop("attempts")
    folder = f"{path}/run={uuid.uuid4().hex}"
    owed.mapInPandas(_sender(send, now), _LEDGER).write.parquet(folder)
    return spark.read.schema(_LEDGER).parquet(folder)


def retry_pending(spark: SparkSession, listings: DataFrame, path: str, send: Send, now: str, hours: int = 24, least: int = 75, most: int | None = None) -> DataFrame:
    """Tell what is owed of listings (key, status, score, first_seen): alert-worthy, not older than ``hours``, and never delivered.

    An older alert stays untold on purpose: a flat of two days ago has gone.
    """
    at = F.lit(now).cast("timestamp")
    worthy = pending_alerts(listings.withColumn("alerted_at", F.lit(None).cast("timestamp")), at, hours, least)
    return deliver(spark, worthy, path, send, now, most)


def deliver_stream(stream: DataFrame, folder: str, send: Send, now: Callable[[], str]) -> None:
    """Run a stream of rows (key, ...) over what its source holds now: each micro-batch is stored, then all that is owed is sent.

    A micro-batch that runs again replaces its stored rows; what the ledger has as delivered is not sent again.
    """
    spark, schema = stream.sparkSession, stream.schema

    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        deliver(spark, spark.read.schema(schema).parquet(f"{folder}/rows"), f"{folder}/ledger", send, now())

    stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(handle).start().awaitTermination()


def run_report(worthy: Column, sent: Column, seen: Column) -> Column:
    """One line on a run's alerts, which says which zero it is: nothing seen, nothing worthy, nothing sent, or some of it."""
    count = lambda c: c.cast("string")
    return (
        F.when(seen == 0, "no alerts: nothing new")
        .when(worthy == 0, F.concat(F.lit("no alerts: none of "), count(seen), F.lit(" passed the score gate")))
        .when(sent == 0, F.concat(F.lit("FAILED: 0 of "), count(worthy), F.lit(" sent, all are owed")))
        .otherwise(F.concat(F.lit("sent "), count(sent), F.lit(" of "), count(worthy)))
    )
