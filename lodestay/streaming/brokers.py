"""How many distinct numbered addresses each phone has advertised, kept by a stream of posts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestay.functions import text
from lodestay.operators.dedup import legacy_address

_SCHEMA = "phone string, addresses long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Without it, a state with a time by the clock asks for one empty micro-batch after another and never ends.
_SETTINGS = {_PROVIDER: _ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


class _Addresses(StatefulProcessor):
    """The addresses of a phone as a map, each entry a row of the state store, so that no phone is held in memory whole."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "address string", "seen boolean", self.keep_ms)
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = (self.count.get() or (0,))[0]
        fresh = 0
        for part in rows:
            for address in part["address"].unique():
                if not self.known.containsKey((address,)):
                    fresh += 1
                    self.known.updateValue((address,), (True,))
                elif self.keep_ms:
                    self.known.updateValue((address,), (True,))  # seen again: its time begins anew
        now = sum(1 for _ in self.known.keys()) if self.keep_ms else before + fresh
        if now != before:
            self.count.update((now,))
            yield pd.DataFrame({"phone": [key[0]], "addresses": [now]})

    def close(self) -> None:
        pass


def address_counts(posts: DataFrame, contact: Column, address: Column, keep: str | None = None) -> DataFrame:
    """A stream of (phone, addresses): the new count of each phone whose count a micro-batch changed.

    Contacts count by their phone key, addresses by their normal form; posts without either add nothing, and an address seen
    before adds nothing, so rows that come twice change nothing. With ``keep`` (such as ``30 days``) an address that was
    not seen for so long by the clock counts no more, from the next post of its phone on.
    """
    pairs = posts.select(text.phone_key(contact).alias("phone"), legacy_address(address).alias("address")).where("phone is not null and address is not null")
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000) if keep else None
    mode = "ProcessingTime" if keep else "None"
    return pairs.groupBy("phone").transformWithStateInPandas(_Addresses(keep_ms), _SCHEMA, "Update", mode)


@contextmanager
def rocksdb_state(spark: SparkSession):
    """The state store on disk that map state needs, for the streams that start inside; the session's settings come back."""
    before = {key: spark.conf.get(key) for key in _SETTINGS}
    try:
        for key, value in _SETTINGS.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def keep_counts(counts: DataFrame, path: str, state: str) -> None:
    """Run ``address_counts`` over what its source holds now; every micro-batch writes its changes as a folder of its own.

    A micro-batch that runs again replaces its folder, so that nothing is counted twice.
    """
    with rocksdb_state(counts.sparkSession):
        writer = counts.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True)
        writer.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")).start().awaitTermination()


def current_counts(spark: SparkSession, path: str) -> DataFrame:
    """(phone, addresses): the last count of each phone among the changes at ``path``."""
    changes = spark.read.schema(f"{_SCHEMA}, batch long").option("basePath", path).parquet(path)
    return changes.groupBy("phone").agg(F.max_by("addresses", "batch").alias("addresses"))
