import glob
import os
import random
import shutil
import sys

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lodestay.operators import reports
from lodestay.streaming import brokers, outbox

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import the tests


def posts(n, seed):
    r = random.Random(seed)
    phone = lambda p: r.choice([f"05{p:08d}", f"05-{p:08d} call", f"+972 5{p:08d}"])
    return [(phone(r.randrange(12)) if r.random() < 0.9 else None, r.choice(["Main St {0}", "main  st {0}", "'Main St' {0}", "no number"]).format(r.randrange(6)) if r.random() < 0.9 else None) for _ in range(n)]


def counted(rows):
    pairs = set()
    for phone, address in rows:
        digits = "".join(c for c in phone or "" if c.isdigit())
        plain = " ".join((address or "").replace("'", "").lower().split())
        if len(digits) >= 7 and any(c.isdigit() for c in plain):
            pairs.add((digits[-9:], plain))
    return {f"phone:{p}": sum(q == p for q, _ in pairs) for p, _ in pairs}


def stream_of(spark, folder):
    return spark.readStream.schema("contact string, address string").option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("cuts", [[200], [50, 50, 100], [1, 199]])
def test_counts_of_any_split_equal_the_batch(spark, tmp_path, cuts):
    rows, at = posts(200, 4), 0
    for i, n in enumerate(cuts):
        spark.createDataFrame(rows[at : at + n], "contact string, address string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        at += n
        if i == 0:  # what a first run saw is carried on by the next
            brokers.keep_counts(brokers.address_counts(stream_of(spark, str(tmp_path / "in")), F.col("contact"), F.col("address")), str(tmp_path / "out"), str(tmp_path / "state"))
    run = lambda: brokers.keep_counts(brokers.address_counts(stream_of(spark, str(tmp_path / "in")), F.col("contact"), F.col("address")), str(tmp_path / "out"), str(tmp_path / "state"))
    run()
    now = lambda: {r.phone: r.addresses for r in brokers.current_counts(spark, str(tmp_path / "out")).collect()}
    assert now() == counted(rows)
    # The last micro-batch is taken for unfinished and runs again, from the state before it.
    last = max(glob.glob(str(tmp_path / "state" / "commits" / "[0-9]*")), key=lambda p: int(os.path.basename(p)))
    os.remove(last)
    if os.path.exists(f"{os.path.dirname(last)}/.{os.path.basename(last)}.crc"):
        os.remove(f"{os.path.dirname(last)}/.{os.path.basename(last)}.crc")
    run()
    assert now() == counted(rows)
    # The same posts once more are nothing new.
    shutil.copytree(tmp_path / "in", tmp_path / "again")
    for f in glob.glob(str(tmp_path / "again" / "part-*.parquet")):
        shutil.copy(f, str(tmp_path / "in" / f"part-9{os.path.basename(f)[5:]}"))
    run()
    assert now() == counted(rows)
    pairs = spark.createDataFrame([(k, f"a{i}") for k, n in counted(rows).items() for i in range(n)], "phone string, identity string")
    assert {r.phone: r.addresses for r in reports.brokers(pairs, 1).collect()} == now()


def test_addresses_that_are_kept_for_a_while_count_by_the_clock(spark, tmp_path):
    spark.createDataFrame(posts(60, 1), "contact string, address string").coalesce(1).write.parquet(str(tmp_path / "in"))
    counts = brokers.address_counts(stream_of(spark, str(tmp_path / "in")), F.col("contact"), F.col("address"), keep="1 day")
    brokers.keep_counts(counts, str(tmp_path / "out"), str(tmp_path / "state"))
    assert {r.phone: r.addresses for r in brokers.current_counts(spark, str(tmp_path / "out")).collect()} == counted(posts(60, 1))


class FolderSink:
    """Writes one file a token and attempt; fails for chosen keys at their first attempts, and breaks down for others."""

    def __init__(self, folder, failures, breaks=()):
        self.folder, self.failures, self.breaks = str(folder), failures, set(breaks)

    def __call__(self, rows: pd.DataFrame) -> list[bool]:
        if self.breaks & set(rows["key"]) and rows["attempt"].min() == 1:
            raise OSError("no network")
        out = []
        for r in rows.itertuples():
            good = r.attempt > self.failures.get(r.key, 0)
            if good:
                with open(os.path.join(self.folder, f"{r.key}-{r.token[:6]}-{random.randrange(10**9)}"), "w") as f:
                    f.write(r.key)
            out.append(good)
        return out


def test_every_alert_goes_out_once_however_often_the_sink_fails(spark, tmp_path):
    sent = tmp_path / "sent"
    sent.mkdir()
    sink = FolderSink(sent, {"k1": 1, "k2": 2, "k3": 99}, breaks={"k4"})
    rows = spark.createDataFrame([(f"k{i % 6}", "MATCH", 80 + i % 6, "2024-01-02 00:00:00") for i in range(9)] + [("low", "MATCH", 10, "2024-01-02 00:00:00"), ("old", "MATCH", 99, "2023-01-01 00:00:00")], "key string, status string, score int, first_seen string").withColumn("first_seen", F.col("first_seen").cast("timestamp")).coalesce(1)
    told = lambda: sorted(f.split("-")[0] for f in os.listdir(sent))
    ledger = str(tmp_path / "ledger")
    first = outbox.retry_pending(spark, rows, ledger, sink, "2024-01-02 10:00:00")
    assert first.count() == 6 and not first.where("delivered").count() == 6
    for _ in range(3):
        outbox.retry_pending(spark, rows, ledger, sink, "2024-01-02 10:00:00")
    assert told() == ["k0", "k1", "k2", "k4", "k5"]
    state = {r.key: (r.attempts, r.delivered) for r in outbox.attempts(spark, ledger).collect()}
    assert state["k3"] == (4, False) and all(d for k, (_, d) in state.items() if k != "k3") and set(state) == {f"k{i}" for i in range(6)}
    assert outbox.deliver(spark, rows.where("key = 'none'"), ledger, sink, "2024-01-02 10:00:00").count() == 0


def test_the_best_alerts_of_a_run_first(spark, tmp_path):
    (tmp_path / "sent").mkdir()
    rows = spark.createDataFrame([(f"k{i}", i) for i in range(8)], "key string, score int")
    runs = [sorted(r.key for r in outbox.deliver(spark, rows, str(tmp_path / "ledger"), FolderSink(tmp_path / "sent", {}), "2024-01-01", most=5).collect()) for _ in range(3)]
    assert runs == [["k3", "k4", "k5", "k6", "k7"], ["k0", "k1", "k2"], []]


def test_a_stream_of_alerts_keeps_what_it_owes(spark, tmp_path):
    (tmp_path / "sent").mkdir()
    sink = FolderSink(tmp_path / "sent", {"k1": 1, "k4": 2})
    for part in (["k1", "k2"], ["k2", "k3"], ["k4"]):
        spark.createDataFrame([(k,) for k in part], "key string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("key string").parquet(str(tmp_path / "in"))
        outbox.deliver_stream(stream, str(tmp_path / "box"), sink, lambda: "2024-01-01")
    assert {r.key: r.delivered for r in outbox.attempts(spark, str(tmp_path / "box" / "ledger")).collect()} == {"k1": True, "k2": True, "k3": True, "k4": False}
    assert sorted(f.split("-")[0] for f in os.listdir(tmp_path / "sent")) == ["k1", "k2", "k3"]


def test_the_report_says_which_zero_it_is(spark):
    rows = spark.createDataFrame([(0, 0, 0), (0, 0, 3), (2, 0, 3), (2, 1, 3)], "worthy int, sent int, seen int")
    said = [r[0] for r in rows.select(outbox.run_report(F.col("worthy"), F.col("sent"), F.col("seen"))).collect()]
    assert said == ["no alerts: nothing new", "no alerts: none of 3 passed the score gate", "FAILED: 0 of 2 sent, all are owed", "sent 1 of 2"]
