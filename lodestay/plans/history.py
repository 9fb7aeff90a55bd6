"""Versions, replays, corrections, owed alerts and changes over orders and events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestay.operators import changes, overrides, replay
from lodestay.operators.snapshots import Snapshots
from lodestay.plans.registry import load, query
from lodestay.storage import Scratch, kept_path
from lodestay.streaming import brokers, feeds, outbox

#: Posts of listings: three posts for two keys each, in the order of their numbers; the new rule turns some over.
_POSTS = """p AS (SELECT o_orderkey AS place, 'sig' || o_orderkey AS sig, 'k' || (o_orderkey // 3) AS dedup_key, 'k' || (o_orderkey // 3 + 1) AS other_key,
     CASE o_orderstatus WHEN 'O' THEN 'MATCH' WHEN 'P' THEN 'NEEDS_DATA' ELSE 'DROP' END AS verdict, (o_orderkey % 90)::INT AS score, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END AS lease,
     floor(o_totalprice)::BIGINT % 2500 AS price FROM orders),
     j AS (SELECT *, CASE WHEN price > 1800 THEN 'DROP' WHEN price < 400 THEN 'MATCH' ELSE verdict END AS new_verdict, CASE WHEN price % 5 = 0 THEN score + 5 ELSE score END AS new_score FROM p WHERE score >= 10)"""


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "O", "MATCH").when(F.col("o_orderstatus") == "P", "NEEDS_DATA").otherwise("DROP")
    named = lambda n: F.concat(F.lit("k"), n.cast("string"))
    third = F.floor(k / 3)
    return load(spark, sf_dir, "orders").select(
        k.alias("place"), F.concat(F.lit("sig"), k.cast("string")).alias("sig"), named(third).alias("dedup_key"), F.array(named(third), named(third + 1)).alias("dedup_keys"),
        status.alias("verdict"), (k % 90).cast("int").alias("score"), F.when(k % 4 == 0, F.col("o_orderpriority")).alias("lease"), (F.floor("o_totalprice") % 2500).alias("price"),
    )


def _rule(posts: DataFrame) -> DataFrame:
    verdict = F.when(F.col("price") > 1800, "DROP").when(F.col("price") < 400, "MATCH").otherwise(F.col("verdict"))
    return posts.select("sig", verdict.alias("verdict"), F.when(F.col("price") % 5 == 0, F.col("score") + 5).otherwise(F.col("score")).alias("score"))


@query("replay_changes", f"""WITH {_POSTS} SELECT sig, verdict, score, new_verdict, new_score, CASE WHEN verdict <> 'MATCH' AND new_verdict = 'MATCH' THEN 'rescued'
       WHEN verdict IN ('MATCH', 'NEEDS_DATA') AND new_verdict NOT IN ('MATCH', 'NEEDS_DATA') THEN 'demoted' ELSE 'changed' END AS change FROM j WHERE verdict <> new_verdict OR score <> new_score""")
def replay_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.changed(replay.judged(replay.selected(_posts(spark, sf_dir), least_score=10), _rule))


@query("replay_apply", f"""WITH {_POSTS}, old AS (SELECT 'k' || (o_orderkey // 2) AS key, 'OLD' AS verdict, 1 AS score, 'old lease' AS lease FROM orders WHERE o_orderkey % 2 = 0),
       d AS (SELECT key, max(place) AS gone FROM (SELECT dedup_key AS key, place FROM j WHERE new_verdict = 'DROP' UNION ALL SELECT other_key, place FROM j WHERE new_verdict = 'DROP') GROUP BY key),
       s AS (SELECT j.dedup_key AS key, new_verdict, new_score, lease, place FROM j LEFT JOIN d ON d.key = j.dedup_key WHERE new_verdict <> 'DROP' AND (gone IS NULL OR place > gone)),
       n AS (SELECT key, arg_max(new_verdict, place) AS verdict, arg_max(new_score, place) AS score, arg_max(lease, place) FILTER (lease IS NOT NULL) AS lease FROM s GROUP BY key),
       o AS (SELECT * FROM old WHERE key NOT IN (SELECT key FROM d)),
       v2 AS (SELECT coalesce(n.key, o.key) AS key, coalesce(n.verdict, o.verdict) AS verdict, coalesce(n.score, o.score) AS score, coalesce(n.lease, o.lease) AS lease FROM o FULL JOIN n ON o.key = n.key)
       SELECT 2 AS version, * FROM v2 UNION ALL SELECT 1, * FROM old UNION ALL SELECT 0, * FROM old""")
def replay_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version 1 are the old listings, 2 those after a replay; 0 stands for what is current after an undo."""
    k = F.col("o_orderkey")
    old = load(spark, sf_dir, "orders").where(k % 2 == 0).select(F.concat(F.lit("k"), F.floor(k / 2).cast("string")).alias("key"), F.lit("OLD").alias("verdict"), F.lit(1).alias("score"), F.lit("old lease").alias("lease"))
    table = Snapshots(spark, kept_path(spark, "listings"))
    table.commit(old)
    rows = replay.judged(replay.selected(_posts(spark, sf_dir), least_score=10), _rule)
    with Scratch(spark) as scratch:
        rows = scratch.write(rows.withColumns({"verdict": F.col("new_verdict"), "score": F.col("new_score")}), "judged")
        replay.apply(table, rows, "key", ["verdict", "score"], ["lease"])
    table.undo()
    read = lambda mark, version: table.read(version).select(F.lit(mark).alias("version"), "key", "verdict", "score", "lease")
    return read(2, 2).unionByName(read(1, 1)).unionByName(read(0, None))


@query("changed_rows", """SELECT event_id AS key, CASE WHEN event_id % 41 = 0 THEN 'deleted' WHEN event_id % 43 = 0 THEN 'inserted' ELSE 'updated' END AS change FROM events
       WHERE event_id % 41 = 0 AND event_id % 43 <> 0 OR event_id % 43 = 0 AND event_id % 41 <> 0 OR event_id % 47 = 0 AND event_id % 41 <> 0 AND event_id % 43 <> 0""")
def changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of the events, stored by bucket: only buckets whose digests differ are read and joined."""
    rows = load(spark, sf_dir, "events").select(F.col("event_id").alias("key"), "event_type", "value", "props")
    old = rows.where("key % 43 <> 0")
    new = rows.where("key % 41 <> 0").withColumn("props", F.when(F.col("key") % 47 == 0, F.lit(None)).otherwise(F.col("props")))
    table = Snapshots(spark, kept_path(spark, "events"))
    for version in (old, new):
        table.commit(changes.with_bucket(version, "key", 64), partition_by=["bucket"])
    before, after = table.read(1), table.read(2)
    differ = changes.changed_buckets(changes.fingerprint(before), changes.fingerprint(after))
    return changes.changes(before, after, "key", differ)


@query("manual_overrides", """WITH e AS (SELECT event_id AS seq, ts, CASE WHEN event_id % 97 = 0 THEN 'clear_all' WHEN event_type = 'error' THEN 'clear' ELSE 'set' END AS kind, user_id AS key, value FROM events WHERE ts < TIMESTAMP '2024-01-25'),
       c AS (SELECT ts, seq FROM e WHERE kind = 'clear_all' ORDER BY ts DESC, seq DESC LIMIT 1), o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS i FROM e WHERE kind <> 'clear_all')
       SELECT o.key, o.value AS lat, o.value + 1 AS lon FROM o LEFT JOIN c ON true WHERE i = 1 AND kind = 'set' AND (c.ts IS NULL OR (o.ts, o.seq) > (c.ts, c.seq))""")
def manual_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 97 == 0, "clear_all").when(F.col("event_type") == "error", "clear").otherwise("set")
    rows = load(spark, sf_dir, "events").where("ts < timestamp '2024-01-25'")
    events = rows.select(F.col("event_id").alias("seq"), "ts", kind.alias("kind"), F.col("user_id").alias("key"), F.col("value").alias("lat"), (F.col("value") + 1).alias("lon"))
    return overrides.current(events, "key", ["lat", "lon"])


_TIERS = "CASE WHEN lat > 500 THEN 'GREEN' WHEN lat > 100 THEN 'AMBER' ELSE 'RED' END"


@query("relocations", f"""WITH l AS (SELECT c_custkey AS key, (c_custkey % 700)::DOUBLE AS lat, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal ELSE (c_custkey % 700)::DOUBLE END AS moved FROM customer),
       g AS (SELECT key, {_TIERS} AS tier, {_TIERS.replace("lat", "moved")} AS new_tier FROM l) SELECT key, tier AS before, new_tier AS after FROM g WHERE tier <> new_tier""")
def relocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third customer is put elsewhere by hand; those whose zone is another one then."""
    tier = lambda lat: F.when(lat > 500, "GREEN").when(lat > 100, "AMBER").otherwise("RED")
    at = (F.col("c_custkey") % 700).cast("double")
    rows = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), at.alias("lat"), F.lit(0.0).alias("lon"), tier(at).alias("tier"), F.lit("MATCH").alias("status"), F.lit(1).alias("score"))
    points = load(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("lat"), F.lit(0.0).alias("lon"))
    _, report = overrides.relocated(rows, points, "key", lambda moved: moved.withColumn("tier", tier(F.col("lat"))))
    return report.select("key", F.col("before.tier").alias("before"), F.col("after.tier").alias("after"))


def _failing_sink(rows: pd.DataFrame) -> list[bool]:
    """Fails once for numbers that three divides, twice for those that nine does, and so on."""
    number = rows["key"].str[1:].astype("int64")
    return (number % 3 ** rows["attempt"] != 0).tolist()


@query("outbox_delivery", """SELECT 'k' || o_orderkey AS key, (CASE WHEN o_orderkey % 3 <> 0 THEN 1 WHEN o_orderkey % 9 <> 0 THEN 2 ELSE 3 END)::BIGINT AS attempts, o_orderkey % 27 <> 0 AS delivered, (o_orderkey % 27 <> 0)::INT::BIGINT AS times
       FROM orders WHERE o_orderkey % 100 >= 75 AND o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1996-01-01'""")
def outbox_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs with a sink that fails at first: how often each owed alert was tried, and how often it was delivered."""
    k = F.col("o_orderkey")
    rows = load(spark, sf_dir, "orders").select(F.concat(F.lit("k"), k.cast("string")).alias("key"), F.when(F.col("o_orderstatus") == "O", "MATCH").otherwise("DROP").alias("status"), (k % 100).alias("score"), F.col("o_orderdate").cast("timestamp").alias("first_seen"))
    path, hours = kept_path(spark, "ledger"), int((pd.Timestamp("2000-01-01") - pd.Timestamp("1996-01-01")).total_seconds() // 3600)
    for _ in range(3):
        outbox.retry_pending(spark, rows, path, _failing_sink, "2000-01-01 00:00:00", hours)
    times = outbox.ledger(spark, path).groupBy("key").agg(F.count_if("delivered").alias("times"))
    return outbox.attempts(spark, path).join(times, "key")


@query("stream_broker_counts", """WITH p AS (SELECT DISTINCT right('05' || lpad((user_id % 400)::VARCHAR, 8, '0'), 9) AS phone, event_type || ' ' || (event_id % 23) AS address FROM events WHERE user_id % 13 <> 0 AND event_id % 7 <> 0)
       SELECT 'phone:' || phone AS phone, count(*) AS addresses FROM p GROUP BY 1""")
def stream_broker_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phones and addresses are written in several ways; some are too short, some have no number."""
    e = F.col("event_id")
    phone = F.concat(F.lit("05"), F.lpad((F.col("user_id") % 400).cast("string"), 8, "0"))
    contact = F.when(F.col("user_id") % 13 == 0, "call me").when(e % 2 == 0, F.concat(F.lit("tel. "), phone)).otherwise(phone)
    number = F.when(e % 7 == 0, "").otherwise((e % 23).cast("string"))
    address = F.concat(F.when(e % 5 == 0, F.upper("event_type")).otherwise(F.col("event_type")), F.when(e % 3 == 0, "'  ").otherwise(" "), number)
    folder = kept_path(spark, "brokers")
    brokers.keep_counts(brokers.address_counts(feeds.table_stream(spark, sf_dir, "events"), contact, address), f"{folder}/rows", f"{folder}/state")
    return brokers.current_counts(spark, f"{folder}/rows")
