"""Clusters, pruning, carried votes and merged sightings on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestay.operators import entities
from lodestay.operators.tiles import shares
from lodestay.plans.registry import load, query


@query(
    "landlord_clusters",
    """WITH RECURSIVE t AS (SELECT DISTINCT o_orderkey AS k, o_custkey AS a, l_suppkey AS c FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
       e AS (SELECT DISTINCT x.k AS x, y.k AS y FROM t x JOIN t y ON x.a = y.a AND x.c = y.c),
       r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
       SELECT x AS o_orderkey, min(y) AS cluster FROM r GROUP BY x""",
)
def landlord_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer that share a supplier, directly or through other orders."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    n = shares(lines)
    rows = orders.repartition(n, "o_orderkey").join(lines.repartition(n, "o_orderkey"), "o_orderkey")
    return entities.shared_contact_clusters(rows, "o_orderkey", "o_custkey", "l_suppkey")


@query(
    "prune_orphans",
    """WITH m AS (SELECT *, o_orderstatus = 'O' AS ok, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
       g AS (SELECT *, bool_or(ok) OVER (PARTITION BY o_custkey) AS any_ok FROM m)
       SELECT o_orderkey, o_custkey FROM g WHERE ok OR (NOT any_ok AND n = 1)""",
)
def prune_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    return entities.prune_orphans(rows, "o_custkey", F.col("o_orderstatus") == "O", [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", "o_custkey")


@query(
    "rekey_votes",
    """WITH m AS (SELECT CASE WHEN user_id % 2 = 0 THEN user_id - user_id % 10 ELSE user_id END AS listing, event_type AS voter, ts, event_id FROM events)
       SELECT listing, voter, ts, event_id FROM m QUALIFY row_number() OVER (PARTITION BY listing, voter ORDER BY ts, event_id) = 1""",
)
def rekey_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even users move to the tens they belong to."""
    events = load(spark, sf_dir, "events")
    votes = events.select(F.col("user_id").alias("listing"), F.col("event_type").alias("voter"), "ts", "event_id")
    mapping = events.where("user_id % 2 = 0").select(F.col("user_id").alias("old"), (F.col("user_id") - F.col("user_id") % 10).alias("new")).distinct()
    return entities.rekey(votes, mapping, "listing", "voter", "ts")


@query("merge_sightings", "SELECT conv_id, arg_max(text, (length(text), -turn)) AS text, min(turn) AS first, count(*) AS sightings FROM conversations GROUP BY conv_id")
def merge_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.merge_sightings(load(spark, sf_dir, "conversations"), "conv_id", "text", "turn")


@query(
    "successor_key",
    """WITH r AS (SELECT o_custkey, o_orderkey AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders),
       t AS (SELECT o_custkey, max(s) FILTER (WHERE n = 1) AS one, max(s) FILTER (WHERE n = 2) AS two FROM r GROUP BY 1)
       SELECT o_orderkey, CASE WHEN one <> o_orderkey THEN one ELSE two END AS successor FROM orders JOIN t USING (o_custkey)""",
)
def successor_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.successor(load(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", "o_totalprice")


@query(
    "bracket_lookup",
    """SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_id,
       first_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after_id
       FROM events QUALIFY event_type = 'error'""",
)
def bracket_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest views before and after each error of a user: the known neighbours of an unknown one."""
    view = F.when(F.col("event_type") == "view", F.col("event_id"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.last(view, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    # The following frame is the preceding one of the reversed order, which needs no second pass over a partition.
    back = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    after = F.last(view, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    rows = load(spark, sf_dir, "events").select("event_id", "event_type", before.alias("before_id"), after.alias("after_id"))
    return rows.where("event_type = 'error'").drop("event_type")
