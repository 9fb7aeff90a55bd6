"""Counts, votes, joins, upserts and rankings on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestay.operators import search, upserts
from lodestay.plans.registry import load, query


@query(
    "group_yield",
    """SELECT d.source, count(*) AS total, count(*) FILTER (WHERE l.quality = 1) AS good,
       count(*) FILTER (WHERE l.quality = 0) AS poor, count(*) FILTER (WHERE l.toxic = 1) AS toxic,
       count(*) FILTER (WHERE l.toxic = 0) AS clean
       FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source""",
)
def group_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = load(spark, sf_dir, "documents").select("doc_id", "source").join(load(spark, sf_dir, "labels"), "doc_id")
    return both.groupBy("source").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("quality") == 1).alias("good"),
        F.count_if(F.col("quality") == 0).alias("poor"),
        F.count_if(F.col("toxic") == 1).alias("toxic"),
        F.count_if(F.col("toxic") == 0).alias("clean"),
    )


@query("verdict_counts", "SELECT o_orderstatus AS verdict, count(*) AS n FROM orders GROUP BY 1")
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("verdict")).agg(F.count("*").alias("n"))


@query("drop_reasons", "SELECT o_orderpriority AS reason, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return rows.groupBy(F.col("o_orderpriority").alias("reason")).agg(F.count("*").alias("n"))


@query(
    "vote_delta_topk",
    """SELECT user_id, sum(CASE WHEN event_type = 'click' THEN 25 WHEN event_type = 'error' THEN -25 ELSE 0 END)::BIGINT AS delta
       FROM events GROUP BY user_id ORDER BY delta DESC, user_id LIMIT 20""",
)
def vote_delta_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = F.when(F.col("event_type") == "click", 25).when(F.col("event_type") == "error", -25).otherwise(0)
    votes = load(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(points).alias("delta"))
    return votes.orderBy(F.desc("delta"), "user_id").limit(20)


@query(
    "saved_not_contacted",
    """SELECT DISTINCT c.c_custkey FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'O'
       WHERE NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = c.c_custkey AND p.o_orderstatus = 'F')""",
)
def saved_not_contacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")
    customers = load(spark, sf_dir, "customer").select("c_custkey")
    saved = orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    contacted = orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return customers.join(saved, "c_custkey", "left_semi").join(contacted, "c_custkey", "left_anti").distinct()


@query("orphan_marks", "SELECT l.doc_id, l.quality, l.toxic FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.lang = 'en')")
def orphan_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    english = load(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    return load(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").join(english, "doc_id", "left_anti")


@query(
    "first_vote_wins",
    """SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n
       FROM events) WHERE n = 1""",
)
def first_vote_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").groupBy("user_id", "event_type")
    return rows.agg(F.min(F.struct("ts", "event_id")).alias("first")).select("user_id", "event_type", F.col("first.event_id").alias("event_id"))


@query("unknown_counter", "SELECT event_type AS location, count(*) AS n, max(ts) AS last_seen FROM events GROUP BY 1")
def unknown_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("location"))
    return rows.agg(F.count("*").alias("n"), F.max("ts").alias("last_seen"))


@query("broker_counts", "SELECT l_suppkey AS phone, count(DISTINCT l_partkey) AS addresses FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) >= 4")
def broker_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("phone"), "l_partkey").distinct()
    return pairs.groupBy("phone").agg(F.count("*").alias("addresses")).where("addresses >= 4")


@query("multi_unit", "SELECT o_custkey AS address, count(*) AS posts FROM orders GROUP BY 1 HAVING count(*) >= 15")
def multi_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("address")).agg(F.count("*").alias("posts")).where("posts >= 15")


@query("score_histogram", "SELECT floor(p_retailprice / 100)::BIGINT AS band, count(*) AS n FROM part GROUP BY 1")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").groupBy(F.floor(F.col("p_retailprice") / 100).alias("band")).agg(F.count("*").alias("n"))


@query(
    "detection_lag",
    """WITH lags AS (SELECT l_returnflag, date_diff('day', o_orderdate, l_shipdate) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
       s AS (SELECT l_returnflag, list_sort(list(d)) AS v FROM lags WHERE d BETWEEN 0 AND 2879 GROUP BY 1)
       SELECT l_returnflag, len(v) AS n, v[floor(0.25 * (len(v) - 1))::INT + 1] AS p25,
       v[floor(0.5 * (len(v) - 1))::INT + 1] AS p50, v[floor(0.75 * (len(v) - 1))::INT + 1] AS p75 FROM s""",
)
def detection_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles by index int(q (n - 1)). Lags are few distinct days, so they are counted before they are ranked."""
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    lags = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_shipdate").join(orders, "l_orderkey")
    lags = lags.select("l_returnflag", F.date_diff("l_shipdate", "o_orderdate").cast("long").alias("d")).where("d between 0 and 2879")
    counted = lags.groupBy("l_returnflag", "d").agg(F.count("*").alias("c"))
    upto = Window.partitionBy("l_returnflag").orderBy("d")
    ranked = counted.withColumn("last", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(Window.partitionBy("l_returnflag")))
    at = lambda q: F.min(F.when(F.col("last") > F.floor(q * (F.col("n") - 1)), F.col("d")))
    return ranked.groupBy("l_returnflag", "n").agg(at(0.25).alias("p25"), at(0.5).alias("p50"), at(0.75).alias("p75"))


@query(
    "search_ranked",
    """SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_retailprice <= 1500 AND p_size >= 3 AND (p_name ILIKE '%a%' OR p_type ILIKE '%a%')
       ORDER BY p_retailprice DESC, p_partkey LIMIT 10""",
)
def search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = search.Request(max_price=1500, rooms=3, terms=["a"])
    found = load(spark, sf_dir, "part").where(search.predicate(wanted, "p_retailprice", "p_size", "p_brand", "p_retailprice", ["p_name", "p_type"]))
    return found.orderBy(F.desc("p_retailprice"), "p_partkey").limit(10).select("p_partkey", "p_name", "p_retailprice")


@query(
    "rekey_enrich_upsert",
    """WITH a AS (SELECT * FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS o_orderstatus, 'NEW' AS o_orderpriority
       FROM orders WHERE o_orderkey % 3 <> 1)
       SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NOT NULL THEN b.o_orderpriority ELSE a.o_orderpriority END AS o_orderpriority,
       coalesce(b.o_orderstatus, a.o_orderstatus) AS o_orderstatus FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey""",
)
def rekey_enrich_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    new = orders.where("o_orderkey % 3 <> 1").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("o_orderstatus"), F.lit("NEW").alias("o_orderpriority"))
    return upserts.enrich(orders.where("o_orderkey % 3 <> 0"), new, "o_orderkey", ["o_orderpriority"], ["o_orderstatus"])


@query("earliest_date", "SELECT user_id, min(ts) AS first_ts, min(ts) FILTER (WHERE event_type = 'purchase') AS first_purchase FROM events GROUP BY user_id")
def earliest_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    purchase = F.when(F.col("event_type") == "purchase", F.col("ts"))
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.min(purchase).alias("first_purchase"))


@query(
    "absorb_unique_match",
    """WITH m AS (SELECT c_custkey, min(s_suppkey) AS s_suppkey, count(*) AS n FROM customer JOIN supplier ON c_nationkey = s_nationkey
       AND floor(c_acctbal / 100) = floor(s_acctbal / 100) GROUP BY c_custkey) SELECT c_custkey, s_suppkey FROM m WHERE n = 1""",
)
def absorb_unique_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    vague = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("k"), F.floor(F.col("c_acctbal") / 100).alias("p"))
    exact = load(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"), F.floor(F.col("s_acctbal") / 100).alias("p"))
    unique = exact.groupBy("k", "p").agg(F.min("s_suppkey").alias("s_suppkey"), F.count("*").alias("n")).where("n = 1")
    return vague.join(unique, ["k", "p"]).select("c_custkey", "s_suppkey")


@query("retention_null", "SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN NULL ELSE o_orderpriority END AS o_orderpriority, o_orderstatus FROM orders")
def retention_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp")
    return upserts.retire(load(spark, sf_dir, "orders"), old, ["o_orderpriority"]).select("o_orderkey", "o_orderpriority", "o_orderstatus")


@query(
    "set_diff_addresses",
    """(SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1""",
)
def set_diff_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(load(spark, sf_dir, "supplier").select("s_nationkey")).distinct()
    skip = load(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("k"))
    return every.join(skip, "k", "left_anti")


@query(
    "coalesce_tiers",
    """SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 5000 THEN n_name END, CASE WHEN c_acctbal > 0 THEN r_name END, 'none') AS place,
       CASE WHEN c_acctbal > 5000 AND n_name IS NOT NULL THEN 'nation' WHEN c_acctbal > 0 AND r_name IS NOT NULL THEN 'region' ELSE 'default' END AS origin
       FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def coalesce_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered fallback: independent left joins, and the first answer names its source."""
    nation = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", F.col("n_regionkey").alias("r_regionkey"))
    rows = load(spark, sf_dir, "customer").join(nation, "c_nationkey", "left").join(load(spark, sf_dir, "region"), "r_regionkey", "left")
    exact, coarse = F.when(F.col("c_acctbal") > 5000, F.col("n_name")), F.when(F.col("c_acctbal") > 0, F.col("r_name"))
    origin = F.when(exact.isNotNull(), "nation").when(coarse.isNotNull(), "region").otherwise("default")
    return rows.select("c_custkey", F.coalesce(exact, coarse, F.lit("none")).alias("place"), origin.alias("origin"))


@query(
    "diff_replay",
    """WITH n AS (SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'F' ELSE o_orderstatus END AS fresh, o_orderstatus AS stored FROM orders)
       SELECT stored, fresh, count(*) AS n FROM n WHERE stored IS DISTINCT FROM fresh GROUP BY 1, 2""",
)
def diff_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = F.when(F.col("o_totalprice") > 200000, "F").otherwise(F.col("o_orderstatus"))
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("stored"), fresh.alias("fresh"))
    return rows.where(~F.col("stored").eqNullSafe(F.col("fresh"))).groupBy("stored", "fresh").agg(F.count("*").alias("n"))


@query(
    "ab_agreement",
    """SELECT field, count(*) AS n, sum((a = b)::INT)::BIGINT AS same FROM (SELECT 'quality' AS field, l.quality AS a, 1 AS b FROM labels l
       UNION ALL SELECT 'toxic', l.toxic, l.quality FROM labels l) GROUP BY field""",
)
def ab_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = load(spark, sf_dir, "labels").selectExpr("stack(2, 'quality', quality, 1, 'toxic', toxic, quality) AS (field, a, b)")
    return pairs.groupBy("field").agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same"))
