"""Runs, intervals, quotas, headways and quantiles over event times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestay.operators import intervals, reports
from lodestay.plans.registry import load, query
from lodestay.storage import Scratch


def _ordered(*keys: str):
    return Window.partitionBy(*keys).orderBy("ts", "event_id")


@query(
    "gaps_islands",
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events)
       SELECT user_id, event_type, min(ts) AS begin_ts, max(ts) AS end_ts, count(*) AS n FROM n GROUP BY user_id, event_type, g""",
)
def gaps_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    changed = (F.lag("event_type").over(_ordered("user_id")) != F.col("event_type")).cast("int")
    rows = rows.withColumn("changed", changed).withColumn("island", F.sum(F.coalesce("changed", F.lit(0))).over(_ordered("user_id")))
    return rows.groupBy("user_id", "event_type", "island").agg(F.min("ts").alias("begin_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n")).drop("island")


@query(
    "start_end_pairs",
    """SELECT user_id, event_id, ts AS start_ts, lead(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS end_ts
       FROM events WHERE event_type IN ('signup', 'purchase') QUALIFY event_type = 'signup'""",
)
def start_end_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").where("event_type in ('signup', 'purchase')")
    end = F.lead(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(_ordered("user_id"))
    return rows.withColumn("end_ts", end).where("event_type = 'signup'").select("user_id", "event_id", F.col("ts").alias("start_ts"), "end_ts")


_RUNS = "runs AS (SELECT event_id, ts AS a, ts + (CASE WHEN event_id % 50 = 0 THEN INTERVAL 40 HOUR ELSE INTERVAL 90 MINUTE END) AS b FROM events WHERE event_type = 'error')"
_SLOTS = "slots AS (SELECT unnest(generate_series(date_trunc('hour', (SELECT min(ts) FROM events)), date_trunc('hour', (SELECT max(ts) FROM events)), INTERVAL 1 HOUR)) AS slot)"


def _error_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 90 minutes, every fiftieth of 40 hours."""
    length = F.when(F.col("event_id") % 50 == 0, F.expr("INTERVAL 40 HOURS")).otherwise(F.expr("INTERVAL 90 MINUTES"))
    return load(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", F.col("ts").alias("a"), (F.col("ts") + length).alias("b"))


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hours from the first event's to the last one's."""
    hour = lambda ts: F.date_trunc("hour", ts).cast("timestamp_ntz")
    ends = load(spark, sf_dir, "events").agg(hour(F.min("ts")).alias("first"), hour(F.max("ts")).alias("last"))
    return ends.select(F.explode(F.sequence("first", "last", F.expr("INTERVAL 1 HOUR"))).alias("slot"))


@query("slot_in_run", f"WITH {_RUNS}, {_SLOTS} SELECT slot, count(event_id) AS runs FROM slots LEFT JOIN runs ON slot BETWEEN a AND b GROUP BY slot")
def slot_in_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many runs hold each hour of the whole table, by one running total over begins, ends and hours."""
    with Scratch(spark) as scratch:
        return scratch.keep(intervals.held(_hourly(spark, sf_dir), _error_runs(spark, sf_dir), "slot", "a", "b", "runs", scratch), "slots")


@query("runs_of_slots", f"WITH {_RUNS}, {_SLOTS} SELECT slot, event_id FROM slots JOIN runs ON slot BETWEEN a AND b")
def runs_of_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which runs hold each hour, by buckets as wide as the runs."""
    return intervals.containing(_hourly(spark, sf_dir), _error_runs(spark, sf_dir), "slot", "a", "b").select("slot", "event_id")


@query("overlapping_runs", f"""WITH {_RUNS}, v AS (SELECT event_id AS view_id, ts AS c, ts + INTERVAL 2 MINUTE * (user_id % 9) AS d FROM events WHERE event_type = 'purchase')
       SELECT event_id, view_id FROM runs JOIN v ON a <= d AND c <= b""")
def overlapping_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = F.make_dt_interval(mins=(2 * (F.col("user_id") % 9)).cast("int"))
    views = load(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("view_id"), F.col("ts").alias("c"), (F.col("ts") + minutes).alias("d"))
    return intervals.overlapping(_error_runs(spark, sf_dir), views, ("a", "b"), ("c", "d")).select("event_id", "view_id")


@query("silent_slots", """WITH g AS (SELECT ts, event_id AS line, CASE event_type WHEN 'click' THEN 'START' WHEN 'view' THEN 'END' WHEN 'signup' THEN 'SKIP' ELSE 'OTHER' END AS event FROM events WHERE event_id % 20 = 0 OR hour(ts) < 12),
       s AS (SELECT *, lag(event) OVER (ORDER BY ts, line) AS before, lag(ts) OVER (ORDER BY ts, line) AS begun FROM g WHERE event IN ('START', 'END')), runs AS (SELECT begun AS a, ts AS b FROM s WHERE event = 'END' AND before = 'START'),
       said AS (SELECT DISTINCT ts::DATE AS day, hour(ts) AS hour FROM g WHERE event IN ('START', 'SKIP')), days AS (SELECT DISTINCT day FROM said ORDER BY day DESC LIMIT 20),
       w AS (SELECT day::TIMESTAMP + to_hours(h) AS slot FROM days, unnest([8, 10, 14, 16, 18, 20]) t(h) WHERE (day, h) NOT IN (SELECT day, hour FROM said))
       SELECT slot, CASE WHEN EXISTS (SELECT 1 FROM runs WHERE slot BETWEEN a AND b) THEN 'eaten' ELSE 'silent' END AS fate FROM w""")
def silent_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned hours of the last twenty days in which nothing was logged: whether a run was still going on."""
    kind = F.col("event_type")
    event = F.when(kind == "click", "START").when(kind == "view", "END").when(kind == "signup", "SKIP").otherwise("OTHER")
    rows = load(spark, sf_dir, "events").where("event_id % 20 = 0 or hour(ts) < 12").select("ts", F.col("event_id").alias("line"), event.alias("event"))
    with Scratch(spark) as scratch:
        found = intervals.silent_slots(rows, [8, 10, 14, 16, 18, 20], 20, scratch)
        return scratch.keep(found.withColumn("slot", F.col("slot").cast("timestamp_ntz")), "silent")


@query("quota_window", "SELECT (ts - INTERVAL 10 HOUR)::DATE::VARCHAR AS quota_day, event_type AS model, count(*) AS calls FROM events GROUP BY 1, 2")
def quota_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date(F.col("ts") - F.expr("INTERVAL 10 HOURS"))
    return load(spark, sf_dir, "events").groupBy(day.cast("string").alias("quota_day"), F.col("event_type").alias("model")).agg(F.count("*").alias("calls"))


@query(
    "run_tallies",
    """SELECT ts::DATE::VARCHAR AS day, count(*) FILTER (WHERE event_type = 'signup') AS started, count(*) FILTER (WHERE event_type = 'purchase') AS finished,
       count(*) FILTER (WHERE event_type = 'error') AS lost, greatest(0, count(*) FILTER (WHERE event_type = 'signup') - count(*) FILTER (WHERE event_type = 'purchase')) AS crashed
       FROM events GROUP BY 1""",
)
def run_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda kind: F.count_if(F.col("event_type") == kind)
    days = load(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(of("signup").alias("started"), of("purchase").alias("finished"), of("error").alias("lost"))
    return days.withColumn("crashed", F.greatest(F.lit(0).cast("long"), F.col("started") - F.col("finished")))


@query(
    "hot_groups_depth",
    """WITH y AS (SELECT source, count(*) AS n, 1000 * sum((l.quality = 0)::INT) // count(*) AS rate FROM documents d JOIN labels l USING (doc_id) GROUP BY source)
       SELECT source, n, rate::BIGINT AS rate, CASE WHEN n < 10 OR rate >= 50 THEN 20 WHEN rate <= 15 THEN 8 ELSE 8 + (12 * (rate - 15) // 35)::INT END::INT AS depth FROM y""",
)
def hot_groups_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How deep to read a source: linear in its yield (per mille) between two bounds, full while it is little known."""
    both = load(spark, sf_dir, "documents").select("doc_id", "source").join(load(spark, sf_dir, "labels"), "doc_id")
    groups = both.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 0).alias("hits"))
    groups = groups.withColumn("rate", F.floor(1000 * F.col("hits") / F.col("n")))
    depth = F.when((F.col("n") < 10) | (F.col("rate") >= 50), 20).when(F.col("rate") <= 15, 8).otherwise(8 + F.floor(12 * (F.col("rate") - 15) / 35))
    return groups.select("source", "n", "rate", depth.cast("int").alias("depth"))


@query(
    "headway",
    """SELECT ts::DATE::VARCHAR AS day, event_type AS route, count(*) AS departures, greatest(1, round_even(900.0 / count(*), 0))::INT AS headway_min FROM events
       WHERE hour(ts) >= 7 AND hour(ts) < 22 GROUP BY 1, 2""",
)
def headway(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes of each 15-hour day for each departure of a route, one at least."""
    rows = load(spark, sf_dir, "events").where((F.hour("ts") >= 7) & (F.hour("ts") < 22))
    counted = rows.groupBy(F.to_date("ts").cast("string").alias("day"), F.col("event_type").alias("route")).agg(F.count("*").alias("departures"))
    return counted.withColumn("headway_min", F.greatest(F.lit(1), F.bround(900 / F.col("departures"), 0).cast("int")))


@query(
    "before_station",
    """WITH s AS (SELECT *, min(CASE WHEN l_returnflag = 'R' THEN l_linenumber END) OVER (PARTITION BY l_orderkey) AS station FROM lineitem)
       SELECT l_orderkey, l_linenumber, l_partkey FROM s WHERE l_linenumber < station""",
)
def before_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    station = F.min(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))).over(Window.partitionBy("l_orderkey"))
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", station.alias("station"))
    return rows.where("l_linenumber < station").drop("station")


@query(
    "anchor_gap",
    """WITH r AS (SELECT l_suppkey, min(l_partkey) AS a, max(l_partkey) AS b FROM lineitem GROUP BY 1), w AS (SELECT l_suppkey, unnest(generate_series(a, b, 2)) AS n FROM r)
       SELECT l_suppkey, count(*) AS missing FROM w WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = w.l_suppkey AND l.l_partkey = w.n) GROUP BY 1""",
)
def anchor_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many numbers of its first one's parity each street lacks in its whole range; ``anchor_gap_ranges`` says which."""
    return gap_ranges(load(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey").groupBy("l_suppkey").agg(F.sum("missing").alias("missing"))


@query(
    "anchor_gap_ranges",
    """WITH r AS (SELECT l_suppkey, min(l_partkey) AS a, max(l_partkey) AS b FROM lineitem GROUP BY 1),
       w AS (SELECT DISTINCT l_suppkey, l_partkey AS n, b FROM lineitem JOIN r USING (l_suppkey) WHERE (l_partkey - a) % 2 = 0),
       g AS (SELECT l_suppkey, n, coalesce(lead(n) OVER (PARTITION BY l_suppkey ORDER BY n), b + 2 - (b - n) % 2) AS m FROM w)
       SELECT l_suppkey, n + 2 AS first_n, m - 2 AS last_n, (m - n) // 2 - 1 AS missing FROM g WHERE m > n + 2""",
)
def anchor_gap_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All gaps of every street: numbers of its first one's parity that are missing up to its last one, a row for each run of them."""
    return gap_ranges(load(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey")


def gap_ranges(rows: DataFrame, street: str, number: str) -> DataFrame:
    """(street, first_n, last_n, missing): runs of missing numbers as ranges, so that there are no more of them than numbers."""
    have = rows.where(F.col(number).isNotNull()).select(street, F.col(number).alias("n")).distinct()
    whole, n = Window.partitionBy(street), F.col("n")
    sided = have.withColumn("a", F.min("n").over(whole)).withColumn("b", F.max("n").over(whole)).where((n - F.col("a")) % 2 == 0)
    beyond = F.col("b") + 2 - (F.col("b") - n) % 2
    m = F.coalesce(F.lead("n").over(Window.partitionBy(street).orderBy("n")), beyond)
    gaps = sided.withColumn("m", m).where(F.col("m") > n + 2)
    return gaps.select(street, (n + 2).alias("first_n"), (F.col("m") - 2).alias("last_n"), (F.floor((F.col("m") - n) / 2) - 1).alias("missing"))


@query(
    "median_gap",
    """WITH g AS (SELECT o_custkey, date_diff('day', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate) AS d FROM orders),
       s AS (SELECT o_custkey, list_sort(list(d)) AS v FROM g WHERE d IS NOT NULL GROUP BY 1) SELECT o_custkey, len(v) AS n, v[len(v) // 2 + 1] AS median_days FROM s""",
)
def median_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median is the element n // 2 of the sorted gaps."""
    before = F.lag("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    gaps = load(spark, sf_dir, "orders").select("o_custkey", F.date_diff("o_orderdate", before).cast("long").alias("d"))
    return reports.ranked_values(gaps, ["o_custkey"], "d", {"median_days": F.floor(F.col("n") / 2)})


@query(
    "session_events",
    """WITH f AS (SELECT *, coalesce(date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) > 1800000000, TRUE)::INT AS fresh FROM events),
       s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM f)
       SELECT user_id, min(ts) AS begin_ts, max(ts) AS end_ts, count(*) AS n FROM s GROUP BY user_id, session""",
)
def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "1800000001 microseconds").alias("w"))
    return rows.agg(F.min("ts").alias("begin_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n")).drop("w")


@query(
    "accuracy_quantiles",
    """WITH s AS (SELECT l_returnflag AS tier, list_sort(list(l_quantity)) AS v FROM lineitem GROUP BY 1)
       SELECT tier, len(v) AS n, v[len(v) // 2 + 1] AS p50, v[floor(0.9 * len(v))::INT + 1] AS p90, v[len(v)] AS most FROM s""",
)
def accuracy_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p50 is element n // 2 and p90 element int(0.9 n); distinct values are counted before they are ranked."""
    counted = load(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("tier"), "l_quantity").agg(F.count("*").alias("c"))
    ranked = counted.withColumn("last", F.sum("c").over(Window.partitionBy("tier").orderBy("l_quantity"))).withColumn("n", F.sum("c").over(Window.partitionBy("tier")))
    at = lambda place: F.min(F.when(F.col("last") > place, F.col("l_quantity")))
    return ranked.groupBy("tier", "n").agg(at(F.floor(F.col("n") / 2)).alias("p50"), at(F.floor(0.9 * F.col("n"))).alias("p90"), F.max("l_quantity").alias("most"))
