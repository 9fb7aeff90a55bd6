"""Listings made of orders, votes made of events: searches, ranked lists, sinks and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestay.operators import numbering, reports, search, upserts
from lodestay.plans.registry import load, query
from lodestay.storage import Scratch

#: The moment that counts as now.
NOW = "1998-08-02 12:00:00"

_LISTINGS = """l AS (SELECT 'k' || o_orderkey AS key, CASE o_orderstatus WHEN 'O' THEN 'MATCH' WHEN 'P' THEN 'NEEDS_DATA' ELSE 'DROP' END AS status,
    CASE WHEN o_orderkey % 11 <> 0 THEN floor(o_totalprice)::BIGINT % 2500 END AS price, (o_orderkey % 5)::INT AS rooms,
    CASE o_orderkey % 3 WHEN 0 THEN 'GREEN' WHEN 1 THEN 'AMBER' ELSE 'RED' END AS tier, CASE WHEN o_orderkey % 13 <> 0 THEN (o_orderkey * 37 % 101)::INT END AS score,
    'רחוב ' || (o_custkey % 7) AS address, o_orderpriority AS summary, lpad((o_orderkey % 28 + 1)::VARCHAR, 2, '0') || '.' || lpad((o_orderkey % 12 + 1)::VARCHAR, 2, '0') AS lease,
    o_orderdate::TIMESTAMP AS first_seen, o_custkey AS phone, 's' || (o_custkey % 20) AS source,
    (32000 + o_orderkey * 37 % 300)::DOUBLE / 1000 AS lat, (34600 + o_orderkey * 53 % 400)::DOUBLE / 1000 AS lon,
    CASE o_orderkey % 4 WHEN 0 THEN 'osm_addr' WHEN 1 THEN 'street_geom' WHEN 2 THEN 'static_area' END AS geo_source FROM orders),
    v AS (SELECT 'k' || (event_id * 7 % (SELECT count(*) FROM orders) + 1) AS key, user_id AS voter, CASE event_type WHEN 'click' THEN 'saved' WHEN 'error' THEN 'dismissed' ELSE 'seen' END AS mark, ts FROM events),
    p AS (SELECT key, count(*) FILTER (WHERE mark = 'saved') AS saved, count(*) FILTER (WHERE mark = 'dismissed') AS dismissed FROM v GROUP BY key),
    e AS (SELECT l.*, coalesce(score, 0) + coalesce((saved - dismissed) * 25, 0) AS effective FROM l LEFT JOIN p USING (key)),
    c AS (SELECT DISTINCT key FROM v WHERE voter % 10 = 0)"""


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    rows = load(spark, sf_dir, "orders").select(
        F.concat(F.lit("k"), k.cast("string")).alias("key"),
        F.when(c("o_orderstatus") == "O", "MATCH").when(c("o_orderstatus") == "P", "NEEDS_DATA").otherwise("DROP").alias("status"),
        F.when(k % 11 != 0, F.floor("o_totalprice") % 2500).alias("price"), (k % 5).cast("int").alias("rooms"),
        F.element_at(F.array(F.lit("GREEN"), F.lit("AMBER"), F.lit("RED")), (k % 3 + 1).cast("int")).alias("tier"),
        F.when(k % 13 != 0, (k * 37 % 101).cast("int")).alias("score"), F.concat(F.lit("רחוב "), (c("o_custkey") % 7).cast("string")).alias("address"),
        c("o_orderpriority").alias("summary"), F.concat(two(k % 28 + 1), F.lit("."), two(k % 12 + 1)).alias("lease"),
        c("o_orderdate").cast("timestamp").alias("first_seen"), c("o_custkey").alias("phone"), F.concat(F.lit("s"), (c("o_custkey") % 20).cast("string")).alias("source"),
        ((32000 + k * 37 % 300).cast("double") / 1000).alias("lat"), ((34600 + k * 53 % 400).cast("double") / 1000).alias("lon"),
        F.when(k % 4 == 0, "osm_addr").when(k % 4 == 1, "street_geom").when(k % 4 == 2, "static_area").alias("geo_source"),
    )
    return rows


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "orders").count()
    mark = F.when(F.col("event_type") == "click", "saved").when(F.col("event_type") == "error", "dismissed").otherwise("seen")
    return load(spark, sf_dir, "events").select(
        F.concat(F.lit("k"), (F.col("event_id") * 7 % n + 1).cast("string")).alias("key"), F.col("user_id").alias("voter"), mark.alias("mark"), F.col("ts").cast("timestamp").alias("ts")
    )


def contacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes(spark, sf_dir).where("voter % 10 = 0").select("key").distinct()


def now():
    return F.lit(NOW).cast("timestamp")


@query("vote_points", f"WITH {_LISTINGS} SELECT key, saved, dismissed, (saved - dismissed) * 25 AS points FROM p")
def vote_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.vote_points(votes(spark, sf_dir))


@query("search_listings", f"""WITH {_LISTINGS} SELECT key, effective FROM e WHERE status IN ('MATCH', 'NEEDS_DATA') AND price <= 1500 AND rooms >= 2 AND tier = 'GREEN' AND score >= 34
       AND lease LIKE '%.10' AND (address LIKE '%רחוב%' OR summary LIKE '%רחוב%') ORDER BY effective DESC, key LIMIT 10""")
def search_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(listings(spark, sf_dir), votes(spark, sf_dir), "2 חדרים עד 1500 ירוק אוקטובר 2 כוכבים רחוב").select("key", "effective")


@query("top_matches", f"""WITH {_LISTINGS} SELECT key, effective FROM e WHERE status = 'MATCH' AND first_seen >= TIMESTAMP '{NOW}' - INTERVAL 2400 HOUR
       AND first_seen >= TIMESTAMP '{NOW}' - INTERVAL 21 DAY AND key NOT IN (SELECT key FROM c) ORDER BY effective DESC, key LIMIT 15""")
def top_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_matches(listings(spark, sf_dir), votes(spark, sf_dir), contacted(spark, sf_dir), now(), 2400, 15).select("key", "effective")


@query("digest", f"""WITH {_LISTINGS} SELECT key, status, score, row_number() OVER (ORDER BY status = 'MATCH' DESC, score DESC NULLS LAST, key)::INT AS place FROM l
       WHERE status IN ('MATCH', 'NEEDS_DATA') AND first_seen >= TIMESTAMP '{NOW}' - INTERVAL 40 DAY""")
def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc(F.col("status") == "MATCH"), F.desc_nulls_last("score"), "key"]
    with Scratch(spark) as scratch:
        rows = search.digest(listings(spark, sf_dir), now(), 40).select("key", "status", "score")
        placed = numbering.numbered(rows, order, "_place", scratch)
        return scratch.keep(placed.select("key", "status", "score", (F.col("_place") + 1).cast("int").alias("place")), "digest")


@query("pending_alerts", f"""WITH {_LISTINGS} SELECT key, score FROM l WHERE status = 'MATCH' AND score >= 75 AND key NOT IN (SELECT key FROM c) AND first_seen >= TIMESTAMP '{NOW}' - INTERVAL 3000 HOUR""")
def pending_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = contacted(spark, sf_dir).withColumn("alerted_at", now())
    return search.pending_alerts(listings(spark, sf_dir).join(told, "key", "left"), now(), 3000).select("key", "score")


@query("board_filters", f"""WITH {_LISTINGS} SELECT l.key FROM l JOIN p USING (key) WHERE address LIKE '%3%' AND tier = 'AMBER' AND price <= 2000 AND rooms >= 1 AND saved > 0
       AND (geo_source IS NULL OR geo_source IN ('street_geom', 'static_area')) AND lat BETWEEN 32.0 AND 32.25 AND lon BETWEEN 34.65 AND 34.95""")
def board_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).join(search.vote_points(votes(spark, sf_dir)), "key", "left").withColumn("broker_listings", F.lit(0))
    shown = search.Board(text="3", tier="AMBER", max_price=2000, min_rooms=1, only_saved=True, only_approximate=True, hide_brokers=True, box=(32.0, 34.65, 32.25, 34.95))
    return search.board(rows, shown, now()).where("address like '%3%'").select("key")


@query("enriched_listings", f"""WITH {_LISTINGS}, n AS (SELECT key, 'note ' || voter AS note FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, voter DESC) AS i FROM v WHERE voter % 3 = 0) WHERE i = 1),
       m AS (SELECT key FROM l WHERE substr(key, 2)::BIGINT % 50 = 0), b AS (SELECT phone, count(DISTINCT address || lease) AS addresses FROM l GROUP BY phone HAVING count(DISTINCT address || lease) >= 4)
       SELECT l.key, coalesce(saved, 0) AS saved, coalesce(dismissed, 0) AS dismissed, coalesce(score, 0) + coalesce((saved - dismissed) * 25, 0) AS effective, c.key IS NOT NULL AS contacted, n.note,
       CASE WHEN m.key IS NOT NULL THEN 'manual' ELSE geo_source END AS geo_source, CASE WHEN m.key IS NOT NULL THEN 1.5 ELSE lat END AS lat, coalesce(b.addresses, 0) AS broker_listings,
       first_seen < TIMESTAMP '{NOW}' - INTERVAL 21 DAY AS stale
       FROM l LEFT JOIN p USING (key) LEFT JOIN c ON l.key = c.key LEFT JOIN n ON l.key = n.key LEFT JOIN m ON l.key = m.key LEFT JOIN b ON l.phone = b.phone""")
def enriched_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, given = listings(spark, sf_dir), votes(spark, sf_dir)
    said = given.where("voter % 3 = 0").withColumn("note", F.concat(F.lit("note "), F.col("voter").cast("string")))
    notes = upserts.first_per_key(said, ["key"], [F.desc("ts"), F.desc("voter")]).select("key", "note")
    manual = rows.where(F.substring("key", 2, 20).cast("long") % 50 == 0).select("key", F.lit(1.5).alias("lat"), F.lit(2.5).alias("lon"))
    brokers = reports.brokers(rows.select("phone", F.concat("address", "lease").alias("identity")))
    found = search.enriched(rows, given, contacted(spark, sf_dir), notes, manual, brokers, now())
    return found.select("key", "saved", "dismissed", "effective", "contacted", "note", "geo_source", "lat", "broker_listings", "stale")


@query("yield_rates", f"""WITH {_LISTINGS} SELECT source, count(*) AS total, count(*) FILTER (WHERE status = 'MATCH') AS matches, round(count(*) FILTER (WHERE status = 'MATCH') / count(*), 4) AS rate,
       CASE WHEN substr(source, 2)::INT >= 15 THEN 'not configured' WHEN count(*) >= 25 AND round(count(*) FILTER (WHERE status = 'MATCH') / count(*), 4) < 0.48 THEN 'low yield' ELSE '' END AS note FROM l GROUP BY source""")
def yield_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    configured = spark.createDataFrame([(f"s{i}",) for i in range(15)], "source string")
    return reports.yield_rates(listings(spark, sf_dir), configured, low=0.48)


@query("address_posts", f"WITH {_LISTINGS} SELECT address || '|' || rooms AS identity, count(DISTINCT coalesce(CASE WHEN phone % 2 = 0 THEN source END, summary)) AS posts FROM l GROUP BY 1 HAVING count(DISTINCT coalesce(CASE WHEN phone % 2 = 0 THEN source END, summary)) >= 5")
def address_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).select(F.concat_ws("|", "address", F.col("rooms").cast("string")).alias("identity"), F.when(F.col("phone") % 2 == 0, F.col("source")).alias("url"), F.col("summary").alias("sig"))
    return reports.multi_unit(rows, 5)


@query("alert_gate", f"""WITH {_LISTINGS}, s AS (SELECT list_sort(list(score)) AS x FROM l WHERE status = 'MATCH' AND score IS NOT NULL)
       SELECT len(x) AS n, x[len(x) // 2 + 1] AS median, len(list_filter(x, lambda y: y >= 75)) AS over, round_even(100 * len(list_filter(x, lambda y: y >= 75)) / len(x), 0)::INT AS percent FROM s""")
def alert_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.alert_gate(listings(spark, sf_dir))


@query("score_bands", f"WITH {_LISTINGS} SELECT (score // 10 * 10)::BIGINT AS low, count(*) AS n FROM l WHERE status = 'MATCH' AND score IS NOT NULL GROUP BY 1")
def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.score_bands(listings(spark, sf_dir))


@query("detection_lags", """WITH r AS (SELECT event_type, (value * 60)::BIGINT / 60 AS lag FROM (SELECT event_type, floor(value * 40)::BIGINT - 120 AS value FROM events WHERE value IS NOT NULL)),
       q AS (SELECT event_type, list_sort(list(lag) FILTER (WHERE lag >= 0 AND lag < 2880)) AS x, count(*) FILTER (WHERE NOT (lag >= 0 AND lag < 2880)) AS discarded FROM r GROUP BY 1)
       SELECT event_type, coalesce(len(x), 0) AS n, discarded, coalesce(len(list_filter(x, lambda y: y <= 60)), 0) AS within_1h, coalesce(len(list_filter(x, lambda y: y > 60 AND y <= 180)), 0) AS within_3h,
       coalesce(len(list_filter(x, lambda y: y > 180)), 0) AS later, CASE WHEN len(x) >= 5 THEN x[floor(0.25 * (len(x) - 1))::INT + 1] END AS p25,
       CASE WHEN len(x) >= 5 THEN x[floor(0.5 * (len(x) - 1))::INT + 1] END AS p50, CASE WHEN len(x) >= 5 THEN x[floor(0.75 * (len(x) - 1))::INT + 1] END AS p75 FROM q""")
def detection_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lags in whole minutes made of the events' values."""
    seen = F.lit(NOW).cast("timestamp")
    minutes = (F.floor(F.col("value") * 40) - 120).cast("int")
    rows = load(spark, sf_dir, "events").where("value is not null").select("event_type", seen.alias("first_seen"), (seen - F.make_dt_interval(mins=minutes)).alias("posted_at"))
    return reports.detection_lag(rows, ["event_type"])


@query("age_bands", f"""WITH {_LISTINGS}, d AS (SELECT floor(epoch(TIMESTAMP '{NOW}' - first_seen) / 86400)::BIGINT AS days FROM l)
       SELECT CASE WHEN days < 1 THEN 'today' WHEN days <= 2 THEN '1-2' WHEN days <= 7 THEN '3-7' WHEN days <= 21 THEN '8-21' ELSE 'stale' END AS band, count(*) AS n FROM d GROUP BY 1""")
def age_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.age_bands(listings(spark, sf_dir), now())


@query("location_uniqueness", f"""WITH {_LISTINGS} SELECT round(lat, 6) AS lat, round(lon, 6) AS lon, count(*) AS listings, count(DISTINCT address) AS addresses,
       CASE WHEN count(*) = 1 THEN 'alone' WHEN count(DISTINCT address) = 1 THEN 'one address' ELSE 'collapsed' END AS kind FROM l GROUP BY 1, 2""")
def location_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.location_uniqueness(listings(spark, sf_dir).withColumn("identity", F.col("address")))


@query("street_worklist", f"""WITH {_LISTINGS}, a AS (SELECT 'רחוב ' || (s_suppkey % 5) AS street, count(*) AS anchors FROM supplier GROUP BY 1)
       SELECT address AS street, count(DISTINCT rooms) AS addresses, count(*) AS listings, coalesce(any_value(anchors), 0) AS anchors FROM l LEFT JOIN a ON address = street WHERE geo_source IS DISTINCT FROM 'osm_addr' AND rooms IS NOT NULL GROUP BY 1""")
def street_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = load(spark, sf_dir, "supplier").select(F.concat(F.lit("רחוב "), (F.col("s_suppkey") % 5).cast("string")).alias("street"))
    return reports.street_worklist(listings(spark, sf_dir).withColumns({"street": F.col("address"), "number": F.col("rooms")}), anchors)


@query("pin_worklist", f"""WITH {_LISTINGS}, r AS (SELECT *, count(*) OVER (PARTITION BY address) AS fixes FROM l WHERE geo_source IS NULL OR geo_source <> 'osm_addr')
       SELECT key, address, fixes FROM r ORDER BY fixes DESC, address, key LIMIT 8""")
def pin_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.pin_worklist(listings(spark, sf_dir).withColumn("street", F.col("address")))


@query("most_overdue", """WITH r AS (SELECT user_id % 40 AS source, ts FROM events), n AS (SELECT max(ts) AS m FROM events), g AS (SELECT DISTINCT s_suppkey % 50 AS source FROM supplier),
       c AS (SELECT source, count(*) FILTER (WHERE ts >= m - INTERVAL 24 HOUR) AS today, max(ts) AS last_read FROM r, n GROUP BY source)
       SELECT g.source, coalesce(today, 0) AS today, last_read FROM g LEFT JOIN c USING (source) ORDER BY coalesce(today, 0), last_read NULLS FIRST, source LIMIT 12""")
def most_overdue(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    reads = events.select((F.col("user_id") % 40).alias("source"), "ts")
    last = events.agg(F.max("ts")).first()[0]
    groups = load(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 50).alias("source")).distinct()
    return reports.most_overdue(groups, reads, F.lit(last), 12)


@query("hot_groups", f"""WITH {_LISTINGS}, r AS (SELECT source, count(*) FILTER (WHERE status = 'MATCH') / count(*) AS rate FROM l GROUP BY source HAVING count(*) >= 25)
       SELECT g.source, rate FROM (SELECT 's' || i AS source, i AS place FROM range(25) t(i)) g LEFT JOIN r USING (source) ORDER BY rate DESC NULLS LAST, place LIMIT 3""")
def hot_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    configured = spark.createDataFrame([(f"s{i}", i) for i in range(25)], "source string, place int")
    return reports.hot_groups(listings(spark, sf_dir), configured)


@query("replay_diff", f"""WITH {_LISTINGS}, f AS (SELECT key, CASE WHEN price > 2000 THEN 'DROP' WHEN rooms = 4 THEN 'MATCH' ELSE status END AS s, CASE WHEN rooms = 3 THEN 50 ELSE score END AS x FROM l)
       SELECT key, CASE WHEN status = 'DROP' AND s <> 'DROP' THEN 'rescued' WHEN status <> 'DROP' AND s = 'DROP' THEN 'demoted' ELSE 'changed' END AS change
       FROM l JOIN f USING (key) WHERE status IS DISTINCT FROM s OR score IS DISTINCT FROM x""")
def replay_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir)
    status = F.when(F.col("price") > 2000, "DROP").when(F.col("rooms") == 4, "MATCH").otherwise(F.col("status"))
    return reports.replay_diff(rows, rows.withColumns({"status": status, "score": F.when(F.col("rooms") == 3, 50).otherwise(F.col("score"))}))


@query("earliest_dates", """WITH d AS (SELECT o_orderkey AS key, min(l_shipdate)::TIMESTAMP AS moved FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
       o AS (SELECT o_orderkey AS key, o_orderdate::TIMESTAMP + INTERVAL 60 DAY AS old FROM orders) SELECT key, moved AS first_seen FROM d JOIN o USING (key) WHERE moved < old""")
def earliest_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = load(spark, sf_dir, "lineitem").select(F.array("l_orderkey").alias("dedup_keys"), F.lit(None).cast("timestamp").alias("posted_at"), F.col("l_shipdate").cast("timestamp").alias("first_seen"))
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 60 DAYS")).alias("first_seen"))
    return reports.earliest_dates(posts, rows)


@query("field_agreement", """WITH r AS (SELECT quality, toxic, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS q FROM labels)
       SELECT * FROM (SELECT 'quality' AS field, count(*) AS n, count(*) FILTER (WHERE quality IS NOT DISTINCT FROM q) AS same, count(*) FILTER (WHERE quality <> q) AS flips, count(*) FILTER (WHERE quality IS NOT NULL AND q IS NULL) AS lost,
       count(*) FILTER (WHERE quality IS NOT DISTINCT FROM q) >= 0.95 * count(*) AS passes FROM r UNION ALL SELECT 'toxic', count(*), count(*), 0, 0, true FROM r)""")
def field_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    candidate = F.when(c("doc_id") % 5 == 0, None).when(c("doc_id") % 7 == 0, 1 - c("quality")).otherwise(c("quality"))
    rows = load(spark, sf_dir, "labels").select(c("quality").alias("control_quality"), candidate.alias("candidate_quality"), c("toxic").alias("control_toxic"), c("toxic").alias("candidate_toxic"))
    return reports.agreement(rows, ["quality", "toxic"])


@query("unknown_locations", """SELECT n_name AS location, count(*) AS n, max(o_orderdate)::TIMESTAMP AS last_seen FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND n_regionkey <> 2 AND n_name NOT LIKE '%A' GROUP BY 1 ORDER BY n DESC, last_seen DESC, location LIMIT 8""")
def unknown_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, placed = _unplaced(spark, sf_dir)
    return reports.unknown_locations(events, placed, F.col("location").endswith("A"), F.lit("1996-01-01").cast("timestamp"))


def _unplaced(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nation = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("location"), "n_regionkey")
    named = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey").join(nation, "c_nationkey")
    events = load(spark, sf_dir, "orders").join(named, "o_custkey").select("location", F.col("o_orderdate").cast("timestamp").alias("ts"))
    return events, nation.where("n_regionkey = 2").select("location")


@query("unknown_counts", """WITH u AS (SELECT n_name, any_value(n_regionkey) AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1)
       SELECT count(*) AS logged, count(*) FILTER (WHERE r <> 2 AND n_name NOT LIKE '%A') AS pinnable, count(*) FILTER (WHERE r = 2) AS resolved, count(*) FILTER (WHERE r <> 2 AND n_name LIKE '%A') AS by_design FROM u""")
def unknown_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header of the report: all names, those worth a pin, and both groups that it leaves out."""
    events, placed = _unplaced(spark, sf_dir)
    return reports.unknown_counts(reports.split_unknowns(events, placed, F.col("location").endswith("A"), F.lit("1996-01-01").cast("timestamp")))


#: A log over months: runs cross midnight, skips and aborts stand between starts, some ENDs are blocked, some report half of their numbers.
_LOG = """g AS (SELECT ts, event_id AS line, CASE event_type WHEN 'click' THEN 'START' WHEN 'view' THEN 'END' WHEN 'error' THEN 'ABORT' WHEN 'purchase' THEN 'DOWN' ELSE 'SKIP' END AS event,
     CASE WHEN user_id % 3 = 0 THEN 'hot' ELSE 'full' END || '  ' || (user_id % 90) || 's  posts=' || (user_id % 17) || ' match=' || (user_id % 5) || CASE WHEN user_id % 7 <> 0 THEN ' needs=' || (user_id % 4) ELSE '' END
     || CASE WHEN user_id % 2 = 0 THEN ' read=' || (user_id % 23) || ' age_skip=' || (user_id % 6) || ' seen_skip=' || (user_id % 8) ELSE '' END || CASE WHEN user_id % 11 = 0 THEN ' block=1' ELSE '' END AS detail, user_id FROM events)"""


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, kind = F.col("user_id"), F.col("event_type")
    event = F.when(kind == "click", "START").when(kind == "view", "END").when(kind == "error", "ABORT").when(kind == "purchase", "DOWN").otherwise("SKIP")
    text = lambda n: (u % n).cast("string")
    detail = F.concat(
        F.when(u % 3 == 0, "hot").otherwise("full"), F.lit("  "), text(90), F.lit("s  posts="), text(17), F.lit(" match="), text(5),
        F.when(u % 7 != 0, F.concat(F.lit(" needs="), text(4))).otherwise(""),
        F.when(u % 2 == 0, F.concat(F.lit(" read="), text(23), F.lit(" age_skip="), text(6), F.lit(" seen_skip="), text(8))).otherwise(""),
        F.when(u % 11 == 0, " block=1").otherwise(""),
    )
    return load(spark, sf_dir, "events").select("ts", F.col("event_id").alias("line"), event.alias("event"), detail.alias("detail"))


_TALLIES = """SELECT ts::DATE::VARCHAR AS day, count(*) FILTER (WHERE event = 'START') AS started, count(*) FILTER (WHERE event = 'END' AND user_id % 3 <> 0) AS full_runs,
       count(*) FILTER (WHERE event = 'END' AND user_id % 3 = 0) AS hot_runs, count(*) FILTER (WHERE event = 'ABORT') AS aborted, count(*) FILTER (WHERE event = 'SKIP') AS skipped,
       count(*) FILTER (WHERE event = 'END' AND user_id % 11 = 0) AS blocked, max(user_id % 90) FILTER (WHERE event = 'END') AS longest FROM g GROUP BY 1"""


@query("log_tallies", f"WITH {_LOG} {_TALLIES}")
def log_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.run_tallies(run_log(spark, sf_dir))


@query("log_reliability", f"""WITH {_LOG}, t AS ({_TALLIES}), s AS (SELECT sum(started)::BIGINT AS started, sum(full_runs + hot_runs)::BIGINT AS completed, sum(aborted)::BIGINT AS aborted,
       sum(greatest(0, started - full_runs - hot_runs))::BIGINT AS lost FROM t) SELECT started, completed, aborted, greatest(0, lost - 2 - aborted) AS crashed, round(completed / started, 4) AS ratio FROM s""")
def log_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.reliability(reports.run_tallies(run_log(spark, sf_dir)), in_flight=2)


@query("log_weekly", f"""WITH {_LOG}, w AS (SELECT * FROM g WHERE ts >= TIMESTAMP '2024-01-10'),
       s AS (SELECT *, lead(event) OVER (ORDER BY ts, line) AS following FROM w WHERE event IN ('START', 'END')), ok AS (SELECT * FROM w WHERE event = 'END' AND user_id % 11 <> 0)
       SELECT (SELECT count(*) FROM ok) AS runs, count(*) FILTER (WHERE event = 'SKIP') AS skipped, count(*) FILTER (WHERE event = 'END' AND user_id % 11 = 0) AS blocked,
       (SELECT count(*) FROM s WHERE event = 'START' AND (following = 'START' OR (following IS NULL AND ts < TIMESTAMP '2030-01-01' - INTERVAL 2 HOUR))) AS dangling,
       (SELECT coalesce(sum(user_id % 17), 0)::BIGINT FROM ok WHERE user_id % 7 <> 0) AS posts, (SELECT coalesce(sum(user_id % 5), 0)::BIGINT FROM ok WHERE user_id % 7 <> 0) AS match,
       (SELECT coalesce(sum(user_id % 4), 0)::BIGINT FROM ok WHERE user_id % 7 <> 0) AS needs, (SELECT coalesce(sum(user_id % 23), 0)::BIGINT FROM ok WHERE user_id % 2 = 0) AS read,
       (SELECT coalesce(sum(user_id % 6), 0)::BIGINT FROM ok WHERE user_id % 2 = 0) AS age_skip, (SELECT coalesce(sum(user_id % 8), 0)::BIGINT FROM ok WHERE user_id % 2 = 0) AS seen_skip FROM w""")
def log_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last START without an END counts, as the report is made years after the log."""
    with Scratch(spark) as scratch:
        row = reports.weekly(run_log(spark, sf_dir), F.lit("2024-01-10").cast("timestamp"), F.lit("2030-01-01").cast("timestamp"), scratch)
        return scratch.keep(row, "weekly")


@query("log_degraded", f"""WITH {_LOG}, f AS (SELECT *, count(*) FILTER (WHERE event = 'END') OVER (ORDER BY ts, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM g WHERE event IN ('END', 'DOWN')),
       e AS (SELECT run, max(ts) FILTER (WHERE event = 'END') AS ts, bool_or(event = 'DOWN') AS flagged FROM f GROUP BY run)
       SELECT ts::DATE::VARCHAR AS day, count(*) AS runs, count(*) FILTER (WHERE flagged) AS degraded FROM e WHERE ts IS NOT NULL GROUP BY 1""")
def log_degraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By day of their END, the runs that a DOWN line precedes."""
    with Scratch(spark) as scratch:
        ends = reports.flagged_ends(run_log(spark, sf_dir), "DOWN", scratch)
        by_day = ends.groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("runs"), F.count_if("flagged").alias("degraded"))
        return scratch.keep(by_day, "degraded")


@query("post_batches", """WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS i, count(*) OVER () AS total FROM documents),
       b AS (SELECT doc_id, i // 8 AS batch, (i % 8)::INT AS index, least(8, total - 8 * (i // 8)) AS size FROM n)
       SELECT doc_id, batch, index, CASE WHEN batch % 5 IN (1, 2, 3) THEN NULL ELSE 'answer ' || doc_id END AS answer, batch % 5 IN (1, 2, 3) AS alone FROM b""")
def post_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in batches of eight, answered batch by batch; batches that come short, with one index twice or with one too many are asked again alone."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source")
    with Scratch(spark) as scratch:
        rows = numbering.batched(docs, ["source", "doc_id"], 8, scratch).drop("source")
        said = rows.select("batch", "index", F.concat(F.lit("answer "), F.col("doc_id").cast("string")).alias("answer"))
        kind, first = F.col("batch") % 5, F.col("index") == 0
        kept = said.where(~((kind == 1) & first))
        twice = said.where((kind == 2) & first)
        beyond = said.where((kind == 3) & first).withColumn("index", F.lit(99))
        return scratch.keep(numbering.regrouped(rows, kept.unionByName(twice).unionByName(beyond), "answer"), "batches")


@query("quota_windows", """WITH d AS (SELECT (ts - INTERVAL 10 HOUR)::DATE::VARCHAR AS quota_day, event_type AS model, count(*) AS c, bool_or(value < 0.01) AS refused FROM events GROUP BY 1, 2)
       SELECT quota_day, sum(c)::BIGINT AS calls, string_agg(model || '=' || c, ' ' ORDER BY model) AS mix, CASE WHEN bool_or(coalesce(refused, false)) THEN 'refused' WHEN sum(c) >= 330 THEN 'own cap met' ELSE '' END AS note
       FROM d GROUP BY 1 ORDER BY 1 DESC LIMIT 8""")
def quota_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = load(spark, sf_dir, "events").select("ts", F.col("event_type").alias("model"), (F.col("value") < 0.01).alias("refused"))
    return reports.quota_windows(calls, 330)


@query("insert_new", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 1")
def insert_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").select("o_orderkey")
    return upserts.insert_new(rows.where("o_orderkey % 3 <> 1"), rows.union(rows.where("o_orderkey % 2 = 0")), ["o_orderkey"])


@query("replace_upsert", """WITH r AS (SELECT user_id, event_type, ts, 0 AS fresh FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id, event_type, ts, 1 FROM events WHERE event_id % 2 = 1),
       n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, fresh DESC, event_type DESC) AS i FROM r) SELECT user_id, event_type, ts FROM n WHERE i = 1""")
def replace_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    halves = (rows.where(f"event_id % 2 = {i}").drop("event_id") for i in (0, 1))
    return upserts.replace(*halves, "user_id", "ts").select("user_id", "event_type", "ts")


@query("last_notes", """SELECT user_id, note FROM (SELECT user_id, CASE WHEN event_type = 'error' THEN ' ' ELSE event_type END AS note, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CASE WHEN event_type = 'error' THEN ' ' ELSE event_type END DESC) AS i FROM events)
       WHERE i = 1 AND note <> ' '""")
def last_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type")).alias("note"), "ts")
    return upserts.last_note(rows, "user_id", "note", "ts").select("user_id", "note")


@query("backfill", "SELECT doc_id, coalesce(CASE WHEN doc_id % 3 <> 0 THEN source END, 'from ' || quality) AS source FROM documents LEFT JOIN labels USING (doc_id)")
def backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("source"))
    known = load(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("from "), F.col("quality").cast("string")).alias("source"))
    return upserts.backfill(rows, known, "doc_id", ["source"])


@query("vote_rescue", """WITH v AS (SELECT o_custkey % 100 AS key, o_orderkey AS voter FROM orders), d AS (SELECT DISTINCT key, CASE WHEN key % 4 = 0 AND key < 50 THEN key + 1 END AS heir FROM v WHERE key % 4 = 0)
       SELECT coalesce(heir, v.key) AS key, voter FROM v LEFT JOIN d USING (key)""")
def vote_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of deleted keys go to their successors; without one they stay."""
    given = load(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("key"), F.col("o_orderkey").alias("voter"))
    dead = given.where("key % 4 = 0").select("key").distinct()
    heirs = dead.where("key < 50").select("key", (F.col("key") + 1).alias("successor"))
    return upserts.delete_with_rescue(given.select("key").distinct(), given, dead, heirs, "key")[1]
