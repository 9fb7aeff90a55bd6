"""Zones, distances, grids and tiers, on points made from keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestay.functions import geo
from lodestay.operators import amenities, houses, nearest, scoring
from lodestay.plans.registry import load, query
from lodestay.storage import Scratch

#: A synthetic zone: a rectangle of latitudes and longitudes.
ZONE = [(32.00, 34.70), (32.00, 34.80), (32.10, 34.80), (32.10, 34.70)]
GATES = [(32.02, 34.72), (32.08, 34.78), (32.05, 34.75), (32.15, 34.85)]
_GATES = [(f"g{i}", a, b) for i, (a, b) in enumerate(GATES)]


def _points(df: DataFrame, key: str) -> DataFrame:
    """A point for each key, in whole thousandths of a degree so that every engine has the same."""
    lat = (32000 + (F.col(key) * 37) % 300).cast("double") / 1000
    lon = (34600 + (F.col(key) * 53) % 400).cast("double") / 1000
    return df.select(F.col(key), lat.alias("lat"), lon.alias("lon"))


_POINTS = "SELECT {key}, (32000 + ({key} * 37) % 300)::DOUBLE / 1000 AS lat, (34600 + ({key} * 53) % 400)::DOUBLE / 1000 AS lon FROM {table}"


def _hav(lat: str, lon: str) -> str:
    return f"2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians({lat} - lat) / 2), 2) + cos(radians(lat)) * cos(radians({lat})) * pow(sin(radians({lon} - lon) / 2), 2))))"


@query(
    "pip_tier",
    f"""WITH p AS ({_POINTS.format(key="p_partkey", table="part")}), m AS (SELECT *, lat >= 32.0 AND lat < 32.1 AND lon >= 34.7 AND lon < 34.8 AS inside,
        least({", ".join(_hav(str(a), str(b)) for a, b in GATES)}) * 1.25 / 80.0 AS walk FROM p)
        SELECT p_partkey, inside, CASE WHEN inside THEN 'GREEN' WHEN walk <= 20 THEN 'AMBER' ELSE 'RED' END AS tier FROM m""",
)
def pip_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = F.array(*(F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in ZONE))
    inside = geo.in_ring(F.col("lat"), F.col("lon"), ring)
    walk = geo.walk_minutes(F.least(*(geo.haversine(F.col("lat"), F.col("lon"), F.lit(a), F.lit(b)) for a, b in GATES)))
    rows = _points(load(spark, sf_dir, "part"), "p_partkey").select("p_partkey", inside.alias("inside"), walk.alias("walk"))
    return rows.select("p_partkey", "inside", geo.tier(F.col("inside"), F.col("walk")).alias("tier"))


@query(
    "haversine_nearest",
    f"""WITH p AS ({_POINTS.format(key="c_custkey", table="customer")}), g AS (SELECT * FROM (VALUES {", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(GATES))}) t(gate, glat, glon)),
        d AS (SELECT c_custkey, gate, {_hav("glat", "glon")} AS m, row_number() OVER (PARTITION BY c_custkey ORDER BY {_hav("glat", "glon")}, gate) AS n FROM p, g)
        SELECT c_custkey, gate, round(m)::BIGINT AS metres FROM d WHERE n = 1""",
)
def haversine_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The few gates are literals, so the nearest one is an expression and no join."""
    far = [F.struct(geo.haversine(F.col("lat"), F.col("lon"), F.lit(a), F.lit(b)).alias("m"), F.lit(i).alias("gate")) for i, (a, b) in enumerate(GATES)]
    near = _points(load(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", F.array_min(F.array(*far)).alias("g"))
    return near.select("c_custkey", F.col("g.gate").alias("gate"), F.round("g.m").cast("long").alias("metres"))


@query(
    "grid_cluster",
    f"""WITH p AS ({_POINTS.format(key="p_partkey", table="part")}) SELECT floor(lat / 0.02)::BIGINT AS i, floor(lon / 0.02)::BIGINT AS j, count(*) AS n,
        round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM p GROUP BY 1, 2""",
)
def grid_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _points(load(spark, sf_dir, "part"), "p_partkey").groupBy(F.floor(F.col("lat") / 0.02).alias("i"), F.floor(F.col("lon") / 0.02).alias("j"))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"))


@query(
    "radius_topk",
    f"""WITH s AS ({_POINTS.format(key="s_suppkey", table="supplier")}), c AS (SELECT c_custkey, lat AS clat, lon AS clon FROM ({_POINTS.format(key="c_custkey", table="customer")})),
        d AS (SELECT s_suppkey, c_custkey, {_hav("clat", "clon")} AS m FROM s, c), r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY round(m), c_custkey) AS rank FROM d WHERE m <= 1500)
        SELECT s_suppkey, c_custkey, rank::INT AS rank, round(m)::BIGINT AS metres FROM r WHERE rank <= 3""",
)
def radius_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within 1,500 m, by places: of the customers at one place only the first three can count."""
    stops = _points(load(spark, sf_dir, "customer"), "c_custkey").withColumnRenamed("c_custkey", "stop")
    homes = _points(load(spark, sf_dir, "supplier"), "s_suppkey").withColumnRenamed("s_suppkey", "key")
    found = amenities.first_within(homes, stops, 1500.0, 3)
    return found.select(F.col("key").alias("s_suppkey"), F.col("stop").alias("c_custkey"), "rank", F.col("metres").cast("long").alias("metres"))


_WALK = f"least({', '.join(_hav(str(a), str(b)) for a, b in GATES)}) * 1.25 / 80.0"


@query(
    "classify_listings",
    f"""WITH p AS ({_POINTS.format(key="p_partkey", table="part")}), m AS (SELECT p.p_partkey, p_name AS address, p_retailprice AS price, p_size % 5 AS rooms, p_size % 7 AS mates, p_size % 2 = 0 AS furnished,
        p_size % 3 = 0 AS balcony, lat >= 32.0 AND lat < 32.1 AND lon >= 34.7 AND lon < 34.8 AS inside, {_WALK} AS walk FROM p JOIN part ON p.p_partkey = part.p_partkey),
        t AS (SELECT *, CASE WHEN inside THEN 'GREEN' WHEN walk <= 20 THEN 'AMBER' ELSE 'RED' END AS tier FROM m),
        s AS (SELECT *, CASE tier WHEN 'GREEN' THEN 25 WHEN 'AMBER' THEN 10 ELSE 0 END + CASE WHEN walk <= 10 THEN 25 WHEN walk <= 14 THEN 20 WHEN walk <= 18 THEN 13 WHEN walk <= 20 THEN 7 ELSE 0 END
          + CASE WHEN price <= 1200 THEN 25 WHEN price <= 1500 THEN 22 WHEN price <= 1600 THEN 20 WHEN price <= 1700 THEN 18 WHEN price <= 2000 THEN 15 ELSE 0 END
          + CASE WHEN rooms <> 0 AND mates <> 0 THEN round_even(15 * least(1.0, rooms / mates), 0) WHEN rooms >= 3 THEN 10 WHEN rooms <> 0 THEN 6 ELSE 0 END
          + CASE WHEN mates <= 2 THEN 15 WHEN mates = 3 THEN 10 WHEN mates = 4 THEN 5 ELSE 0 END + CASE WHEN furnished THEN 10 ELSE 0 END + CASE WHEN balcony THEN 18 ELSE 0 END AS total FROM t),
        r AS (SELECT *, greatest(0, least(100, round_even(100 * total / 125, 0)))::INT AS score FROM s)
        SELECT p_partkey, tier, score, CASE WHEN score >= 90 THEN 5 WHEN score >= 75 THEN 4 WHEN score >= 60 THEN 3 WHEN score >= 45 THEN 2 ELSE 1 END::INT AS stars,
          CASE WHEN price > 2000 OR rooms < 2 OR mates > 4 OR tier = 'RED' THEN 'DROP' ELSE 'MATCH' END AS status,
          CASE WHEN price > 2000 THEN 'price ' || floor(price)::BIGINT || ' > 2000' WHEN rooms < 2 THEN 'only ' || rooms || ' rooms free' WHEN mates > 4 THEN mates || ' flatmates > 4'
          WHEN tier = 'RED' THEN 'more than 20 min walk from a gate' WHEN tier = 'GREEN' THEN 'in the zone' ELSE 'near the zone' END AS reason FROM r""",
)
def classify_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict cascade and score over listings made of the part table."""
    ring = F.array(*(F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in ZONE))
    part = load(spark, sf_dir, "part")
    points = _points(part, "p_partkey").join(part.select("p_partkey", "p_name", "p_size", "p_retailprice"), "p_partkey")
    rows = points.select(
        "p_partkey", F.col("p_name").alias("address"), F.col("p_retailprice").alias("price"), (F.col("p_size") % 5).alias("rooms"), (F.col("p_size") % 7).alias("mates"),
        (F.col("p_size") % 2 == 0).alias("furnished"), (F.col("p_size") % 3 == 0).alias("balcony"), F.lit(True).alias("is_ad"), F.lit("osm_addr").alias("geo_source"),
        geo.in_ring(F.col("lat"), F.col("lon"), ring).alias("inside"), geo.walk_or_estimate(F.lit(None).cast("double"), F.col("lat"), F.col("lon"), _GATES).alias("walk_minutes"),
    )
    rows = scoring.verdict(scoring.with_score(scoring.with_tier(rows)))
    return rows.select("p_partkey", "tier", "score", scoring.stars(F.col("score")).alias("stars"), "status", "reason")


@query(
    "effective_tiers",
    f"""WITH p AS ({_POINTS.format(key="p_partkey", table="part")}), m AS (SELECT *, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE lat >= 32.0 AND lat < 32.1 AND lon >= 34.7 AND lon < 34.8 END AS inside,
        CASE WHEN p_partkey % 5 = 0 THEN 12.0 ELSE {_WALK} END AS walk FROM p),
        t AS (SELECT *, CASE WHEN inside IS NULL THEN 'UNKNOWN' WHEN inside THEN 'GREEN' WHEN walk <= 20 THEN 'AMBER' ELSE 'RED' END AS tier FROM m)
        SELECT p_partkey, tier AS base, CASE WHEN tier IN ('GREEN', 'AMBER') AND ((tier = 'AMBER' AND lat < 32.05) OR lon >= 34.85) THEN 'RED' ELSE tier END AS tier FROM t""",
)
def effective_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers with known and estimated walks, points missing, and both masks."""
    c = F.col
    ring = F.array(*(F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in ZONE))
    known = F.when(c("p_partkey") % 5 == 0, 12.0)
    rows = _points(load(spark, sf_dir, "part"), "p_partkey").withColumn("inside", F.when(c("p_partkey") % 9 != 0, geo.in_ring(c("lat"), c("lon"), ring)))
    rows = rows.withColumn("base", geo.tier(c("inside"), geo.walk_or_estimate(known, c("lat"), c("lon"), _GATES)))
    return rows.select("p_partkey", "base", geo.effective_tier(c("base"), c("lat") < 32.05, c("lon") < 34.85).alias("tier"))


_SLOTS = f"""s AS ({_POINTS.format(key="s_suppkey", table="supplier")}), c AS (SELECT c_custkey, lat AS clat, lon AS clon, c_custkey % 3 AS target, c_custkey % 2 AS direction, CASE WHEN c_custkey % 7 <> 0 THEN (5 + c_custkey % 20)::INT END AS headway,
        CASE c_custkey % 3 WHEN 0 THEN 800 WHEN 1 THEN 1500 ELSE 400 END AS reach FROM ({_POINTS.format(key="c_custkey", table="customer")})),
        d AS (SELECT s_suppkey AS key, c.*, {_hav("clat", "clon")} AS m FROM s, c), w AS (SELECT *, m * 1.25 / 80 AS minutes FROM d WHERE m <= reach)"""


def _slots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("c_custkey")
    amenities_ = _points(load(spark, sf_dir, "customer"), "c_custkey").select(
        (k % 3).alias("target"), F.concat(F.lit("a"), F.lpad(k.cast("string"), 8, "0")).alias("name"), (k % 2).alias("direction"), F.when(k % 7 != 0, (5 + k % 20).cast("int")).alias("headway"),
        F.element_at(F.array(F.lit(800.0), F.lit(1500.0), F.lit(400.0)), (k % 3 + 1).cast("int")).alias("reach"), "lat", "lon",
    )
    homes = _points(load(spark, sf_dir, "supplier"), "s_suppkey").withColumnRenamed("s_suppkey", "key")
    return homes, amenities_


@query("amenities_in_reach", f"WITH {_SLOTS} SELECT key, target, 'a' || lpad(c_custkey::VARCHAR, 8, '0') AS name, round(m)::BIGINT AS metres FROM w")
def amenities_in_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amenities within the reach of their own target."""
    return amenities.within_reach(*_slots(spark, sf_dir), 1500.0).select("key", "target", "name", F.round("metres").cast("long").alias("metres"))


@query(
    "amenity_slots",
    f"""WITH {_SLOTS}, n AS (SELECT *, min(minutes) OVER (PARTITION BY key, target, direction) AS near FROM w),
        r AS (SELECT *, row_number() OVER (PARTITION BY key, target, direction ORDER BY headway NULLS LAST, minutes, c_custkey) AS i FROM n WHERE minutes <= near + 2)
        SELECT key, target, direction, 'a' || lpad(c_custkey::VARCHAR, 8, '0') AS name, headway FROM r WHERE i = 1""",
)
def amenity_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The amenity that wins each slot of a home."""
    return amenities.slots(*_slots(spark, sf_dir), 1500.0).select("key", "target", "direction", "name", "headway")


@query("walk_rings", "SELECT s_suppkey AS gate, m::INT AS minutes, m * 80.0 / 1.25 AS metres FROM supplier, (VALUES (5), (10), (15), (20)) v(m)")
def walk_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of walking time around each supplier."""
    return amenities.rings(load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("gate")))


@query(
    "tier_runs",
    f"""WITH p AS ({_POINTS.format(key="c_custkey", table="customer")}), b AS (SELECT min(lat) AS s, min(lon) AS w, max(lat) AS n, max(lon) AS e FROM p),
        c AS (SELECT i // 60 AS r, i % 60 AS k, s + (i // 60 + 0.5) * ((n - s) / 40) AS lat, w + (i % 60 + 0.5) * ((e - w) / 60) AS lon FROM range(2400) t(i), b),
        t AS (SELECT r, k, CASE WHEN lat >= 32.0 AND lat < 32.1 AND lon >= 34.7 AND lon < 34.8 THEN 'GREEN' WHEN {_WALK} <= 20 THEN 'AMBER' ELSE 'RED' END AS tier FROM c),
        g AS (SELECT *, k - row_number() OVER (PARTITION BY r, tier ORDER BY k) AS i FROM t), m AS (SELECT r, tier, min(k) AS first, max(k) AS last FROM g GROUP BY r, tier, i),
        h AS (SELECT least(39, floor((lat - s) / ((n - s) / 40)))::BIGINT AS r, least(59, floor((lon - w) / ((e - w) / 60)))::BIGINT AS k FROM p, b)
        SELECT m.r AS row, tier, first, last, count(h.r) AS customers FROM m LEFT JOIN h ON h.r = m.r AND h.k BETWEEN first AND last GROUP BY 1, 2, 3, 4""",
)
def tier_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster of tiers over the extent of all customers, merged into runs of cells, with the customers in each."""
    ring = F.array(*(F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in ZONE))
    points = _points(load(spark, sf_dir, "customer"), "c_custkey")
    south, west, north, east = points.agg(F.min("lat"), F.min("lon"), F.max("lat"), F.max("lon")).first()
    cells = amenities.raster(spark, south, west, north, east, 40, 60)
    walk = geo.walk_or_estimate(F.lit(None).cast("double"), F.col("lat"), F.col("lon"), _GATES)
    runs = amenities.merged_cells(cells.withColumn("tier", geo.tier(geo.in_ring(F.col("lat"), F.col("lon"), ring), walk)), "tier")
    cell = lambda value, low, high, n: F.least(F.lit(n - 1), F.floor((value - low) / ((high - low) / n)))
    homes = points.groupBy(cell(F.col("lat"), south, north, 40).alias("row"), cell(F.col("lon"), west, east, 60).alias("k")).agg(F.count("*").alias("c"))
    held = runs.join(homes, (runs["row"] == homes["row"]) & F.col("k").between(F.col("first"), F.col("last")), "left")
    return held.groupBy(runs["row"], "tier", "first", "last").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("customers"))


#: Streets of five vertices for each supplier, and houses near and far from them for each part; a third of the houses name no street.
_CITY = """n AS (SELECT count(*) AS s FROM supplier), v AS (SELECT 's' || s_suppkey AS street, 32 + (s_suppkey * 7919 % 10007) / 10007.0::DOUBLE * 0.2 + k * 0.0004::DOUBLE AS lat, 34.6 + (s_suppkey * 104729 % 10009) / 10009.0::DOUBLE * 0.3 + k * 0.0003::DOUBLE AS lon
    FROM supplier, range(5) t(k)),
    h AS (SELECT p_partkey AS house, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN 'u' || (p_partkey % 5) ELSE 's' || (p_partkey % s) END AS street,
    32 + (p_partkey % s * 7919 % 10007) / 10007.0::DOUBLE * 0.2 + (p_partkey % 50) * 0.00002::DOUBLE - CASE WHEN p_partkey % 7 = 0 THEN 0.01::DOUBLE ELSE 0 END AS lat, 34.6 + (p_partkey % s * 104729 % 10009) / 10009.0::DOUBLE * 0.3 - (p_partkey % 13) * 0.00003::DOUBLE AS lon FROM part, n)"""


def _city(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    suppliers, parts = load(spark, sf_dir, "supplier"), load(spark, sf_dir, "part")
    many = suppliers.count()
    lat = lambda key: 32 + (key * 7919 % 10007) / 10007 * 0.2
    lon = lambda key: 34.6 + (key * 104729 % 10009) / 10009 * 0.3
    key, p, k = F.col("s_suppkey").cast("long"), F.col("p_partkey").cast("long"), F.col("k")
    named = lambda n: F.concat(F.lit("s"), n.cast("string"))
    vertices = suppliers.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)))).select(named(key).alias("street"), (lat(key) + k * 0.0004).alias("lat"), (lon(key) + k * 0.0003).alias("lon"))
    street = F.when(p % 3 == 0, None).when(p % 11 == 0, F.concat(F.lit("u"), (p % 5).cast("string"))).otherwise(named(p % many))
    houses_ = parts.select(p.alias("house"), street.alias("street"), (lat(p % many) + (p % 50) * 0.00002 - F.when(p % 7 == 0, 0.01).otherwise(0.0)).alias("lat"), (lon(p % many) - (p % 13) * 0.00003).alias("lon"))
    return houses_, vertices


_NEAR = "sqrt(pow((v.lat - h.lat) * 111320, 2) + pow((v.lon - h.lon) * 111320 * cos(radians(h.lat)), 2))"


@query("nearest_street", f"""WITH {_CITY}, d AS (SELECT house, v.street, min({_NEAR}) AS metres FROM h, v GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY house ORDER BY metres, street) AS i FROM d)
       SELECT house, street, round(metres, 3) AS metres FROM r WHERE i = 1""")
def nearest_street(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest street of every house, however far it is."""
    rows, vertices = _city(spark, sf_dir)
    with Scratch(spark) as scratch:
        found = nearest.nearest(rows, vertices, "street", scratch)
        return scratch.keep(rows.drop("street").join(found, ["lat", "lon"]).select("house", F.col("name").alias("street"), F.round("metres", 3).alias("metres")), "streets")


@query("address_bind", f"""WITH {_CITY}, own AS (SELECT house, min({_NEAR}) AS m FROM h JOIN v USING (street) GROUP BY 1), d AS (SELECT house, v.street, min({_NEAR}) AS m FROM h, v WHERE h.street IS NULL GROUP BY 1, 2),
       any_ AS (SELECT house, arg_min(street, m) AS street, min(m) AS m FROM d GROUP BY 1), b AS (SELECT h.house, CASE WHEN h.street IS NOT NULL AND (own.m IS NULL OR own.m <= 200) THEN 'by name' WHEN h.street IS NOT NULL THEN 'far from name' WHEN any_.m <= 40 THEN 'by distance' ELSE 'too far' END AS how,
       h.street AS said, any_.street AS near FROM h LEFT JOIN own USING (house) LEFT JOIN any_ USING (house)) SELECT house, how, CASE how WHEN 'by name' THEN said WHEN 'by distance' THEN near END AS bound FROM b""")
def address_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which street each house belongs to: by the name it gives or by distance, or why to none."""
    rows, vertices = _city(spark, sf_dir)
    with Scratch(spark) as scratch:
        return scratch.keep(nearest.bound_to_streets(rows, vertices, scratch).select("house", "how", "bound"), "bound")


@query(
    "edge_distances",
    f"""WITH p AS ({_POINTS.format(key="s_suppkey", table="supplier")}), x AS (SELECT *, radians(lon) * 6371000.0 * cos(radians(32.05)) AS x, radians(lat) * 6371000.0 AS y FROM p),
        e AS (SELECT radians(34.7) * 6371000.0 * cos(radians(32.05)) AS w, radians(34.8) * 6371000.0 * cos(radians(32.05)) AS e, radians(32.0) * 6371000.0 AS s, radians(32.1) * 6371000.0 AS n)
        SELECT s_suppkey, round(CASE WHEN x BETWEEN w AND e AND y BETWEEN s AND n THEN least(x - w, e - x, y - s, n - y) ELSE sqrt(pow(greatest(w - x, 0, x - e), 2) + pow(greatest(s - y, 0, y - n), 2)) END)::BIGINT AS metres FROM x, e""",
)
def edge_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metres to the edge of the zone, inside and outside."""
    ring = F.array(*(F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in ZONE))
    rows = _points(load(spark, sf_dir, "supplier"), "s_suppkey")
    return rows.select("s_suppkey", F.round(geo.edge_metres(F.col("lat"), F.col("lon"), ring, 32.05)).cast("long").alias("metres"))


# A made city: ten straight streets, each with anchors of some house numbers.
_STREETS = """a AS (SELECT DISTINCT 's' || (s_suppkey % 10) AS street, (s_suppkey // 10 * 3 + 1)::INT AS number FROM supplier WHERE s_suppkey % 10 <> 3),
       n AS (SELECT DISTINCT 's' || (c_custkey % 10) AS street, (c_custkey % 61)::INT AS number FROM customer)"""
STEP = 0.0001


def _street(k):
    return F.concat(F.lit("s"), (k % 10).cast("string"))


def made_city(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(anchors, vertices, wanted): a street runs north, a number is STEP degrees; even numbers lie east of it."""
    s = F.col("s_suppkey")
    number = (F.floor(s / 10) * 3 + 1).cast("int")
    anchors = load(spark, sf_dir, "supplier").where(s % 10 != 3).select(_street(s).alias("street"), number.alias("number"), (32.0 + number * STEP).alias("lat"), F.when(number % 2 == 0, 34.0003).otherwise(34.0).alias("lon")).distinct()
    vertices = spark.range(100).select(_street(F.col("id")).alias("street"), (31.99 + F.floor(F.col("id") / 10) * 0.01).alias("lat"), F.lit(34.0001).alias("lon"))
    wanted = load(spark, sf_dir, "customer").select(_street(F.col("c_custkey")).alias("street"), (F.col("c_custkey") % 61).cast("int").alias("number"))
    return anchors, vertices, wanted


@query(
    "house_points",
    f"""WITH {_STREETS}, f AS (SELECT n.street, n.number, max(a.number = n.number) AS hit, min(a.number) FILTER (WHERE a.number % 2 = n.number % 2) AS slow, max(a.number) FILTER (WHERE a.number % 2 = n.number % 2) AS shigh,
       min(a.number) AS low, max(a.number) AS high, count(*) FILTER (WHERE a.number % 2 = n.number % 2) AS same, count(*) AS every,
       min(abs(a.number - n.number)) FILTER (WHERE a.number % 2 = n.number % 2) AS far FROM n JOIN a ON a.street = n.street GROUP BY 1, 2)
       SELECT street, number, CASE WHEN hit THEN 'osm_addr' WHEN (slow > number OR shigh < number) AND far <= 2 THEN 'anchor_neighbour' WHEN every >= 2 AND low <= number AND high >= number THEN 'interpolated'
       WHEN every >= 2 AND greatest(low - number, number - high) * {STEP} * 111320 <= 150 THEN 'extrapolated' WHEN every = 1 AND abs(low - number) * {STEP} * 111320 <= 150 THEN 'projected' END AS how
       FROM f WHERE how IS NOT NULL""",
)
def house_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """House numbers placed between and beside the anchors of their street."""
    return houses.place(made_city(spark, sf_dir)[2], *made_city(spark, sf_dir)[:2], typical=STEP * 111_320).select("street", "number", "how")


@query(
    "house_errors",
    f"""WITH {_STREETS}, f AS (SELECT n.street, n.number, max(a.number = n.number) AS hit, min(a.number) AS low, max(a.number) AS high, min(a.number) FILTER (WHERE a.number % 2 = n.number % 2) AS slow,
       max(a.number) FILTER (WHERE a.number % 2 = n.number % 2) AS shigh, min(abs(a.number - n.number)) FILTER (WHERE a.number % 2 = n.number % 2) AS far, count(*) AS every FROM n JOIN a ON a.street = n.street GROUP BY 1, 2)
       SELECT street, number FROM f WHERE every >= 2 AND low <= number AND high >= number AND NOT hit AND NOT ((slow > number OR shigh < number) AND far <= 2)""",
)
def house_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated numbers that lie within a metre of the line on which they were made to lie."""
    anchors, vertices, wanted = made_city(spark, sf_dir)
    placed = houses.place(wanted, anchors, vertices, typical=STEP * 111_320).where("how = 'interpolated'")
    return placed.where(F.abs(F.col("lat") - 32.0 - F.col("number") * STEP) * 111_320 <= 1).select("street", "number")


@query("outward_numbers", f"""WITH {_STREETS}, e AS (SELECT street, min(number) AS low, max(number) AS high FROM a GROUP BY 1)
       SELECT street, 'up' AS way, 10::INT AS numbers, high + 2 AS first FROM e UNION ALL SELECT street, 'down', least(10, (low - 1) // 2)::INT, low - 2 FROM e WHERE low > 2""")
def outward_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = houses.outward(made_city(spark, sf_dir)[0])
    return found.select("street", "way", F.size("numbers").alias("numbers"), F.col("numbers")[0].alias("first"))


@query("thin_streets", f"WITH {_STREETS} SELECT DISTINCT n.street FROM n WHERE n.street NOT IN (SELECT street FROM a GROUP BY 1 HAVING count(*) >= 2)")
def thin_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors, _, wanted = made_city(spark, sf_dir)
    return houses.thin_streets(wanted, anchors)


@query("gap_order", """WITH a AS (SELECT DISTINCT 's' || (s_suppkey % 10) AS street, (s_suppkey // 10 * 3 + 1)::INT AS number FROM supplier), e AS (SELECT street, min(number) AS low, max(number) AS high FROM a GROUP BY 1),
       m AS (SELECT street, unnest(range(low, high + 1, 2))::INT AS number FROM e), g AS (SELECT m.* FROM m ANTI JOIN a ON m.street = a.street AND m.number = a.number),
       s AS (SELECT street, count(*) AS lacks FROM g GROUP BY 1 ORDER BY lacks DESC, street DESC LIMIT 3), t AS (SELECT g.*, lacks, row_number() OVER (PARTITION BY g.street ORDER BY number) AS turn FROM g JOIN s USING (street))
       SELECT street, number FROM t ORDER BY turn, lacks DESC, street DESC LIMIT 30""")
def gap_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The missing numbers to ask for first, street by street in turns."""
    from lodestay.plans.operations import gap_ranges

    s = F.col("s_suppkey")
    anchors = load(spark, sf_dir, "supplier").select(_street(s).alias("street"), (F.floor(s / 10) * 3 + 1).cast("int").alias("number")).distinct()
    ends = anchors.groupBy("street").agg(F.min("number").alias("low"))
    gaps = gap_ranges(anchors, "street", "number").join(ends, "street").where(F.col("first_n") % 2 == F.col("low") % 2)
    gaps = gaps.select("street", F.explode(F.sequence("first_n", "last_n", F.lit(2).cast("int"))).alias("number"))
    return houses.round_robin(gaps, 30)


@query("chained_anchors", """WITH RECURSIVE c AS (SELECT p_partkey AS place, 's' || (p_partkey % 40) AS street, 32 + ((p_partkey * 37 % 997) % 100) * 0.0005::DOUBLE AS lat, ((p_partkey * 37 % 997) % 100) * 55.6 AS off FROM part),
       a AS (SELECT * FROM c WHERE off <= 200 UNION SELECT c.* FROM c JOIN a ON c.street = a.street AND a.place < c.place AND abs(c.lat - a.lat) * 111195 <= 200) SELECT street, place FROM a""")
def chained_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that are believed because they are near their street, or near one of it that was believed before."""
    key = F.col("p_partkey").cast("long")
    step = (key * 37 % 997) % 100
    rows = load(spark, sf_dir, "part").select(key.alias("place"), F.concat(F.lit("s"), (key % 40).cast("string")).alias("street"), (32 + step * 0.0005).alias("lat"), F.lit(34.8).alias("lon"), (step * 55.6).alias("off"))
    with Scratch(spark) as scratch:
        return scratch.keep(houses.chained(rows, scratch).select("street", "place"), "chained")
