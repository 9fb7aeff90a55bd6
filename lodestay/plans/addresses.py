"""Addresses of a made city, one for each row of ``part``, resolved to points; the SQL states the known point of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestay.operators import resolver
from lodestay.plans.posts import answers
from lodestay.plans.registry import load, query

#: (address, hundred-thousandths of a degree north of 31.24 and east of 34.79, source)
CASES = [
    ("רגר 11", 110, 0, "osm_addr"), ("רגר 15", 150, 0, "interpolated"), ("רחוב רגר", 1000, 0, "street_geom"), ("רגר 33", 310, 0, "anchor_neighbour"),
    ("רגר 41", 410, 0, "extrapolated"), ("שכונה ב", 2000, 1000, "static_area"), ("הבלוק", 3000, 1000, "static"), ("ליד הבלוק", 3000, 1000, "static_area"),
    ("ליד הבלוק, מגדלי דוד", 4000, 1000, "static_street"), ("רגר 15, הבלוק", 150, 0, "interpolated"), ("אלון 7, הבלוק", 3000, 1000, "static"), ("ליד הים", 5000, 1000, "landmark"),
    ("כפר דמיון", None, None, None), (None, None, None, None), ("גן סודי", 6000, 1000, "google"), ("רגר 999", None, None, None), ("רחוב רגר, שכונה ב", 1000, 0, "street_geom"),
    ("מגדלי", 4000, 1000, "static_street"), ("קמפוס 3", None, None, None), ("  ", None, None, None),
]
UNIT = 1e-5


def made_places(spark: SparkSession) -> dict[str, DataFrame]:
    """The tables of the made city, as ``resolver.resolve`` takes them."""
    lat, lon = (lambda n: 31.24 + n * UNIT), (lambda e: 34.79 + e * UNIT)
    places = [("שכונה ב", "area", None, 2000), ("הבלוק", "place", None, 9000), ("הבלוק", "landmark", 123.0, 3000), ("מגדלי דוד", "place", None, 4000), ("הים", "bearing", None, 5000)]
    return {
        "places": spark.createDataFrame([(n, lat(y), lon(1000), k, e, i) for i, (n, k, e, y) in enumerate(places)], "name string, lat double, lon double, kind string, extent_m double, rank int"),
        "names": spark.createDataFrame([("רגר",), ("קמפוס",)], "name string"),
        "anchors": spark.createDataFrame([("רגר", n, lat(10 * n), lon(0)) for n in (1, 11, 21, 31)] + [("קמפוס", 3, lat(8000), lon(8000))], "street string, number int, lat double, lon double"),
        "vertices": spark.createDataFrame([("רגר", lat(100 * i), lon(0)) for i in range(21)], "street string, lat double, lon double"),
        "known": spark.createDataFrame([("גן סודי", lat(6000), lon(1000), "google"), ("רגר 999", None, None, None)], "address string, lat double, lon double, source string"),
    }


def no_housing() -> list:
    """A campus on which nobody lives."""
    ring = [(7900, 7900), (7900, 8100), (8100, 8100), (8100, 7900)]
    return [("campus", F.array(*(F.struct(F.lit(31.24 + n * UNIT).alias("lat"), F.lit(34.79 + e * UNIT).alias("lon")) for n, e in ring)))]


@query("resolved_addresses", answers("north BIGINT, east BIGINT, source VARCHAR", [row[1:] for row in CASES]))
def resolved_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct address through all tiers, then joined to the rows that have it."""
    texts = spark.createDataFrame([(i, row[0]) for i, row in enumerate(CASES)], "i int, address string")
    rows = load(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % len(CASES)).cast("int").alias("i")).join(texts, "i")
    found = resolver.resolve(rows, **made_places(spark), no_housing=no_housing(), typical=10 * UNIT * 111_320)
    north, east = F.round((F.col("lat") - 31.24) / UNIT).cast("long"), F.round((F.col("lon") - 34.79) / UNIT).cast("long")
    return rows.join(found, "address", "left").select("p_partkey", north.alias("north"), east.alias("east"), "source")
