"""Sources: run logs, timetables, map files, saved mail and JSON archives, each read by Spark's own readers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestay.functions import dates


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """(ts, event, detail) of log lines that begin with a time of 19 characters; other lines are skipped."""
    lines = spark.read.text(path)
    ts = F.try_to_timestamp(F.substring("value", 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))
    rest = F.trim(F.substring("value", 20, 1 << 20))
    found = lines.select(ts.alias("ts"), F.regexp_extract(rest, r"^(\S+)", 1).alias("event"), F.regexp_extract(rest, r"^\S+\s+(.*)$", 1).alias("detail"))
    return found.where("ts is not null")


def parsed_posts(posts: DataFrame, column: str, schema: str, needed: str) -> DataFrame:
    """Posts with ``column`` decoded from JSON into ``parsed``; bad JSON, or JSON without ``needed``, is skipped."""
    found = posts.where(F.col(column).isNotNull()).withColumn("parsed", F.from_json(column, schema))
    return found.where(F.col(f"parsed.{needed}").isNotNull())


def departures(spark: SparkSession, folder: str, weekday: str, today: str) -> DataFrame:
    """(stop_id, route_id, direction_id, trip_id, sequence, hour) of the trips that run on ``weekday``.

    ``folder`` holds the unzipped CSV files of a timetable. Only what is used is read from the large stop_times;
    the join strategy is left to the optimizer, which knows the sizes of the files.
    """
    read = lambda name: spark.read.option("header", True).csv(f"{folder}/{name}.txt")
    runs = dates.service_active(F.col(weekday).cast("int"), F.col("end_date"), F.lit(today).cast("date"))
    services = read("calendar").where(runs).select("service_id")
    trips = read("trips").join(services, "service_id", "left_semi").select("trip_id", "route_id", "direction_id")
    times = read("stop_times").select("trip_id", "stop_id", F.col("stop_sequence").cast("int").alias("sequence"), dates.service_hour(F.col("departure_time")).alias("hour"))
    return times.join(trips, "trip_id").select("stop_id", "route_id", "direction_id", "trip_id", "sequence", "hour")


def headways(trips: DataFrame, first: int = 7, last: int = 22) -> DataFrame:
    """(stop_id, route_id, direction_id, minutes): minutes between departures in [first, last), 1 at least, null if none."""
    counted = trips.groupBy("stop_id", "route_id", "direction_id").agg(F.count_if((F.col("hour") >= first) & (F.col("hour") < last)).alias("n"))
    minutes = F.greatest(F.lit(1), F.bround(F.lit((last - first) * 60.0) / F.nullif(F.col("n"), F.lit(0))).cast("int"))
    return counted.select("stop_id", "route_id", "direction_id", F.when(F.col("n") > 0, minutes).alias("minutes"))


def placemarks(spark: SparkSession, path: str) -> DataFrame:
    """(name, ring) of the placemarks of KML files, ring array<struct<lat, lon>> of three points or more."""
    schema = "name string, Polygon struct<outerBoundaryIs: struct<LinearRing: struct<coordinates: string>>>"
    rows = spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path)
    words = F.filter(F.split(F.col("Polygon.outerBoundaryIs.LinearRing.coordinates"), r"\s+"), lambda w: w != "")
    pairs = F.transform(words, lambda w: F.struct(F.split(w, ",")[1].cast("double").alias("lat"), F.split(w, ",")[0].cast("double").alias("lon")))
    return rows.select(F.trim("name").alias("name"), pairs.alias("ring")).where(F.size("ring") >= 3)


def saved_mail(spark: SparkSession, path: str) -> DataFrame:
    """(path, subject, body, is_html) of ``.eml`` files; the plain part is preferred to the HTML one."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import email
        from email import policy

        for frame in frames:
            rows = []
            for where, content in zip(frame["path"], frame["content"], strict=True):
                message = email.message_from_bytes(content, policy=policy.default)
                part = message.get_body(("plain", "html"))
                rows.append((where, message["subject"], part.get_content() if part else None, bool(part) and part.get_content_subtype() == "html"))
            yield pd.DataFrame(rows, columns=["path", "subject", "body", "is_html"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").load(path).select("path", "content")
    return files.mapInPandas(parse, "path string, subject string, body string, is_html boolean")
