"""Corrections made by hand: set for one key, cleared for one key, or all cleared at once; the last word counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def current(events: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(key, values) that hold after events (kind set, clear or clear_all, key, values, ts, seq).

    An event covers its key, a clear_all every key there is; of those that cover a key the last by ts, then seq,
    counts, and leaves a value only if it is a set. The clear_alls are one row, the last, that every key is
    compared with. A set without a key is none.
    """
    at = F.struct("ts", "seq")
    cleared = events.where("kind = 'clear_all'").agg(F.max(at).alias("_cleared"))
    own = events.where(F.col("kind").isin("set", "clear") & F.col(key).isNotNull())
    last = own.groupBy(key).agg(F.max(at).alias("_at"), F.max_by(F.struct("kind", *values), at).alias("_last"))
    kept = last.crossJoin(F.broadcast(cleared)).where("_last.kind = 'set' and (_cleared is null or _at > _cleared)")
    return kept.select(key, *(F.col(f"_last.{v}").alias(v) for v in values))


def relocated(rows: DataFrame, overrides: DataFrame, key: str, regrade) -> tuple[DataFrame, DataFrame]:
    """``rows`` (key, lat, lon, tier, status, score) with the points of ``overrides`` (key, lat, lon), and what that changed.

    ``regrade`` takes the rows whose point moved, with the new one, and gives them a new tier, status and score; all
    others are untouched. The second table has (key, before, after) of the rows whose verdict is another now.
    """
    points = overrides.select(F.col(key), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    joined = rows.join(points, key, "left")
    moves = F.col("_lat").isNotNull() & ~(F.col("lat").eqNullSafe(F.col("_lat")) & F.col("lon").eqNullSafe(F.col("_lon")))
    moved = joined.where(moves).withColumns({"lat": F.col("_lat"), "lon": F.col("_lon")}).drop("_lat", "_lon")
    graded = regrade(moved).select(*rows.columns)
    rest = joined.where(~moves).select(*rows.columns)
    verdict = F.struct("tier", "status", "score")
    was = rows.select(key, verdict.alias("before"))
    report = graded.select(key, verdict.alias("after")).join(was, key).where(~F.col("before").eqNullSafe(F.col("after")))
    return rest.unionByName(graded), report.select(key, "before", "after")


def near_enough(lat: Column, lon: Column, street_lat: Column, street_lon: Column, metres: float = 200.0) -> Column:
    """Whether a corrected point is close enough to its street to teach that street a house's place."""
    from lodestay.functions import geo

    return F.coalesce(geo.haversine(lat, lon, street_lat, street_lon) <= metres, F.lit(False))
