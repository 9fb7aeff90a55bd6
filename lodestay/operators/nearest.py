"""Exact nearest neighbours on the plane without a radius, by descending a tree of cells; and what binds to a street.

Cells that hold few targets are leaves, so dense quarters are cut finer than empty land. A point goes down the tree with
those cells only that may hold its nearest target: of every cell the box of its targets says how near and how far they can be, and
what cannot be nearer than another cell's farthest is dropped. Whether a target is near or far makes no difference to the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestay.functions.geo import METRES_A_DEGREE, flat_metres
from lodestay.operators.tiles import shares
from lodestay.storage import Scratch

#: Targets of a leaf, and levels of the tree, each of which cuts a cell into four by four.
LEAF, DEPTH = 32, 10
#: Cells of a level up to which they are broadcast; beyond, they are joined by shuffling.
BROADCAST_CELLS = 1 << 17


def _few(cells: DataFrame, count: int) -> DataFrame:
    return F.broadcast(cells) if count <= BROADCAST_CELLS else cells


def _tree(targets: DataFrame, by: list[str], scratch: Scratch) -> tuple[list[tuple[DataFrame, int]], DataFrame | None]:
    """The cells on the way to a leaf, (by, level, x, y, px, py, box, leaf, targets) and their number for each level, and ``targets`` (by, lat, lon, cx, cy, ...) with their leaf.

    Levels are made from the root down, each of the targets in crowded cells alone, so no target is copied to levels below its leaf.
    """
    levels, housed, held = [], None, targets
    box = F.struct(F.min("lat").alias("s"), F.min("lon").alias("w"), F.max("lat").alias("n"), F.max("lon").alias("e"))
    for level in range(DEPTH + 1):
        at = {to: F.shiftright(of, 2 * (DEPTH - level)) for to, of in (("x", "cx"), ("y", "cy"))}
        held = held.withColumns(at)
        cells = held.groupBy(*by, "x", "y").agg(F.count("*").alias("targets"), box.alias("box"))
        cells = cells.withColumns({"leaf": (F.col("targets") <= LEAF) | F.lit(level == DEPTH), "level": F.lit(level), "px": F.shiftright("x", 2), "py": F.shiftright("y", 2)})
        cells = scratch.write(cells, "cells")
        count, crowded = cells.agg(F.count("*"), F.count_if(~F.col("leaf"))).first()
        if not count:
            break
        levels.append((cells, count))
        full = _few(cells.where("not leaf").select(*by, "x", "y"), crowded)
        own = held.join(full, [*by, "x", "y"], "left_anti") if crowded else held
        housed = own.withColumn("level", F.lit(level)) if housed is None else housed.unionByName(own.withColumn("level", F.lit(level)))
        if not crowded:
            break
        held = targets.withColumns(at).join(full, [*by, "x", "y"], "left_semi")
    return levels, housed


def _reach(box: Column) -> tuple[Column, Column]:
    """How near and how far the nearest target of a box can be, in metres: a target lies on each side of it."""
    over = lambda low, high, at: F.greatest(low - at, at - high, F.lit(0.0))
    side = lambda low, high, at: F.least(F.abs(high - at), F.abs(low - at))
    most = lambda low, high, at: F.greatest(F.abs(low - at), F.abs(high - at))
    shrink = F.cos(F.radians("lat"))
    north = lambda f: f(box["s"], box["n"], F.col("lat")) * METRES_A_DEGREE
    east = lambda f: f(box["w"], box["e"], F.col("lon")) * METRES_A_DEGREE * shrink
    return F.hypot(north(over), east(over)), F.least(F.hypot(north(side), east(most)), F.hypot(north(most), east(side)))


def nearest(points: DataFrame, targets: DataFrame, name: str, scratch: Scratch, by: list[str] = ()) -> DataFrame:
    """(by, lat, lon, name, metres) of every distinct place of ``points`` (by, lat, lon): its nearest of ``targets`` (by, name, lat, lon).

    With ``by``, only targets with the same values there count. Metres are those of ``flat_metres`` from the point; of equally
    near targets the first by name counts. Places without any target, and rows without a place, give no row. Points
    and targets at one place are one each, so copies cost nothing. An empty side gives no rows.
    """
    by = list(by)
    placed = lambda rows: rows.where("lat is not null and lon is not null").withColumns({"lat": F.col("lat").cast("double"), "lon": F.col("lon").cast("double")})
    sites = placed(targets).groupBy(*by, "lat", "lon").agg(F.min(name).alias("name"))
    south, west, north, east = sites.agg(F.min("lat"), F.min("lon"), F.max("lat"), F.max("lon")).first()
    if south is None:
        south = west = north = east = 0.0
    side = max(north - south, east - west) * (1 + 1e-9) + 1e-12
    cell = lambda value, low: F.least(F.floor((value - low) / side * 4**DEPTH), F.lit(4**DEPTH - 1))
    sites = scratch.write(sites.withColumns({"cx": cell(F.col("lat"), south), "cy": cell(F.col("lon"), west)}), "sites")
    levels, housed = _tree(sites, by, scratch)

    key = ["lat", "lon", *by]
    if not levels:
        return placed(points).select(*by, "lat", "lon").limit(0).withColumns({"name": F.lit(None).cast(targets.schema[name].dataType), "metres": F.lit(0.0)})
    # Places have numbers, since Spark deals out doubles anew for every step that groups by them.
    now = scratch.write(placed(points).select(*by, "lat", "lon").distinct().withColumn("place", F.monotonically_increasing_id()), "places")
    # Dealt by place once: levels that are broadcast need no further shuffle. A place meets some thirty cells of a level.
    start = {"px": F.lit(0).cast("long"), "py": F.lit(0).cast("long"), "most": F.lit(float("inf")), **{c: F.lit(0).cast("long") for c in ("_x", "_y")}}
    now = now.repartition(shares(now, 32), "place").withColumns(start | {"_leaf": F.lit(False), "_least": F.lit(0.0), "_level": F.lit(0)})
    near = F.col("least") * (1 - 1e-9) <= F.col("most")
    for level, (cells, count) in enumerate(levels):
        here = _few(cells.select(*by, "px", "py", "x", "y", "leaf", "box"), count)
        met = now.join(here, [*by, "px", "py"], "left" if level else "inner")
        least, most = _reach(F.col("box"))
        # A leaf met at an earlier level stays as it is.
        met = met.select("place", *key, F.least("most", most).alias("most"), F.coalesce(least, "_least").alias("least"), F.coalesce("leaf", "_leaf").alias("_leaf"),
                         F.when(F.col("_leaf"), F.col("_level")).otherwise(level).alias("_level"), F.coalesce("x", "_x").alias("_x"), F.coalesce("y", "_y").alias("_y"))
        met = met.where(near).withColumn("most", F.min("most").over(Window.partitionBy("place"))).where(near).withColumnRenamed("least", "_least")
        # No cell lies at a negative place, and these are many.
        now = met.withColumns({"px": F.when(F.col("_leaf"), -1 - F.pmod(F.xxhash64("lat", "lon"), F.lit(1 << 20))).otherwise(F.col("_x")), "py": F.col("_y")})
    found = now.select(*key, *(F.col(f"_{c}").alias(c) for c in ("level", "x", "y")))
    # Leaves of the last level may hold many targets; they are cut, so that no list is long.
    part = F.lit(0)
    if len(levels) > DEPTH:
        housed = housed.join(levels[DEPTH][0].where(F.col("targets") > LEAF).select(*by, "level", "x", "y", "targets"), [*by, "level", "x", "y"], "left")
        part = F.pmod(F.xxhash64("lat", "lon"), F.coalesce(F.ceil(F.col("targets") / LEAF), F.lit(1)))
    housed = housed.withColumn("part", part)
    housed = housed.groupBy(*by, "level", "x", "y", "part").agg(F.collect_list(F.struct("lat", "lon", "name")).alias("housed"))
    metres = lambda t: flat_metres(F.col("lat"), F.col("lon"), t["lat"], t["lon"])
    least = F.array_min(F.transform("housed", lambda t: F.struct(metres(t).alias("metres"), t["name"].alias("name"))))
    best = found.join(housed, [*by, "level", "x", "y"]).select(*key, least.alias("best")).groupBy(*key).agg(F.min("best").alias("best"))
    return scratch.write(best.select(*by, "lat", "lon", F.col("best.name").alias("name"), F.col("best.metres").alias("metres")), "nearest")


def bound_to_streets(houses: DataFrame, vertices: DataFrame, scratch: Scratch, most_named: float = 200.0, most: float = 40.0) -> DataFrame:
    """``houses`` (street, lat, lon, ...) with ``bound``, the street each belongs to, and ``how``.

    A house that names a street belongs to it (by name) if it lies within ``most_named`` metres of the street's ``vertices``
    (street, lat, lon), or if nobody knows where the street is; else it names another street of that name (far from name).
    One without a name belongs to the nearest street within ``most`` metres (by distance), else to none (too far). Only
    the first and third are bound; the second and fourth are null. A house without a place is too far.
    """
    known = vertices.select("street").distinct().withColumn("_known", F.lit(True))
    own = nearest(houses.where("street is not null").join(known, "street", "left_semi"), vertices.withColumn("_name", F.col("street")), "_name", scratch, by=["street"])
    any_ = nearest(houses.where("street is null"), vertices, "street", scratch)
    at = ["lat", "lon"]
    rows = houses.withColumns({c: F.col(c).cast("double") for c in at}).join(known, "street", "left")
    rows = rows.join(own.select("street", *at, F.col("metres").alias("_own")), ["street", *at], "left")
    rows = rows.join(any_.select(*at, F.col("name").alias("_near"), F.col("metres").alias("_any")), at, "left")
    named = F.col("street").isNotNull()
    how = (
        F.when(named & (F.col("_known").isNull() | (F.col("_own") <= most_named)), "by name")
        .when(named, "far from name")
        .when(F.col("_any") <= most, "by distance")
        .otherwise("too far")
    )
    bound = F.when(how == "by name", F.col("street")).when(how == "by distance", F.col("_near"))
    return rows.withColumns({"bound": bound, "how": how}).select(*houses.columns, "bound", "how")
