"""Houses on streets: axes of streets, anchors of house numbers and who gave them, placing a number between or beside anchors,
and audits of the anchors. Streets are keys of joins and groups; a street has tens of anchors and hundreds of vertices."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestay.functions import geo

METRES = geo.METRES_A_DEGREE
#: Metres that a number may lie beyond the last anchor, numbers to a neighbour on one side, metres to a building it is moved to.
MOST_BEYOND, MOST_NUMBERS, SNAP = 150.0, 2, 25.0
#: Metres from its street within which an address is believed.
MOST_OFFSET = 200.0
TYPICAL = 8.0
#: Bounds of believable metres for each number; of the audit of an order: anchors at least, share that must agree.
PER_NUMBER, LEAST_ANCHORS, CONSENSUS, MOST_GAP = (0.5, 40.0), 4, 0.6, 300.0


def axes(vertices: DataFrame) -> DataFrame:
    """(street, along, low, high, middle_lat, middle_lon) of streets with two vertices (street, lat, lon) or more.

    ``along`` is lat or lon, whichever the street reaches further in; low and high are its ends.
    """
    first = F.min(F.struct("lat", "lon"))["lat"]
    box = vertices.groupBy("street").agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"), first.alias("lat0"), F.count_distinct("lat", "lon").alias("points")).where("points >= 2")
    upright = (F.col("n") - F.col("s")) >= (F.col("e") - F.col("w")) * F.cos(F.radians("lat0"))
    along = F.when(upright, "lat").otherwise("lon")
    return box.select("street", along.alias("along"), F.when(upright, F.col("s")).otherwise(F.col("w")).alias("low"), F.when(upright, F.col("n")).otherwise(F.col("e")).alias("high"))


def authoritative(anchors: DataFrame, masked: DataFrame | None = None, pools: DataFrame | None = None) -> DataFrame:
    """(street, number, lat, lon, source) with one point for each number of anchors (street, number, lat, lon, source).

    A user's point wins, then the map's, then the survey's, which only fills gaps; of one source the first point. ``masked``
    (street, number) are left out unless a user gave them; ``pools`` (name, main) are spellings of one road.
    """
    rank = F.when(F.col("source") == "user", 0).when(F.col("source") == "osm", 1).otherwise(2)
    rows = anchors
    if pools is not None:
        rows = rows.join(pools.select(F.col("name").alias("street"), "main"), "street", "left").withColumn("street", F.coalesce("main", "street")).drop("main")
    if masked is not None:
        hidden = masked.select("street", "number").distinct().withColumn("_hidden", F.lit(True))
        rows = rows.join(hidden, ["street", "number"], "left").where("_hidden is null or source = 'user'").drop("_hidden")
    best = rows.groupBy("street", "number").agg(F.min(F.struct(rank.alias("rank"), "lat", "lon", "source")).alias("b"))
    return best.select("street", "number", "b.lat", "b.lon", "b.source")


def gap_per_number(anchors: DataFrame, axis: DataFrame) -> DataFrame:
    """(street, number, per): metres along the street for each number from the anchor before it, where believable."""
    rows = anchors.join(axis, "street").withColumn("at", F.when(F.col("along") == "lat", F.col("lat")).otherwise(F.col("lon")))
    before = Window.partitionBy("street").orderBy("number")
    per = F.abs(F.col("at") - F.lag("at").over(before)) * METRES / (F.col("number") - F.lag("number").over(before))
    return rows.select("street", "number", per.alias("per")).where(F.col("per").between(*PER_NUMBER))


def typical_gap(anchors: DataFrame, axis: DataFrame) -> float:
    """The median of the metres for each number over all streets; one number for the driver."""
    found = gap_per_number(anchors, axis).agg(F.percentile("per", F.lit(0.5))).first()[0]
    return TYPICAL if found is None else float(found)


def _on_axis(points: Column, target: Column) -> Column:
    """The cross coordinate of a street at a place on its axis: between the two points beside it, or at its end."""
    low = F.try_element_at(F.filter(points, lambda p: p["at"] <= target), F.lit(-1))
    high = F.get(F.filter(points, lambda p: p["at"] >= target), F.lit(0))
    share = F.coalesce((target - low["at"]) / F.nullif(high["at"] - low["at"], F.lit(0.0)), F.lit(0.0))
    return F.coalesce(low["cross"] + share * (high["cross"] - low["cross"]), low["cross"], high["cross"])


def place(wanted: DataFrame, anchors: DataFrame, vertices: DataFrame, typical: float | None = None) -> DataFrame:
    """(street, number, lat, lon, how) of distinct house numbers (street, number) that can be placed.

    An anchor of the very number; a neighbour of its side, where its side does not reach around it; between two anchors,
    with their distances off the street's line; beyond the last one, or from the only one, no further than the street
    goes and than 150 m. anchors (street, number, lat, lon) have one point for each number.
    """
    axis = axes(vertices)
    typical = typical_gap(anchors, axis) if typical is None else typical
    asked = wanted.select("street", F.col("number").cast("int").alias("number")).where("street is not null and number is not null").distinct()
    semi = lambda df: df.join(asked.select("street").distinct(), "street", "left_semi")
    known = semi(anchors).groupBy("street").agg(F.array_sort(F.collect_set(F.struct(F.col("number").cast("int").alias("number"), "lat", "lon"))).alias("known"))
    turned = semi(vertices).join(axis, "street").withColumn("p", F.when(F.col("along") == "lat", F.struct(F.col("lat").alias("at"), F.col("lon").alias("cross"))).otherwise(F.struct(F.col("lon").alias("at"), F.col("lat").alias("cross"))))
    line = turned.groupBy("street", "along", "low", "high").agg(F.array_sort(F.collect_set("p")).alias("points"))
    rows = asked.join(known, "street").join(line, "street", "left")
    n, up, step = F.col("number"), F.col("along") == "lat", typical / METRES
    turn = lambda a: F.struct(a["number"].alias("number"), F.when(up, a["lat"]).otherwise(a["lon"]).alias("at"), F.when(up, a["lon"]).otherwise(a["lat"]).alias("cross"), a["lat"].alias("lat"), a["lon"].alias("lon"))
    point = lambda along, over, how: F.struct(F.when(up, along).otherwise(over).alias("lat"), F.when(up, over).otherwise(along).alias("lon"), F.lit(how).alias("how"))

    # Each step is a column of its own: as one expression the plan would repeat the inner ones a thousand times.
    rows = rows.withColumn("known", F.transform("known", turn))
    rows = rows.withColumn("same", F.filter("known", lambda a: F.pmod(a["number"], F.lit(2)) == F.pmod(n, F.lit(2))))
    lowest, highest = F.get("same", F.lit(0)), F.try_element_at("same", F.lit(-1))
    rows = rows.withColumns({
        "hit": F.get(F.filter("known", lambda a: a["number"] == n), F.lit(0)), "first": F.col("known")[0], "last": F.element_at("known", -1),
        "inside": (F.size("same") >= 2) & (lowest["number"] <= n) & (highest["number"] >= n),
        "outside": (F.size("same") > 0) & ((lowest["number"] > n) | (highest["number"] < n)),
        "beside": F.array_min(F.transform("same", lambda a: F.struct(F.abs(a["number"] - n).alias("far"), a["number"].alias("number"), a["lat"].alias("lat"), a["lon"].alias("lon")))),
    })
    rows = rows.withColumn("used", F.when(F.col("inside"), F.col("same")).otherwise(F.col("known")))
    rows = rows.withColumns({
        "lo": F.try_element_at(F.filter("used", lambda a: a["number"] <= n), F.lit(-1)), "hi": F.get(F.filter("used", lambda a: a["number"] >= n), F.lit(0)),
        "edge": F.when(n > F.col("last.number"), F.col("last")).otherwise(F.col("first")),
        "slope": (F.col("last.at") - F.col("first.at")) / F.nullif(F.col("last.number") - F.col("first.number"), F.lit(0)),
        "heading": F.when(F.col("first.at") - F.col("low") < F.col("high") - F.col("first.at"), 1.0).otherwise(-1.0),
    })
    believed = F.when(F.abs("slope").between(0.25 * step, 4 * step), F.col("slope")).when(F.col("slope") >= 0, step).otherwise(-step)
    rows = rows.withColumns({
        "share": F.coalesce((n - F.col("lo.number")) / F.nullif(F.col("hi.number") - F.col("lo.number"), F.lit(0)), F.lit(0.0)),
        "lo_at": F.col("lo.at"), "hi_at": F.col("hi.at"),
        "onward": F.col("edge.at") + (n - F.col("edge.number")) * believed, "lone": F.col("first.at") + F.col("heading") * (n - F.col("first.number")) * step,
    }).withColumn("target", F.col("lo_at") + F.col("share") * (F.col("hi_at") - F.col("lo_at")))
    rows = rows.withColumns({f"{at}_cross": _on_axis(F.col("points"), F.col(at)) for at in ("lo_at", "hi_at", "target", "onward", "lone")})

    held = lambda at: F.least(F.greatest(F.col(at), F.col("low")), F.col("high"))
    mixed = lambda a, b: a + F.col("share") * (b - a)
    reach = lambda place, start: (F.abs(F.col(place) - F.col(start)) * METRES <= MOST_BEYOND) & F.col(place).between(F.col("low"), F.col("high"))
    beside = F.col("beside")
    exact = F.when(F.col("hit").isNotNull(), F.struct(F.col("hit.lat").alias("lat"), F.col("hit.lon").alias("lon"), F.lit("osm_addr").alias("how")))
    neighbour = F.when(F.col("outside") & (beside["far"] <= MOST_NUMBERS), F.struct(beside["lat"].alias("lat"), beside["lon"].alias("lon"), F.lit("anchor_neighbour").alias("how")))
    off_along, off_across = mixed(F.col("lo_at") - held("lo_at"), F.col("hi_at") - held("hi_at")), mixed(F.col("lo.cross") - F.col("lo_at_cross"), F.col("hi.cross") - F.col("hi_at_cross"))
    bracketed = (F.size("used") >= 2) & F.col("lo").isNotNull() & F.col("hi").isNotNull() & F.col("points").isNotNull()
    between = F.when(bracketed, point(held("target") + off_along, F.col("target_cross") + off_across, "interpolated"))
    several = (F.size("known") >= 2) & (F.col("last.number") > F.col("first.number"))
    beyond = F.when(several & reach("onward", "edge.at"), point(F.col("onward"), F.col("onward_cross"), "extrapolated"))
    from_one = F.when((F.size("known") == 1) & reach("lone", "first.at"), point(F.col("lone"), F.col("lone_cross"), "projected"))
    # Grouped by keys that are distinct already: a filter does not pass an aggregate, or it would carry all steps down in one expression.
    found = rows.groupBy("street", "number").agg(F.min(F.coalesce(exact, neighbour, between, beyond, from_one)).alias("p")).where("p is not null")
    return found.select("street", "number", "p.lat", "p.lon", "p.how")


def snap(points: DataFrame, buildings: DataFrame, most: float = SNAP, size: float = 0.002) -> DataFrame:
    """``points`` (id, lat, lon) moved to the nearest building (lat, lon) within ``most`` metres; others stay.

    A building is looked for in the nine cells around a point.
    """
    cell = lambda df: df.withColumn("i", F.floor(F.col("lat") / size)).withColumn("j", F.floor(F.col("lon") / size))
    near = F.explode(F.array(*(F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j")) for a in (-1, 0, 1) for b in (-1, 0, 1)))).alias("c")
    asked = cell(points.select("id", "lat", "lon")).select("id", "lat", "lon", near).select("id", "lat", "lon", "c.i", "c.j")
    built = cell(buildings.select("lat", "lon")).select("i", "j", F.col("lat").alias("blat"), F.col("lon").alias("blon"))
    far = geo.haversine(F.col("lat"), F.col("lon"), F.col("blat"), F.col("blon"))
    best = asked.join(built, ["i", "j"]).withColumn("far", far).where(F.col("far") <= most).groupBy("id").agg(F.min(F.struct("far", "blat", "blon")).alias("b"))
    moved = points.join(best, "id", "left")
    return moved.withColumns({"lat": F.coalesce("b.blat", "lat"), "lon": F.coalesce("b.blon", "lon")}).drop("b")


def street_middle(vertices: DataFrame, most: float = 200.0) -> DataFrame:
    """(street, lat, lon): the middle of each street on its axis, unless it lies further than ``most`` metres from all its vertices."""
    turned = vertices.join(axes(vertices), "street").withColumn("up", F.col("along") == "lat")
    at, cross = F.when(F.col("up"), F.col("lat")).otherwise(F.col("lon")), F.when(F.col("up"), F.col("lon")).otherwise(F.col("lat"))
    turned = turned.withColumns({"at": at, "cross": cross, "middle": (F.col("low") + F.col("high")) / 2})
    below, above = F.max(F.when(F.col("at") <= F.col("middle"), F.struct("at", "cross"))), F.min(F.when(F.col("at") >= F.col("middle"), F.struct("at", "cross")))
    ends = turned.groupBy("street", "up", "middle").agg(below.alias("a"), above.alias("b"))
    over = F.col("a.cross") + F.coalesce((F.col("middle") - F.col("a.at")) / F.nullif(F.col("b.at") - F.col("a.at"), F.lit(0.0)), F.lit(0.0)) * (F.col("b.cross") - F.col("a.cross"))
    middle = ends.select("street", F.when(F.col("up"), F.col("middle")).otherwise(over).alias("mlat"), F.when(F.col("up"), over).otherwise(F.col("middle")).alias("mlon"))
    far = F.min(geo.haversine(F.col("mlat"), F.col("mlon"), F.col("lat"), F.col("lon")))
    return vertices.join(middle, "street").groupBy("street", "mlat", "mlon").agg(far.alias("far")).where(F.col("far") <= most).select("street", F.col("mlat").alias("lat"), F.col("mlon").alias("lon"))


def street_lengths(vertices: DataFrame) -> DataFrame:
    """(street, metres) of segments (street, segment, place, lat, lon), whose vertices follow by place."""
    order = Window.partitionBy("street", "segment").orderBy("place")
    step = geo.haversine(F.lag("lat").over(order), F.lag("lon").over(order), F.col("lat"), F.col("lon"))
    return vertices.withColumn("step", step).groupBy("street").agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("metres"))


def in_range_share(vertices: DataFrame, tier: str = "tier", least: int = 3) -> DataFrame:
    """(street, share, boundary): the part of a street's vertices that is not RED, and whether the street crosses the edge."""
    red, good = F.col(tier) == "RED", F.col(tier).isin("GREEN", "AMBER")
    found = vertices.groupBy("street").agg(F.count("*").alias("n"), F.avg((~red).cast("int")).alias("share"), F.bool_or(red).alias("r"), F.bool_or(good).alias("g"))
    return found.select("street", F.when(F.col("n") >= least, F.col("share")).alias("share"), (F.col("r") & F.col("g")).alias("boundary"))


def one_road(anchors: DataFrame, most: float = MOST_GAP) -> DataFrame:
    """(street, one_road): false where three or more anchors fall into clumps further apart than ``most`` metres on an axis."""
    widest = []
    for c in ("lat", "lon"):
        order = Window.partitionBy("street").orderBy(c)
        scale = METRES * (F.cos(F.radians(F.min("lat").over(Window.partitionBy("street")))) if c == "lon" else F.lit(1.0))
        widest.append(((F.col(c) - F.lag(c).over(order)) * scale).alias(f"gap_{c}"))
    gaps = anchors.select("street", *widest).groupBy("street").agg(F.count("*").alias("n"), F.max(F.greatest("gap_lat", "gap_lon")).alias("gap"))
    return gaps.select("street", ((F.col("n") < 3) | (F.coalesce("gap", F.lit(0.0)) <= most)).alias("one_road"))


def longest_run(values: list[float]) -> set[int]:
    """Places of the longest part of a list that never falls, or never rises; of equal ones the rising one that ends last."""
    best: set[int] = set()
    for sign in (1, -1):
        lengths, before = [], []
        for i, v in enumerate(values):
            fits = [(lengths[j], -j) for j in range(i) if sign * (v - values[j]) >= 0]
            length, j = max(fits, default=(0, 1))
            lengths.append(length + 1)
            before.append(-j if length else -1)
        if lengths:
            at = max(range(len(values)), key=lambda i: (lengths[i], i))
            run = set()
            while at >= 0:
                run.add(at)
                at = before[at]
            best = max(best, run, key=len)
    return best


def order_outliers(anchors: DataFrame, axis: DataFrame) -> DataFrame:
    """(street, number) of anchors out of order along their street: of one side of four or more, where most of the others agree."""
    at = F.when(F.col("along") == "lat", F.col("lat")).otherwise(F.col("lon"))
    rows = anchors.join(axis, "street").select("street", F.col("number").cast("int").alias("number"), F.pmod("number", F.lit(2)).cast("int").alias("parity"), at.alias("at"))

    def judge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("number")
        keep = longest_run(group["at"].tolist())
        if len(group) < LEAST_ANCHORS or len(keep) < CONSENSUS * len(group):
            return group.iloc[:0][["street", "number"]]
        return group.iloc[[i for i in range(len(group)) if i not in keep]][["street", "number"]]

    return rows.groupBy("street", "parity").applyInPandas(judge, "street string, number int")


def seed_conflicts(seeds: DataFrame, survey: DataFrame, typical: float, floor: float = 250.0) -> DataFrame:
    """(street, number, allowed, metres) of seeds that lie too far from the survey's nearest number on their street.

    The allowance is 250 m, or four typical gaps for each number between them.
    """
    near = seeds.alias("s").join(survey.alias("k"), F.col("s.street") == F.col("k.street"))
    far = geo.haversine(F.col("s.lat"), F.col("s.lon"), F.col("k.lat"), F.col("k.lon"))
    apart = F.abs(F.col("s.number") - F.col("k.number"))
    best = near.groupBy(F.col("s.street").alias("street"), F.col("s.number").alias("number")).agg(F.min(F.struct(apart.alias("apart"), F.col("k.number"), far.alias("metres"))).alias("b"))
    allowed = F.greatest(F.lit(floor), 4 * typical * F.col("b.apart"))
    return best.select("street", "number", allowed.alias("allowed"), F.col("b.metres").alias("metres")).where(F.col("metres") > F.col("allowed"))


def audited(seeds: DataFrame, survey: DataFrame, axis: DataFrame, typical: float) -> DataFrame:
    """``seeds`` with ``kept`` and ``why``: first those that contradict the survey go, then those out of order among the rest."""
    bad = seed_conflicts(seeds, survey, typical).select("street", "number", F.lit("survey").alias("why"))
    rest = seeds.join(bad, ["street", "number"], "left_anti")
    odd = order_outliers(rest, axis).select("street", "number", F.lit("order").alias("why"))
    found = seeds.join(bad.unionByName(odd), ["street", "number"], "left")
    return found.withColumns({"kept": F.col("why").isNull(), "why": F.coalesce("why", F.lit(""))})


def round_robin(gaps: DataFrame, most: int, depth: int = 10) -> DataFrame:
    """(street, number) of at most ``most`` missing numbers: the streets that lack most first, and of each one number a round.

    gaps (street, number); only as many streets as would give ``depth`` numbers each.
    """
    size = gaps.groupBy("street").agg(F.count("*").alias("lacks")).orderBy(F.desc("lacks"), F.desc("street")).limit(max(1, most // depth))
    numbered = gaps.join(size, "street").withColumn("turn", F.row_number().over(Window.partitionBy("street").orderBy("number")))
    return numbered.orderBy("turn", F.desc("lacks"), F.desc("street")).limit(most).select("street", "number")


def outward(anchors: DataFrame, most: int = 10) -> DataFrame:
    """(street, way, numbers) to look for below the lowest and above the highest anchor, by twos; none below 1."""
    ends = anchors.groupBy("street").agg(F.min("number").alias("low"), F.max("number").alias("high"))
    down = F.when(F.col("low") > 2, F.slice(F.sequence(F.col("low") - 2, F.lit(1), F.lit(-2)), 1, most))
    up = F.sequence(F.col("high") + 2, F.col("high") + 2 * most, F.lit(2))
    ways = F.array(F.struct(F.lit("down").alias("way"), down.alias("numbers")), F.struct(F.lit("up").alias("way"), up.alias("numbers")))
    return ends.select("street", F.explode(ways).alias("w")).select("street", "w.way", "w.numbers").where("numbers is not null")


def thin_streets(in_zone: DataFrame, anchors: DataFrame, least: int = 2) -> DataFrame:
    """Streets (street) of the zone with fewer than ``least`` anchors."""
    counted = anchors.groupBy("street").agg(F.count("*").alias("anchors"))
    return in_zone.select("street").distinct().join(counted, "street", "left").where(F.coalesce("anchors", F.lit(0)) < least).select("street")


def stitched(ways: DataFrame, ring: str = "ring") -> DataFrame:
    """(ring, points): ways (ring, points array<struct<lat, lon>>) joined end to end into one line, as far as ends meet."""

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for frame in frames:
            rows = []
            for name, parts in zip(frame[ring], map(json.loads, frame["ways"]), strict=True):
                left = [[(p["lat"], p["lon"]) for p in part] for part in parts if len(part)]
                line = left.pop(0) if left else []
                while left:
                    fit = next((i for i, w in enumerate(left) if line[-1] in (w[0], w[-1])), None)
                    if fit is None:
                        break
                    way = left.pop(fit)
                    line += way[1:] if way[0] == line[-1] else way[::-1][1:]
                rows.append((name, [{"lat": a, "lon": b} for a, b in line]))
            yield pd.DataFrame(rows, columns=[ring, "points"])

    kind = ways.schema["points"].dataType.simpleString()
    gathered = ways.groupBy(ring).agg(F.to_json(F.array_sort(F.collect_list("points"))).alias("ways"))
    return gathered.mapInPandas(join, f"{ring} string, points {kind}")


def _since(open_: DataFrame, new: DataFrame, most: float) -> DataFrame:
    """(street, lat, lon, _since): of each point of ``open_`` the least place of ``new`` on its street within ``most`` metres.

    Of the new ones at one point the first decides, and open ones at one point have the same: points meet, not rows.
    """
    at = ["street", "lat", "lon"]
    high = most / geo.METRES_A_DEGREE * 1.01
    # A degree of longitude is shorter than one of latitude: up to 80 degrees north, six times.
    row, column = F.floor(F.col("lat") / high).alias("_i"), F.floor(F.col("lon") / (6 * high)).alias("_j")
    around = F.explode(F.flatten(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda j: F.struct(i.alias("di"), j.alias("dj"))))))
    first = new.groupBy("street", "lat", "lon").agg(F.min("place").alias("_before"))
    spread = first.select("street", "_before", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), row, column, around.alias("d"))
    spread = spread.select("street", "_before", "_lat", "_lon", (F.col("_i") + F.col("d.di")).alias("_i"), (F.col("_j") + F.col("d.dj")).alias("_j"))
    spots = open_.select(*at).distinct()
    met = spots.withColumns({"_i": F.floor(F.col("lat") / high), "_j": F.floor(F.col("lon") / (6 * high))}).join(spread, ["street", "_i", "_j"])
    close = met.where(geo.haversine(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")) <= most)
    return close.groupBy(*at).agg(F.min("_before").alias("_since"))


def chained(candidates: DataFrame, scratch: Scratch, most: float = MOST_OFFSET) -> DataFrame:
    """The candidates (street, place, lat, lon, off) that are accepted one after another in the order of their unique places.

    One is accepted if it lies within ``most`` metres of its street's geometry (``off``; null: nobody knows that), or of an
    accepted one of its street that came before it. Each round tests only those that the round before accepted against
    those still open, in cells around them; rounds end when none is new, after as many as the longest chain has links.
    A candidate without a point, and with an off beyond ``most``, is not.
    """
    near = F.col("off").isNull() | (F.col("off") <= most)
    new = scratch.write(candidates.where(near), "accepted")
    open_ = scratch.write(candidates.where(~near & F.col("lat").isNotNull() & F.col("lon").isNotNull()), "open")
    accepted, at = [new], ["street", "lat", "lon"]
    while not new.isEmpty():
        since = _since(open_, new, most)
        new = scratch.write(open_.join(since, at).where(F.col("place") > F.col("_since")).select(*open_.columns), "accepted")
        open_ = scratch.write(open_.join(new.select("street", "place"), ["street", "place"], "left_anti"), "open")
        accepted.append(new)
    out = accepted[0]
    for more in accepted[1:]:
        out = out.unionByName(more)
    return out
