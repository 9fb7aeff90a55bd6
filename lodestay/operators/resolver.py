"""Addresses to points: a chain of tiers over distinct addresses, each a join of its own, of which the first that answers counts.

Named places come first, then houses on streets, earlier answers, places that had stepped aside for a house number, the
middle of a street, the house next door, and last what an address says it is near.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestay.functions import addresses as kinds
from lodestay.functions import facts, geo
from lodestay.operators import houses, streets
from lodestay.storage import Scratch

QUARTER = "^שכונ[הת]"
#: Characters before a place in which a word of nearness governs it, least length of an address found inside a name,
#: parts of an address that are tried as the street of its number.
LOOKBACK, LEAST_REVERSE, MOST_PARTS = 14, 4, 2
#: Sources of points that a person has placed, which stay even where nobody lives.
PLACED = ["static", "static_area", "static_street", "manual"]
_POINT = "struct<lat: double, lon: double, source: string>"


def folded(text: Column) -> Column:
    """The form in which addresses and names of places are compared: one kind of quotes, single spaces, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.translate(text, "׳״`", "'\"'"), r"\s+", " ")))


def _point(lat: Column, lon: Column, source: Column) -> Column:
    return F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon"), source.alias("source"))


def _grams(text: Column) -> Column:
    """array<struct<pos, gram>>: the two and three characters at each position of a text."""
    at = lambda size: F.transform(F.sequence(F.lit(0), F.length(text) - size), lambda i: F.struct(i.alias("pos"), F.substr(text, i + 1, F.lit(size)).alias("gram")))
    return F.concat(*(F.when(F.length(text) >= size, at(size)).otherwise(F.array().cast("array<struct<pos:int,gram:string>>")) for size in (3, 2)))


def known_places(places: DataFrame, names: DataFrame) -> DataFrame:
    """(key, lat, lon, kind, source, rank, is_street) of ``places`` (name, lat, lon, kind, extent_m, rank), one for each folded name.

    kind is place, area, landmark or bearing. Of equal names a landmark counts, then the least rank. Names of one
    character are left out.
    """
    graded = F.when((F.col("kind") == "landmark") & F.col("extent_m").isNotNull(), geo.landmark_grade(F.col("extent_m")))
    source = F.coalesce(graded, F.when((F.col("kind") == "area") | F.regexp_like("key", F.lit(QUARTER)), "static_area"), F.lit("static"))
    rows = places.withColumn("key", folded(F.col("name"))).withColumn("source", source)
    rows = rows.where("length(key) >= 2 and lat is not null and lon is not null")
    order = F.struct((F.col("kind") != "landmark").alias("later"), "rank", "lat", "lon", "kind", "source")
    best = rows.groupBy("key", (F.col("kind") == "bearing").alias("bearing")).agg(F.min(order).alias("b"), F.min("rank").alias("rank"))
    best = best.select("key", "b.lat", "b.lon", "b.kind", "b.source", "rank", streets.norm(F.col("key")).alias("street_key"))
    index = names.select(streets.norm(F.col("name")).alias("street_key")).distinct().withColumn("is_street", F.lit(True))
    return best.join(index, "street_key", "left").withColumn("is_street", F.coalesce("is_street", F.lit(False))).drop("street_key")


def contained(asked: DataFrame, places: DataFrame) -> DataFrame:
    """``asked`` (address, folded) joined with every place (key) that its text contains, with the first position ``pos``.

    The join is on the first characters of the names, so no address meets a place that it shares nothing with.
    """
    grams = asked.select("address", "folded", F.explode(_grams(F.col("folded"))).alias("g")).select("address", "folded", "g.pos", "g.gram")
    keyed = places.withColumn("gram", F.substring("key", 1, 3))
    hit = F.substr("folded", F.col("pos") + 1, F.length("key")) == F.col("key")
    found = grams.join(keyed, "gram").where(hit)
    others = [c for c in places.columns if c != "key"]
    return found.groupBy("address", "folded", "key").agg(F.min("pos").alias("pos"), *(F.first(c).alias(c) for c in others))


def containing(asked: DataFrame, places: DataFrame) -> DataFrame:
    """``asked`` (address, folded) joined with the places (key) whose longer name contains its whole text of four characters or more."""
    grams = places.select("*", F.explode(_grams(F.col("key"))).alias("g")).select(*places.columns, "g.pos", "g.gram")
    short = asked.where(F.length("folded") >= LEAST_REVERSE).select("address", "folded", F.substring("folded", 1, 3).alias("gram"))
    inside = (F.substr("key", F.col("pos") + 1, F.length("folded")) == F.col("folded")) & (F.length("key") > F.length("folded"))
    return short.join(grams, "gram").where(inside).drop("gram", "pos").dropDuplicates(["address", "key"])


def governed(text: Column, pos: Column) -> Column:
    """Whether a word of nearness stands just before a position, with no comma, stop, bar or slash between."""
    before = F.substr(text, F.greatest(pos - LOOKBACK, F.lit(0)) + 1, F.least(pos, F.lit(LOOKBACK)))
    return (pos > 0) & F.regexp_like(F.regexp_extract(before, "[^,.|/،]*$", 0), F.lit(kinds.NEAR))


def _place_tier(asked: DataFrame, places: DataFrame) -> DataFrame:
    """(address, at_place, aside): the point of the place that an address names, and of one that stepped aside for its number."""
    facts_of = asked.select("address", "folded", "numbered", "precise", F.col("named").isNotNull().alias("on_street"))
    of_quarter = (F.col("precise") | F.col("on_street")) & F.regexp_like("key", F.lit(QUARTER))
    rows = contained(asked, places).join(facts_of.drop("folded"), "address")
    area, landmark = F.col("source") == "static_area", F.col("kind") == "landmark"
    rows = rows.where(~of_quarter & ~(F.col("on_street") & area))
    aside = F.col("numbered") & (F.col("is_street") | area | landmark)
    near = governed(F.col("folded"), F.col("pos"))
    whole = F.struct("pos", "rank", "key", "lat", "lon", "source", landmark.alias("landmark"))
    first = rows.groupBy("address").agg(
        F.min(F.when(~aside & ~near, whole)).alias("best"), F.min(F.when(~aside & near, whole)).alias("near"), F.min(F.when(aside, F.struct("rank", "key", "lat", "lon", "source", landmark.alias("landmark")))).alias("skipped")
    )
    longer = containing(asked, places).join(facts_of.drop("folded"), "address").where(~of_quarter)
    inverse = longer.groupBy("address").agg(F.min(F.struct("rank", "key", "lat", "lon", "source", landmark.alias("landmark"))).alias("longer"))
    both = facts_of.select("address", "numbered").join(first, "address", "left").join(inverse, "address", "left")
    street = lambda hit: F.when((hit["source"] == "static") & ~F.col("numbered") & ~hit["landmark"], "static_street").otherwise(hit["source"])
    of = lambda hit, source: F.when(hit.isNotNull(), _point(hit["lat"], hit["lon"], source))
    best, longer_hit, near_hit, skipped = F.col("best"), F.col("longer"), F.col("near"), F.col("skipped")
    at_place = F.coalesce(of(best, street(best)), of(longer_hit, street(longer_hit)), of(near_hit, F.lit("static_area")))
    coarse = F.when(skipped["landmark"] | (skipped["source"] == "static_area"), skipped["source"]).otherwise("static_street")
    return both.select("address", at_place.alias("at_place"), of(skipped, coarse).alias("aside"))


def _neighbour_tier(asked: DataFrame, anchors: DataFrame, typical: float) -> DataFrame:
    """(address, neighbour): the anchor with the nearest number on the street that an address names, if it is next door."""
    wanted = asked.where("named is not null and number is not null").select("named", "number").distinct()
    near = wanted.join(anchors.select(F.col("street").alias("named"), F.col("number").alias("other"), "lat", "lon"), "named")
    apart = F.abs(F.col("other") - F.col("number"))
    near = near.where((apart <= houses.MOST_NUMBERS) & (apart * typical <= houses.MOST_BEYOND))
    best = near.groupBy("named", "number").agg(F.min(F.struct(apart.alias("apart"), "other", "lat", "lon")).alias("b"))
    return best.select("named", "number", _point(F.col("b.lat"), F.col("b.lon"), F.lit("anchor_neighbour")).alias("neighbour"))


def resolve(
    addresses: DataFrame, places: DataFrame, names: DataFrame, anchors: DataFrame, vertices: DataFrame, known: DataFrame | None = None, no_housing: list[tuple[str, Column]] | None = None,
    pools: DataFrame | None = None, likeness: float | None = streets.LEAST_LIKENESS, typical: float | None = None,
) -> DataFrame:
    """(address, lat, lon, source, confidence): a row for each distinct address, its point null where no tier knows it.

    addresses (address) and street names (name) are texts; anchors (street, number, lat, lon) have one point for each
    number, vertices (street, lat, lon) the shapes of streets. ``places`` is as ``known_places`` takes it; those of kind
    bearing only serve as the last tier. ``known`` (address, lat, lon, source) are earlier answers, without a point for
    an address that was asked for in vain. Computed points inside a ring of ``no_housing`` (name, ring) are dropped.
    Null and blank addresses give no row; an empty table of any kind leaves its tier without answers.
    Each tier is written to the shared folder, so that the plan of one does not repeat in the next.
    """
    with Scratch(addresses.sparkSession) as scratch:
        text = F.col("address")
        asked = addresses.select("address").where(F.trim("address") != "").distinct()
        parts = asked.select("address", F.posexplode(streets.candidates(text)).alias("place", "token"))
        real = streets.canonical(parts, names, pools, likeness)
        tokens = scratch.write(parts.join(real, "token", "left"), "tokens")
        named = tokens.where("street is not null and how <> 'fuzzy'").groupBy("address").agg(F.min(F.struct("place", "street")).alias("b")).select("address", F.col("b.street").alias("named"))
        number = facts.house_number(text).cast("int")
        asked = scratch.write(asked.join(named, "address", "left").withColumns({
            "folded": folded(text), "number": number, "numbered": number.isNotNull(), "precise": kinds.precise(text) & ~kinds.bare_quarter(text),
            "bearing": kinds.only_bearing(text, F.col("named").isNotNull()),
        }), "asked")
        typical = houses.typical_gap(anchors, houses.axes(vertices)) if typical is None else typical

        every = scratch.write(known_places(places, names), "places")
        at_place = scratch.write(_place_tier(asked, every.where("kind <> 'bearing'")), "at_place")
        tries = tokens.where(F.col("place") < MOST_PARTS).select("address", "place", F.coalesce("street", "token").alias("street"))
        tries = tries.join(asked.where("numbered").select("address", "number"), "address")
        placed = scratch.write(houses.place(tries, anchors, vertices, typical), "houses")
        house = tries.join(placed, ["street", "number"])
        house = house.groupBy("address").agg(F.min(F.struct("place", "lat", "lon", "how")).alias("b")).select("address", _point(F.col("b.lat"), F.col("b.lon"), F.col("b.how")).alias("house"))
        middle = houses.street_middle(vertices).select(F.col("street").alias("named"), _point(F.col("lat"), F.col("lon"), F.lit("street_geom")).alias("middle"))
        said = asked.where(F.regexp_like("folded", F.lit(kinds.NEAR)))
        bearing = contained(said, every.where("kind = 'bearing'")).groupBy("address").agg(F.min(F.struct("rank", "lat", "lon")).alias("b"))
        bearing = bearing.select("address", _point(F.col("b.lat"), F.col("b.lon"), F.lit("landmark")).alias("near_to"))

        rows = asked.join(at_place, "address", "left").join(house, "address", "left").join(bearing, "address", "left")
        rows = rows.join(middle, "named", "left").join(_neighbour_tier(asked, anchors, typical), ["named", "number"], "left")
        if known is None:
            rows = rows.withColumns({"asked_before": F.lit(False), "answer": F.lit(None).cast(_POINT)})
        else:
            answer = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), _point(F.col("lat"), F.col("lon"), F.col("source")))
            before = known.where("address is not null").groupBy(folded(text).alias("folded")).agg(F.min(answer).alias("answer")).withColumn("asked_before", F.lit(True))
            rows = rows.join(before, "folded", "left").withColumn("asked_before", F.coalesce("asked_before", F.lit(False)))
        on_street = F.when(~F.col("numbered") & ~F.col("bearing"), F.col("middle"))
        vain = F.coalesce(on_street, F.col("neighbour"))
        rest = F.when(F.col("asked_before"), vain).when(F.col("bearing"), F.col("near_to")).otherwise(F.coalesce(F.col("aside"), on_street, F.col("neighbour"), F.col("near_to")))
        found = rows.select("address", F.coalesce("at_place", "house", "answer", rest).alias("p"))
        if no_housing:
            hidden = geo.in_any_ring(F.col("p.lat"), F.col("p.lon"), no_housing).isNotNull() & ~F.col("p.source").isin(*PLACED)
            found = found.withColumn("p", F.when(~F.coalesce(hidden, F.lit(False)), F.col("p")))
        return scratch.keep(found.select("address", "p.lat", "p.lon", "p.source", kinds.confidence(F.col("p.source")).alias("confidence")), "resolved")
