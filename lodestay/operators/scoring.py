"""Tiers, gates and the explainable score of a listing, as projections.

A listing has the columns that ``COLUMNS`` names; a function takes those that are missing as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestay.functions import addresses, facts, geo

#: Most a room may cost, fewest rooms, most flatmates. Null passes.
MAX_PRICE, MIN_ROOMS, MAX_MATES = 2000, 2, 4
#: What the factors of an excellent listing add up to.
FULL = 125
ALERT_SCORE, LEAST_WITHOUT_ADDRESS = 75, 50
#: The month to move in, listings that make a contact an agency, the base and the cap of the penalty for floors.
MOVE_IN, BROKER, FLOOR_BASE, FLOOR_CAP = 10, 4, 2.5, 40
#: Metres outside the zone that still count as inside, and near its edge that make a rough point uncertain; shares of a
#: street in range up to which it is out, and from which it is in.
GRACE, UNCERTAIN, REJECT, ACCEPT = 40.0, 150.0, 0.2, 0.8

# Quarters that are wanted, the one that is preferred, areas that are not.
ALLOWED, PREFERRED = ["ב", "ג", "ד"], {"ב": 4}
BLACKLIST = [
    "רמות", "נווה זאב", "נחל עשן", "פלח 7", "נאות אברהם", "נאות לון", "העיר העתיקה", "נווה מנחם", "כלניות", "סיגליות",
    "נחל בקע", "מרכז העיר", "שכונה דרום", "קרית יהודית", "הרובע", "רסקו", "נאות הדרים", "מרכז אזרחי",
]
NO_AMBER = ["שכונה ד", "שכונת ד"]

COLUMNS = {
    "is_ad": "boolean", "address": "string", "text": "string", "price": "double", "rooms": "int", "mates": "int", "tier": "string",
    "walk_minutes": "double", "age_hours": "double", "lease": "string", "furnished": "boolean", "balcony": "boolean", "floor": "string",
    "elevator": "boolean", "quarter": "string", "images": "array<string>", "broker_listings": "long", "price_from_comment": "boolean",
    "price_is_derived": "boolean", "geo_source": "string", "seen": "boolean", "inside": "boolean", "in_no_amber": "boolean",
    "in_allowed": "boolean", "edge_metres": "double", "boundary_street": "boolean", "street_in_range": "double",
}


def complete(listings: DataFrame) -> DataFrame:
    """``listings`` with all columns of a listing; those that were missing are null."""
    return listings.withColumns({n: F.lit(None).cast(t) for n, t in COLUMNS.items() if n not in listings.columns})


def steps(value: Column, bounds: list[tuple[float, int]], beyond: int, missing: int) -> Column:
    """Points of the first bound that a value does not exceed."""
    out = F.when(value.isNull(), missing)
    for bound, points in bounds:
        out = out.when(value <= bound, points)
    return out.otherwise(beyond)


def factors() -> list[tuple[str, Column]]:
    """(label, points) of a complete listing; a factor that does not apply has 0."""
    c = F.col
    share = F.bround(15 * F.least(F.lit(1.0), c("rooms") / F.nullif(c("mates"), F.lit(0)))).cast("int")
    age = F.when(c("age_hours") < 24, 4).when(c("age_hours") < 72, 2).when(c("age_hours") < 168, 0).when(c("age_hours").isNotNull(), -12).otherwise(0)
    month = facts.month_of(c("lease"))
    apart = F.least(F.pmod(month - MOVE_IN, F.lit(12)), F.pmod(MOVE_IN - month, F.lit(12)))
    floor = facts.floor_number(c("floor"))
    high = (floor > 1) & ~F.coalesce(c("elevator"), F.lit(False))
    preferred = F.coalesce(*(F.when(c("quarter") == q, n) for q, n in PREFERRED.items()), F.lit(0))
    return [
        ("zone", F.when(c("tier") == "GREEN", 25).when(c("tier") == "AMBER", 10).otherwise(0)),
        ("walk", steps(c("walk_minutes"), [(10, 25), (14, 20), (18, 13), (20, 7)], 0, 13)),
        ("price", steps(c("price"), [(1200, 25), (1500, 22), (1600, 20), (1700, 18), (2000, 15)], 0, 10)),
        ("rooms", F.when((c("rooms") != 0) & (c("mates") != 0), share).when(c("rooms") >= 3, 10).when(c("rooms") != 0, 6).otherwise(0)),
        ("mates", steps(c("mates"), [(2, 15), (3, 10), (4, 5)], 0, 5)),
        ("fresh", age),
        ("entry", F.when(apart == 0, 4).when(apart == 1, 2).otherwise(0)),
        ("furnished", F.when(c("furnished"), 10).otherwise(0)),
        ("balcony", F.when(c("balcony"), 18).otherwise(0)),
        ("quarter", preferred),
        ("photos", F.when(F.size("images") > 0, 6).otherwise(0)),
        ("women", F.when(facts.seeks_women(c("text")), -15).otherwise(0)),
        ("broker", F.when(c("broker_listings") >= BROKER, -12).otherwise(0)),
        ("floor", F.when(high, -F.bround(F.least(F.lit(float(FLOOR_CAP)), F.pow(F.lit(FLOOR_BASE), floor - 1))).cast("int")).otherwise(0)),
        ("no price", F.when(c("price").isNull(), -6).otherwise(0)),
        ("comment price", F.when(c("price_from_comment"), -3).otherwise(0)),
        ("derived price", F.when(c("price_is_derived"), -3).otherwise(0)),
    ]


def with_score(listings: DataFrame) -> DataFrame:
    """Add ``why`` (the factors other than 0) and ``score`` from 0 to 100, rounded half to even."""
    parts = F.array(*(F.struct(F.lit(k).alias("label"), v.cast("int").alias("points")) for k, v in factors()))
    total = F.aggregate("why", F.lit(0), lambda a, x: a + x["points"])
    scored = complete(listings).withColumn("why", F.filter(parts, lambda x: x["points"] != 0))
    return scored.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), F.bround(100 * total / FULL))).cast("int"))


def top_factors(why: Column, best: int = 3, worst: int = 2) -> Column:
    """The ``best`` highest positive factors and the ``worst`` lowest negative ones, in the order of the score where equal."""
    placed = F.transform(why, lambda x, i: F.struct((-x["points"]).alias("lost"), i.alias("place"), x["label"].alias("label"), x["points"].alias("points")))
    good = F.slice(F.array_sort(F.filter(placed, lambda x: x["points"] > 0)), 1, best)
    bad = F.slice(F.array_sort(F.transform(F.filter(placed, lambda x: x["points"] < 0), lambda x: F.struct((-x["lost"]).alias("lost"), x["place"], x["label"], x["points"]))), 1, worst)
    plain = lambda parts: F.transform(parts, lambda x: F.struct(x["label"].alias("label"), x["points"].alias("points")))
    return F.concat(plain(good), plain(bad))


def explain(why: Column) -> Column:
    """The score's factors as one line of text."""
    return F.array_join(F.transform(why, lambda x: F.concat(x["label"], F.when(x["points"] > 0, " +").otherwise(" "), x["points"].cast("string"))), ", ")


def stars(score: Column) -> Column:
    return F.when(score >= 90, 5).when(score >= 75, 4).when(score >= 60, 3).when(score >= 45, 2).otherwise(1)


def worth_an_alert(status: Column, score: Column, statuses: tuple[str, ...] = ("MATCH",)) -> Column:
    return F.coalesce(status.isin(*statuses) & (score >= ALERT_SCORE), F.lit(False))


def blacklisted(address: Column) -> Column:
    return F.coalesce(F.exists(F.array(*map(F.lit, BLACKLIST)), lambda b: F.contains(address, b)), F.lit(False))


def without_amber(address: Column) -> Column:
    """Whether an address names an area that has no margin outside the zone."""
    plain = F.translate(address, "״׳'`", "")
    return F.coalesce(F.exists(F.array(*map(F.lit, NO_AMBER)), lambda b: F.contains(plain, b)), F.lit(False))


def with_tier(listings: DataFrame) -> DataFrame:
    """Set ``tier`` of listings with inside, walk_minutes and a point's flags, and add why it was changed.

    In this order: no margin where an area has none; a bare quarter is AMBER at most; a precise point a few metres
    outside is in; a rough point near the edge is uncertain, one on a boundary street goes by the street's share in
    range, and on a bare street it is AMBER at most; points outside the wanted quarters are RED (unknown: allowed).
    """
    c, yes = F.col, lambda x: F.coalesce(x, F.lit(False))
    rows = complete(listings)
    bare = addresses.bare_quarter(c("address"))
    precise = addresses.precise_source(c("geo_source"))
    rows = rows.withColumn("tier", geo.tier(c("inside"), c("walk_minutes")))
    rows = rows.withColumn("no_amber", (c("tier") == "AMBER") & (yes(c("in_no_amber")) | without_amber(c("address"))))
    rows = rows.withColumn("tier", F.when(c("no_amber"), "RED").when((c("tier") == "GREEN") & bare, "AMBER").otherwise(c("tier")))
    rows = rows.withColumn("edge_grace", (c("tier") == "AMBER") & precise & ~bare & yes(c("edge_metres") <= GRACE))
    rows = rows.withColumn("tier", F.when(c("edge_grace"), "GREEN").otherwise(c("tier")))
    rough = c("tier").isin("GREEN", "AMBER") & ~precise
    near, crossing = yes(c("edge_metres") <= UNCERTAIN), yes(c("boundary_street"))
    split = c("street_in_range").isNull() | ((c("street_in_range") > REJECT) & (c("street_in_range") < ACCEPT))
    rows = rows.withColumn("edge_uncertain", rough & (near | (crossing & split)))
    rows = rows.withColumn("boundary", rough & ~near & crossing & yes(c("street_in_range") <= REJECT))
    capped = rough & ~near & ~crossing & (c("tier") == "GREEN") & addresses.bare_street(c("address"))
    rows = rows.withColumn("tier", F.when(c("boundary"), "RED").when(capped, "AMBER").otherwise(c("tier")))
    rows = rows.withColumn("outside", c("tier").isin("GREEN", "AMBER") & ~F.coalesce(c("in_allowed"), F.lit(True)))
    return rows.withColumn("tier", F.when(c("outside"), "RED").otherwise(c("tier")))


def missing_facts(rooms: Column, address: Column) -> Column:
    return rooms.isNull() | address.isNull() | addresses.bare_quarter(address)


def gates() -> list[tuple[Column, str, Column]]:
    """(test, status, reason) in order, for complete listings with a tier and a score; the first that holds decides."""
    c, text, yes = F.col, lambda x: x.cast("string"), lambda x: F.coalesce(x, F.lit(False))
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    flag = lambda name: yes(c(name)) if name in ("no_amber", "outside", "boundary") else c(name)
    letter = facts.quarter_letter(c("address"))
    whole = c("price").cast("long")
    nowhere = ~addresses.located(c("geo_source"))
    red = F.when(flag("boundary"), "a street across the edge, no exact address").when(flag("outside"), "outside the wanted quarters")
    red = red.when(flag("no_amber"), "an area without a margin outside the zone").otherwise(f"more than {geo.WALK_LIMIT:.0f} min walk from a gate")
    return [
        (~yes(c("is_ad")), "NOT_AD", F.lit("not an advertisement")),
        (blacklisted(c("address")), "DROP", say("unwanted area: ", c("address"))),
        (yes(~letter.isin(*ALLOWED)), "DROP", say("unwanted quarter ", letter)),
        (yes(c("seen")), "DROP", F.lit("already seen")),
        (c("price") > MAX_PRICE, "DROP", say("price ", text(whole), f" > {MAX_PRICE}")),
        (c("rooms") < MIN_ROOMS, "DROP", say("only ", text(c("rooms")), " rooms free")),
        (c("mates") > MAX_MATES, "DROP", say(text(c("mates")), f" flatmates > {MAX_MATES}")),
        (c("tier") == "RED", "DROP", red),
        (nowhere & addresses.only_bearing(c("address")), "DROP", F.lit("no address, only a bearing")),
        (nowhere & addresses.only_quarter(c("address")), "DROP", F.lit("no address, only a quarter")),
        (nowhere & (c("score") <= LEAST_WITHOUT_ADDRESS), "DROP", say("no address and score ", text(c("score")), f" <= {LEAST_WITHOUT_ADDRESS}")),
    ]


def doubts() -> Column:
    """Why a listing that passes all gates still needs data, joined by "; "; empty if it does not."""
    c, yes = F.col, lambda x: F.coalesce(x, F.lit(False))
    letter = facts.quarter_letter(c("address"))
    strange_quarter, strange_walk = yes(letter != c("quarter")), facts.walk_conflict(c("text"), c("walk_minutes"))
    unknown = c("tier") == "UNKNOWN"
    missing = missing_facts(c("rooms"), c("address"))
    any_doubt = missing | unknown | yes(c("edge_uncertain")) | strange_quarter | strange_walk
    parts = [
        F.when(missing, "rooms or street are missing"),
        F.when(unknown, "not located").when(any_doubt & (c("tier") == "AMBER"), "near the zone"),
        F.when(yes(c("edge_uncertain")), "too near the edge for a rough point"),
        F.when(strange_quarter, F.concat(F.lit("says quarter "), letter, F.lit(", lies in "), c("quarter"))),
        F.when(strange_walk, F.concat(F.lit("claims "), facts.claimed_walk(c("text")).cast("string"), F.lit(" min walk, is "), F.bround("walk_minutes").cast("long").cast("string"))),
    ]
    return F.when(any_doubt, F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), "; ")).otherwise("")


def verdict(listings: DataFrame) -> DataFrame:
    """Add ``status`` and ``reason``: the first failing gate decides, then doubts; a null never fails a hard gate."""
    flags = [n for n in ("no_amber", "edge_grace", "edge_uncertain", "boundary", "outside", "score") if n not in listings.columns]
    rows = complete(listings).withColumns({n: F.lit(None).cast("int" if n == "score" else "boolean") for n in flags})
    status, reason = F, F
    for test, name, why in gates():
        status, reason = status.when(test, name), reason.when(test, why)
    doubt = doubts()
    good = F.when(F.coalesce("edge_grace", F.lit(False)), "a few metres outside the zone").when(F.col("tier") == "GREEN", "in the zone").otherwise("near the zone")
    status, reason = status.when(doubt != "", "NEEDS_DATA").otherwise("MATCH"), reason.when(doubt != "", doubt).otherwise(good)
    return rows.withColumns({"status": status, "reason": reason}).drop(*flags)


def trace(listings: DataFrame) -> DataFrame:
    """Add ``trace``: (step, ok, detail) of every gate in order, for a listing with tier, score, status and reason."""
    c, yes = F.col, lambda x: F.coalesce(x, F.lit(False))
    step = lambda name, ok, detail: F.struct(F.lit(name).alias("step"), ok.alias("ok"), F.coalesce(detail.cast("string"), F.lit("none")).alias("detail"))
    words = F.filter(F.array(*map(F.lit, facts.KEYWORDS)), lambda w: F.contains(c("text"), w))
    facts_line = F.concat_ws(" ", F.concat(F.lit("rooms="), "rooms"), F.concat(F.lit("price="), c("price").cast("long")), F.concat(F.lit("mates="), "mates"))
    return listings.withColumn(
        "trace",
        F.array(
            step("keywords", facts.has_keyword(c("text")), F.array_join(F.slice(words, 1, 4), ", ")),
            step("not seen", ~yes(c("seen")), F.when(yes(c("seen")), "seen").otherwise("new")),
            step("advertisement", yes(c("is_ad")), c("is_ad")),
            step("address", c("address").isNotNull(), c("address")),
            step("rooms", c("rooms").isNotNull(), facts_line),
            step("located", c("tier") != "UNKNOWN", c("geo_source")),
            step("tier", c("tier").isin("GREEN", "AMBER"), c("tier")),
            step("verdict", c("status").isin("MATCH", "NEEDS_DATA"), F.concat_ws(": ", "status", "reason")),
            step("alert", worth_an_alert(c("status"), c("score")), c("score")),
        ),
    )


def classify(posts: DataFrame) -> DataFrame:
    """Facts mended, tier set, scored and judged: the whole way of posts (text, comments and the columns of a listing)."""
    return verdict(with_score(with_tier(facts.postprocess(complete(posts)))))
