"""Search of listings, and ranked lists of them: free text becomes a conjunction of column predicates."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestay.functions import addresses, facts

# Words of a search.
TIERS = {"green": "GREEN", "ירוק": "GREEN", "amber": "AMBER", "צהוב": "AMBER", "קרוב": "AMBER"}
STAR_SCORES = {5: 88, 4: 70, 3: 52, 2: 34, 1: 1}
ENGLISH_MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
STOP = {"חדרים", "חדר", "עד", "מתחת", "פחות", "ירוק", "צהוב", "קרוב", "כוכב", "כוכבים", "ניקוד", "מעל", "דירה", "דירות"}
#: Points of a vote, days after which a listing is stale.
VOTE, STALE_DAYS = 25, 21


@dataclass
class Request:
    max_price: float | None = None
    rooms: int | None = None
    tier: str | None = None
    min_score: int | None = None
    month: int | None = None
    terms: list[str] = field(default_factory=list)


def _number(pattern: str, text: str) -> int | None:
    found = re.search(pattern, text)
    return int(found[1]) if found else None


def parse(text: str) -> Request:
    """Limits of price, rooms, tier, stars or score and month; all other words of the listings' script are terms."""
    low = (text or "").strip().lower()
    scores = [STAR_SCORES.get(_number(r"(\d)\s*(?:stars?|כוכב(?:ים)?)", low), 0), _number(r"(?:score|ניקוד)\s*(?:over|above|מעל|>)?\s*(\d{2,3})", low) or 0]
    day = re.search(r"\b(\d{1,2})[-./](\d{1,2})", low)
    month = int(day[2]) if day and 1 <= int(day[2]) <= 12 else None
    if not day or not month:
        month = next((i % 12 + 1 for i, name in enumerate([*facts.MONTHS, *ENGLISH_MONTHS]) if name in low), None)
    return Request(
        max_price=_number(r"(?:under|below|max|עד|מתחת ל?|פחות מ?)\s*(\d{3,5})", low),
        rooms=_number(r"(\d)\s*(?:rooms?|חדרים|חדר)", low),
        tier=next((tier for word, tier in TIERS.items() if word in low), None),
        min_score=max(scores) or None,
        month=month,
        terms=[w for w in re.findall("[א-ת]{2,}", text or "") if w not in STOP and w not in facts.MONTHS],
    )


def says(term: str, columns: list[str]) -> Column:
    """Whether a term occurs in any of the columns; case matters as little as LIKE makes it, for ASCII letters."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(term.lower())), F.lit(False))
    return found


def predicate(request: Request, price: str = "price", rooms: str = "rooms", tier: str = "tier", score: str = "score", text: list[str] = ("address", "summary"), lease: str | None = None) -> Column:
    """All limits and, for each term, its appearance in any of the text columns; the month only where ``lease`` names a column."""
    out = F.lit(True)
    tests = [
        (request.max_price, lambda v: F.col(price) <= v),
        (request.rooms, lambda v: F.col(rooms) >= v),
        (request.tier, lambda v: F.col(tier) == v),
        (request.min_score, lambda v: F.col(score) >= v),
        (request.month if lease else None, lambda v: facts.month_of(F.col(lease)) == v),
    ]
    for value, test in tests:
        if value is not None:
            out = out & F.coalesce(test(value), F.lit(False))
    for term in request.terms:
        out = out & says(term, list(text))
    return out


def vote_points(votes: DataFrame, key: str = "key") -> DataFrame:
    """(key, saved, dismissed, points) of votes (key, voter, mark): each saved one adds, each dismissed one takes."""
    counted = votes.groupBy(key).agg(F.count_if(F.col("mark") == "saved").alias("saved"), F.count_if(F.col("mark") == "dismissed").alias("dismissed"))
    return counted.withColumn("points", (F.col("saved") - F.col("dismissed")) * VOTE)


def with_effective_score(listings: DataFrame, votes: DataFrame, key: str = "key") -> DataFrame:
    """Add ``effective``: the score with the votes' points, without bounds."""
    return listings.join(vote_points(votes, key).select(key, "points"), key, "left").withColumn("effective", F.coalesce("score", F.lit(0)) + F.coalesce("points", F.lit(0))).drop("points")


def search(listings: DataFrame, votes: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """The ``limit`` best listings (key, status, price, rooms, tier, score, lease, address, summary) that a text asks for,
    by effective score, ties by key. Only matches and those that need data are searched."""
    kept = listings.where(F.col("status").isin("MATCH", "NEEDS_DATA")).where(predicate(parse(text), lease="lease"))
    return with_effective_score(kept, votes).orderBy(F.desc("effective"), "key").limit(limit)


def skipped(listings: DataFrame, contacted: DataFrame, now: Column, key: str = "key") -> DataFrame:
    """Keys not to show again: contacted ones and stale ones."""
    old = listings.where(F.col("first_seen") < now - F.make_dt_interval(days=F.lit(STALE_DAYS))).select(key)
    return contacted.select(key).union(old).distinct()


def top_matches(listings: DataFrame, votes: DataFrame, contacted: DataFrame, now: Column, hours: int, limit: int) -> DataFrame:
    """The ``limit`` best matches of the last ``hours`` by effective score that are neither contacted nor stale."""
    recent = listings.where((F.col("status") == "MATCH") & (F.col("first_seen") >= now - F.make_dt_interval(hours=F.lit(hours))))
    left = recent.join(skipped(listings, contacted, now), "key", "left_anti")
    return with_effective_score(left, votes).orderBy(F.desc("effective"), "key").limit(limit)


def digest(listings: DataFrame, now: Column, days: int) -> DataFrame:
    """Matches and listings that need data of the last ``days``: matches first, then by score, ties by key."""
    recent = listings.where(F.col("status").isin("MATCH", "NEEDS_DATA") & (F.col("first_seen") >= now - F.make_dt_interval(days=F.lit(days))))
    return recent.orderBy(F.desc(F.col("status") == "MATCH"), F.desc_nulls_last("score"), "key")


def pending_alerts(listings: DataFrame, now: Column, hours: int, least: int = 75) -> DataFrame:
    """Matches that should have been told and were not, within ``hours``: the best first, of equal ones the newest."""
    owed = listings.where((F.col("status") == "MATCH") & (F.col("score") >= least) & F.col("alerted_at").isNull())
    return owed.where(F.col("first_seen") >= now - F.make_dt_interval(hours=F.lit(hours))).orderBy(F.desc("score"), F.desc("first_seen"), "key")


@dataclass
class Board:
    """What a board of listings shows; None, False and empty values leave a filter out."""

    text: str = ""
    status: str | None = None
    tier: str | None = None
    max_price: float | None = None
    min_rooms: int | None = None
    hide_stale: bool = False
    hide_brokers: bool = False
    only_saved: bool = False
    only_approximate: bool = False
    box: tuple[float, float, float, float] | None = None  # south, west, north, east


def board(listings: DataFrame, shown: Board, now: Column, text: tuple[str, ...] = ("address", "summary", "contact", "reason", "quarter", "lease", "source")) -> DataFrame:
    """Listings that pass all filters; a listing without a price, room or point fails a limit of these."""
    c, yes = F.col, lambda x: F.coalesce(x, F.lit(False))
    there = [n for n in text if n in listings.columns]
    tests = [says(w, there) for w in shown.text.split()]
    tests += [c("status") == shown.status] * bool(shown.status) + [c("tier") == shown.tier] * bool(shown.tier)
    tests += [c("price") <= shown.max_price] if shown.max_price is not None else []
    tests += [c("rooms") >= shown.min_rooms] if shown.min_rooms is not None else []
    tests += [c("first_seen") >= now - F.make_dt_interval(days=F.lit(STALE_DAYS))] * shown.hide_stale
    tests += [F.coalesce(c("broker_listings"), F.lit(0)) < 4] * shown.hide_brokers
    tests += [c("saved") > 0] * shown.only_saved + [addresses.approximate(c("geo_source"))] * shown.only_approximate
    if shown.box:
        south, west, north, east = shown.box
        tests.append(c("lat").between(south, north) & c("lon").between(west, east))
    out = F.lit(True)
    for test in tests:
        out = out & yes(test)
    return listings.where(out)


def enriched(listings: DataFrame, votes: DataFrame, contacted: DataFrame, notes: DataFrame, manual: DataFrame, brokers: DataFrame, now: Column) -> DataFrame:
    """Listings with votes, whether contacted and stale, their note, the listings of their contact, and the point that counts:
    a manual one before the stored one. notes (key, note), manual (key, lat, lon) and brokers (phone, addresses) have one row each."""
    c = F.col
    rows = listings.join(vote_points(votes), "key", "left").join(contacted.select("key").distinct().withColumn("contacted", F.lit(True)), "key", "left")
    rows = rows.join(notes, "key", "left").join(manual.select("key", c("lat").alias("_lat"), c("lon").alias("_lon")), "key", "left")
    rows = rows.join(brokers.withColumnRenamed("addresses", "broker_listings"), "phone", "left")
    zero = lambda n: F.coalesce(n, F.lit(0))
    return rows.withColumns({
        "saved": zero("saved"), "dismissed": zero("dismissed"), "effective": zero("score") + zero("points"),
        "contacted": F.coalesce("contacted", F.lit(False)), "stale": c("first_seen") < now - F.make_dt_interval(days=F.lit(STALE_DAYS)),
        "geo_source": F.when(c("_lat").isNotNull(), "manual").otherwise(c("geo_source")),
        "lat": F.coalesce("_lat", "lat"), "lon": F.coalesce("_lon", "lon"), "broker_listings": zero("broker_listings"),
    }).drop("points", "_lat", "_lon")


def messages(rows: DataFrame, group: str, order: str, line: str, most_characters: int = 3800, most_rows: int = 25) -> DataFrame:
    """(group, message, body): lines of each group packed in order into messages of bounded length and number of lines.

    A line that is too long by itself is a message of its own. Running sums cannot start anew at a bound that depends
    on them, so lines are folded one by one; a group is one recipient's digest.
    """
    ordered = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("line")))).alias("lines"))
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("now"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        size = F.length(x["line"]) + 1
        full = (F.size(a["now"]) > 0) & ((a["n"] + size > most_characters) | (F.size(a["now"]) >= most_rows))
        return F.struct(
            F.when(full, F.array_append(a["done"], a["now"])).otherwise(a["done"]).alias("done"),
            F.when(full, F.array(x["line"])).otherwise(F.array_append(a["now"], x["line"])).alias("now"),
            F.when(full, size).otherwise(a["n"] + size).alias("n"),
        )

    packed = F.aggregate("lines", start, step, lambda a: F.array_append(a["done"], a["now"]))
    return ordered.select(group, F.posexplode(packed).alias("message", "parts")).select(group, "message", F.array_join("parts", "\n").alias("body"))
