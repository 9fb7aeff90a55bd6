"""Reports over posts, votes, runs, calls and locations, each one DataFrame. Values are ranked by their counts, not gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestay.functions import addresses, facts
from lodestay.operators.numbering import running_total
from lodestay.operators.upserts import first_per_key
from lodestay.storage import Scratch

#: Distinct posts of one numbered address from which on it is a house of many flats; addresses of one phone of an agency.
MULTI_UNIT, BROKER = 15, 4
LAG_MOST, LAG_LEAST_ROWS = 2880, 5


def ranked_values(rows: DataFrame, keys: list[str], value: str, indexes: dict[str, Column]) -> DataFrame:
    """(keys, n, one column for each of ``indexes``): the values at places from 0, which may depend on the number ``n``.

    Equal values are counted before they are put in order, so a group's order is over distinct values.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(*keys).orderBy(value)
    placed = counted.withColumn("_last", F.sum("_c").over(upto)).withColumn("n", F.sum("_c").over(Window.partitionBy(*keys)))
    return placed.groupBy(*keys, "n").agg(*(F.min(F.when(F.col("_last") > at, F.col(value))).alias(name) for name, at in indexes.items()))


def quantile_place(q: float) -> Column:
    """The place int(q (n - 1)) of a quantile."""
    return F.floor(q * (F.col("n") - 1))


def yield_rates(posts: DataFrame, configured: DataFrame, low: float = 0.015, least: int = 25) -> DataFrame:
    """(source, total, matches, rate, note) of posts (source, status): the share of matches, and what is odd about a source."""
    counted = posts.groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "MATCH").alias("matches"))
    known = configured.select("source").distinct().withColumn("_known", F.lit(True))
    rate = F.round(F.col("matches") / F.col("total"), 4)
    note = F.when(F.col("_known").isNull(), "not configured").when((F.col("total") >= least) & (rate < low), "low yield").otherwise("")
    return counted.join(known, "source", "left").select("source", "total", "matches", rate.alias("rate"), note.alias("note"))


def address_posts(posts: DataFrame) -> DataFrame:
    """(identity, posts): distinct posts (identity, url, sig) of each numbered address, by url or else by signature."""
    return posts.where("identity is not null").groupBy("identity").agg(F.count_distinct(F.coalesce("url", "sig")).alias("posts"))


def multi_unit(posts: DataFrame, least: int = MULTI_UNIT) -> DataFrame:
    return address_posts(posts).where(F.col("posts") >= least)


def brokers(posts: DataFrame, least: int = BROKER) -> DataFrame:
    """(phone, addresses): phones that advertise ``least`` distinct numbered addresses (phone, identity) or more."""
    pairs = posts.select("phone", "identity").where("phone is not null and identity is not null").distinct()
    return pairs.groupBy("phone").agg(F.count("*").alias("addresses")).where(F.col("addresses") >= least)


def alert_gate(listings: DataFrame, gate: int = 75) -> DataFrame:
    """One row: matches with a score, how many pass the gate, their share and the median (the value at place n // 2)."""
    scored = listings.where("status = 'MATCH' and score is not null").withColumn("_all", F.lit(1))
    middle = ranked_values(scored, ["_all"], "score", {"median": F.floor(F.col("n") / 2)})
    over = scored.groupBy("_all").agg(F.count_if(F.col("score") >= gate).alias("over"))
    share = F.bround(100 * F.col("over") / F.col("n")).cast("int")
    return middle.join(over, "_all").select("n", "median", "over", share.alias("percent"))


def score_bands(listings: DataFrame, width: int = 10) -> DataFrame:
    """(low, n) of matches by bands of scores."""
    scored = listings.where("status = 'MATCH' and score is not null")
    return scored.groupBy((F.floor(F.col("score") / width) * width).alias("low")).agg(F.count("*").alias("n"))


def detection_lag(posts: DataFrame, keys: list[str]) -> DataFrame:
    """Minutes from posted_at to first_seen by ``keys``: those from 0 below two days, their quartiles and bands, and how many
    were discarded. Quartiles are null below five rows."""
    minutes = (F.unix_timestamp("first_seen") - F.unix_timestamp("posted_at")) / 60
    rows = posts.where("posted_at is not null and first_seen is not null").withColumn("lag", minutes)
    fits = (F.col("lag") >= 0) & (F.col("lag") < LAG_MOST)
    one = rows.groupBy(*keys).agg(
        F.count_if(fits).alias("n"), F.count_if(~fits).alias("discarded"), F.count_if(fits & (F.col("lag") <= 60)).alias("within_1h"),
        F.count_if(fits & (F.col("lag") > 60) & (F.col("lag") <= 180)).alias("within_3h"), F.count_if(fits & (F.col("lag") > 180)).alias("later"),
    )
    places = ranked_values(rows.where(fits), keys, "lag", {f"p{int(100 * q)}": quantile_place(q) for q in (0.25, 0.5, 0.75)}).drop("n")
    found = one.join(places, keys, "left")
    return found.withColumns({p: F.when(F.col("n") >= LAG_LEAST_ROWS, F.col(p)) for p in ("p25", "p50", "p75")})


def accuracy(errors: DataFrame, tier: str, metres: str) -> DataFrame:
    """(tier, n, unresolved, p50, p90, most) of the errors of placed points; a null error is an unresolved one."""
    counted = errors.groupBy(tier).agg(F.count_if(F.col(metres).isNull()).alias("unresolved"), F.max(metres).alias("most"))
    places = ranked_values(errors, [tier], metres, {"p50": F.floor(F.col("n") / 2), "p90": F.least(F.floor(0.9 * F.col("n")), F.col("n") - 1)})
    return counted.join(places, tier, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def run_tallies(log: DataFrame) -> DataFrame:
    """By day of a log (ts, event, detail): starts, full and hot ends, aborted and skipped runs, blocked ends and the longest run.

    The detail of an END begins with the kind of the run and its seconds.
    """
    hot, seconds = F.col("detail").startswith("hot"), facts.found(F.col("detail"), r"(\d+)s(?:\s|$)", 1).cast("long")
    of = lambda event: F.col("event") == event
    day = F.to_date("ts").cast("string").alias("day")
    return log.groupBy(day).agg(
        F.count_if(of("START")).alias("started"), F.count_if(of("END") & ~hot).alias("full_runs"), F.count_if(of("END") & hot).alias("hot_runs"),
        F.count_if(of("ABORT")).alias("aborted"), F.count_if(of("SKIP")).alias("skipped"), F.count_if(of("END") & F.contains("detail", F.lit("block="))).alias("blocked"),
        F.max(F.when(of("END"), seconds)).alias("longest"),
    )


def reliability(days: DataFrame, in_flight: int = 0) -> DataFrame:
    """One row over ``run_tallies``: started, completed, aborted, crashed (starts that neither ended nor were aborted or run now), and the ratio."""
    lost = F.greatest(F.lit(0), F.col("started") - F.col("full_runs") - F.col("hot_runs"))
    one = days.agg(F.sum("started").alias("started"), F.sum(F.col("full_runs") + F.col("hot_runs")).alias("completed"), F.sum("aborted").alias("aborted"), F.sum(lost).alias("lost"))
    crashed = F.greatest(F.lit(0), F.col("lost") - in_flight - F.col("aborted"))
    return one.select("started", "completed", "aborted", crashed.alias("crashed"), F.round(F.col("completed") / F.nullif(F.col("started"), F.lit(0)), 4).alias("ratio"))


def _log_order(log: DataFrame) -> list[Column]:
    """Lines in order: by time, then by ``line`` where the log has it, else a flag before an END and that before a START."""
    tie = F.col("line") if "line" in log.columns else F.when(F.col("event") == "START", 2).when(F.col("event") == "END", 1).otherwise(0)
    return [F.col("ts"), tie]


def flagged_ends(log: DataFrame, flag: str, scratch: Scratch) -> DataFrame:
    """(ts, flagged) of every END of a log (ts, event): whether a ``flag`` event lies between the END before it and itself.

    A line belongs to the END that as many ENDs lie before as before itself, however far that is: a run may cross
    midnight. Flags after the last END belong to none.
    """
    lines = log.where(F.col("event").isin("END", flag))
    lines = running_total(lines, _log_order(log), F.when(F.col("event") == "END", 1), "_end", scratch)
    marks = lines.groupBy("_end").agg(F.max(F.when(F.col("event") == "END", F.col("ts"))).alias("ts"), F.max(F.col("event") == flag).alias("flagged"))
    return marks.where("ts is not null").select("ts", "flagged")


def degraded_share(log: DataFrame, flag: str, scratch: Scratch) -> DataFrame:
    """One row: completed runs, those with a flag, and their share."""
    runs = flagged_ends(log, flag, scratch).agg(F.count("*").alias("runs"), F.count_if("flagged").alias("degraded"))
    return runs.withColumn("share", F.round(F.col("degraded") / F.nullif(F.col("runs"), F.lit(0)), 4))


#: What the detail of an END reports, each group in one piece.
_REPORTED = [("posts", "match", "needs"), ("read", "age_skip", "seen_skip")]


def weekly(log: DataFrame, since: Column, now: Column, scratch: Scratch, patience_hours: int = 2) -> DataFrame:
    """One row over a log (ts, event, detail) from ``since`` on: runs, skipped, blocked, dangling, and sums of what runs report.

    A blocked END is no run and its numbers do not count. A START dangles if the next START comes before an END, whatever
    else lies between, or if neither comes within ``patience_hours`` before ``now``. Days do not matter.
    """
    rows = log.where(F.col("ts") >= since)
    is_end = F.col("event") == "END"
    stopped = F.contains("detail", F.lit("BLOCKED")) | F.contains("detail", F.lit("block="))
    run, blocked = is_end & ~F.coalesce(stopped, F.lit(False)), is_end & stopped
    sums = []
    for names in _REPORTED:
        pattern = r"\s+".join(rf"{n}=(\d+)" for n in names)
        sums += [F.coalesce(F.sum(F.when(run, facts.found(F.col("detail"), pattern, i).cast("long"))), F.lit(0)).alias(n) for i, n in enumerate(names, 1)]
    counted = rows.agg(F.count_if(run).alias("runs"), F.count_if(F.col("event") == "SKIP").alias("skipped"), F.count_if(blocked).alias("blocked"), *sums)

    marks = running_total(rows.where(F.col("event").isin("START", "END")), _log_order(log), F.when(is_end, 1), "_end", scratch)
    between = marks.groupBy("_end").agg(F.count_if(F.col("event") == "START").alias("starts"), F.max(is_end).alias("ended"), F.max("ts").alias("last"))
    late = F.col("last") < now - F.make_dt_interval(hours=F.lit(patience_hours))
    lost = F.when(F.col("starts") > 0, F.col("starts") - 1 + (~F.col("ended") & late).cast("int")).otherwise(0)
    dangling = between.agg(F.coalesce(F.sum(lost), F.lit(0)).alias("dangling"))
    return counted.crossJoin(dangling).select("runs", "skipped", "blocked", "dangling", *(n for names in _REPORTED for n in names))


def quota_windows(calls: DataFrame, cap: int, windows: int = 8) -> DataFrame:
    """(quota_day, calls, mix, note) of the last ``windows`` quota days of calls (ts, model, refused): the models' counts and whether the cap was met."""
    day = F.to_date(F.col("ts") - F.make_dt_interval(hours=F.lit(10))).cast("string")
    by_model = calls.groupBy(day.alias("quota_day"), "model").agg(F.count("*").alias("c"), F.max(F.coalesce("refused", F.lit(False))).alias("refused"))
    by_day = by_model.groupBy("quota_day").agg(F.sum("c").alias("calls"), F.max("refused").alias("refused"), F.array_sort(F.collect_list(F.struct("model", "c"))).alias("m"))
    mix = F.array_join(F.transform("m", lambda x: F.concat_ws("=", x["model"], x["c"].cast("string"))), " ")
    note = F.when(F.col("refused"), "refused").when(F.col("calls") >= cap, "own cap met").otherwise("")
    return by_day.orderBy(F.desc("quota_day")).limit(windows).select("quota_day", "calls", mix.alias("mix"), note.alias("note"))


def refusals(errors: DataFrame) -> DataFrame:
    """(model, refused, stated_limit, retry_seconds) of error texts (model, text): quota errors, and what they say themselves."""
    quota = errors.where(F.regexp_like(F.lower("text"), F.lit("quota|rate.?limit|resource.?exhausted|429")))
    limit = facts.found(F.col("text"), r"(?i)limit[\"':= ]+(\d+)", 1).cast("long")
    retry = facts.found(F.col("text"), r"(?i)retry[^0-9]{0,20}(\d+(?:\.\d+)?)\s*s", 1).cast("double")
    return quota.groupBy("model").agg(F.count("*").alias("refused"), F.max(limit).alias("stated_limit"), F.max(retry).alias("retry_seconds"))


def location_uniqueness(listings: DataFrame) -> DataFrame:
    """(lat, lon, listings, addresses, kind): what shares a point, coordinates rounded to six places.

    alone, one flat (one address), one building (several flats of a number) or collapsed (different addresses on one point).
    """
    rows = listings.where("lat is not null and lon is not null")
    found = rows.groupBy(F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon")).agg(F.count("*").alias("listings"), F.count_distinct("identity").alias("addresses"))
    kind = F.when(F.col("listings") == 1, "alone").when(F.col("addresses") == 1, "one address").otherwise("collapsed")
    return found.withColumn("kind", kind)


def street_worklist(listings: DataFrame, anchors: DataFrame) -> DataFrame:
    """(street, addresses, listings, anchors) of numbered listings (street, number, geo_source) that have no exact point."""
    rough = listings.where(F.col("street").isNotNull() & F.col("number").isNotNull() & ~addresses.precise_source(F.col("geo_source")))
    found = rough.groupBy("street").agg(F.count_distinct("number").alias("addresses"), F.count("*").alias("listings"))
    return found.join(anchors.groupBy("street").agg(F.count("*").alias("anchors")), "street", "left").withColumn("anchors", F.coalesce("anchors", F.lit(0).cast("long")))


def pin_worklist(listings: DataFrame, limit: int = 8) -> DataFrame:
    """(key, address, fixes): imprecise listings (key, address, street, geo_source) in the order in which a pin helps most.

    A pin mends all imprecise listings of its street; numbered addresses come first, then by address and key.
    """
    rough = listings.where(addresses.approximate(F.col("geo_source")))
    fixes = rough.where("street is not null").groupBy("street").agg(F.count("*").alias("fixes"))
    rows = rough.join(fixes, "street", "left").withColumn("fixes", F.coalesce("fixes", F.lit(1).cast("long")))
    return rows.orderBy(F.desc("fixes"), facts.house_number(F.col("address")).isNull(), "address", "key").limit(limit).select("key", "address", "fixes")


def split_unknowns(events: DataFrame, placed: DataFrame, by_design: Column, since: Column) -> DataFrame:
    """(location, n, last_seen, kind) of names (location, ts) that could not be placed since then.

    kind is resolved for a name that is ``placed`` (location) by now, by design for one that must never be pinned, else
    pinnable; what is resolved is so whatever else it is.
    """
    rows = events.where((F.col("ts") >= since) & F.col("location").isNotNull()).groupBy("location").agg(F.count("*").alias("n"), F.max("ts").alias("last_seen"))
    done = placed.select("location").distinct().withColumn("_placed", F.lit(True))
    kind = F.when(F.col("_placed"), "resolved").when(F.coalesce(by_design, F.lit(False)), "by design").otherwise("pinnable")
    return rows.join(done, "location", "left").select("location", "n", "last_seen", kind.alias("kind"))


def unknown_counts(split: DataFrame) -> DataFrame:
    """One row over ``split_unknowns``: how many names were logged, how many are worth a pin, and the two groups that are not shown."""
    of = lambda kind: F.count_if(F.col("kind") == kind)
    return split.agg(F.count("*").alias("logged"), of("pinnable").alias("pinnable"), of("resolved").alias("resolved"), of("by design").alias("by_design"))


def unknown_locations(events: DataFrame, placed: DataFrame, by_design: Column, since: Column, limit: int = 8) -> DataFrame:
    """(location, n, last_seen) of the names worth a pin, the commonest first."""
    left = split_unknowns(events, placed, by_design, since).where("kind = 'pinnable'").select("location", "n", "last_seen")
    return left.orderBy(F.desc("n"), F.desc("last_seen"), "location").limit(limit)


def most_overdue(groups: DataFrame, reads: DataFrame, now: Column, limit: int) -> DataFrame:
    """The ``limit`` groups (source) that were read (source, ts) least in the last day, of equal ones the longest ago; never read ones first."""
    day = now - F.make_dt_interval(hours=F.lit(24))
    counted = reads.groupBy("source").agg(F.count_if(F.col("ts") >= day).alias("today"), F.max("ts").alias("last_read"))
    found = groups.join(counted, "source", "left").withColumn("today", F.coalesce("today", F.lit(0).cast("long")))
    return found.orderBy("today", F.asc_nulls_first("last_read"), "source").limit(limit)


def hot_groups(posts: DataFrame, configured: DataFrame, most: int = 3, least: int = 25) -> DataFrame:
    """The ``most`` sources with the highest rate of matches among those with enough posts, then configured ones (source, place) in order."""
    rates = posts.groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "MATCH").alias("matches")).where(F.col("total") >= least)
    found = configured.join(rates, "source", "left").withColumn("rate", F.col("matches") / F.col("total"))
    return found.orderBy(F.desc_nulls_last("rate"), "place", "source").limit(most).select("source", "rate")


def age_bands(listings: DataFrame, now: Column) -> DataFrame:
    """(band, n) of listings by the days since they were first seen."""
    days = F.floor((F.unix_timestamp(now) - F.unix_timestamp("first_seen")) / 86400)
    band = F.when(days < 1, "today").when(days <= 2, "1-2").when(days <= 7, "3-7").when(days <= 21, "8-21").otherwise("stale")
    return listings.groupBy(band.alias("band")).agg(F.count("*").alias("n"))


def agreement(runs: DataFrame, fields: list[str], least: float = 0.95) -> DataFrame:
    """(field, n, same, flips, lost, passes) of a control and a candidate reading: columns control_x and candidate_x of each field.

    A flip is another value, a loss is null where the control has a value. Enough must agree for a field to pass.
    """
    text = lambda c: F.col(c).cast("string")
    parts = F.array(*(F.struct(F.lit(f).alias("field"), text(f"control_{f}").alias("a"), text(f"candidate_{f}").alias("b")) for f in fields))
    rows = runs.select(F.explode(parts).alias("x")).select("x.*")
    same, a, b = F.col("a").eqNullSafe(F.col("b")), F.col("a"), F.col("b")
    found = rows.groupBy("field").agg(F.count("*").alias("n"), F.count_if(same).alias("same"), F.count_if(~same & a.isNotNull() & b.isNotNull()).alias("flips"), F.count_if(a.isNotNull() & b.isNull()).alias("lost"))
    return found.withColumn("passes", F.col("same") >= least * F.col("n"))


def replay_diff(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """(key, change) of keys (key, status, score) whose verdict or score is another one now: rescued, demoted or changed.

    Keys that only one side has are no change.
    """
    named = fresh.select("key", F.col("status").alias("_status"), F.col("score").alias("_score"))
    kept = lambda c: F.col(c).isin("MATCH", "NEEDS_DATA")
    both = stored.join(named, "key").where(~(F.col("status").eqNullSafe(F.col("_status")) & F.col("score").eqNullSafe(F.col("_score"))))
    change = F.when(~kept("status") & kept("_status"), "rescued").when(kept("status") & ~kept("_status"), "demoted").otherwise("changed")
    return both.select("key", change.alias("change"))


def earliest_dates(posts: DataFrame, listings: DataFrame) -> DataFrame:
    """(key, first_seen) of listings whose date moves back to that of an earlier post (dedup_keys, posted_at, first_seen); dates never move on."""
    exploded = posts.select(F.explode("dedup_keys").alias("key"), F.coalesce("posted_at", "first_seen").alias("at"))
    first = exploded.groupBy("key").agg(F.min("at").alias("at"))
    return listings.select("key", F.col("first_seen").alias("old")).join(first, "key").where("at < old").select("key", F.col("at").alias("first_seen"))


def post_of_listing(posts: DataFrame, listings: DataFrame) -> DataFrame:
    """(key, sig) of the first post (sig, dedup_keys, first_seen) that shares a key with a listing (key)."""
    exploded = posts.select("sig", "first_seen", F.explode("dedup_keys").alias("key")).join(listings.select("key").distinct(), "key", "left_semi")
    return first_per_key(exploded, ["key"], [F.col("first_seen"), F.col("sig")]).select("key", "sig")


def health(checks: DataFrame) -> DataFrame:
    """(name, status, detail) of measured checks (name, value, warn, fail): a value at or above ``fail`` fails, null fails too."""
    status = F.when(F.col("value").isNull() | (F.col("value") >= F.col("fail")), "fail").when(F.col("value") >= F.col("warn"), "warn").otherwise("ok")
    return checks.select("name", status.alias("status"), F.concat_ws(" ", F.lit("value"), F.coalesce(F.col("value").cast("string"), F.lit("unknown"))).alias("detail"))
