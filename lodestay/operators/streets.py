"""Street names: messy names to real ones by one join on prepared keys, and pools of spellings of one road.

A token is tried as it is, without a one-letter prefix, without its word for a road, as a run of words that only one
street has, then by runs of words inside it, and last by likeness. All tries of all tokens are keys of one join; the
best try wins. What is left is compared with the names that share enough pairs of letters with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestay.functions.addresses import CITY, NUMBERS, TAIL

# Prefixes that stick to names, words for roads, titles.
PREFIXES = "הבלמוש"
ROAD_TYPES = ["דרך", "רחוב", "שדרות", "שדרת", "סמטת", "סמטה", "שביל", "כביש", "כיכר", "ככר"]
TITLES = ["הרב", "רב", 'ד"ר', "דר", "פרופ", "פרופסור", "הרבי"]
LEAST_LIKENESS, TOUCH_M = 0.82, 50.0
_PARTS = r"[,/|]|(?<![\p{L}\p{N}_])(?:(?:פינת|פינה|מול|ליד)(?![\p{L}\p{N}_])|בין(?![\p{L}\p{N}_])(?=.*(?<![\p{L}\p{N}_])ל))"


def norm(name: Column) -> Column:
    """The form in which names are compared: no quotes, dots and dashes, single spaces, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.translate(name, "\"'״׳`,.-", ""), r"\s+", " ")))


def without_prefix(n: Column) -> Column:
    """A normal name without a one-letter prefix, or null if it has none or is too short."""
    return F.when((F.length(n) >= 3) & F.contains(F.lit(PREFIXES), F.substring(n, 1, 1)), F.substring(n, 2, 1 << 20))


def without_road_type(n: Column) -> Column:
    """A normal name without the words for a road that lead it, or null if none does."""
    bare = F.regexp_replace(n, rf"^(?:(?:{'|'.join(ROAD_TYPES)})\s)+(?=\S)", "")
    return F.when(bare != n, bare)


def pool_key(name: Column) -> Column:
    """The sorted words of a name without words for a road and titles: the same for all spellings of one road."""
    words = F.split(F.coalesce(without_road_type(norm(name)), norm(name)), " ")
    plain = F.filter(words, lambda w: ~w.isin(*TITLES))
    return F.array_join(F.array_sort(F.when(F.size(plain) > 0, plain).otherwise(words)), " ")


def _runs(n: Column, most: int = 3) -> Column:
    """All runs of up to ``most`` words of a normal name: struct<size, place, run, whole>."""
    words = F.split(n, " ")
    of_size = lambda size: F.when(
        F.size(words) >= size,
        F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.struct(F.lit(size).alias("size"), i.alias("place"), F.array_join(F.slice(words, i + 1, F.lit(size)), " ").alias("run"), (F.size(words) == size).alias("whole"))),
    )
    return F.flatten(F.filter(F.array(*(of_size(s) for s in range(most, 0, -1))), lambda r: r.isNotNull()))


def keys_of(streets: DataFrame, pools: DataFrame | None = None) -> DataFrame:
    """(kind, key, street): what a token may be known by, from ``streets`` (name).

    ``index`` has names and, where no name is the same, names without a prefix; ``own`` has names alone; ``run`` has
    runs of words of one street only, or of streets in one pool (name, main), which gives its main name. Of equal
    names the first in order counts.
    """
    names = streets.select(F.col("name").alias("street"), norm(F.col("name")).alias("key")).where("key <> ''").groupBy("key").agg(F.min("street").alias("street"))
    bare = names.select(without_prefix(F.col("key")).alias("key"), "street").where("key <> ''").groupBy("key").agg(F.min("street").alias("street"))
    index = names.unionByName(bare.join(names.select("key"), "key", "left_anti"))
    runs = index.select("street", F.explode(_runs(F.col("key"))).alias("r")).select("street", F.col("r.run").alias("key")).distinct()
    if pools is not None:
        main = pools.select(F.col("name").alias("street"), F.col("main"))
        runs = runs.join(main, "street", "left").select("key", F.coalesce("main", "street").alias("street"), "street")
        runs = runs.toDF("key", "main", "street").groupBy("key").agg(F.min("main").alias("main"), F.count_distinct("main").alias("n"), F.count("*").alias("streets"), F.min("street").alias("street"))
        runs = runs.where("n = 1").select("key", F.when(F.col("streets") > 1, F.col("main")).otherwise(F.col("street")).alias("street"))
    else:
        runs = runs.groupBy("key").agg(F.min("street").alias("street"), F.count("*").alias("n")).where("n = 1").drop("n")
    kinds = (("index", index), ("own", names), ("run", runs))
    first, *rest = (df.select(F.lit(kind).alias("kind"), "key", "street") for kind, df in kinds)
    for df in rest:
        first = first.unionByName(df)
    return first


def _tries(n: Column) -> Column:
    """The keys to try for a normal token in order: array<struct<rank, kind, key, how>>."""
    bare = without_prefix(n)
    one = lambda rank, kind, key, how: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), key.alias("key"), F.lit(how).alias("how"))
    start = [one(1, "index", n, "exact"), one(2, "index", bare, "prefix"), one(3, "own", without_road_type(n), "prefix")]
    start += [one(4, "run", F.when(F.length(n) >= 3, n), "word"), one(5, "run", F.when(F.length(bare) >= 3, bare), "word")]

    def inner(base: Column, rank: int) -> Column:
        long = F.filter(_runs(base), lambda r: ~r["whole"] & (F.length(r["run"]) >= 4))
        kind = lambda r: F.when(r["size"] == 1, "own").otherwise("run")
        return F.transform(long, lambda r: F.struct((rank + 300 * (3 - r["size"]) + r["place"]).alias("rank"), kind(r).alias("kind"), r["run"].alias("key"), F.lit("word").alias("how")))

    return F.concat(F.array(*start), inner(n, 10), F.when(bare.isNotNull(), inner(bare, 2000)).otherwise(F.array().cast("array<struct<rank:int,kind:string,key:string,how:string>>")))


def canonical(tokens: DataFrame, streets: DataFrame, pools: DataFrame | None = None, likeness: float | None = LEAST_LIKENESS) -> DataFrame:
    """(token, street, how) for each distinct token (token) that names a street (name); how is exact, prefix, word or fuzzy.

    Tokens of less than two characters name none. ``likeness`` null leaves the last try out.
    """
    known = keys_of(streets, pools)
    asked = tokens.select("token").where("token is not null").distinct().withColumn("n", norm(F.col("token"))).where(F.length("n") >= 2)
    tries = asked.select("token", F.explode(_tries(F.col("n"))).alias("t")).select("token", "t.*").where("key is not null")
    found = tries.join(known, ["kind", "key"]).groupBy("token").agg(F.min(F.struct("rank", "street", "how")).alias("b")).select("token", "b.street", "b.how")
    if likeness is None:
        return found
    return found.unionByName(_alike(asked.join(found, "token", "left_anti"), known.where("kind = 'index'"), likeness))


def _numbered_pairs(name: Column) -> Column:
    """All pairs of neighbouring letters of a name, each with how often it stood before: equal pairs are told apart."""
    pair = lambda i: F.substring(name, i, F.lit(2))
    before = lambda i: F.size(F.filter(F.sequence(F.lit(1), i), lambda j: pair(j) == pair(i)))
    return F.when(F.length(name) >= 2, F.transform(F.sequence(F.lit(1), F.length(name) - 1), lambda i: F.concat(pair(i), before(i).cast("string"))))


def _ratios(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The share of letters in matching blocks, as difflib counts them, of each (form, key)."""
    import difflib

    for frame in frames:
        ratio = [difflib.SequenceMatcher(None, key, form).ratio() for form, key in zip(frame["form"], frame["key"], strict=True)]
        yield frame.assign(ratio=ratio)


def _alike(asked: DataFrame, index: DataFrame, least: float) -> DataFrame:
    """The street whose key is most like a token by matching blocks, if it is like enough; a token as it is before one without its prefix.

    Of a pair of lengths that add up to s, at least m = ceil(least s / 2) letters match, in at most s - 2m + 1 blocks, so
    3m - s - 1 pairs of neighbouring letters are common; for 0.8 and more that is one at least. Names and tokens meet
    on such pairs, and only those that have enough of them are compared. Any number of names will do.
    """
    if least < 0.8:
        raise ValueError("likeness below 0.8 is not bounded by common pairs of letters")
    forms = asked.select("token", F.posexplode(F.array("n", without_prefix(F.col("n")))).alias("place", "form")).where("form is not null")
    sought = forms.select("*", F.explode(_numbered_pairs(F.col("form"))).alias("pair"))
    known = index.select("key", "street").select("*", F.explode(_numbered_pairs(F.col("key"))).alias("pair"))
    total = F.length("form") + F.length("key")
    enough = F.ceil(F.lit(least) / 2 * total)
    possible = (F.least(F.length("form"), F.length("key")) >= enough) & (F.col("common") >= 3 * enough - total - 1)
    met = sought.join(known, "pair").where(F.least(F.length("form"), F.length("key")) >= enough)
    met = met.groupBy("token", "place", "form", "key", "street").agg(F.count("*").alias("common")).where(possible).drop("common")
    scored = met.mapInPandas(_ratios, "token string, place int, form string, key string, street string, ratio double").where(F.col("ratio") >= least)
    best = scored.groupBy("token").agg(F.max_by("street", F.struct(-F.col("place"), "ratio", "key")).alias("street"))
    return best.select("token", "street", F.lit("fuzzy").alias("how"))


def pools_of(vertices: DataFrame, touch: float = TOUCH_M) -> DataFrame:
    """(name, main): spellings of one road, from street ``vertices`` (name, lat, lon).

    Names of the same pool key are one road if a vertex of theirs lies within ``touch`` metres of the name with the
    most vertices (of equal ones the first). Only vertices in neighbouring cells of a grid are compared.
    """
    keyed = vertices.select("name", "lat", "lon", pool_key(F.col("name")).alias("pool"))
    count = keyed.groupBy("pool", "name").agg(F.count("*").alias("n"))
    order = Window.partitionBy("pool").orderBy(F.desc("n"), "name")
    ranked = count.withColumn("rank", F.row_number().over(order)).withColumn("names", F.count("*").over(Window.partitionBy("pool"))).where("names > 1")
    main, others = ranked.where("rank = 1").select("pool", F.col("name").alias("main")), ranked.where("rank > 1").select("pool", "name")
    size = touch / 111_320 * 2
    cell = lambda df: df.withColumn("i", F.floor(F.col("lat") / size)).withColumn("j", F.floor(F.col("lon") / size))
    near = F.explode(F.array(*(F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j")) for a in (-1, 0, 1) for b in (-1, 0, 1)))).alias("c")
    of_main = cell(keyed.join(main, "pool").where("name = main")).select("pool", "main", F.col("lat").alias("mlat"), F.col("lon").alias("mlon"), near).select("pool", "main", "mlat", "mlon", "c.i", "c.j")
    of_others = cell(keyed.join(others, ["pool", "name"])).select("pool", "name", "lat", "lon", "i", "j")
    apart = F.hypot((F.col("lat") - F.col("mlat")) * 111_320, (F.col("lon") - F.col("mlon")) * 111_320 * F.cos(F.radians("mlat")))
    touching = of_others.join(of_main, ["pool", "i", "j"]).where(apart <= touch).select("name", "main").distinct()
    return touching.unionByName(touching.select(F.col("main").alias("name"), "main").distinct())


def candidates(address: Column) -> Column:
    """The parts of an address that may be streets, in order: city, floors and entrances away, split, numbers away."""
    base = F.regexp_replace(F.regexp_replace(address, CITY, " "), TAIL, " ")
    clean = lambda p: F.trim(F.regexp_replace(F.translate(F.regexp_replace(p, NUMBERS, " "), '"\\/,', ""), r"\s+", " "))
    return F.array_distinct(F.filter(F.transform(F.split(base, _PARTS), clean), lambda p: F.length(p) >= 2))


def streets_of(addresses: DataFrame, streets: DataFrame, pools: DataFrame | None = None, likeness: float | None = LEAST_LIKENESS) -> DataFrame:
    """(address, street, how): of each distinct address the street of its first part that names one, exact names before others."""
    parts = addresses.select("address").where("address is not null").distinct()
    parts = parts.select("address", F.posexplode(candidates(F.col("address"))).alias("place", "token"))
    found = parts.join(canonical(parts, streets, pools, likeness), "token")
    best = F.min(F.struct((F.col("how") != "exact").alias("inexact"), "place", "street", "how"))
    return found.groupBy("address").agg(best.alias("b")).select("address", "b.street", "b.how")
