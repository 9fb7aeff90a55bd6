"""Keys under which posts of one flat meet, the order of duplicate tests, and the merging of rows of one flat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestay.functions import facts, text
from lodestay.operators.entities import shared_contact_clusters


def legacy_address(address: Column) -> Column:
    """A numbered address without quotes, single-spaced, in lower case; null without a digit."""
    plain = F.lower(F.trim(F.regexp_replace(F.translate(address, "״׳'`\"‘’“”", ""), r"\s+", " ")))
    return F.when(F.regexp_like(address, F.lit("[0-9]")), F.nullif(plain, F.lit("")))


def address_identity(address: Column, street: Column) -> Column:
    """``street|number`` of a numbered address whose street is known, else its legacy form."""
    number = facts.house_number(address)
    return F.when(legacy_address(address).isNotNull(), F.coalesce(F.lower(F.concat(street, F.lit("|"), number)), legacy_address(address)))


def content_key(address: Column, price: Column, rooms: Column, mates: Column) -> Column:
    """A hash of what a post says; what it does not say is written None."""
    said = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    basis = F.concat_ws("|", *(said(c) for c in (address, price, rooms, mates)))
    return F.concat(F.lit("hash:"), F.substring(F.sha1(basis.cast("binary")), 1, 16))


def primary_key(contact: Column, identity: Column, content: Column) -> Column:
    """Phone and numbered address, else the phone, else the content hash."""
    phone = text.phone_key(contact)
    return F.coalesce(F.concat(phone, F.lit("|"), identity), phone, content)


def with_keys(posts: DataFrame) -> DataFrame:
    """Add ``dedup_key`` and ``dedup_keys`` to posts (address, price, rooms, mates, contact, street, corner_street).

    street is the canonical street of the address without its corner clause, corner_street the one of the whole
    address; both may be null. The keys are the primary one, the address's, and those of older forms.
    """
    c = F.col
    phone = text.phone_key(c("contact"))
    plain = facts.without_corner(c("address"))
    identity = F.when(legacy_address(c("address")).isNotNull(), F.coalesce(F.lower(F.concat("street", F.lit("|"), facts.house_number(plain))), legacy_address(c("address"))))
    older = [legacy_address(c("address")), address_identity(c("address"), c("corner_street"))]
    content = content_key(c("address"), c("price"), c("rooms"), c("mates"))
    rows = posts.withColumn("dedup_key", primary_key(c("contact"), identity, content))
    under = lambda a: [F.concat(phone, F.lit("|"), a), F.concat(F.lit("addr:"), a)]
    keys = F.array("dedup_key", F.concat(F.lit("addr:"), identity), *under(older[0]), *under(older[1]))
    return rows.withColumn("dedup_keys", F.array_distinct(F.filter(keys, lambda k: k.isNotNull())))


def group_key(key: Column, address: Column) -> Column:
    """Rows of one numbered address have one group; others are groups by themselves."""
    return F.coalesce(F.concat(F.lit("addr:"), legacy_address(address)), key)


def short_tokens(keys: DataFrame, key: str, least: int = 12) -> DataFrame:
    """(key, token): the first ``least`` hex digits of a hash, more where two keys would have the same."""
    hashed = keys.select(key).distinct().withColumn("h", F.sha2(F.col(key).cast("binary"), 256))
    alike = F.count("*").over(Window.partitionBy(F.substring("h", 1, least)))
    return hashed.select(key, F.when(alike == 1, F.substring("h", 1, least)).otherwise(F.col("h")).alias("token"))


def known_posts(posts: DataFrame, seen: DataFrame, id: str) -> DataFrame:
    """Ids of ``posts`` (id, dedup_keys, contact, address) that ``seen`` (key) knows.

    Either one of their keys is there or, for an address without a number, any key of their phone.
    """
    exact = posts.select(id, F.explode("dedup_keys").alias("key")).join(seen, "key", "left_semi").select(id)
    phone = F.when(legacy_address(F.col("address")).isNull(), text.phone_key(F.col("contact")))
    of_phone = seen.select(F.regexp_extract("key", r"^(phone:[0-9]+)(?:\||$)", 1).alias("phone")).where("phone <> ''").distinct()
    vague = posts.select(id, phone.alias("phone")).where("phone is not null").join(of_phone, "phone", "left_semi").select(id)
    return exact.unionByName(vague).distinct()


def first_reason(posts: DataFrame, seen_urls: DataFrame, seen_texts: DataFrame, similar: DataFrame, id: str) -> DataFrame:
    """(id, status, reason) of posts (id, url, text, images) that need no reading, by the first test that says so.

    In this order: the url is in ``seen_urls`` (url), no keyword, the text's signature is in ``seen_texts`` (sig), the
    id is in ``similar`` (id, of). Pictures of texts are spared the tests of words and signatures.
    """
    rows = posts.withColumn("sig", text.signature(F.coalesce("text", F.lit(""))))
    mark = lambda df, key, name: df.select(key).distinct().withColumn(name, F.lit(True))
    rows = rows.join(mark(seen_urls, "url", "by_url"), "url", "left").join(mark(seen_texts, "sig", "by_text"), "sig", "left")
    rows = rows.join(similar.groupBy(id).agg(F.min("of").alias("of")), id, "left")
    picture = facts.is_picture(F.col("text"), F.col("images"))
    no_word, same_text = ~facts.has_keyword(F.col("text")) & ~picture, F.coalesce("by_text", F.lit(False)) & ~picture
    of = F.concat(F.lit("repost of "), F.col("of").cast("string"))
    cases = [(F.col("by_url"), "DROP", F.lit("already seen (url)")), (no_word, "NOT_AD", F.lit("no keyword")), (same_text, "DROP", F.lit("already seen (text)")), (F.col("of").isNotNull(), "DROP", of)]
    status, reason = F, F
    for test, name, why in cases:
        status, reason = status.when(test, name), reason.when(test, why)
    return rows.select(id, status.alias("status"), reason.alias("reason")).where("status is not null")


def richness(price: Column, rooms: Column, mates: Column, contact: Column, key: Column, score: Column) -> Column:
    """What decides which of equal rows stays: known facts, then a phone in the key, then the score."""
    known = sum((x.isNotNull().cast("int") for x in (price, rooms, mates, contact)), F.lit(0))
    return F.struct(known.alias("known"), key.startswith("phone:").alias("by_phone"), F.coalesce(score, F.lit(0)).alias("score"))


def landlords(rows: DataFrame) -> DataFrame:
    """(key, cluster) of listings (key, address_group, contact, price) of one address each.

    Rows that share a number are one landlord's. A row without a number joins the landlord of its address if there is
    one only and no row of theirs states another price; else it stands alone. A null address_group stands alone.
    """
    numbers = rows.select("key", "address_group", "price", facts.contact_numbers(F.col("contact")).alias("numbers"))
    exploded = numbers.select("key", "address_group", F.explode_outer("numbers").alias("number"))
    found = shared_contact_clusters(exploded, "key", "address_group", "number").join(numbers, "key")
    called = found.where("size(numbers) > 0")
    sole = called.groupBy("address_group").agg(F.min("cluster").alias("sole"), F.max("cluster").alias("other"), F.min("price").alias("low"), F.max("price").alias("high")).where("sole = other")
    joined = found.join(sole.select("address_group", "sole", "low", "high"), "address_group", "left")
    agrees = F.col("price").isNull() | F.col("low").isNull() | ((F.col("low") == F.col("price")) & (F.col("high") == F.col("price")))
    joins = (F.size("numbers") == 0) & F.col("sole").isNotNull() & agrees
    return joined.select("key", F.when(joins, F.col("sole")).otherwise(F.col("cluster")).alias("cluster"))


def merge_duplicates(listings: DataFrame, multi_unit: DataFrame) -> DataFrame:
    """(key, keeper) of listings (key, address, street, price, rooms, mates, contact, score): the row that stays for each.

    Rows of one numbered address and one landlord are one flat, unless the address is in ``multi_unit`` (address_group);
    the richest stays, of equal ones the first key. A row without a number then goes to the only numbered row that has
    one of its phones, its price and its rooms.
    """
    identity = address_identity(F.col("address"), F.col("street"))
    rows = listings.withColumn("address_group", F.concat(F.lit("addr:"), identity))
    single = rows.where("address_group is not null").join(multi_unit.select("address_group").distinct(), "address_group", "left_anti")
    clusters = landlords(single.select("key", "address_group", "contact", "price"))
    rich = richness(*(F.col(x) for x in ("price", "rooms", "mates", "contact", "key", "score")))
    best = single.join(clusters, "key").withColumn("rich", rich)
    order = Window.partitionBy("cluster").orderBy(F.desc("rich"), "key")
    keepers = best.select("key", F.first("key").over(order).alias("keeper"))

    numbered = rows.where("address_group is not null").select(F.col("key").alias("numbered"), "price", "rooms", F.explode(facts.contact_numbers(F.col("contact"))).alias("number"))
    vague = rows.where("address_group is null and price is not null and rooms is not null")
    vague = vague.select("key", "price", "rooms", F.explode(facts.contact_numbers(F.col("contact"))).alias("number"))
    fits = vague.join(numbered, ["number", "price", "rooms"]).groupBy("key").agg(F.min("numbered").alias("one"), F.max("numbered").alias("other")).where("one = other")
    moved = fits.select("key", F.col("one").alias("numbered")).join(keepers.withColumnRenamed("key", "numbered"), "numbered", "left")
    moved = moved.select("key", F.coalesce("keeper", "numbered").alias("absorbed"))
    found = rows.select("key").join(keepers, "key", "left").join(moved, "key", "left")
    return found.select("key", F.coalesce("absorbed", "keeper", "key").alias("keeper"))


def merge_sightings(posts: DataFrame, key: str) -> DataFrame:
    """One row per key of posts (key, text, comments, images, url, age_hours, at): the longest text and comments, the most
    images, and the first url and age that is known, by ``at``."""
    longest = lambda c: F.max_by(c, F.struct(F.coalesce(F.length(c), F.lit(-1)), -F.unix_micros("at"))).alias(c)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    most = F.max_by("images", F.struct(F.coalesce(F.size("images"), F.lit(-1)), -F.unix_micros("at"))).alias("images")
    return posts.groupBy(key).agg(longest("text"), longest("comments"), most, first("url"), first("age_hours"), F.count("*").alias("sightings"))
