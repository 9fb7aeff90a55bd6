"""Posts made from a few texts, one for each row of ``part``: facts, keys, addresses, tiers, scores and verdicts.

The SQL states for each text what must come of it, so that rows are compared with known answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestay.functions import addresses, facts, text
from lodestay.operators import dedup, scoring, streets
from lodestay.operators.tiles import width
from lodestay.plans.registry import load, query

#: (text, comments, price, rooms, mates, address, lease, contact)
POSTS = [
    ("דירת 3 חדרים להשכרה 2,400 ₪ לחודש", None, None, None, None, "רגר 93, הבלוק", "15 בספטמבר", "052-3252255 / +972 54 337 6992"),
    ("מתפנים שני חדרים בדירה, מחיר: 1200", None, None, None, 2, "רחוב Rager רגר", "1.10 גמיש", "call me"),
    ("דירה 5000 ₪ 10 דקות הליכה", None, 5000.0, None, 4, "__ שכונה ב __", "מיידי", None),
    ("1500 לחודש לשותף", None, 4000.0, 2, 2, None, "בקרוב", ""),
    (None, "המחיר 900 שח", None, None, None, "", None, "0541234567"),
    ("מחפשים שותפה, 10-12 דקות הליכה", None, 1000.0, None, 3, "רחוב הבשור 19 (פינת סוסו הכהן), צמודה", "31.12, 40.1", "08-6461111"),
    ("למסירה ארון ישן", None, None, None, None, None, None, None),
    ("חדר פנוי בשכונה ד'", None, 1400.0, 2, 3, "שכונה ד'", "אוקטובר", "https://wa.me/972521112222"),
    ("דירה ליד האוניברסיטה", "1700 לחודש", None, 3, 3, "ליד האוניברסיטה", "13.13", "054-3376992, 052-3252255"),
    ("דירת 4 חדרים 3600 ש\"ח", None, 3600.0, None, None, "רגר 93 פינת שלמה המלך", "1/11 מיידי", "0543376992"),
]
_KEYS = "p_partkey"
_SCHEMA = "i int, text string, comments string, price double, rooms int, mates int, address string, lease string, contact string"


def made_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A post for each part, its text by the part's key."""
    texts = spark.createDataFrame([(i, *row) for i, row in enumerate(POSTS)], _SCHEMA)
    # Keys are few bytes and posts much work: they are dealt to all tasks, whatever the table's files are.
    keys = load(spark, sf_dir, "part").select("p_partkey").repartition(width(spark))
    return keys.withColumn("i", F.pmod("p_partkey", F.lit(len(POSTS))).cast("int")).join(F.broadcast(texts), "i")


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


def answers(columns: str, rows: list[tuple]) -> str:
    """SQL that gives each part the answers (with a type each, as ``name type``) of its text."""
    names = [c.split() for c in columns.split(", ")]
    picked = ", ".join(f"v.{n}::{t} AS {n}" for n, t in names)
    values = ", ".join("(" + ", ".join(map(_sql, (i, *row))) + ")" for i, row in enumerate(rows))
    return f"SELECT p_partkey, {picked} FROM part JOIN (VALUES {values}) v(i, {', '.join(n for n, _ in names)}) ON p_partkey % {len(rows)} = v.i"


FACTS = [
    (1200.0, 2, True, True, "רגר 93, הבלוק", "15.09", "052-3252255, 054-3376992"),
    (1200.0, 2, True, False, "רחוב רגר", "01.10, גמיש", "call me"),
    (1250.0, None, False, True, "שכונה ב", "מיידי", None),
    (4000.0, 2, False, False, None, "בקרוב", ""),
    (900.0, None, True, False, None, None, "054-1234567"),
    (1000.0, 1, False, False, "רחוב הבשור 19 (פינת סוסו הכהן), צמודה", "31.12", "08-6461111"),
    (None, None, False, False, None, None, None),
    (1400.0, 2, False, False, "שכונה ד", "01.10", "052-1112222"),
    (1700.0, 3, True, False, "ליד האוניברסיטה", "13.13", "054-3376992, 052-3252255"),
    (1200.0, 3, False, True, "רגר 93 פינת שלמה המלך", "01.11, מיידי", "054-3376992"),
]


@query("post_facts", answers("price DOUBLE, rooms INT, price_from_comment BOOLEAN, price_is_derived BOOLEAN, address VARCHAR, lease VARCHAR, contact VARCHAR", FACTS))
def post_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices, rooms, addresses, dates and phones mended."""
    return facts.postprocess(made_posts(spark, sf_dir)).select(_KEYS, "price", "rooms", "price_from_comment", "price_is_derived", "address", "lease", "contact")


@query("post_claims", answers("month INT, number VARCHAR, women BOOLEAN, bearing BOOLEAN, claimed_walk INT, quarter VARCHAR, keyword BOOLEAN, numbers INT", [
    (9, "93", False, False, None, None, True, 2), (10, None, False, False, None, None, True, 0), (None, None, False, False, 10, "ב", True, 0),
    (None, None, False, False, None, None, True, 0), (None, None, False, False, None, None, False, 1), (12, "19", True, False, 12, None, True, 1),
    (None, None, False, False, None, None, False, 0), (10, None, False, False, None, "ד", True, 1), (None, None, False, True, None, None, True, 2),
    (11, "93", False, False, None, None, True, 1),
]))
def post_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What texts claim: month, house number, flatmates, walk, quarter, and how many phones."""
    c = F.col
    return made_posts(spark, sf_dir).select(
        _KEYS, facts.month_of(c("lease")).alias("month"), facts.house_number(c("address")).alias("number"), facts.seeks_women(c("text")).alias("women"),
        addresses.only_bearing(c("address")).alias("bearing"), facts.claimed_walk(c("text")).alias("claimed_walk"),
        facts.quarter_letter(c("address")).alias("quarter"), facts.has_keyword(c("text")).alias("keyword"), F.size(facts.contact_numbers(c("contact"))).alias("numbers"),
    )


#: Streets of a made city; two names are spellings of one road.
STREETS = ["שדרות יצחק רגר", "הבשור", "שלמה המלך", "סוסו הכהן", "צבי קלישר", "קלישר הרב צבי", "רינגלבלום", "בזל", "האבות"]
POOLS = [("צבי קלישר", "צבי קלישר"), ("קלישר הרב צבי", "צבי קלישר")]
TOKENS = ["הבשור", "ברגר", "רחוב בזל", "רגר", "קלישר", "הרב סוסו הכהן", "רינגנבלום", "כיכר אבות", "מרכז", "x", "שלמה  המלך."]
FOUND = [
    ("הבשור", "exact"), ("שדרות יצחק רגר", "word"), ("בזל", "prefix"), ("שדרות יצחק רגר", "word"), ("צבי קלישר", "word"),
    ("סוסו הכהן", "word"), ("רינגלבלום", "fuzzy"), (None, None), (None, None), (None, None), ("שלמה המלך", "exact"),
]


def _city(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([(s,) for s in STREETS], "name string"), spark.createDataFrame(POOLS, "name string, main string")


def _token_answers() -> str:
    values = ", ".join(f"({i}, {_sql(t)}, {_sql(s)}, {_sql(h)})" for i, (t, (s, h)) in enumerate(zip(TOKENS, FOUND, strict=True)))
    return f"SELECT c_custkey, v.token, v.street::VARCHAR AS street, v.how::VARCHAR AS how FROM customer JOIN (VALUES {values}) v(i, token, street, how) ON c_custkey % {len(TOKENS)} = v.i"


@query("street_names", _token_answers())
def street_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messy street names of customers, solved once for each distinct one."""
    names, pools = _city(spark)
    tokens = spark.createDataFrame(list(enumerate(TOKENS)), "i int, token string")
    rows = load(spark, sf_dir, "customer").select("c_custkey", F.pmod("c_custkey", F.lit(len(TOKENS))).cast("int").alias("i")).join(F.broadcast(tokens), "i")
    return rows.join(streets.canonical(rows, names, pools), "token", "left").select("c_custkey", "token", "street", "how")


def keyed_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made posts with their street with and without the corner clause, and their keys."""
    names, pools = _city(spark)
    rows = facts.postprocess(made_posts(spark, sf_dir)).withColumn("plain", facts.without_corner(F.col("address")))
    found = streets.streets_of(rows.select(F.col("address")).union(rows.select("plain")), names, pools, likeness=None).select("address", "street")
    rows = rows.join(found.withColumnsRenamed({"address": "plain"}), "plain", "left")
    return dedup.with_keys(rows.join(found.withColumnRenamed("street", "corner_street"), "address", "left"))


def _hash(address: str, price: str, rooms: str, mates: str) -> str:
    import hashlib

    return "hash:" + hashlib.sha1(f"{address}|{price}|{rooms}|{mates}".encode()).hexdigest()[:16]


_REGER = "שדרות יצחק רגר|93"
KEYS = [
    ("phone:543376992|" + _REGER, " ".join(["phone:543376992|" + _REGER, "addr:" + _REGER, "phone:543376992|רגר 93, הבלוק", "addr:רגר 93, הבלוק"])),
    (_hash("רחוב רגר", "1200.0", "2", "2"), _hash("רחוב רגר", "1200.0", "2", "2")),
    (_hash("שכונה ב", "1250.0", "None", "4"), _hash("שכונה ב", "1250.0", "None", "4")),
    (_hash("None", "4000.0", "2", "2"), _hash("None", "4000.0", "2", "2")),
    ("phone:541234567", "phone:541234567"),
    ("phone:086461111|הבשור|19", " ".join(["phone:086461111|הבשור|19", "addr:הבשור|19", "phone:086461111|רחוב הבשור 19 (פינת סוסו הכהן), צמודה", "addr:רחוב הבשור 19 (פינת סוסו הכהן), צמודה"])),
    (_hash("None", "None", "None", "None"), _hash("None", "None", "None", "None")),
    ("phone:521112222", "phone:521112222"),
    ("phone:523252255", "phone:523252255"),
    ("phone:543376992|" + _REGER, " ".join(["phone:543376992|" + _REGER, "addr:" + _REGER, "phone:543376992|רגר 93 פינת שלמה המלך", "addr:רגר 93 פינת שלמה המלך", "phone:543376992|שלמה המלך|93", "addr:שלמה המלך|93"])),
]


@query("post_keys", answers("dedup_key VARCHAR, keys VARCHAR", KEYS))
def post_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys under which posts of one flat meet."""
    return keyed_posts(spark, sf_dir).select(_KEYS, "dedup_key", F.array_join("dedup_keys", " ").alias("keys"))


def judged_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made posts with made points, through the whole way from text to verdict."""
    i = F.col("i")
    rows = made_posts(spark, sf_dir).withColumns({
        "is_ad": i != 6, "inside": F.when(~i.isin(3, 4, 8), i.isin(0, 1, 9)), "walk_minutes": F.when(~i.isin(3, 4, 8), 5.0 + 3 * i),
        "geo_source": F.when(i.isin(0, 5, 9), "osm_addr").when(i.isin(1), "street_geom").when(i.isin(2, 7), "static_area"),
        "edge_metres": F.when(i == 5, 30.0).otherwise(500.0), "in_allowed": F.lit(True), "quarter": F.when(i == 0, "ב"), "age_hours": (i * 20).cast("double"),
        "furnished": i == 0, "balcony": i == 9, "floor": F.when(i == 1, "קומה שלישית"), "broker_listings": F.when(i == 9, 5).otherwise(0).cast("long"),
        "images": F.when(i == 0, F.array(F.lit("http://a"))),
    })
    return scoring.classify(rows)


VERDICTS = [
    ("GREEN", 85, 4, "MATCH", "in the zone"),
    ("AMBER", 71, 3, "MATCH", "near the zone"),
    ("AMBER", 45, 2, "DROP", "no address, only a quarter"),
    ("UNKNOWN", 36, 1, "DROP", "price 4000 > 2000"),
    ("UNKNOWN", 32, 1, "DROP", "no address and score 32 <= 50"),
    ("GREEN", 46, 2, "DROP", "only 1 rooms free"),
    ("RED", 7, 1, "NOT_AD", "not an advertisement"),
    ("RED", 37, 1, "DROP", "more than 20 min walk from a gate"),
    ("UNKNOWN", 42, 1, "DROP", "no address, only a bearing"),
    ("GREEN", 46, 2, "MATCH", "in the zone"),
]


@query("post_verdicts", answers("tier VARCHAR, score INT, stars INT, status VARCHAR, reason VARCHAR", VERDICTS))
def post_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way of a post: facts, tier, seventeen factors, gates and doubts."""
    return judged_posts(spark, sf_dir).select(_KEYS, "tier", "score", scoring.stars(F.col("score")).alias("stars"), "status", "reason")


_STEPS = ["keywords", "not seen", "advertisement", "address", "rooms", "located", "tier", "verdict", "alert"]
#: Steps passed (1) or not (0), in order, and the factors that weigh most.
TRACES = [
    ("111111111", "zone +25, walk +25, price +25, comment price -3, derived price -3"), ("111111110", "walk +25, price +25, rooms +15, floor -6, comment price -3"),
    ("111101100", "price +22, walk +20, zone +10, derived price -3"), ("111010000", "rooms +15, mates +15, walk +13"), ("011000000", "price +25, walk +13, mates +5, comment price -3"),
    ("111111100", "zone +25, price +25, mates +10, women -15"), ("010001000", "price +10, mates +5, no price -6"), ("111111000", "price +22, rooms +10, mates +10"),
    ("111110000", "price +18, rooms +15, walk +13, comment price -3"), ("111111110", "zone +25, price +25, balcony +18, fresh -12, broker -12"),
]


def _steps(passed: str) -> str:
    return " ".join(f"{name}={'true' if ok == '1' else 'false'}" for name, ok in zip(_STEPS, passed, strict=True))


@query("post_traces", answers("steps VARCHAR, factors VARCHAR", [(_steps(passed), why) for passed, why in TRACES]))
def post_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every gate of every post, and the factors that weigh most."""
    rows = scoring.trace(judged_posts(spark, sf_dir))
    steps = F.array_join(F.transform("trace", lambda s: F.concat_ws("=", s["step"], s["ok"].cast("string"))), " ")
    return rows.select(_KEYS, steps.alias("steps"), scoring.explain(scoring.top_factors(F.col("why"))).alias("factors"))


@query("post_signatures", """SELECT doc_id, 'text:' || substr(sha1(substr(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), 1, 150)), 1, 16) AS sig,
       list_sort(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '\\p{L}{12,}'))) AS long_words FROM documents WHERE text IS NOT NULL""")
def post_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures and long words of documents, in any script."""
    docs = load(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", text.signature(F.col("text")).alias("sig"), text.tokens(F.col("text"), 12).alias("long_words"))
