"""Posts written by a small grammar, another text for each row of ``part``, so that SQL computes every answer from the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestay.functions import facts
from lodestay.operators.tiles import width
from lodestay.plans.registry import load, query

STREETS = ["רגר", "בזל", "הבשור", "רינגלבלום", "האבות"]
#: More characters than a price may be away from its marker, without any number.
_GAP = " ועוד כמה מלים שאין בהן שום מספר כלל "


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def written_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, text, comments, price, rooms, mates, address, lease, contact): facts are in the texts alone, in many ways of writing."""
    p = F.col("p_partkey").cast("long")
    text = lambda c: c.cast("string")
    price = 500 + p * 37 % 2400
    number = F.when((p % 5 == 0) & (price >= 1000), F.concat(text(F.floor(price / 1000)), F.lit(","), F.lpad(text(price % 1000), 3, "0"))).otherwise(text(price))
    marker = _pick(facts.PRICE_MARKERS, p % 9)
    asked = F.when(p % 11 == 0, "המחיר ידוע").when(p % 2 == 0, F.concat(marker, F.lit(" "), number)).otherwise(F.concat(number, F.lit(" "), marker))
    rooms = (
        F.when(p % 4 == 0, F.concat(F.lit("מתפנים "), text(1 + p % 3), F.lit(" חדרים")))
        .when(p % 4 == 1, F.concat(F.lit("מתפנות "), F.when(p % 8 == 1, "שני").otherwise("שלושה"), F.lit(" חדרים")))
        .when(p % 4 == 2, "מחפשים שותפה")
        .otherwise("דירה יפה")
    )
    street = _pick(STREETS, p % 5)
    place = F.when(p % 3 == 0, F.concat(F.lit("ברחוב "), street, F.lit("  "), text(1 + p % 150))).otherwise(F.concat(F.lit("ליד "), street))
    walk = F.when(p % 6 == 0, "לא רחוק").otherwise(F.concat(text(3 + p % 25), F.lit(" דקות הליכה")))
    address = F.when(p % 13 == 0, F.concat(street, F.lit(" 7"))).when(p % 2 == 0, street).otherwise(F.concat(F.lit("רחוב "), street))
    local = F.lpad(text(p * 7919 % 10**7), 7, "0")
    mobile, tail = F.concat(F.lit("05"), text(p % 10)), F.concat(F.substring(local, 1, 3), F.lit(" "), F.substring(local, 4, 4))
    contact = (
        F.when(p % 5 == 0, F.concat(mobile, F.lit("-"), local))
        .when(p % 5 == 1, F.concat(F.lit("+972 5"), text(p % 10), F.lit(" "), tail))
        .when(p % 5 == 2, F.concat(mobile, local, F.lit(" / "), mobile, F.lit("-"), local))
        .when(p % 5 == 3, "call me")
    )
    day, month = 1 + p % 28, 1 + p % 12
    lease = (
        F.when(p % 6 == 0, F.concat(text(day), F.lit("."), text(month)))
        .when(p % 6 == 1, F.concat(text(day), F.lit("/"), text(month), F.lit(" גמיש")))
        .when(p % 6 == 2, F.concat(text(day), F.lit("-"), text(month)))
        .when(p % 6 == 3, "מיידי")
        .when(p % 6 == 4, F.concat(text(day), F.lit(" ב"), _pick(facts.MONTHS, p % 12)))
    )
    whole = lambda kind: F.lit(None).cast(kind)
    # Keys are few bytes and posts much work: they are dealt to all tasks, whatever the table's files are.
    return load(spark, sf_dir, "part").select("p_partkey").repartition(width(spark)).select(
        "p_partkey", F.concat_ws(_GAP, asked, rooms, place, walk).alias("text"), F.lit(None).cast("string").alias("comments"), whole("double").alias("price"), whole("int").alias("rooms"),
        whole("int").alias("mates"), address.alias("address"), lease.alias("lease"), contact.alias("contact"),
    )


_STREET = "(['" + "', '".join(STREETS) + "'])[(p_partkey % 5 + 1)::INT]"


@query("varied_posts", f"""WITH a AS (SELECT p_partkey, CASE WHEN p_partkey % 11 <> 0 THEN 500 + p_partkey * 37 % 2400 END AS said,
         CASE p_partkey % 4 WHEN 0 THEN 1 + p_partkey % 3 WHEN 1 THEN CASE WHEN p_partkey % 8 = 1 THEN 2 ELSE 3 END WHEN 2 THEN 1 END AS rooms,
         '05' || (p_partkey % 10) || '-' || lpad((p_partkey * 7919 % 10000000)::VARCHAR, 7, '0') AS phone,
         lpad((1 + p_partkey % 28)::VARCHAR, 2, '0') || '.' || lpad((1 + p_partkey % 12)::VARCHAR, 2, '0') AS day,
         CASE WHEN p_partkey % 13 = 0 THEN {_STREET} || ' 7' ELSE CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'רחוב ' END || {_STREET} || CASE WHEN p_partkey % 3 = 0 THEN ' ' || (1 + p_partkey % 150) ELSE '' END END AS address FROM part),
       b AS (SELECT *, coalesce(said > 2000 AND rooms >= 2 AND round_even(said / rooms, 0) <= 2000, false) AS shared FROM a)
       SELECT p_partkey, (CASE WHEN shared THEN round_even(said / rooms, 0) ELSE said END)::DOUBLE AS price, rooms::INT AS rooms, said IS NOT NULL AS price_from_comment, shared AS price_is_derived, address,
       CASE p_partkey % 6 WHEN 1 THEN day || ', גמיש' WHEN 3 THEN 'מיידי' WHEN 5 THEN NULL ELSE day END AS lease, CASE WHEN p_partkey % 5 <= 2 THEN phone WHEN p_partkey % 5 = 3 THEN 'call me' END AS contact,
       p_partkey % 4 = 2 AS women, CASE WHEN p_partkey % 6 <> 0 THEN 3 + p_partkey % 25 END::INT AS claimed_walk, regexp_extract(address, '[0-9]+') AS number FROM b""")
def varied_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices with markers before and behind them, rooms in digits and words, numbers of houses, dates, phones and walks."""
    rows = facts.postprocess(written_posts(spark, sf_dir))
    said = [facts.seeks_women(F.col("text")).alias("women"), facts.claimed_walk(F.col("text")).alias("claimed_walk"), F.coalesce(facts.house_number(F.col("address")), F.lit("")).alias("number")]
    return rows.select("p_partkey", "price", "rooms", "price_from_comment", "price_is_derived", "address", "lease", "contact", *said)
