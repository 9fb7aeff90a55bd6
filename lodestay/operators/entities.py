"""Entity resolution: clusters of rows that share contacts, carried votes, pruned orphans and merged sightings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestay.operators.graph import components
from lodestay.operators.tiles import shares
from lodestay.storage import Scratch


def shared_contact_clusters(rows: DataFrame, key: str, address: str, contact: str) -> DataFrame:
    """(key, cluster) of rows (key, address, contact), one line for each contact of a row.

    Rows of one address that share a contact, directly or through others, are one cluster, named by its smallest
    key; a row whose contacts are all null stands alone. Each row is linked to the smallest key of each of its
    contacts, and the links' components are found in a number of steps that grows with the logarithm of the longest
    chain. The rows are written once and dealt into shares of a bounded number, so that a task's memory does not grow
    with them; a contact of very many rows is sorted by one task, which Spark spills, and none is gathered.
    """
    with Scratch(rows.sparkSession) as scratch:
        rows = scratch.write(rows.select(F.col(key).alias("k"), F.col(address).alias("a"), F.col(contact).alias("c")), "rows")
        n = shares(rows)
        ties = rows.where("k is not null and a is not null and c is not null").repartition(n, "a", "c")
        least = ties.groupBy("a", "c").agg(F.min("k").alias("first"), F.max("k").alias("last")).where("first < last").drop("last")
        edges = scratch.write(ties.join(least, ["a", "c"]).where("k <> first").select("k", "first").distinct(), "ties")
        linked = components(edges, "k", "first", scratch).withColumnRenamed("id", "k").repartition(n, "k")
        found = rows.select("k").repartition(n, "k").distinct().join(linked, "k", "left")
        return scratch.keep(found.select(F.col("k").alias(key), F.coalesce("component", "k").alias("cluster")), "clusters")


def prune_orphans(rows: DataFrame, group: str, reachable: Column, order: list[Column]) -> DataFrame:
    """Drop rows that are not reachable, but never the last row of a group.

    Of a group without any reachable row, the first by ``order`` (which should decide all ties) stays.
    """
    whole = Window.partitionBy(group)
    marked = rows.withColumn("_ok", F.coalesce(reachable, F.lit(False)))
    marked = marked.withColumn("_any", F.max("_ok").over(whole)).withColumn("_n", F.row_number().over(whole.orderBy(*order)))
    return marked.where("_ok or (not _any and _n = 1)").drop("_ok", "_any", "_n")


def rekey(votes: DataFrame, mapping: DataFrame, key: str, voter: str, ts: str) -> DataFrame:
    """Votes (key, voter, ts, ...) under their new keys by ``mapping`` (old, new); the first of a voter stays.

    Keys that ``mapping`` lacks stay as they are.
    """
    moved = votes.join(mapping, votes[key] == mapping["old"], "left").withColumn(key, F.coalesce("new", key)).drop("old", "new")
    order = [F.col(ts).asc_nulls_last(), *(F.col(c).asc_nulls_last() for c in moved.columns if c not in (key, voter, ts))]
    return moved.withColumn("_n", F.row_number().over(Window.partitionBy(key, voter).orderBy(*order))).where("_n = 1").drop("_n")


def merge_sightings(rows: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """One row per key: its longest text (of equals the first by ``order``), its first sighting and their number."""
    longest = F.max_by(text, F.struct(F.coalesce(F.length(text), F.lit(-1)), -F.col(order)))
    return rows.groupBy(key).agg(longest.alias(text), F.min(order).alias("first"), F.count("*").alias("sightings"))


def successor(listings: DataFrame, key: str, phone: str, score: str) -> DataFrame:
    """(key, successor): of the other rows with the same phone that of the highest score, ties to the smallest key.

    Only the best two rows of each phone can be an answer, so no row is joined with all the others of its phone.
    """
    order = Window.partitionBy(phone).orderBy(F.col(score).desc_nulls_last(), F.col(key))
    best = listings.where(F.col(phone).isNotNull()).select(phone, F.col(key).alias("s"), F.row_number().over(order).alias("n")).where("n <= 2")
    two = best.groupBy(phone).agg(F.max(F.when(F.col("n") == 1, F.col("s"))).alias("one"), F.max(F.when(F.col("n") == 2, F.col("s"))).alias("two"))
    return listings.select(key, phone).join(two, phone).select(key, F.when(F.col("one") != F.col(key), F.col("one")).otherwise(F.col("two")).alias("successor"))
