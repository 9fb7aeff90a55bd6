"""Judging the archive anew: which posts, what changes, and the table of listings after it, as a version that can be undone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestay.functions import addresses
from lodestay.functions import text as texts
from lodestay.operators.snapshots import Snapshots
from lodestay.operators.upserts import enrich

#: Verdicts that are listings; a post of any other one has none.
LISTED = ("MATCH", "NEEDS_DATA")


def selected(posts: DataFrame, least_score: int | None = None, only_imprecise: bool = False, only_bare_quarter: bool = False, only_merged: bool = False) -> DataFrame:
    """Posts (address, text, score, ...) worth judging anew: of a stored score, of a place that is no more than a street or a
    quarter, or of a text that runs on into a second post.

    A post without a score counts as 0, one without an address is never imprecise.
    """
    kept = posts
    if least_score is not None:
        kept = kept.where(F.coalesce("score", F.lit(0)) >= least_score)
    if only_imprecise or only_bare_quarter:
        vague = addresses.bare_quarter(F.col("address"))
        kept = kept.where(vague if only_bare_quarter else vague | addresses.bare_street(F.col("address")))
    return kept.where(texts.holds_another_story(F.col("text"))) if only_merged else kept


def judged(posts: DataFrame, classify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``posts`` (sig, verdict, score, ...) with new_verdict and new_score of today's rules; what ``classify`` gives no verdict is left out."""
    now = classify(posts).select("sig", F.col("verdict").alias("new_verdict"), F.col("score").alias("new_score"))
    return posts.join(now, "sig").where("new_verdict is not null")


def changed(rows: DataFrame) -> DataFrame:
    """(sig, verdict, score, new_verdict, new_score, change) of ``judged`` rows with another verdict or score.

    change is rescued (now a match), demoted (a listing no more) or changed.
    """
    differ = ~(F.col("verdict").eqNullSafe(F.col("new_verdict")) & F.col("score").eqNullSafe(F.col("new_score")))
    old, new = F.coalesce("verdict", F.lit("")), F.col("new_verdict")
    change = F.when((old != "MATCH") & (new == "MATCH"), "rescued").when(old.isin(*LISTED) & ~new.isin(*LISTED), "demoted").otherwise("changed")
    return rows.where(differ).select("sig", "verdict", "score", "new_verdict", "new_score", change.alias("change"))


def listings_after(listings: DataFrame, rows: DataFrame, key: str, overwrite: list[str], fill: list[str]) -> DataFrame:
    """The table of listings (key, overwrite, fill) after ``judged`` rows (dedup_key, dedup_keys, place, and those columns).

    Posts take effect in the order of ``place``: one that is a listing saves its key, any other deletes all its keys, also
    those that earlier posts saved. What is saved after a key's last deletion makes its row: ``overwrite``
    columns of the last post, ``fill`` ones of the last that has them. A key that no post names stays as it is.
    """
    is_listing = F.col("new_verdict").isin(*LISTED)
    gone = rows.where(~is_listing).select("place", F.explode("dedup_keys").alias(key)).groupBy(key).agg(F.max("place").alias("_gone"))
    saved = rows.where(is_listing & F.col("dedup_key").isNotNull()).withColumn(key, F.col("dedup_key"))
    alive = saved.join(gone, key, "left").where("_gone is null or place > _gone")
    last = [F.max_by(c, "place").alias(c) for c in overwrite]
    known = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("place"))).alias(c) for c in fill]
    return enrich(listings.join(gone.select(key), key, "left_anti"), alive.groupBy(key).agg(*last, *known), key, overwrite, fill)


def apply(table: Snapshots, rows: DataFrame, key: str, overwrite: list[str], fill: list[str]) -> dict[str, int]:
    """Make ``listings_after`` the next version of ``table``; returns it with the number of posts rescued, demoted and changed.

    ``table.undo()`` takes it back.
    """
    version = table.commit(listings_after(table.read(), rows, key, overwrite, fill), "replay")
    counts = {r.change: r["count"] for r in changed(rows).groupBy("change").count().collect()}
    return {"version": version, **{c: counts.get(c, 0) for c in ("rescued", "demoted", "changed")}}
