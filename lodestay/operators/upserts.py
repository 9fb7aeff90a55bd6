"""Upserts and deletes on tables without MERGE: joins that give the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def enrich(old: DataFrame, new: DataFrame, key: str, overwrite: list[str], fill: list[str], fill_json: list[str] = ()) -> DataFrame:
    """Rows of both; of a key in both, ``overwrite`` columns come from ``new``, ``fill`` ones keep what ``new`` lacks.

    ``fill_json`` columns hold JSON, where an empty list, object or text is no more than null.
    """
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    in_new = F.col(f"b.{key}").isNotNull()
    filled = lambda c: F.when(~F.trim(F.col(f"b.{c}")).isin("", "[]", "{}"), F.col(f"b.{c}"))
    columns = [F.coalesce(F.col(f"b.{key}"), F.col(f"a.{key}")).alias(key)]
    columns += [F.when(in_new, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in overwrite]
    columns += [F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in fill]
    columns += [F.coalesce(filled(c), F.col(f"a.{c}")).alias(c) for c in fill_json]
    return both.select(*columns)


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, one of each key, that ``old`` does not have: what an insert-or-ignore appends."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")


def replace(old: DataFrame, new: DataFrame, key: str, ts: str) -> DataFrame:
    """Rows of both, of each key the last by ``ts``; at one time that of ``new``, then the greatest."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    columns = [c for c in rows.columns if c not in ("_new", key, ts)]
    order = [F.desc(ts), F.desc("_new"), *(F.desc_nulls_last(c) for c in columns)]
    return first_per_key(rows, [key], order).drop("_new")


def last_note(events: DataFrame, key: str, text: str, ts: str) -> DataFrame:
    """The last text of each key, where an empty or null one deletes it."""
    last = first_per_key(events, [key], [F.desc(ts), F.desc_nulls_last(text)])
    return last.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "")


def backfill(rows: DataFrame, facts: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``rows`` whose empty ``columns`` are filled from ``facts`` (key, columns), of which each key has one row."""
    named = facts.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    return rows.join(named, key, "left").withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(*(f"_{c}" for c in columns))


def merge_without_erasing(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) after a refresh: a value that came out empty or null leaves the old one."""
    named = new.select(key, F.when(F.size(value) > 0, F.col(value)).alias("_new"))
    return old.select(key, value).join(named, key, "full").select(key, F.coalesce("_new", value).alias(value))


def guarded_write(new: DataFrame, old_rows: int, path: str, least: int = 20) -> None:
    """Write ``new`` in place of a table of ``old_rows`` rows, unless that had more than ``least`` and would lose half of them."""
    rows = new.count()
    if old_rows > least and rows < old_rows / 2:
        raise ValueError(f"{rows} rows instead of {old_rows}: not written")
    new.write.mode("overwrite").parquet(path)


def newest(versions: DataFrame, name: str, keep: int) -> DataFrame:
    """(name, kept): which of the named versions stay when the ``keep`` newest by name do."""
    last = versions.select(name).distinct().orderBy(F.desc(name)).limit(keep)
    return versions.select(name).distinct().join(last.withColumn("kept", F.lit(True)), name, "left").select(name, F.coalesce("kept", F.lit(False)).alias("kept"))


def delete_with_rescue(rows: DataFrame, votes: DataFrame, dead: DataFrame, successors: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` without the ``dead`` keys, and ``votes`` (key, voter, ...) under the successors (key, successor) of those.

    A vote whose key has no successor stays as it is; of a voter's votes on one key that which was there first wins.
    """
    left = rows.join(dead.select(key), key, "left_anti")
    heir = dead.select(key).join(successors, key, "left").where("successor is not null").select(F.col(key).alias("_dead"), "successor")
    moved = votes.join(heir, votes[key] == heir["_dead"], "left").withColumn("_moved", F.col("successor").isNotNull())
    moved = moved.withColumn(key, F.coalesce("successor", key)).drop("successor", "_dead")
    rest = [c for c in moved.columns if c not in (key, "voter", "_moved")]
    return left, first_per_key(moved, [key, "voter"], [F.col("_moved"), *(F.asc_nulls_last(c) for c in rest)]).drop("_moved")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``, which should decide all ties."""
    numbered = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.where("_n = 1").drop("_n")


def earlier_time(old: Column, new: Column, seen: Column) -> Column:
    """The earlier of two times; a new one after the first sighting is refused, not clamped."""
    return F.least(old, F.when(new <= seen, new))


def retire(df: DataFrame, when: Column, columns: list[str]) -> DataFrame:
    """Blank ``columns`` of the rows that ``when`` holds for; keys and verdicts stay."""
    return df.withColumns({c: F.when(~F.coalesce(when, F.lit(False)), F.col(c)) for c in columns})
