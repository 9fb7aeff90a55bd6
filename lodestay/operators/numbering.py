"""Consecutive numbers and running totals over a whole table, in two passes and without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestay.storage import Scratch

#: ``monotonically_increasing_id`` counts the rows of a partition in its lower bits and partitions above them.
_ROW_BITS = 33


def _ranged(rows: DataFrame, order: list[str | Column], scratch: Scratch) -> DataFrame:
    """``rows`` in ranges of ``order``, written with _range and _row, the place inside it."""
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    held = scratch.write(sorted_rows.withColumn("_place", F.monotonically_increasing_id()), "ordered")
    inside = F.col("_place").bitwiseAND((1 << _ROW_BITS) - 1)
    return held.withColumns({"_range": F.shiftright("_place", _ROW_BITS), "_row": inside}).drop("_place")


def _with_offsets(held: DataFrame, amount: Column) -> DataFrame:
    """``held`` with _before: what the ranges before a row's add up to. There is one row per range: as many as a shuffle has partitions."""
    sizes = held.groupBy("_range").agg(F.sum(amount).alias("_amount"))
    before = F.sum("_amount").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    return held.join(F.broadcast(sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))), "_range")


def numbered(rows: DataFrame, order: list[str | Column], name: str, scratch: Scratch) -> DataFrame:
    """``rows`` with a column ``name``: their places from 0 in ``order``, without gaps.

    Rows are dealt into ranges of the order, sorted there, and written with their places inside the range; the counts
    of the ranges, one row each, then give what lies before a range. Rows alike in ``order`` fall into one range and
    are numbered in any way, so where a key may hold a great part of the rows, ``order`` should end with a stored
    column that tells them apart. An empty table stays empty; nulls come where the order puts them.
    """
    held = _with_offsets(_ranged(rows, order, scratch), F.lit(1))
    return held.withColumn(name, F.col("_before") + F.col("_row")).drop("_range", "_row", "_before")


def running_total(rows: DataFrame, order: list[str | Column], amount: Column, name: str, scratch: Scratch) -> DataFrame:
    """``rows`` with a column ``name``: the sum of ``amount`` (whole numbers, null counts as 0) over all rows before each in ``order``.

    Ranges are added up one by one, and what the ranges before hold is added to each, as in ``numbered``.
    """
    held = _ranged(rows, order, scratch).withColumn("_value", F.coalesce(amount, F.lit(0)).cast("long"))
    inside = F.sum("_value").over(Window.partitionBy("_range").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1))
    summed = _with_offsets(held.withColumn("_inside", F.coalesce(inside, F.lit(0))), F.col("_value"))
    return summed.withColumn(name, F.col("_before") + F.col("_inside")).drop("_range", "_row", "_value", "_inside", "_before")


def batched(rows: DataFrame, order: list[str | Column], size: int, scratch: Scratch) -> DataFrame:
    """``rows`` with ``batch`` and ``index``: batches of ``size`` rows each in ``order``, the last one smaller, indexed from 0."""
    numbers = numbered(rows, order, "_number", scratch)
    return numbers.withColumns({"batch": F.floor(F.col("_number") / size), "index": (F.col("_number") % size).cast("int")}).drop("_number")


def regrouped(rows: DataFrame, answers: DataFrame, answer: str) -> DataFrame:
    """``rows`` (batch, index, ...) with ``answer`` from answers (batch, index, answer), and ``alone``: whether a row is to be asked by itself.

    A batch of answers counts only if each of its rows has exactly one and there is no other: an answer given to the
    wrong row would never be noticed. All rows of any other batch get null and are asked alone. A batch has few rows
    by construction, however many answers came for it.
    """
    wanted = rows.groupBy("batch").agg(F.count("*").alias("_rows"))
    given = answers.groupBy("batch").agg(F.count("*").alias("_given"), F.count_distinct("index").alias("_distinct"), F.min("index").alias("_least"), F.max("index").alias("_most"))
    whole = (F.col("_given") == F.col("_rows")) & (F.col("_distinct") == F.col("_rows")) & (F.col("_least") == 0) & (F.col("_most") == F.col("_rows") - 1)
    good = wanted.join(given, "batch").where(whole).select("batch", F.lit(True).alias("_whole"))
    kept = answers.join(good, "batch", "left_semi").select("batch", "index", answer)
    joined = rows.join(kept, ["batch", "index"], "left").join(good, "batch", "left")
    return joined.withColumn("alone", F.col("_whole").isNull()).drop("_whole")
