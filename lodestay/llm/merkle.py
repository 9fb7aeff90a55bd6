"""Merkle manifest of a dataset: a tree for each group of rows, and one tree over the roots of the groups.

A level is one window: nodes are partitioned by group and parent index, and the ordered list of a run's digests, taken
over the whole frame, is both the parent's preimage and, without the node's own place, its siblings. The parents
without duplicates are the next level. When all trees have ended, paths are handed down from the roots, level by level, by
joins of a run with its parent, so no join key has more rows than a run. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestay.llm.common import BROADCAST_KEYS, quoted
from lodestay.operators.numbering import numbered
from lodestay.storage import Scratch

#: Nodes that make one parent.
ARITY = 3
_PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """A value as a leaf's preimage holds it: ``-`` for null, else UTF-8 byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    """The digest of a row: sha256 in hex of its fields, one after another."""
    return F.sha2(F.concat(*map(field, values)), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of ``path``: each digest is put between those left and right of it."""
    return F.aggregate(path, leaf, lambda digest, step: F.sha2(F.concat(step["left"], digest, step["right"]), 256))


def proof_digest(path: Column) -> Column:
    """sha256 of all siblings of ``path`` from the leaf upwards, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda step: F.concat(step["left"], step["right"]))), 256)


def _level(nodes: DataFrame, arity: int) -> DataFrame:
    """``nodes`` (tree, place, n, digest, ...) with parent, its digest, and the siblings left and right."""
    nodes = nodes.withColumn("parent", F.floor(F.col("place") / arity))
    frame = Window.partitionBy("tree", "parent").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nodes = nodes.withColumn("run", F.collect_list("digest").over(frame))
    at = (F.col("place") % arity).cast("int")
    left, right = F.slice("run", F.lit(1), at), F.slice("run", at + 2, F.lit(arity))
    above = F.sha2(F.concat_ws("", "run"), 256)
    return nodes.select("*", F.concat_ws("", left).alias("left"), F.concat_ws("", right).alias("right"), above.alias("above")).drop("run")


def _climb(leaves: DataFrame, largest: int, arity: int, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """The levels of all trees from the leaves (tree, place, n, digest, ...) up, and (tree, height, digest) of their roots."""
    levels, nodes = [], leaves
    roots = nodes.where("n = 1").select("tree", F.lit(0).alias("height"), "digest")
    while largest > 1:
        levels.append(scratch.write(_level(nodes.where("n > 1"), arity), "level"))
        above = levels[-1].select("tree", F.col("parent").alias("place"), F.ceil(F.col("n") / arity).alias("n"), F.col("above").alias("digest"))
        nodes = above.dropDuplicates(["tree", "place"])
        largest = -(-largest // arity)
        roots = roots.unionByName(nodes.where("n = 1").select("tree", F.lit(len(levels)).alias("height"), "digest"))
    return levels, roots


def _descend(leaves: DataFrame, levels: list[DataFrame], roots: DataFrame, kept: list[str], carried: list[str]) -> DataFrame:
    """``kept`` columns of the leaves, ``carried`` ones and path of ``roots`` (tree, height, path, ...): paths grow downwards."""
    longer = F.concat(F.array(F.struct("left", "right")), F.col("path")).alias("path")

    def tops(height: int) -> DataFrame:
        return roots.where(F.col("height") == height).select("tree", F.lit(0).cast("long").alias("parent"), *carried, "path")

    above = tops(len(levels))
    for height in reversed(range(1, len(levels))):
        own = levels[height].select("tree", "place", "parent", "left", "right").join(above, ["tree", "parent"])
        above = own.select("tree", F.col("place").alias("parent"), *carried, longer).unionByName(tops(height))
    alone = leaves.where("n = 1").join(tops(0), "tree").select(*kept, *carried, "path")
    if not levels:
        return alone
    first = levels[0].join(above, ["tree", "parent"]).select(*kept, *carried, longer)
    return first.unionByName(alone)


def manifest(spark: SparkSession, rows: DataFrame, group: str, order: str, leaf: Column, others: dict[str, Column] | None = None, arity: int = ARITY) -> DataFrame:
    """(order, group, leaf, others, subroot, root, path) of every row; path holds the siblings from the leaf to the root.

    Within a group, leaves follow each other by ``order`` (null first, then by digest; rows with equal digests stand side
    by side). As long as a level has several nodes, each ``arity`` consecutive ones, the last run fewer, make one by
    sha256 of their digests in hex; the one that is left is the group's subroot, of a lone row its leaf. The subroots by
    group (null first, then bytewise) make the root likewise. ``others`` are further columns to carry. An empty
    table has no rows and no root. The number of levels is the logarithm of the largest group.
    """
    others = others or {}
    o, g = quoted([order, group])
    columns = {"order": o, "group": g, "digest": leaf} | {f"other{i}": c for i, c in enumerate(others.values())}
    with Scratch(spark) as scratch:
        read = rows.select(*(c.alias(n) for n, c in columns.items()))
        # Rows alike in all columns differ by this number; it is stored before anything is dealt by it.
        read = scratch.write(read.withColumn("copy", F.monotonically_increasing_id()), "leaves")
        placed = numbered(read, ["group", "order", "digest", "copy"], "number", scratch)
        groups = placed.groupBy("group").agg(F.min("number").alias("first"), F.count("*").alias("n"))
        trees = scratch.write(numbered(groups, ["group"], "tree", scratch), "groups").withColumnRenamed("group", "name")
        count, largest = trees.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
        side = F.broadcast(trees) if count <= BROADCAST_KEYS else trees
        leaves = placed.join(side, F.col("group").eqNullSafe(F.col("name"))).withColumn("place", F.col("number") - F.col("first"))
        leaves = leaves.drop("number", "first", "name", "copy")
        levels, subroots = _climb(leaves, largest, arity, scratch)

        subroots = scratch.write(subroots.withColumnRenamed("tree", "place"), "subroots")
        tops = subroots.select(F.lit(0).alias("tree"), "place", F.lit(count).alias("n"), "digest", F.col("height").alias("under"))
        over, roots = _climb(tops, count, arity, scratch)
        roots = roots.select("tree", "height", F.col("digest").alias("root"), F.array().cast(_PATH).alias("path"))
        named = [F.col("place"), F.col("under"), F.col("digest")]
        above = _descend(tops, over, roots, named, ["root"])
        above = above.select(F.col("place").alias("tree"), F.col("under").alias("height"), F.col("digest").alias("subroot"), "root", "path")
        above = scratch.write(above, "above")

        kept = [F.col("order"), F.col("group"), F.col("digest"), *(F.col(n) for n in columns if n.startswith("other"))]
        found = _descend(leaves, levels, above, kept, ["subroot", "root"])
        names = [order, group, "leaf", *others, "subroot", "root", "path"]
        return scratch.keep(found.toDF(*names), "manifest")
