"""N-gram Jaccard join with signature trees.

Documents with equal shingle sets form a class at once. Each class is dealt into blocks by its segment keys, of
which any two sets similar enough share one (see ``segment_keys``). Blocks led by the same class meet in one
group, and large groups are cut into tiles. In each tile a
signature tree (nodes hold OR-combined bitmaps and size ranges) is traversed against itself: node pairs whose
largest possible overlap is too small are pruned, and pairs already connected are skipped. Only rows that bitmaps
leave are joined with their texts and compared exactly. A tile returns a spanning set of links, never all pairs of a group.
Tiles of one group meet in pairs only where their size ranges allow a link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestay.llm.common import keep_keys, list_array, runs, text_slices
from lodestay.llm.shingles import mix, shingle_sets
from lodestay.operators.graph import components
from lodestay.storage import Scratch

#: Rows in one tile, and shingles in it, at which a group is cut.
TILE_ROWS, TILE_SHINGLES = 1024, 1 << 22
_LEAF, _FAN = 8, 4


class SignatureTree:
    """Hierarchy over sets of one bitmap width: each node has its members' OR-ed bitmaps, size range and bit excess.

    The excess of a set is by how much its size exceeds the bits it sets. Two sets share at most their common bits
    plus the smaller excess. Rows of different ``sides`` go to different nodes as far as possible.
    """

    def __init__(self, sizes: np.ndarray, bitmaps: np.ndarray, sides: np.ndarray):
        self.order = np.lexsort((bitmaps[:, 0], sizes, sides))
        self.size, self.bitmap = sizes[self.order], bitmaps[self.order]
        self.excess = self.size - np.bitwise_count(self.bitmap).sum(1).astype(np.int64)
        #: Levels from the leaves up; each is (first rows, bitmaps, least size, greatest size, greatest excess).
        self.levels = []
        at, level = np.arange(0, len(sizes), _LEAF), (self.bitmap, self.size, self.size, self.excess)
        step = at
        while True:
            level = (
                np.bitwise_or.reduceat(level[0], step, axis=0),
                np.minimum.reduceat(level[1], step),
                np.maximum.reduceat(level[2], step),
                np.maximum.reduceat(level[3], step),
            )
            self.levels.append((np.append(at, len(sizes)), *level))
            if len(at) == 1:
                return
            step = np.arange(0, len(at), _FAN)
            at = at[step]

    def may_match(self, level: int, i: int, j: int, num: int, den: int) -> bool:
        """Whether any pair of members of two nodes can reach the similarity num / den."""
        _, bitmap, least, most, excess = self.levels[level]
        if den * min(most[i], most[j]) < num * max(least[i], least[j]):
            return False
        if i == j:
            return True
        shared = int(np.bitwise_count(bitmap[i] & bitmap[j]).sum()) + int(min(excess[i], excess[j]))
        shared = min(shared, int(most[i]), int(most[j]))
        return (num + den) * shared >= num * int(least[i] + least[j])

    def candidates(self, num: int, den: int, settled: Callable[[np.ndarray, np.ndarray], bool]) -> Iterator[tuple[int, int]]:
        """Pairs of rows that may reach num / den, leaving out node pairs and pairs that are ``settled`` by then."""
        stack = [(len(self.levels) - 1, 0, 0)]
        while stack:
            level, i, j = stack.pop()
            at = self.levels[level][0]
            a, b = slice(at[i], at[i + 1]), slice(at[j], at[j + 1])
            if settled(self.order[a], self.order[b]) or not self.may_match(level, i, j, num, den):
                continue
            if level:
                below = len(self.levels[level - 1][0]) - 1
                left, right = (range(x * _FAN, min(x * _FAN + _FAN, below)) for x in (i, j))
                stack += [(level - 1, x, y) for x in left for y in right if x <= y]
                continue
            shared = np.bitwise_count(self.bitmap[a][:, None] & self.bitmap[b][None]).sum(2).astype(np.int64)
            shared += np.minimum(self.excess[a][:, None], self.excess[b][None])
            least = np.minimum(self.size[a][:, None], self.size[b][None])
            both = self.size[a][:, None] + self.size[b][None]
            possible = ((num + den) * np.minimum(shared, least) >= num * both) & (den * least >= num * (both - least))
            for x, y in zip(*np.nonzero(possible), strict=True):
                if i == j and x >= y:
                    continue
                pair = self.order[at[i] + x], self.order[at[j] + y]
                if not settled(pair[0], pair[1]):
                    yield int(pair[0]), int(pair[1])


def width_of(size: int) -> int:
    """Words of a set's bitmap: a power of two with two bits or more for each member."""
    return max(8, 1 << max(0, (2 * size - 1).bit_length() - 6))


def bitmap_of(members: np.ndarray) -> np.ndarray:
    width = width_of(len(members))
    bits = np.zeros(width * 64, bool)
    bits[(members >> np.uint64(64 - 6 - (width.bit_length() - 1))).astype(np.int64)] = True
    return np.packbits(bits).view(np.uint64)


def candidate_pairs(sizes: np.ndarray, bitmaps: list[np.ndarray], sides: np.ndarray, num: int, den: int, settled: Callable) -> Iterator[tuple[int, int]]:
    """Pairs of all rows that may reach num / den (above one half), by one tree for each bitmap width.

    Sets of a wider bitmap than their partner's are at most twice as large, so a tree of one width also takes
    the sets of the next one, their bitmaps halved by OR-ing neighbouring bits.
    """
    widths = np.array([len(b) for b in bitmaps])
    for width in np.unique(widths):
        rows = np.flatnonzero((widths == width) | (widths == 2 * width))
        if len(rows) > 1:
            narrow = np.stack([_halved(bitmaps[r]) if widths[r] > width else bitmaps[r] for r in rows])
            tree = SignatureTree(sizes[rows], narrow, sides[rows])
            for x, y in tree.candidates(num, den, lambda a, b, rows=rows: settled(rows[a], rows[b])):
                yield int(rows[x]), int(rows[y])


def _halved(bitmap: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(bitmap.view(np.uint8))
    return np.packbits(bits[0::2] | bits[1::2]).view(np.uint64)


def _one(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
    """Whether all rows of two nodes have one value."""
    return bool((values[a] == values[a[0]]).all() and (values[b] == values[a[0]]).all())


def _same_side(sides: np.ndarray) -> Callable:
    """Whether two rows or nodes lie on one side, whose pairs are tested elsewhere; side -1 is not left out."""

    def same(a: np.ndarray, b: np.ndarray) -> bool:
        if np.ndim(a) == 0:
            return sides[a] == sides[b] >= 0
        return bool(sides[a[0]] >= 0) and _one(sides, a, b)

    return same


def linked_pairs(sets: list[np.ndarray], labels: np.ndarray, sides: np.ndarray, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Pairs of rows that link sets with different labels, found by exact comparison; linking joins their labels.

    Rows of one side from 0 on are not compared with each other.
    """
    root = np.unique(labels, return_inverse=True)[1]
    apart = _same_side(sides)

    def settled(a: np.ndarray, b: np.ndarray) -> bool:
        if np.ndim(a) == 0:
            return root[a] == root[b] or apart(a, b)
        return _one(root, a, b) or apart(a, b)

    sizes = np.array([len(s) for s in sets])
    for x, y in candidate_pairs(sizes, [bitmap_of(s) for s in sets], sides, num, den, settled):
        common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        if den * common >= num * (sizes[x] + sizes[y] - common):
            root[root == root[y]] = root[x]
            yield x, y


def possible_rows(sizes: np.ndarray, bitmaps: list[np.ndarray], labels: np.ndarray, sides: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which rows have a partner of another label that they may link with, by their bitmaps alone."""
    found = np.zeros(len(sizes), bool)
    root = np.unique(labels, return_inverse=True)[1]
    apart = _same_side(sides)

    def settled(a: np.ndarray, b: np.ndarray) -> bool:
        if np.ndim(a) == 0:
            return bool(found[a] and found[b]) or root[a] == root[b] or apart(a, b)
        return bool(found[a].all() and found[b].all()) or _one(root, a, b) or apart(a, b)

    for x, y in candidate_pairs(sizes, bitmaps, sides, num, den, settled):
        found[x] = found[y] = True
    return found


def segment_keys(members: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of a sorted set such that any two sets of similarity num / den or more share one.

    Sizes are dealt into classes by powers of two; a set also takes part in the next class if it is large enough
    for a partner there. A class cuts the range of hashes into m segments. Sets that differ in at most k members
    agree in at least m - k segments, so each set can leave out the m - k - 1 last ones in one fixed order of
    contents; that order puts segments of many members first, which others seldom share by chance.
    """
    n = len(members)
    if n == 0:
        return np.zeros(0, np.uint64)
    keys = []
    own = n.bit_length() - 1
    for c in (own, own + 1):
        most = (2 << c) - 1
        partner = min(most, den * n // num)
        if partner < 1 << c:
            continue
        differ = lambda a, b: (den - num) * (a + b) // (den + num)
        m = 5 * (differ(most, most) + 1) // 4 + 1
        emit = min(m, differ(n, partner) + 1)
        bounds = np.arange(m, dtype=np.uint64) * np.uint64(((1 << 64) - 1) // m)
        at = np.append(np.searchsorted(members, bounds), n)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(members))])
        count, content = np.diff(at), mix((total[at[1:]] - total[at[:-1]]) + np.arange(m, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(c))
        keys.append(content[np.lexsort((content, -count))[:emit]])
    return np.concatenate(keys)


def _facts(size: int, num: int, den: int) -> Callable:
    """(doc_id, n, fingerprint, bitmap, segment keys) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                sets = shingle_sets(part.column(1), size)
                keys = [segment_keys(s, num, den) for s in sets]
                columns = [
                    part.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None for s in sets], pa.string()),
                    pa.array([bitmap_of(s).tobytes() for s in sets], pa.binary()),
                    list_array(np.concatenate(keys).view(np.int64), [len(k) for k in keys]),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "fingerprint", "bits", "keys"])

    return run


def _tile_rows(num: int, den: int, keys: list[str]) -> Callable:
    """The rows of each tile that may link with another one of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in runs(batches, keys):
            if tile.num_rows < 2:
                continue
            bitmaps = [np.frombuffer(b, np.uint64) for b in tile.column("bits").to_pylist()]
            found = possible_rows(*(tile.column(c).to_numpy() if c else bitmaps for c in ("n", "", "label", "side")), num, den)
            if found.any():
                yield from tile.select([*keys, "id", "label", "side"]).filter(pa.array(found)).combine_chunks().to_batches()

    return run


def _tile_links(size: int, num: int, den: int, keys: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in runs(batches, keys):
            if tile.num_rows < 2:
                continue
            tile = tile.combine_chunks()
            ids, labels, sides = (tile.column(c).to_numpy() for c in ("id", "label", "side"))
            found = list(linked_pairs(shingle_sets(tile.column("text").chunk(0), size), labels, sides, num, den))
            if found:
                a, b = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    return run


def _link_tiles(tiles: DataFrame, signs: DataFrame, docs: DataFrame, keys: list[str], scratch: Scratch, size: int, num: int, den: int) -> DataFrame:
    """Links found in tiles (keys, id, label, side). Bitmaps thin the tiles out; the texts of what stays settle it."""
    rows = tiles.join(signs, "id").repartition(*keys).sortWithinPartitions(*keys, "id")
    kept = rows.mapInArrow(_tile_rows(num, den, keys), ", ".join(f"{k} long" for k in [*keys, "id", "label", "side"]))
    kept = scratch.write(kept, "kept")
    ids = scratch.write(kept.select(F.col("id").alias("doc_id")).distinct(), "ids")
    texts = keep_keys(docs, ids, "doc_id").select(F.col("doc_id").alias("id"), "text")
    rows = kept.join(texts, "id").repartition(*keys).sortWithinPartitions(*keys, "id")
    return scratch.write(rows.mapInArrow(_tile_links(size, num, den, keys), "a long, b long"), "links")


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text).

    Two documents link when ``den * |intersection| >= num * |union|`` of their sets of ``size``-word shingles;
    component_id is the smallest doc_id that links lead to. Null or empty texts and texts without words have no
    shingles and link with nothing. Rows that repeat a doc_id count as that one document; a null doc_id keeps its
    row, with a null component_id. Further columns of ``docs`` are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        return scratch.keep(_components(docs, scratch, size, num, den), "near-duplicates")


def _components(docs: DataFrame, scratch: Scratch, size: int, num: int, den: int) -> DataFrame:
    both = docs.mapInArrow(_facts(size, num, den), "doc_id long, n_shingles long, fingerprint string, bits binary, keys array<long>")
    both = scratch.write(both, "facts")
    facts = both.select("doc_id", "n_shingles", "fingerprint")
    named = facts.where("fingerprint is not null and doc_id is not null")
    classes = scratch.write(named.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id")), "classes")
    class_ids = classes.select(F.col("class_id").alias("id"))
    signs = both.where("n_shingles > 0").select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "bits", "keys")
    signs = keep_keys(signs, class_ids, "id")

    # Blocks of two classes or more; those led by the same class form one group.
    listed = signs.select("id", F.explode("keys").alias("key"))
    blocks = listed.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader < last")
    groups = scratch.write(listed.join(blocks.select("key", "leader"), "key").select("leader", "id").distinct(), "groups")

    # A group of one tile is settled there; a larger one is first cut at random, each part with its leader.
    signs = signs.drop("keys")
    measured = groups.join(signs.select("id", "n"), "id")
    tiles = F.greatest(F.ceil(F.count("*") / TILE_ROWS), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int")
    large = scratch.write(measured.groupBy("leader").agg(tiles.alias("tiles")).where("tiles > 1"), "large")
    part = F.when(F.col("id") == F.col("leader"), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(
        F.array(F.pmod(F.xxhash64(F.lit(3), "id"), F.col("tiles")).cast("int"))
    )
    first = groups.join(large, "leader", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    first = first.select("leader", "id", F.col("id").alias("label"), F.explode(part).alias("tile"))
    first = first.select("leader", "id", "label", F.col("tile").cast("long").alias("tile"), F.lit(-1).cast("long").alias("side"))
    links = _link_tiles(first, signs, docs, ["leader", "tile"], scratch, size, num, den)
    if not large.isEmpty():
        links = links.unionByName(_between_tiles(measured.join(large, "leader"), signs, docs, links, scratch, size, num, den))
    reached = components(links, "a", "b", scratch)

    classes = classes.join(reached.withColumnRenamed("id", "class_id"), "class_id", "left")
    classes = classes.select("fingerprint", F.coalesce("component", "class_id").alias("component"))
    alike = facts.where("doc_id is not null").join(classes, "fingerprint", "left")
    # A repeated doc_id may have several texts, hence several classes: their components are one.
    repeats = alike.groupBy("doc_id").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b")
    if not repeats.isEmpty():
        own = alike.where("component is not null").select(F.col("doc_id").alias("a"), F.col("component").alias("b"))
        merged = components(own, "a", "b", scratch)
        alike = alike.drop("component").join(merged.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    out = alike.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    lost = facts.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(lost)


def _size_tiles(rows: DataFrame) -> DataFrame:
    """``rows`` (leader, main, id, label, n) with the number of a tile: each holds sizes next to each other.

    Only the counts of equal sizes are put in order, not the rows; many rows of one size share several tiles.
    """
    load = F.greatest(F.lit(1 / TILE_ROWS), F.col("n") / TILE_SHINGLES)
    counted = rows.groupBy("leader", "main", "n").agg((F.count("*") * F.first(load)).alias("load"))
    before = F.sum("load").over(Window.partitionBy("leader", "main").orderBy("n")) - F.col("load")
    counted = counted.select("leader", "main", "n", F.floor(before).alias("base"), F.ceil("load").alias("spread"))
    placed = rows.join(counted, ["leader", "main", "n"])
    return placed.withColumn("tile", F.col("base") + F.pmod(F.xxhash64(F.lit(5), "id"), F.col("spread"))).drop("base", "spread")


def _between_tiles(groups: DataFrame, signs: DataFrame, docs: DataFrame, links: DataFrame, scratch: Scratch, size: int, num: int, den: int) -> DataFrame:
    """Links between different tiles of the large ``groups`` (leader, id, n).

    After the first pass nearly all of a group of copies is one component, the main one. Pairs inside it need no
    test; each other row must meet the main component and all other such rows whose sizes allow a link. Rows are
    dealt anew into tiles of like sizes, and each pair of tiles whose size ranges fit is one task.
    """
    reached = components(links, "a", "b", scratch)
    rows = groups.join(reached, "id", "left").withColumn("label", F.coalesce("component", "id"))
    count = rows.groupBy("leader", "label").agg(F.count("*").alias("rows"))
    most = count.groupBy("leader").agg(F.max_by("label", F.struct("rows", "label")).alias("most"), F.count("*").alias("labels"))
    rows = rows.join(most.where("labels > 1"), "leader").withColumn("main", F.col("label") == F.col("most"))
    rows = scratch.write(_size_tiles(rows.select("leader", "main", "id", "label", "n")), "dealt")

    ranges = scratch.write(rows.groupBy("leader", "main", "tile").agg(F.min("n").alias("least"), F.max("n").alias("most")), "ranges")
    a, b = ranges.where("not main").alias("a"), ranges.alias("b")
    fits = den * F.least("a.most", "b.most") >= num * F.greatest("a.least", "b.least")
    pairs = a.join(b, (F.col("a.leader") == F.col("b.leader")) & fits & (F.col("b.main") | (F.col("a.tile") <= F.col("b.tile"))))
    # Main tiles are numbered below zero.
    other = F.when(F.col("b.main"), -1 - F.col("b.tile")).otherwise(F.col("b.tile"))
    pairs = scratch.write(pairs.select(F.col("a.leader").alias("leader"), F.col("a.tile").alias("tile"), other.alias("other")), "pairs")

    rows = rows.select("leader", "id", "label", F.when(F.col("main"), -1 - F.col("tile")).otherwise(F.col("tile")).alias("mine"))
    side = lambda n: F.when(F.col("tile") == F.col("other"), -1).otherwise(n).cast("long").alias("side")
    left = rows.join(pairs, (rows["leader"] == pairs["leader"]) & (rows["mine"] == pairs["tile"])).drop(pairs["leader"])
    right = rows.join(pairs, (rows["leader"] == pairs["leader"]) & (rows["mine"] == pairs["other"]) & (pairs["tile"] != pairs["other"])).drop(pairs["leader"])
    dealt = left.select("leader", "id", "label", "tile", "other", side(0)).unionByName(right.select("leader", "id", "label", "tile", "other", side(1)))
    return _link_tiles(dealt, signs, docs, ["leader", "tile", "other"], scratch, size, num, den)
