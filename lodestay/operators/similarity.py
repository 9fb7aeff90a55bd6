"""Fuzzy text matching: sets of tokens dealt into tiles by size, so that no pair of rows is made before it may be alike."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestay.operators.numbering import numbered, running_total
from lodestay.operators.tiles import SHARE
from lodestay.storage import Scratch

#: Similarity from which a post is a repost, tokens that both must have, and days that may lie between them.
REPOST, LEAST_TOKENS, REPOST_DAYS = 0.72, 8, 4
#: Words of 64 bits in a sketch.
WORDS = 8
_SKETCH = [f"s{i}" for i in range(WORDS)]
#: Tokens of one tile, at most and at least, and candidates that a task holds at once.
MOST_TOKENS, FEWEST_TOKENS, CANDIDATES = 1 << 24, 1 << 16, 1 << 21
#: Tiles that ask one task: what it sorts is bounded.
ASKING = 8
#: Most frequent tokens, whose numbers are broadcast.
FREQUENT = 1 << 16
#: Copies that are broadcast, so that the tokens of the others need no shuffle.
BROADCAST_COPIES = 1 << 20


def classes_of(rows: DataFrame, least: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``rows`` (..., tokens) of ``least`` distinct tokens or more, with ``class`` instead of tokens, and (class, tokens), each class once.

    Rows with equal sets of tokens are one class. Texts are cut into tokens once: they are written before anything is asked of them.
    """
    held = rows.withColumns({"tokens": F.array_distinct("tokens"), "_row": F.monotonically_increasing_id()})
    held = scratch.write(held.withColumn("_h", F.sha2(F.array_join(F.sort_array("tokens"), " ").cast("binary"), 256)), "texts").where(F.size("tokens") >= least)
    marked = held.drop("tokens")
    members = scratch.write(marked.join(marked.groupBy("_h").agg(F.min("_row").alias("class")), "_h").drop("_h"), "members")
    copies = members.where("_row <> class").select("_row")
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_COPIES else copies
    return members.drop("_row"), held.join(copies, "_row", "left_anti").select(F.col("_row").alias("class"), "tokens")


def numbered_sets(rows: DataFrame, key: str, tokens: str, least: int, scratch: Scratch) -> DataFrame:
    """(k, n, ids) of rows with ``least`` distinct tokens or more: their tokens as numbers in order, the rarest first."""
    sized = rows.select(F.col(key).alias("k"), F.col(tokens).alias("t")).where(F.size("t") >= least)
    said = sized.select("k", F.explode("t").alias("token"))
    rarity = numbered(said.groupBy("token").agg(F.count("*").alias("rows")), ["rows", "token"], "id", scratch).select("token", "rows", F.col("id").cast("int").alias("id"))
    tokens, total = rarity.agg(F.count("*"), F.sum("rows")).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    # Most of what is said are a few tokens: their numbers are broadcast, and only the others are dealt by token, in shares that are hashed, not sorted.
    often, seldom = (rarity.where(F.col("id") >= tokens - FREQUENT) if up else rarity.where(F.col("id") < tokens - FREQUENT) for up in (True, False))
    known = said.join(F.broadcast(often.select("token", "id")), "token").select("k", "id")
    if tokens > FREQUENT:
        n = max(cores, -(-seldom.agg(F.sum("rows")).first()[0] // SHARE))
        others = said.join(F.broadcast(often.select("token")), "token", "left_anti").repartition(n, "token")
        known = known.unionByName(others.join(seldom.select("token", "id").repartition(n, "token").hint("shuffle_hash"), "token").select("k", "id"))
    sets = known.repartition(max(cores, -(-(total or 0) // SHARE)), "k").groupBy("k").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return scratch.write(sets.select("k", F.size("ids").alias("n"), "ids"), "sets")


def token_sets(rows: DataFrame, key: str, tokens: str, least: int, scratch: Scratch) -> DataFrame:
    """(k, n, ids, s0, ...): ``numbered_sets`` with a sketch of each set.

    A bit of the sketch says whether the set has an odd number of the tokens that fall to it: two sets differ in at least as many
    tokens as their sketches in bits.
    """
    sets = numbered_sets(rows, key, tokens, least, scratch)
    bit = F.pmod(F.xxhash64("id"), F.lit(64 * WORDS)).cast("int")
    sketch = [F.bit_xor(F.when(F.floor(bit / 64) == i, F.call_function("shiftleft", F.lit(1).cast("long"), bit % 64)).otherwise(F.lit(0).cast("long"))).alias(s) for i, s in enumerate(_SKETCH)]
    return sets.join(sets.select("k", F.explode("ids").alias("id")).groupBy("k").agg(*sketch), "k")


def prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """(k, n, id, place, s0, ...) of the first ``n - ceil(threshold n) + 1`` tokens of each set: two that are alike share one of them."""
    first = F.slice("ids", F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold) + 1).cast("int"))
    return sets.select("k", "n", *_SKETCH, F.posexplode(first).alias("place", "id"))


def _may_be_alike(a: str, b: str, threshold: float) -> Column:
    """Whether two sets can be alike by their sizes, by what is left of both from a common token on, if it is their first, and by their sketches."""
    n, m, i, j = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.place"), F.col(f"{b}.place")
    needed = F.ceil(threshold / (1 + threshold) * (n + m) - F.lit(1e-9))
    differ = sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in _SKETCH[1:]), F.bit_count(F.col(f"{a}.s0").bitwiseXOR(F.col(f"{b}.s0"))))
    return (F.least(n, m) >= threshold * F.greatest(n, m)) & (F.least(n - i, m - j) >= needed) & (differ <= n + m - 2 * needed)


def size_tiles(sizes: list[tuple[int, int]], tokens: int) -> list[tuple[int, int, int]]:
    """(least, most, parts) of ranges of sizes, at most twofold, that hold about ``tokens`` tokens, from ascending (size, sets).

    One size with more is cut into parts.
    """
    tiles, held = [], tokens
    for n, sets in sizes:
        if held + n * sets <= tokens and n <= 2 * tiles[-1][0]:
            tiles[-1] = (tiles[-1][0], n, 1)
            held += n * sets
        else:
            tiles.append((n, n, -(-n * sets // tokens)))
            held = n * sets
    return tiles


def tile_tasks(ranges: list[tuple[int, int, int]], threshold: float) -> tuple[list[tuple[int, int, int]], int]:
    """(tile, task, side) of every tile in every task that it takes part in, and the number of tasks.

    A task holds one tile and is asked by at most ``ASKING`` others, whose sizes allow a pair at the threshold and are no smaller.
    """
    tiles = [(i, least, most) for i, (least, most, parts) in enumerate(ranges) for _ in range(parts)]
    asking = [[] for _ in tiles]
    for t, (i, _, most) in enumerate(tiles):
        for u in range(t + 1, len(tiles)):
            if most < threshold * tiles[u][1] - 1e-9:
                break
            # Of two parts of one size either can hold the other: by turns, so that none is asked by all.
            held, asks = (u, t) if tiles[u][0] == i and (t + u) % 2 else (t, u)
            asking[held].append(asks)
    rows, tasks = [], 0
    for t, others in enumerate(asking):
        for k in range(0, max(1, len(others)), ASKING):
            rows += [(t, tasks, _HELD if k else _SELF), *((u, tasks, _ASKS) for u in others[k : k + ASKING])]
            tasks += 1
    return rows, tasks


def alike(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs of ``sets`` (k, n, ids), written, that reach ``threshold``; each once, a and b in any order.

    Sets lie in tiles of like sizes and bounded length. A task holds one tile, and the tiles whose sizes allow a pair with it stream by;
    pairs are found and counted there, so that no candidate is ever shuffled.
    """
    spark = sets.sparkSession
    # As many rows as there are sizes: fewer than the root of twice the tokens.
    sizes = [(r["n"], r["count"]) for r in sets.groupBy("n").count().orderBy("n").collect()]
    total = sum(n * count for n, count in sizes)
    ranges = size_tiles(sizes, min(MOST_TOKENS, max(FEWEST_TOKENS, total // spark.sparkContext.defaultParallelism)))
    rows, tasks = tile_tasks(ranges, threshold)
    starts = [sum(parts for *_, parts in ranges[:i]) for i in range(len(ranges))]
    known = pa.table({"least": pa.array([r[0] for r in ranges], pa.int32()), "most": pa.array([r[1] for r in ranges], pa.int32()), "parts": pa.array([r[2] for r in ranges], pa.int32()), "start": pa.array(starts, pa.int32())})
    found = pa.table({name: pa.array(column, pa.int32()) for name, column in zip(("tile", "task", "side"), zip(*rows) if rows else ((), (), ()))})
    tile = (F.col("start") + F.pmod(F.xxhash64("k"), F.col("parts"))).cast("int")
    placed = sets.join(F.broadcast(spark.createDataFrame(known)), F.col("n").between(F.col("least"), F.col("most"))).select("k", "ids", tile.alias("tile"))
    dealt = placed.join(F.broadcast(spark.createDataFrame(found)), "tile").select("task", "side", "k", "ids")
    kind = sets.schema["k"].dataType.simpleString()
    return dealt.repartitionById(max(1, tasks), "task").sortWithinPartitions("side").mapInArrow(_meeting(threshold), f"a {kind}, b {kind}, similarity double")


#: What a set is to a task: held and to meet the others that are held, held alone, or asking for those.
_SELF, _HELD, _ASKS = 0, 1, 2


class _Sets:
    """Rows (k, ids): set i is ``ids[at[i]:at[i + 1]]``."""

    def __init__(self, rows: pa.Table):
        lists = rows["ids"].combine_chunks()
        self.k, self.ids, self.at = rows["k"], lists.flatten().to_numpy(), lists.offsets.to_numpy().astype(np.int64)
        self.at -= self.at[0]
        self.n = np.diff(self.at)

    def heads(self, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(set, place, id) of the first ``most`` ids of each."""
        most = np.clip(most, 0, self.n)
        row = np.repeat(np.arange(len(most), dtype=np.int32), most)
        place = (np.arange(len(row)) - np.repeat(np.cumsum(most) - most, most)).astype(np.int32)
        return row, place, self.ids[self.at[row] + place]

    def sketches(self, bits: int) -> np.ndarray:
        """2 ** ``bits`` parities of each set: two differ in at least as many ids as these in bits."""
        words = np.zeros((len(self.n), 1 << (bits - 6)), np.uint64)
        flat, step = words.reshape(-1), max(1, CANDIDATES // int(self.n.max(initial=1)))
        for r in range(0, len(self.n), step):
            n = self.n[r : r + step]
            bit = (self.ids[self.at[r] : self.at[r] + n.sum()].astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(32 - bits)
            np.bitwise_xor.at(flat, np.repeat(np.arange(r, r + len(n)), n) * words.shape[1] + (bit >> 6), np.uint64(1) << (bit & np.uint32(63)).astype(np.uint64))
        return words


class _Held:
    """One tile of sets, indexed by the ids that a set of the same size or longer may share first."""

    def __init__(self, rows: pa.Table, threshold: float):
        self.sets, self.threshold = _Sets(rows), threshold
        n = self.sets.n
        self.longest, self.shortest = int(n.max()), int(n.min())
        most = int(self.longest / threshold) + 2
        self.least = np.ceil(threshold * np.arange(most) - 1e-9).astype(np.int64)
        self.needed = np.ceil(threshold / (1 + threshold) * np.arange(2 * most) - 1e-9).astype(np.int64)
        row, place, token = self.sets.heads(n - self.needed[2 * n] + 1)
        order = np.argsort(token, kind="stable")
        self.row, self.place, self.token = row[order], place[order], token[order]
        #: Sets that ask at once.
        self.step = max(1, CANDIDATES // self.longest)
        self.bits = min(32, max(6, (2 * self.longest - 1).bit_length()))
        self.sketches, self.mark = self.sets.sketches(self.bits), np.zeros(int(self.sets.ids.max()) + 1, bool)

    def meet(self, rows: pa.Table, first: int | None = None) -> Iterator[pa.RecordBatch]:
        """(a, b, similarity) of sets that are held and sets of ``rows``, which are held ones themselves from the ``first`` on if that is given."""
        asks = _Sets(rows.filter(pc.less(pc.list_value_length(rows["ids"]), len(self.least))))
        n, m, needed = self.sets.n, asks.n, self.needed
        y, j, token = asks.heads(m - needed[m + np.maximum(self.least[m], self.shortest)] + 1)
        begin = np.searchsorted(self.token, token)
        count = np.searchsorted(self.token, token, "right") - begin
        sketches = asks.sketches(self.bits)
        for part in _parts(y, count):
            # All candidates of some sets that ask.
            c = count[part]
            e = np.repeat(np.arange(part.start, part.stop), c)
            f = np.arange(len(e)) - np.repeat(np.cumsum(c) - c, c) + begin[e]
            a, b = self.row[f], y[e]
            good = (np.minimum(n[a] - self.place[f], m[b] - j[e]) >= needed[n[a] + m[b]]) & (n[a] >= self.least[m[b]])
            good &= (n[a] <= m[b]) if first is None else (n[a] < m[b]) | ((n[a] == m[b]) & (a < b + first))
            pair = np.unique(b[good].astype(np.int64) * len(n) + a[good])
            step = max(1, 4 * CANDIDATES // sketches.shape[1])
            for k in range(0, len(pair), step):
                b, a = np.divmod(pair[k : k + step], len(n))
                near = np.bitwise_count(self.sketches[a] ^ sketches[b]).sum(1, dtype=np.int64) <= n[a] + m[b] - 2 * needed[n[a] + m[b]]
                a, b = a[near], b[near]
                both = self._shared(asks, a, b)
                similarity = both / (n[a] + m[b] - both)
                yes = similarity >= self.threshold
                yield from pa.table({"a": self.sets.k.take(pa.array(a[yes])), "b": asks.k.take(pa.array(b[yes])), "similarity": similarity[yes]}).to_batches()

    def _shared(self, asks: _Sets, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many ids set a that is held and set b that asks share; pairs come in order of b."""
        both, last, own = np.zeros(len(a), np.int64), -1, None
        for p, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            if y != last:
                self.mark[own] = False
                own, last = asks.ids[asks.at[y] : asks.at[y + 1]], y
                own = own[own < len(self.mark)]
                self.mark[own] = True
            both[p] = np.count_nonzero(self.mark[self.sets.ids[self.sets.at[x] : self.sets.at[x + 1]]])
        self.mark[own] = False
        return both


def _meeting(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []
        for batch in batches:
            side = batch["side"].to_numpy()
            at = int(np.searchsorted(side, _ASKS))
            if at:
                rows.append(batch.slice(0, at))
            if at < len(side) and rows:
                held = held or _Held(pa.Table.from_batches(rows), threshold)
                for r in range(at, len(side), held.step):
                    yield from held.meet(pa.Table.from_batches([batch.slice(r, held.step)]))
        if rows and rows[0]["side"][0].as_py() == _SELF:
            held, first = held or _Held(pa.Table.from_batches(rows), threshold), 0
            for batch in rows:
                for r in range(0, len(batch), held.step):
                    yield from held.meet(pa.Table.from_batches([batch.slice(r, held.step)]), first + r)
                first += len(batch)

    return run


def _parts(row: np.ndarray, count: np.ndarray) -> Iterator[slice]:
    """Slices of whole runs of ``row`` whose counts add up to about ``CANDIDATES``."""
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    if len(starts):
        share = (np.cumsum(np.add.reduceat(count, starts)) - 1) // CANDIDATES
        cuts = [*starts[np.flatnonzero(np.diff(share, prepend=-1))].tolist(), len(row)]
        yield from (slice(a, b) for a, b in zip(cuts, cuts[1:]) if a < b)


def similar_texts(rows: DataFrame, key: str, tokens: str, threshold: float, least: int, scratch: Scratch) -> DataFrame:
    """(a, b, similarity) of row pairs, a < b, whose distinct-token arrays of ``least`` or more reach a Jaccard value."""
    found = alike(numbered_sets(rows, key, tokens, least, scratch), threshold)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


def best_reposts(rows: DataFrame, scratch: Scratch, days: int = REPOST_DAYS, threshold: float = REPOST, least: int = LEAST_TOKENS) -> DataFrame:
    """(key, earlier, similarity): for each row (key, ts, tokens) the most similar row of the ``days`` before it, if one reaches ``threshold``.

    Of equally similar ones the earliest counts, then the least key; a row of the same moment is not earlier. Rows with
    fewer than ``least`` distinct tokens, without a key or without a time take no part. Equal token sets are one class, and
    a row asks only for classes that have rows in its band of ``days`` or the one before. Which row of a class is the first one
    in reach is a place in the order of all rows, found by a running count: copies make no pairs, however many they are.
    """
    span = days * 86_400_000_000
    good = rows.select("key", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.when(F.col("key").isNotNull() & F.col("ts").isNotNull(), F.col("tokens")).alias("tokens"))
    placed, classes = classes_of(good, least, scratch)
    placed = placed.withColumn("band", F.floor(F.col("ts") / span))
    pairs = scratch.write(alike(numbered_sets(classes, "class", "tokens", least, scratch), threshold), "pairs")
    own = placed.select(F.col("class").alias("a"), F.col("class").alias("b"), F.lit(1.0).alias("similarity")).distinct()
    links = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity")).unionByName(own)
    bands = scratch.write(placed.select("class", "band").distinct(), "bands")
    reached = bands.select(F.col("class").alias("b"), F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band")).distinct()
    links = scratch.write(links.join(bands.withColumnRenamed("class", "a"), "a").join(reached, ["b", "band"], "left_semi").select("a", "band", "b", "similarity"), "links")

    # All rows by class and time, and among them for each row the moment from which a row of a like class is in reach.
    line = placed.select("class", "ts", F.lit(1).alias("order"), "key", F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("long").alias("until"))
    asks = placed.withColumnRenamed("class", "a").join(links, ["a", "band"]).select(F.col("b").alias("class"), (F.col("ts") - span).alias("ts"), F.lit(0).alias("order"), "key", "similarity", F.col("ts").alias("until"))
    total = running_total(line.unionByName(asks), ["class", "ts", "order", "key"], F.col("order"), "place", scratch)
    earlier = total.where("order = 1").select("place", F.col("class").alias("_class"), F.col("ts").alias("_ts"), F.col("key").alias("earlier"))
    found = total.where("order = 0").join(earlier, "place").where("class = _class and _ts < until")
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "_ts", "earlier")).alias("best")
    return found.groupBy("key").agg(best).select("key", F.col("best.earlier").alias("earlier"), (-F.col("best.s")).alias("similarity"))
