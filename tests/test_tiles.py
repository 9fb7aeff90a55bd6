"""Work that grows with places and results, not with the square of copies."""

import random

from pyspark.sql import functions as F

from lodestay.functions import geo
from lodestay.operators import amenities, entities, houses, intervals, similarity, tiles
from lodestay.plans import posts, varied
from lodestay.plans import texts as texts_plans
from lodestay.storage import Scratch


def test_copies_of_places_are_one(spark):
    """Four hundred homes and stops at two places each: four pairs of places, and the first stops by distance and key."""
    at = (F.lit(32.0) + (F.col("id") % 2) * 0.001).alias("lat"), F.lit(34.8).alias("lon")
    homes, stops = spark.range(400).select(F.col("id").alias("key"), *at), spark.range(400).select(F.col("id").alias("stop"), *at)
    assert amenities.places_within(homes, stops.select("lat", "lon").distinct(), 1500.0).count() == 4
    rows = amenities.first_within(homes, stops, 1500.0, 3).collect()
    assert len(rows) == 1200
    assert {(r.key % 2, r.stop, r.rank, r.metres) for r in rows} == {(0, 0, 1, 0.0), (0, 2, 2, 0.0), (0, 4, 3, 0.0), (1, 1, 1, 0.0), (1, 3, 2, 0.0), (1, 5, 3, 0.0)}
    assert amenities.first_within(homes, stops.where("stop > 398"), 1500.0, 3).where("key < 2").orderBy("key").select("stop", "rank", F.round("metres")).collect() == [(399, 1, 111.0), (399, 1, 0.0)]


def test_slots_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(tiles.tiled_join, "__defaults__", (3,))
    k = F.col("id")
    place = lambda m: ((32 + k % m * 0.004).alias("lat"), (34.8 + k % 3 * 0.003).alias("lon"))
    homes = spark.range(40).select(k.alias("key"), *place(5))
    offers = spark.range(300).select((k % 3).alias("target"), F.concat(F.lit("a"), k.cast("string")).alias("name"), F.when(k % 4 > 0, k % 2).alias("direction"), F.when(k % 7 > 0, (k * 31 % 23).cast("int")).alias("headway"),
                                     F.when(k % 5 > 0, 300.0 + k % 5 * 300).alias("reach"), *place(7))
    far = geo.haversine(F.col("h.lat"), F.col("h.lon"), F.col("o.lat"), F.col("o.lon"))
    wanted = homes.alias("h").join(offers.alias("o"), far <= F.least("reach", F.lit(1000.0))).select("key", "target", "name", "direction", "headway", far.alias("metres"))
    wanted = wanted.withColumn("minutes", geo.walk_minutes(F.col("metres")))
    rows = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    pairs = amenities.within_reach(homes, offers, 1000.0)
    assert rows(pairs) == rows(wanted) and len(rows(wanted)) > 1000
    assert rows(amenities.slots(homes, offers, 1000.0)) == rows(amenities.slot_winners(wanted))


def test_tiles_bound_what_a_task_makes(spark):
    """One key of 900 rows on both sides: 810,000 results, of which no partition makes them all."""
    a, b = spark.range(900).select(F.lit(1).alias("k"), F.col("id").alias("x")), spark.range(900).select(F.lit(1).alias("k"), F.col("id").alias("y"))
    made = tiles.tiled_join(a, b, ["k"], 100)
    sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 810_000 and max(sizes) < 405_000
    assert made.distinct().count() == 810_000


def test_sketches_spare_candidates(spark):
    """Sixty sets of eighty tokens that share four rare ones alone are no candidates; two that differ in two tokens are."""
    k = F.col("id")
    shared = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.concat(F.lit("r"), i.cast("string")))
    own = lambda key: F.transform(F.sequence(F.lit(0), F.lit(75)), lambda i: F.concat_ws("_", F.lit("t"), key.cast("string"), i.cast("string")))
    rows = spark.range(60).select(k, F.concat(shared, own(k)).alias("tokens")).unionByName(spark.range(60, 61).select(k, F.concat(F.array(F.lit("x"), F.lit("y")), F.slice(shared, 3, 2), own(F.lit(7))).alias("tokens")))
    with Scratch(spark) as scratch:
        sets = similarity.token_sets(rows, "id", "tokens", 8, scratch)
        index = similarity.prefixes(sets, 0.72)
        a, b = index.alias("a"), index.alias("b")
        met = a.join(b, (F.col("a.id") == F.col("b.id")) & (F.col("a.k") < F.col("b.k")) & similarity._may_be_alike("a", "b", 0.72)).select("a.k", "b.k").distinct()
        assert [tuple(r) for r in met.collect()] == [(7, 60)]
        assert [(r.a, r.b, round(r.similarity, 6)) for r in similarity.similar_texts(rows, "id", "tokens", 0.72, 8, scratch).collect()] == [(7, 60, round(78 / 82, 6))]


def test_crowded_bucket_is_shared_out(spark, monkeypatch):
    """Six hundred runs and slots of one minute: no partition makes all their pairs."""
    monkeypatch.setattr(tiles.tiled_join, "__defaults__", (200,))
    at = (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=F.col("id") % 10)).alias("at")
    runs = spark.range(600).select(F.col("id").alias("run"), at.alias("a"), (at + F.expr("INTERVAL 30 SECONDS")).alias("b"))
    slots = spark.range(4000).select(F.col("id").alias("slot"), at)
    found = intervals.containing(slots, runs, "at", "a", "b")
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 60 * 400 * 55 and max(sizes) < sum(sizes)


def test_posts_are_written_by_all_tasks(spark):
    """The table of parts is one small file, the work on its keys is not."""
    parts = lambda df: {r[0] for r in df.select(F.spark_partition_id()).distinct().collect()}
    assert parts(posts.made_posts(spark, "/root/testdata/sf0.001")) == {0, 1, 2, 3}
    assert parts(varied.written_posts(spark, "/root/testdata/sf0.001")) == {0, 1, 2, 3}


def test_anchors_at_one_point_do_not_meet_in_pairs(spark):
    """Four hundred candidates at each of three points: one row for each point in reach, and all with one before them are accepted."""
    k = F.col("id")
    rows = spark.range(1200).select(k.alias("place"), F.lit("s").alias("street"), (32 + k % 3 * 0.0015).alias("lat"), F.lit(34.8).alias("lon"), (k % 3 * 166.8).alias("off"))
    assert [r._since for r in houses._since(rows.where("off > 0"), rows.where("off = 0"), 200.0).collect()] == [0]
    with Scratch(spark) as scratch:
        assert houses.chained(rows, scratch).select("place").distinct().count() == houses.chained(rows, scratch).count() == 1200


def test_clusters_are_made_in_shares(spark, monkeypatch):
    """Ten thousand orders in chains of ten, in shares of five hundred rows: more tasks than the session's four partitions have a part of the result."""
    monkeypatch.setattr(tiles, "SHARE", 500, raising=False)
    k = F.col("id")
    rows = spark.range(10_000).select(k.alias("key"), F.lit("a").alias("address"), F.explode(F.array(k, k + F.when(k % 10 < 9, 1).otherwise(0))).alias("contact"))
    found = entities.shared_contact_clusters(rows, "key", "address", "contact")
    assert found.where("cluster = key - key % 10").count() == found.count() == 10_000
    assert len(found.inputFiles()) == 40


def test_tiles_of_sizes_give_all_pairs(spark, monkeypatch):
    """Sets of many sizes in tiles of a few rows, sizes of several parts, tiles that ask several tasks: the pairs of brute force, each once."""
    r = random.Random(7)
    monkeypatch.setattr(similarity, "MOST_TOKENS", 200)
    monkeypatch.setattr(similarity, "ASKING", 2)
    monkeypatch.setattr(similarity, "FREQUENT", 40)
    sets = {}
    for k in range(240):
        g, size = r.randrange(3), r.choice([9, 12, 12, 12, 17, 30])
        base = [f"g{g}x{i}" for i in range(size)]
        sets[f"k{k}"] = r.sample(base, len(base) - r.randrange(3)) + [f"own{k}"] * r.randrange(2)
    sets |= {"short": ["a"] * 3, "none": None}
    with Scratch(spark) as scratch:
        rows = similarity.similar_texts(spark.createDataFrame(list(sets.items()), "k string, t array<string>").repartition(3), "k", "t", 0.72, 8, scratch).collect()
    wanted = {}
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and min(len(x or ()), len(y or ())) >= 8 and len({*x} & {*y}) / len({*x} | {*y}) >= 0.72:
                wanted[a, b] = len({*x} & {*y}) / len({*x} | {*y})
    assert {(x.a, x.b): x.similarity for x in rows} == wanted and len(rows) == len(wanted) > 500
    tasks, _ = similarity.tile_tasks([(12, 12, 1), (13, 13, 5), (14, 16, 1), (40, 50, 1)], 0.72)
    met = sorted(tuple(sorted((t, u))) for t, k, side in tasks if side < 2 for u, j, other in tasks if j == k and (other == 2 or u == t and side == 0))
    assert met == [*((i, j) for i in range(7) for j in range(i, 7)), (7, 7)]


def test_texts_are_cut_once_and_candidates_stay_where_they_are(spark):
    """Each text is cut into tokens once, a repeated key keeps its texts apart, and pairs are found behind one exchange of the sets."""
    cuts = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def cut(text):
        cuts.add(1)
        return sorted(set(text.split()))

    words = [f"w{i:02}" for i in range(12)]
    texts = [(1, words), (2, words[:11]), (2, [*words[1:], "zz"]), (3, words), (4, words[:5])]
    rows = spark.createDataFrame([(k, " ".join(t)) for k, t in texts], "key long, text string").select("key", cut("text").alias("tokens"))
    with Scratch(spark) as scratch:
        found = sorted((x.a, x.b, x.kind, round(x.similarity, 6)) for x in texts_plans.alike(rows, scratch).collect())
        assert cuts.value == len(texts)
        assert found == [(1, 2, "pair", round(11 / 13, 6)), (1, 2, "pair", round(11 / 12, 6)), (1, 3, "member", 1.0)]
        sets = similarity.numbered_sets(rows.where("key <> 2 or size(tokens) = 11"), "key", "tokens", 8, scratch)
        plan = similarity.alike(sets, 0.72)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        assert plan.count("Exchange ") - plan.count("BroadcastExchange ") == 1


def test_reposts_cut_texts_once_and_ship_no_candidates(spark):
    """Each text is cut into tokens once; like classes whose rows are far apart in time ask nothing of each other."""
    cuts = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def cut(text):
        cuts.add(1)
        return text.split()

    words = [f"w{i:02}" for i in range(12)]
    texts = [(1, 0, words), (2, 3, words[:11]), (3, 50, words[1:]), (4, 51, [*words, "w00"]), (5, 51, words[:5]), (6, None, words), (7, 55, words[:11])]
    rows = spark.createDataFrame([(k, d, " ".join(t)) for k, d, t in texts], "key long, day int, text string")
    rows = rows.select("key", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.col("day"))).alias("ts"), cut("text").alias("tokens"))
    with Scratch(spark) as scratch:
        found = sorted((x.key, x.earlier, round(x.similarity, 6)) for x in similarity.best_reposts(rows, scratch).collect())
    assert cuts.value == len(texts)
    assert found == [(2, 1, round(11 / 12, 6)), (4, 3, round(11 / 12, 6)), (7, 4, round(11 / 12, 6))]


def test_crowded_keys_are_copied_few_times(spark):
    """Six and five thousand rows of one key meet in one tile: what is shuffled is the rows, not a copy for each two thousand."""

    def shuffled(node):
        metric = node.metrics().get("shuffleRecordsWritten")
        below = [node.children().apply(i) for i in range(node.children().size())]
        return (metric.get().value() if metric.isDefined() else 0) + sum(map(shuffled, below))

    a, b = spark.range(6000).select(F.lit(1).alias("k"), F.col("id").alias("x")), spark.range(5000).select(F.lit(1).alias("k"), F.col("id").alias("y"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = tiles.tiled_join(a, b, ["k"])._jdf.queryExecution()
        assert made.toRdd().count() == 30_000_000
        assert shuffled(made.executedPlan()) == 11_000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
