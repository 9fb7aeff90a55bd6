import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestay.functions.geo import flat_metres
from lodestay.operators import houses, intervals, nearest
from lodestay.storage import Scratch


def metres(p, t):
    return math.hypot((t[0] - p[0]) * 111320.0, (t[1] - p[1]) * 111320.0 * math.cos(math.radians(p[0])))


def scattered(r, n):
    """Points of a dense town, a few villages and empty land, some at one place."""
    out = [(32 + r.gauss(0, 0.002), 34.8 + r.gauss(0, 0.002)) for _ in range(n)]
    out += [(31 + r.random() * 3, 34 + r.random() * 2) for _ in range(n // 5)]
    return out + out[: n // 10]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_nearest_equals_brute_force(spark, seed, monkeypatch):
    r = random.Random(seed)
    monkeypatch.setattr(nearest, "LEAF", 4 if seed < 3 else 1)
    if seed == 2:
        monkeypatch.setattr(nearest, "BROADCAST_CELLS", 0)
    targets = [(f"t{i % 40}", *p) for i, p in enumerate(scattered(r, 80))]
    points = scattered(r, 60) + [targets[0][1:], (None, 34.0), (10.0, 10.0), (90.0, 180.0)]
    with Scratch(spark) as scratch:
        t = spark.createDataFrame([*targets, ("none", None, 34.0)], "name string, lat double, lon double")
        p = spark.createDataFrame(points, "lat double, lon double")
        found = {(x.lat, x.lon): (x.name, x.metres) for x in nearest.nearest(p, t, "name", scratch).collect()}
        wanted = {q: min((metres(q, x[1:]), x[0]) for x in targets) for q in points if None not in q}
        assert set(found) == set(wanted)
        for q, (far, name) in wanted.items():
            assert math.isclose(found[q][1], far, rel_tol=1e-9, abs_tol=1e-6) and found[q][0] == name
        assert nearest.nearest(p, t.limit(0), "name", scratch).count() == 0 and nearest.nearest(p.limit(0), t, "name", scratch).count() == 0


def test_nearest_of_a_group_and_one_place(spark):
    r = random.Random(9)
    targets = [(r.choice("ab"), f"t{i}", *p) for i, p in enumerate(scattered(r, 60))]
    points = [(r.choice("abc"), *p) for p in scattered(r, 40)]
    with Scratch(spark) as scratch:
        t, p = spark.createDataFrame(targets, "g string, name string, lat double, lon double"), spark.createDataFrame(points, "g string, lat double, lon double")
        found = {(x.g, x.lat, x.lon): x.name for x in nearest.nearest(p, t, "name", scratch, by=["g"]).collect()}
        assert found == {q: min((metres(q[1:], x[2:]), x[1]) for x in targets if x[0] == q[0])[1] for q in points if q[0] != "c"}
        same = spark.createDataFrame([("z", 1.0, 1.0), ("y", 1.0, 1.0)] * 100, "name string, lat double, lon double")
        assert [tuple(x) for x in nearest.nearest(same.drop("name"), same, "name", scratch).collect()] == [(1.0, 1.0, "y", 0.0)]


def test_houses_bind_to_streets(spark):
    vertices = spark.createDataFrame([("a", 32.0, 34.0), ("a", 32.001, 34.0), ("b", 32.0, 34.01)], "street string, lat double, lon double")
    houses = [(1, "a", 32.0005, 34.0), (2, "a", 32.1, 34.0), (3, "unknown", 50.0, 50.0), (4, None, 32.0, 34.0101), (5, None, 33.0, 34.0), (6, None, None, None), (7, "a", None, None), (8, None, 32.0, 34.0101)]
    rows = spark.createDataFrame(houses, "id int, street string, lat double, lon double")
    with Scratch(spark) as scratch:
        found = {x.id: (x.how, x.bound) for x in nearest.bound_to_streets(rows, vertices, scratch).collect()}
    assert found == {1: ("by name", "a"), 2: ("far from name", None), 3: ("by name", "unknown"), 4: ("by distance", "b"), 5: ("too far", None), 6: ("too far", None), 7: ("far from name", None), 8: ("by distance", "b")}


BASE = datetime(2024, 1, 1)


def spans(r, n):
    out = []
    for i in range(n):
        a = BASE + timedelta(seconds=r.randrange(40 * 86400))
        out.append((i, a, a + timedelta(seconds=int(r.choice([0, 30, 90, 5400, 86400 * 3, 86400 * 60, -50]) * r.random()))))
    return [*out, (n, None, BASE), (n + 1, BASE, None), (n + 2, BASE, BASE + timedelta(days=365 * 200))]


def good(s):
    return s[1] is not None and s[2] is not None and s[1] <= s[2]


@pytest.mark.parametrize("seed", [1, 2])
def test_containment_overlap_and_counts_equal_brute_force(spark, seed):
    r = random.Random(seed)
    runs, slots = spans(r, 120), [(i, BASE + timedelta(seconds=r.randrange(45 * 86400))) for i in range(80)] + [(998, None)]
    slots += [(1000 + i, t) for i, s in enumerate(runs[:20]) for t in s[1:3] if t]
    a = spark.createDataFrame(runs, "run int, a timestamp_ntz, b timestamp_ntz")
    s = spark.createDataFrame(slots, "slot int, at timestamp_ntz")
    wanted = sorted((i, j) for i, t in slots if t for j, lo, hi in filter(good, runs) if lo <= t <= hi)
    assert sorted((x.slot, x.run) for x in intervals.containing(s, a, "at", "a", "b").collect()) == wanted
    assert intervals.containing(s, a.limit(0), "at", "a", "b").count() == 0
    with Scratch(spark) as scratch:
        counts = sorted((x.slot, x.at, x.n) for x in intervals.held(s.where("at is not null"), a, "at", "a", "b", "n", scratch).collect())
        assert counts == sorted((i, t, sum(lo <= t <= hi for _, lo, hi in filter(good, runs))) for i, t in slots if t)
        assert intervals.held(s, a, "at", "a", "b", "n", scratch).where("at is null").first().n == 0
    others = spans(r, 60)
    b = spark.createDataFrame([(i + 5000, *x) for i, *x in others], "other int, c timestamp_ntz, d timestamp_ntz")
    pairs = sorted((i, j + 5000) for i, lo, hi in filter(good, runs) for j, c, d in filter(good, others) if lo <= d and c <= hi)
    assert sorted((x.run, x.other) for x in intervals.overlapping(a, b, ("a", "b"), ("c", "d")).collect()) == pairs


def test_runs_and_slots_without_a_line(spark):
    hour = lambda d, h, m=0: BASE + timedelta(days=d, hours=h, minutes=m)
    log = [(hour(0, 8), "START"), (hour(0, 9), "START"), (hour(0, 11), "END"), (hour(0, 13), "END"), (hour(0, 23), "START"), (hour(1, 8, 30), "END"), (hour(1, 14), "SKIP")]
    rows = spark.createDataFrame(log, "ts timestamp, event string")
    with Scratch(spark) as scratch:
        assert sorted(tuple(x) for x in intervals.runs_of(rows, scratch).collect()) == [(hour(0, 9), hour(0, 11)), (hour(0, 23), hour(1, 8, 30))]
        found = {x.slot: x.fate for x in intervals.silent_slots(rows, [8, 10, 14], 7, scratch).collect()}
        assert found == {hour(0, 10): "eaten", hour(0, 14): "silent", hour(1, 8): "eaten", hour(1, 10): "silent"}
        assert intervals.silent_slots(rows.limit(0), [8], 7, scratch).count() == 0


def test_chains_of_anchors_equal_the_sequential_loop(spark):
    r = random.Random(6)
    for _ in range(3):
        rows, place = [], 0
        for street in "abc":
            for _ in range(60):
                place += 1
                off = r.choice([None, 50.0]) if r.random() < 0.06 else 900.0
                rows.append((street, place, 32 + r.random() * 0.01, 34.8 + r.random() * 0.01, off) if r.random() < 0.95 else (street, place, None, None, off))
        r.shuffle(rows)
        held, wanted = {}, set()
        for street, k, lat, lon, off in sorted(rows, key=lambda x: x[1]):
            ok = off is None or off <= 200
            if not ok and lat is not None:
                ok = any(haversine(lat, lon, *o) <= 200 for o in held.get(street, []))
            if ok:
                wanted.add(k)
                if lat is not None:
                    held.setdefault(street, []).append((lat, lon))
        with Scratch(spark) as scratch:
            df = spark.createDataFrame(rows, "street string, place int, lat double, lon double, off double")
            assert {x.place for x in houses.chained(df, scratch).collect()} == wanted and len(wanted) > 20
            assert houses.chained(df.limit(0), scratch).count() == 0


def haversine(lat1, lon1, lat2, lon2):
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(a))


def test_descent_keeps_no_cells(spark, monkeypatch):
    """Of 800 points that go down six levels and more, tables hold the points and their answers alone, not the cells that they meet."""
    monkeypatch.setattr(nearest, "LEAF", 1)
    k, kept = F.col("id"), []

    class Counted(Scratch):
        def write(self, df, label):
            table = super().write(df, label)
            kept.append((label, table.count()))
            return table

    points = spark.range(800).select((32 + k * 37 % 801 * 0.0001).alias("lat"), (34 + k * 53 % 799 * 0.0001).alias("lon"))
    targets = spark.range(400).select(k.cast("string").alias("name"), (32 + k * 7 % 401 * 0.0002).alias("lat"), (34 + k * 11 % 397 * 0.0002).alias("lon"))
    with Counted(spark) as scratch:
        found = {(r.lat, r.lon): r.metres for r in nearest.nearest(points, targets, "name", scratch).collect()}
        far = flat_metres(F.col("lat"), F.col("lon"), F.col("t.lat"), F.col("t.lon"))
        wanted = points.crossJoin(targets.select(F.struct("lat", "lon").alias("t"))).groupBy("lat", "lon").agg(F.min(far).alias("metres"))
        assert found == {(r.lat, r.lon): r.metres for r in wanted.collect()} and len(found) == 800
    assert sum(n for label, n in kept if label not in ("sites", "cells")) == 1600


def test_crowded_leaves_are_cut(spark, monkeypatch):
    """One level of sixteen cells of at most two targets a list: leaves of many targets are several lists, of which the nearest counts."""
    monkeypatch.setattr(nearest, "LEAF", 2)
    monkeypatch.setattr(nearest, "DEPTH", 1)
    r = random.Random(5)
    points, targets = scattered(r, 40), scattered(r, 90)
    p = spark.createDataFrame(points, "lat double, lon double")
    t = spark.createDataFrame([(f"t{i}", *x) for i, x in enumerate(targets)], "name string, lat double, lon double")
    with Scratch(spark) as scratch:
        found = {(x.lat, x.lon): x.metres for x in nearest.nearest(p, t, "name", scratch).collect()}
    assert set(found) == set(points)
    assert all(math.isclose(found[x], min(metres(x, y) for y in targets), rel_tol=1e-9, abs_tol=1e-6) for x in points)


def shuffled(spark) -> dict[int, int]:
    """Records that each stage so far has written for shuffles."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty()
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return {s.stageId(): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}


def test_targets_are_not_copied_below_their_leaf(spark):
    """Of 3000 targets whose leaves lie three levels down, and no cell is large, shuffles take a few rows each and not one for every level of the tree."""
    k = F.col("id")
    targets = spark.range(3000).select(k, k.cast("string").alias("name"), (32 + k * 37 % 3001 * 0.0001).alias("lat"), (34 + k * 53 % 2999 * 0.0001).alias("lon"))
    before = shuffled(spark)
    with Scratch(spark) as scratch:
        assert [x.name for x in nearest.nearest(targets.where("id = 77"), targets, "name", scratch).collect()] == ["77"]
    assert sum(n for stage, n in shuffled(spark).items() if stage not in before) < 5 * 3000
