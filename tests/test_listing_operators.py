import random

import pytest
from pyspark.sql import functions as F

from lodestay import storage
from lodestay.functions import facts, geo, text
from lodestay.operators import amenities, dedup, entities, houses, reports, resolver, scoring, search, streets, upserts
from lodestay.plans import addresses as made
from lodestay.storage import Scratch


def test_landlords_join_by_phone_and_contactless_rows(spark):
    rows = [
        ("a", "g1", "054-3376992, 052-3252255", 1000), ("b", "g1", "054-3376992", 1100), ("c", "g1", None, None), ("d", "g1", None, 900),
        ("e", "g2", "052-1111111", 1), ("f", "g2", "052-2222222", 1), ("g", "g2", None, 1), ("h", None, "052-1111111", 1), ("i", "g3", None, 7),
        ("j", "g4", "052-1111111", 5), ("k", "g4", "", 5), ("l", "g4", None, 6),
    ]
    found = {r.key: r.cluster for r in dedup.landlords(spark.createDataFrame(rows, "key string, address_group string, contact string, price int")).collect()}
    assert found == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "f", "g": "g", "h": "h", "i": "i", "j": "j", "k": "j", "l": "l"}


def test_clusters_equal_brute_force_on_long_chains(spark):
    r = random.Random(2)
    rows = [(i, i % 2, c) for i in range(200) for c in {i // 2, (i + 3) // 2, r.randrange(500)}]
    found = {x.k: x.cluster for x in entities.shared_contact_clusters(spark.createDataFrame(rows, "k long, a long, c long"), "k", "a", "c").collect()}
    root, changed = {i: i for i in range(200)}, True
    while changed:
        changed = False
        least = {}
        for i, a, c in rows:
            least[a, c] = min(least.get((a, c), i), root[i])
        for i, a, c in rows:
            if least[a, c] < root[i]:
                root[i], changed = least[a, c], True
    assert found == root


def test_merge_keeps_the_richest_and_absorbs_vague_rows(spark):
    rows = [
        ("phone:1", "רגר 93", "רגר", 1000, 2, 3, "054-3376992", 50), ("hash:2", "ברגר 93", "רגר", None, 2, 3, "054-3376992", 90),
        ("hash:3", "ליד האוניברסיטה", None, 1000, 2, None, "0543376992", 10), ("hash:4", "ליד הים", None, 1000, 3, None, "0543376992", 10),
        ("hash:5", "מגדל 7", "מגדל", 1, 2, 3, "054-3376992", 5), ("phone:6", "מגדל 7", "מגדל", 1, 2, 3, "054-3376992", 5), ("hash:7", None, None, None, None, None, None, None),
    ]
    listings = spark.createDataFrame(rows, "key string, address string, street string, price int, rooms int, mates int, contact string, score int")
    towers = spark.createDataFrame([("addr:מגדל|7",)], "address_group string")
    found = {r.key: r.keeper for r in dedup.merge_duplicates(listings, towers).collect()}
    assert found == {"phone:1": "phone:1", "hash:2": "phone:1", "hash:3": "phone:1", "hash:4": "hash:4", "hash:5": "hash:5", "phone:6": "phone:6", "hash:7": "hash:7"}


def test_known_posts_and_first_reason(spark):
    posts = spark.createDataFrame([(1, ["a", "b"], "0521234567", "x 1"), (2, ["c"], "052-1234567", "near x"), (3, ["c"], "052-1234567", "x 2"), (4, ["d"], None, None)], "id int, dedup_keys array<string>, contact string, address string")
    seen = spark.createDataFrame([("b",), ("phone:521234567|y|1",)], "key string")
    assert {r.id for r in dedup.known_posts(posts, seen, "id").collect()} == {1, 2}
    good = "דירה עם הרבה מילים כדי שלא תהיה תמונה בלבד כאן"
    rows = [(1, "u", good, []), (2, "v", "no word of it, but quite long enough a text", []), (3, "w", good, []), (4, "x", "דירה", ["i"]), (5, "y", good + " עוד", []), (6, "z", None, ["i"])]
    posts = spark.createDataFrame(rows, "id int, url string, text string, images array<string>")
    sigs = posts.where("id in (3, 4)").select(text.signature(F.col("text")).alias("sig"))
    found = dedup.first_reason(posts, spark.createDataFrame([("u",)], "url string"), sigs, spark.createDataFrame([(5, 1), (1, 9)], "id int, of int"), "id")
    assert {r.id: (r.status, r.reason) for r in found.collect()} == {1: ("DROP", "already seen (url)"), 2: ("NOT_AD", "no keyword"), 3: ("DROP", "already seen (text)"), 5: ("DROP", "repost of 1")}


def test_short_tokens_differ_where_prefixes_are_equal(spark):
    rows = spark.createDataFrame([(f"k{i}",) for i in range(300)], "k string")
    found = dedup.short_tokens(rows, "k", 2).collect()
    assert len({r.token for r in found}) == 300 and any(len(r.token) > 2 for r in found)


def test_houses_equal_a_plain_ladder(spark):
    r = random.Random(3)
    anchors, wanted, line = [], [], [31.99 + i * 0.002 for i in range(12)]
    for s in range(12):
        for n in r.sample(range(1, 80), r.choice([1, 2, 5, 20])):
            anchors.append((f"s{s}", n, 32.0 + n * 1e-4, 34.0 + (2e-4 if n % 2 else -2e-4)))
        wanted += [(f"s{s}", n) for n in range(1, 100, 3)]
    vertices = spark.createDataFrame([(f"s{s}", la, 34.0) for s in range(12) for la in line], "street string, lat double, lon double")
    found = {(x.street, x.number): x for x in houses.place(spark.createDataFrame(wanted, "street string, number int"), spark.createDataFrame(anchors, "street string, number int, lat double, lon double"), vertices, typical=11.132).collect()}
    by_street = {}
    for s, n, la, lo in anchors:
        by_street.setdefault(s, {})[n] = (la, lo)
    for s, n in wanted:
        known = by_street[s]
        same = sorted(k for k in known if k % 2 == n % 2)
        every = sorted(known)
        near = min(same, key=lambda k: (abs(k - n), k), default=None)
        used = same if len(same) >= 2 and same[0] <= n <= same[-1] else every
        if n in known:
            how, lat = "osm_addr", known[n][0]
        elif same and not same[0] <= n <= same[-1] and abs(near - n) <= 2:
            how, lat = "anchor_neighbour", known[near][0]
        elif len(used) >= 2 and used[0] <= n <= used[-1]:
            how, lat = "interpolated", 32.0 + n * 1e-4
        elif len(every) >= 2 and max(every[0] - n, n - every[-1]) * 11.132 <= 150.01:
            how, lat = "extrapolated", 32.0 + n * 1e-4
        elif len(every) == 1 and abs(every[0] - n) * 11.132 <= 150.01:
            how, lat = "projected", None
        else:
            how, lat = None, None
        got = found.get((s, n))
        assert (got.how if got else None) == how, (s, n, every)
        assert lat is None or abs(got.lat - lat) < 1e-7


def test_axes_gaps_and_middles(spark):
    vertices = spark.createDataFrame([("v", 32.0, 34.0), ("v", 32.01, 34.001), ("w", 32.0, 34.0), ("w", 32.0001, 34.02), ("x", 1.0, 1.0), ("y", 32.0, 34.0), ("y", 32.4, 34.0)], "street string, lat double, lon double")
    assert {r.street: r.along for r in houses.axes(vertices).collect()} == {"v": "lat", "w": "lon", "y": "lat"}
    anchors = spark.createDataFrame([("v", 1, 32.0, 34.0), ("v", 3, 32.0002, 34.0), ("v", 4, 32.0004, 34.0)], "street string, number int, lat double, lon double")
    assert abs(houses.typical_gap(anchors, houses.axes(vertices)) - (11.132 + 22.264) / 2) < 0.01
    middles = {r.street: (round(r.lat, 4), round(r.lon, 4)) for r in houses.street_middle(vertices).collect()}
    assert middles == {} or "y" not in middles
    assert {r.street: r.one_road for r in houses.one_road(vertices.union(vertices)).collect()}["y"] is False


def test_longest_run_and_order_outliers(spark):
    def brute(values):
        best = 0
        for mask in range(1 << len(values)):
            pick = [v for i, v in enumerate(values) if mask >> i & 1]
            if pick == sorted(pick) or pick == sorted(pick, reverse=True):
                best = max(best, len(pick))
        return best

    r = random.Random(5)
    for _ in range(60):
        values = [r.randrange(9) for _ in range(r.randrange(9))]
        run = [values[i] for i in sorted(houses.longest_run(values))]
        assert len(run) == brute(values) and (run == sorted(run) or run == sorted(run, reverse=True))
    rows = [("s", 2 * i, 32.0 + 0.001 * i, 34.0) for i in range(1, 7)] + [("s", 14, 32.002, 34.0), ("s", 1, 32.0, 34.0), ("s", 3, 31.0, 34.0)]
    anchors = spark.createDataFrame(rows, "street string, number int, lat double, lon double")
    axis = spark.createDataFrame([("s", "lat", 31.0, 33.0)], "street string, along string, low double, high double")
    assert [tuple(x) for x in houses.order_outliers(anchors, axis).collect()] == [("s", 14)]
    kept = houses.audited(anchors, anchors.where("number = 2"), axis, 8.0).where("not kept").collect()
    assert {(x.number, x.why) for x in kept} >= {(3, "survey")}


def test_authority_and_snap(spark):
    rows = [("a", 1, 1.0, 1.0, "govmap"), ("a", 1, 2.0, 2.0, "osm"), ("a", 1, 3.0, 3.0, "user"), ("a", 2, 1.0, 1.0, "govmap"), ("b", 2, 5.0, 5.0, "osm"), ("a", 9, 4.0, 4.0, "osm")]
    anchors = spark.createDataFrame(rows, "street string, number int, lat double, lon double, source string")
    pools = spark.createDataFrame([("b", "a"), ("a", "a")], "name string, main string")
    hidden = spark.createDataFrame([("a", 9), ("a", 1)], "street string, number int")
    assert sorted(tuple(r) for r in houses.authoritative(anchors, hidden, pools).collect()) == [("a", 1, 3.0, 3.0, "user"), ("a", 2, 5.0, 5.0, "osm")]
    points = spark.createDataFrame([(1, 32.0, 34.0), (2, 33.0, 34.0)], "id int, lat double, lon double")
    buildings = spark.createDataFrame([(32.0001, 34.0), (32.0002, 34.0), (33.001, 34.0)], "lat double, lon double")
    assert {r.id: r.lat for r in houses.snap(points, buildings).collect()} == {1: 32.0001, 2: 33.0}


def test_rings_are_stitched(spark):
    p = lambda *xs: [{"lat": float(x), "lon": 0.0} for x in xs]
    ways = spark.createDataFrame([("r", p(1, 2)), ("r", p(3, 2)), ("r", p(3, 4, 1)), ("q", p(1, 2))], "ring string, points array<struct<lat double, lon double>>")
    found = {r.ring: [x.lat for x in r.points] for r in houses.stitched(ways).collect()}
    assert found == {"r": [1, 2, 3, 4, 1], "q": [1, 2]}


def test_pools_need_touching_vertices(spark):
    rows = [("ביאליק חיים", 32.0, 34.0), ("חיים ביאליק", 32.0001, 34.0), ("חיים ביאליק", 32.1, 34.0), ("כיכר האבות", 32.0, 34.0), ("האבות", 32.5, 34.0), ("בזל", 1.0, 1.0)]
    found = {(r.name, r.main) for r in streets.pools_of(spark.createDataFrame(rows, "name string, lat double, lon double")).collect()}
    assert found == {("ביאליק חיים", "חיים ביאליק"), ("חיים ביאליק", "חיים ביאליק")}


def test_messages_are_packed_greedily(spark):
    r = random.Random(1)
    lines = [(g, i, "x" * r.randrange(1, 60)) for g in range(3) for i in range(40)]
    rows = spark.createDataFrame(lines, "g int, i int, line string")
    for m in search.messages(rows, "g", "i", "line", 100, 5).collect():
        parts = m.body.split("\n")
        assert len(parts) <= 5 and (len(m.body) < 100 or len(parts) == 1)
    found = search.messages(rows, "g", "i", "line", 100, 5).orderBy("g", "message").collect()
    assert [x for m in found for x in m.body.split("\n")] == [x for _, _, x in lines]


def test_nearest_next_routes(spark):
    stops = spark.createDataFrame([("t", "a", 32.3, 34.0), ("t", "b", 32.1, 34.0), ("t", "c", 32.2, 34.0), ("u", "d", 1.0, 1.0)], "trip string, stop string, lat double, lon double")
    assert {r.trip: r.order for r in amenities.route(stops, (32.0, 34.0)).collect()} == {"t": ["b", "c", "a"], "u": ["d"]}


def test_stops_and_lines(spark):
    times = spark.createDataFrame([("t", "x", 1), ("t", "s", 2), ("t", "y", 3), ("u", "y", 1), ("v", "s", 1), ("v", "x", 2)], "trip_id string, stop_id string, sequence int")
    before = amenities.before_station(times, spark.createDataFrame([("s",)], "stop_id string"))
    assert [tuple(r) for r in before.select("trip_id", "stop_id").collect()] == [("t", "x")]
    stops = spark.createDataFrame([("a", "north station", 32.0, 34.0), ("b", "b", 32.001, 34.0), ("c", "c", 32.01, 34.0)], "stop_id string, stop_name string, lat double, lon double")
    assert {r.stop_id for r in amenities.station_stops(stops, "station", (0.0, 0.0)).collect()} == {"a", "b"}
    assert {r.stop_id for r in amenities.station_stops(stops, "none", (32.01, 34.0)).collect()} == {"c"}
    lines = spark.createDataFrame([("1", 0, "x st"), ("1", 0, "y"), ("1", 1, "y"), ("2", 0, "z")], "line string, direction int, stop_name string")
    assert {tuple(r) for r in amenities.on_street_or_all(lines, "st").collect()} == {("1", 0, "x st"), ("1", 1, "y"), ("2", 0, "z")}
    heads = spark.createDataFrame([("a", "2", 10), ("a", "1", 10), ("a", "0", None)], "stop_id string, line string, minutes int")
    assert [tuple(r) for r in amenities.best_lines(heads).collect()] == [("a", "1", 10)]
    points = spark.createDataFrame([("t", "foo 1", 3), ("t", "bar", 1), ("t", "foo 2", 2), ("u", "none", 1)], "target string, name string, rank int")
    assert [r.name for r in amenities.resolved(points, ["foo", "bar"], 2).orderBy("pattern", "rank").collect()] == ["foo 2", "foo 1"]
    assert amenities.without_crowds(points, 2).count() == 1


def made_log(spark, lines):
    return spark.createDataFrame([(t, e, d) for t, e, *rest in lines for d in [rest[0] if rest else ""]], "ts string, event string, detail string").withColumn("ts", F.col("ts").cast("timestamp"))


def test_flags_belong_to_the_next_end_whatever_the_day(spark):
    lines = [("2024-01-01 01:00:00", "DOWN"), ("2024-01-01 02:00:00", "END"), ("2024-01-01 03:00:00", "END"), ("2024-01-01 23:55:00", "DOWN"), ("2024-01-03 00:10:00", "END"), ("2024-01-03 00:20:00", "DOWN")]
    rows = made_log(spark, lines)
    with Scratch(spark) as scratch:
        assert [r.flagged for r in reports.flagged_ends(rows, "DOWN", scratch).orderBy("ts").collect()] == [True, False, True]
        assert tuple(reports.degraded_share(rows, "DOWN", scratch).first()) == (3, 2, 0.6667)
        assert tuple(reports.degraded_share(rows.limit(0), "DOWN", scratch).first()) == (0, 0, None)


def plain_week(lines, now):
    pending, dangling, runs, blocked = None, 0, 0, 0
    for ts, event, *rest in lines:
        if event == "START":
            dangling += pending is not None
            pending = ts
        elif event == "END":
            pending = None
            stopped = bool(rest) and "block=" in rest[0]
            blocked, runs = blocked + stopped, runs + (not stopped)
    return runs, blocked, dangling + (pending is not None and pending < now)


def test_weekly_follows_starts_over_midnight_skips_and_blocks(spark):
    night = [("2024-01-01 23:58:00", "START"), ("2024-01-02 00:30:00", "START"), ("2024-01-02 00:31:00", "SKIP"), ("2024-01-02 00:40:00", "START"), ("2024-01-02 00:50:00", "ABORT"), ("2024-01-02 01:00:00", "END", "full  60s posts=5 match=2 needs=1 read=9 age_skip=3 seen_skip=1"), ("2024-01-02 02:00:00", "END", "full posts=50 match=2 needs=1 block=1"), ("2024-01-02 03:00:00", "END", "posts=7")]
    with Scratch(spark) as scratch:
        for end in ([], [("2024-01-02 04:00:00", "START")], [("2024-01-02 05:30:00", "START")]):
            row = reports.weekly(made_log(spark, night + end), F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-02 07:00:00").cast("timestamp"), scratch).first()
            runs, blocked, dangling = plain_week(night + end, "2024-01-02 05:00:00")
            assert tuple(row) == (runs, 1, blocked, dangling, 5, 2, 1, 9, 3, 1)
        empty = reports.weekly(made_log(spark, night).limit(0), F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-02").cast("timestamp"), scratch).first()
        assert tuple(empty) == (0,) * 10


def test_refusals_health_and_accuracy(spark):
    errors = spark.createDataFrame([("m", "429 quota: limit: 20, retry in 12.5s"), ("m", "Rate limit"), ("n", "other")], "model string, text string")
    assert [tuple(r) for r in reports.refusals(errors).collect()] == [("m", 2, 20, 12.5)]
    checks = spark.createDataFrame([("a", 1.0, 2.0, 3.0), ("b", 2.0, 2.0, 3.0), ("c", None, 2.0, 3.0)], "name string, value double, warn double, fail double")
    assert [r.status for r in reports.health(checks).orderBy("name").collect()] == ["ok", "warn", "fail"]
    rows = spark.createDataFrame([("t", float(i)) for i in range(10)] + [("t", None), ("u", None)], "tier string, m double")
    assert {r.tier: (r.n, r.unresolved, r.p50, r.p90, r.most) for r in reports.accuracy(rows, "tier", "m").collect()} == {"t": (10, 1, 5.0, 9.0, 9.0), "u": (0, 1, None, None, None)}


def test_upserts_keep_what_they_should(spark, tmp_path):
    old = spark.createDataFrame([(1, '["a"]'), (2, "[]")], "k int, images string")
    new = spark.createDataFrame([(1, "[]"), (2, '["b"]'), (3, "{}")], "k int, images string")
    assert sorted(tuple(r) for r in upserts.enrich(old, new, "k", [], [], ["images"]).collect()) == [(1, '["a"]'), (2, '["b"]'), (3, None)]
    a = spark.createDataFrame([("x", [1]), ("y", [2])], "k string, v array<int>")
    b = spark.createDataFrame([("x", []), ("y", [3]), ("z", [4])], "k string, v array<int>")
    assert {r.k: r.v for r in upserts.merge_without_erasing(a, b, "k", "v").collect()} == {"x": [1], "y": [3], "z": [4]}
    upserts.guarded_write(spark.range(11), 20, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        upserts.guarded_write(spark.range(9), 30, str(tmp_path / "t"))
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "v string")
    assert {r.v for r in upserts.newest(names, "v", 2).where("kept").collect()} == {"b", "c"}


def test_tier_rules(spark):
    rows = [
        ("רגר 93", "osm_addr", True, 5.0, 10.0, None, None, None, True), ("שכונה ב", "static_area", True, 5.0, 900.0, None, None, None, True), ("רגר", "street_geom", True, 5.0, 900.0, False, None, None, True),
        ("רגר 93", "osm_addr", False, 5.0, 30.0, None, None, None, True), ("שכונה ד, רגר 9", "osm_addr", False, 5.0, 30.0, None, None, None, True), ("רגר", "street_geom", True, 5.0, 100.0, True, 0.1, None, True),
        ("רגר", "street_geom", True, 5.0, 900.0, True, 0.1, None, True), ("רגר", "street_geom", True, 5.0, 900.0, True, 0.5, None, True), ("רגר", "street_geom", True, 5.0, 900.0, True, 0.9, None, True), ("רגר 9", "osm_addr", True, 5.0, 900.0, None, None, None, False),
    ]
    schema = "address string, geo_source string, inside boolean, walk_minutes double, edge_metres double, boundary_street boolean, street_in_range double, in_no_amber boolean, in_allowed boolean"
    found = scoring.with_tier(spark.createDataFrame(rows, schema)).collect()
    assert [r.tier for r in found] == ["GREEN", "AMBER", "AMBER", "GREEN", "RED", "GREEN", "RED", "GREEN", "GREEN", "RED"]
    assert [r.edge_uncertain for r in found] == [False, False, False, False, False, True, False, True, False, False]


def test_html_sections_and_small_texts(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.html_text(F.lit("<p>a&#1502;b &amp; c</p><style>x</style><br>d&#x41;"))) == "aמb & c\n\ndA"
    body = "intro\n" + "\n".join(f"FLAT {i} " + "word " * 10 for i in range(3))
    assert len(one(text.sections(F.lit(body), "^FLAT", None, 20))) == 3
    assert len(one(text.sections(F.lit("a" * 50 + "\n\n" + "b" * 50 + "\n\nshort"), "^FLAT"))) == 2
    assert one(facts.phones(F.lit("052 325 2255"))) == "052-3252255" and one(text.chat_link(F.lit("052-3252255"))) == "https://wa.me/972523252255"
    assert one(text.every_index_once(F.array(F.lit(1), F.lit(0)), F.lit(2))) is True and one(text.every_index_once(F.array(F.lit(0), F.lit(0)), F.lit(2))) is False
    assert one(text.core_token(F.lit("bus station centre"), ["station"])) == "centre"
    assert one(text.clean_url(F.lit("http://x/y/?a=1"))) == "http://x/y"
    east, north = geo.mercator(F.lit(32.0), F.lit(34.0))
    assert [round(v, 6) for v in spark.range(1).select(*geo.from_mercator(east, north)).first()] == [32.0, 34.0]


def test_no_shared_folder_outside_local_mode(spark, monkeypatch):
    class Session:
        conf = type("c", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("s", (), {"master": "local-cluster[2,1,1024]"})

    with pytest.raises(RuntimeError):
        storage.shared_dir(Session)
    Session.sparkContext.master = "local[2]"
    assert storage.shared_dir(Session)


def test_resolver_without_tables_and_with_odd_texts(spark):
    tables = {name: df.limit(0) for name, df in made.made_places(spark).items()}
    asked = spark.createDataFrame([("רגר 11",), ("רגר 11",), (None,), (" ",), ("x" * 5000,), ("ליד",)], "address string")
    found = resolver.resolve(asked, **tables, typical=8.0).collect()
    assert sorted((r.address, r.lat, r.source, r.confidence) for r in found) == sorted([("רגר 11", None, None, "none"), ("x" * 5000, None, None, "none"), ("ליד", None, None, "none")])


def test_places_are_found_where_python_finds_them(spark):
    r = random.Random(5)
    word = lambda most: "".join(r.choice("abc ") for _ in range(r.randrange(1, most)))
    texts = {resolver_text(word(14)) for _ in range(60)} - {""}
    names = {resolver_text(word(5)) for _ in range(40)}
    names = {n for n in names if len(n) >= 2}
    asked = spark.createDataFrame([(t, t) for t in texts], "address string, folded string")
    places = spark.createDataFrame([(n, 1) for n in names], "key string, rank int")
    found = {(x.address, x.key): x.pos for x in resolver.contained(asked, places).collect()}
    assert found == {(t, n): t.find(n) for t in texts for n in names if n in t} and len(found) > 50
    longer = {(x.address, x.key) for x in resolver.containing(spark.createDataFrame([(n * 2, n * 2) for n in names], "address string, folded string"), spark.createDataFrame([(f"{n * 2}a{n}", 1) for n in names], "key string, rank int")).collect()}
    assert longer == {(a * 2, f"{b * 2}a{b}") for a in names for b in names if len(a) >= 2 and a * 2 in f"{b * 2}a{b}"}


def resolver_text(text):
    return " ".join(text.split())


def test_a_word_of_nearness_governs_only_its_own_place(spark):
    cases = [("ליד הבלוק", 4, True), ("רגר 5, ליד הבלוק", 11, True), ("ליד הבלוק, מגדלי דוד", 11, False), ("הבלוק", 0, False), ("ליד " + "א" * 20 + " הבלוק", 25, False)]
    rows = spark.createDataFrame(cases, "t string, pos int, wanted boolean")
    assert all(r.found == r.wanted for r in rows.withColumn("found", resolver.governed(F.col("t"), F.col("pos"))).collect())
