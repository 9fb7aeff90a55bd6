"""Sources, dates, entity resolution and stream operators on small cases."""

import datetime as dt

from pyspark.sql import functions as F

from lodestay.functions import dates
from lodestay.operators import entities
from lodestay.sources import files
from lodestay.streaming import feeds


def test_run_log_skips_bad_lines(spark, tmp_path):
    (tmp_path / "run.log").write_text("2024-01-02 03:04:05 START full\nnoise\n2024-01-02 04:00:00 END posts=3\n")
    rows = files.run_log(spark, str(tmp_path)).orderBy("ts").collect()
    assert [(r.event, r.detail) for r in rows] == [("START", "full"), ("END", "posts=3")]


def test_parsed_posts_skips_bad_json(spark):
    posts = spark.createDataFrame([(1, '{"rooms": 3}'), (2, "{oops"), (3, None), (4, '{"price": 1}')], "k int, j string")
    assert [r.k for r in files.parsed_posts(posts, "j", "rooms int, price int", "rooms").collect()] == [1]


def test_departures_and_headways(spark, tmp_path):
    (tmp_path / "calendar.txt").write_text("service_id,sunday,end_date\na,1,20240301\nb,1,20230101\nc,0,20240301\nd,1,soon\n")
    (tmp_path / "trips.txt").write_text("route_id,service_id,trip_id,direction_id\nr,a,t1,0\nr,b,t2,0\nr,c,t3,0\nr,d,t4,0\n")
    times = "".join(f"{t},{h}:00:00,s,{i}\n" for i, (t, h) in enumerate([("t1", "08"), ("t1", "25"), ("t2", "09"), ("t3", "10"), ("t4", "21"), ("t4", "06")]))
    (tmp_path / "stop_times.txt").write_text("trip_id,departure_time,stop_id,stop_sequence\n" + times)
    trips = files.departures(spark, str(tmp_path), "sunday", "2024-02-01")
    assert sorted((r.trip_id, r.hour) for r in trips.collect()) == [("t1", 1), ("t1", 8), ("t4", 6), ("t4", 21)]
    assert [tuple(r) for r in files.headways(trips).collect()] == [("s", "r", "0", 450)]


def test_placemarks_need_three_points(spark, tmp_path):
    ring = "<Polygon><outerBoundaryIs><LinearRing><coordinates>{}</coordinates></LinearRing></outerBoundaryIs></Polygon>"
    body = "".join(f"<Placemark><name> {n} </name>{ring.format(c)}</Placemark>" for n, c in [("zone", "34.1,32.0,0 34.2,32.0,0\n34.2,32.1,0"), ("line", "34.1,32.0 34.2,32.0")])
    (tmp_path / "z.kml").write_text(f"<kml><Document>{body}</Document></kml>")
    rows = files.placemarks(spark, str(tmp_path)).collect()
    assert [r.name for r in rows] == ["zone"] and [tuple(p) for p in rows[0].ring] == [(32.0, 34.1), (32.0, 34.2), (32.1, 34.2)]


def test_saved_mail_prefers_plain_text(spark, tmp_path):
    (tmp_path / "a.eml").write_text('Subject: two\nMIME-Version: 1.0\nContent-Type: multipart/alternative; boundary="x"\n\n--x\nContent-Type: text/html\n\n<b>no</b>\n--x\nContent-Type: text/plain\n\nyes\n--x--\n')
    (tmp_path / "b.eml").write_text("Subject: one\nContent-Type: text/html\n\n<b>only</b>\n")
    rows = {r.subject: (r.body.strip(), r.is_html) for r in files.saved_mail(spark, str(tmp_path)).collect()}
    assert rows == {"two": ("yes", False), "one": ("<b>only</b>", True)}


def test_dates(spark):
    rows = spark.createDataFrame([("from 1.9 or 15/10",), ("in march",), ("13.13 may",), ("none",), (None,)], "t string")
    assert [tuple(r) for r in rows.select(dates.month_of(F.col("t")), dates.entry_dates(F.col("t"))).collect()] == [(9, "01.09, 15.10"), (3, None), (None, None), (None, None), (None, None)]
    ages = spark.createDataFrame([("30 min",), ("2d",), ("1 W",), ("now",), (None,)], "t string").select(dates.age_hours(F.col("t")).alias("h"))
    assert [r.h for r in ages.collect()] == [0.5, 48.0, 168.0, None, None]
    assert [r[0] for r in ages.select(dates.age_passes(F.col("h"))).collect()] == [True, False, False, True, True]
    day = spark.sql("select timestamp '2024-01-02 09:59:00' t union all select timestamp '2024-01-02 10:00:00'").select(dates.quota_day(F.col("t")))
    assert sorted(r[0].day for r in day.collect()) == [1, 2]


def test_clusters_follow_chains_inside_an_address(spark):
    rows = [(1, "a", "x"), (2, "a", "x"), (2, "a", "y"), (3, "a", "y"), (4, "a", "z"), (5, "b", "x"), (6, "a", None), (3, "a", "y")]
    found = entities.shared_contact_clusters(spark.createDataFrame(rows, "k int, a string, c string"), "k", "a", "c")
    assert sorted(map(tuple, found.collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6)]


def test_prune_keeps_the_last_row(spark):
    rows = spark.createDataFrame([(1, "a", True), (2, "a", False), (3, "b", False), (4, "b", None)], "k int, g string, ok boolean")
    assert sorted(r.k for r in entities.prune_orphans(rows, "g", F.col("ok"), [F.col("k")]).collect()) == [1, 3]


def test_successor_is_another_row(spark):
    rows = spark.createDataFrame([(1, "p", 5), (2, "p", 9), (3, "p", 9), (4, "q", 1), (5, None, 1)], "k int, phone string, score int")
    assert sorted(map(tuple, entities.successor(rows, "k", "phone", "score").collect())) == [(1, 2), (2, 3), (3, 2), (4, None)]


def test_merge_earliest_refuses_later_than_seen_and_repeats(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    schema = "k int, posted_at timestamp, first_seen timestamp"
    old = spark.createDataFrame([(1, t(5), t(8)), (2, None, t(3))], schema)
    new = spark.createDataFrame([(1, t(4), t(9)), (1, t(9), t(10)), (2, t(4), t(6)), (3, t(1), t(2))], schema)
    once = feeds.merge_earliest(old, new, "k")
    assert sorted(map(tuple, once.collect())) == [(1, t(4), t(8)), (2, None, t(3)), (3, t(1), t(2))]
    assert sorted(map(tuple, feeds.merge_earliest(once, new, "k").collect())) == sorted(map(tuple, once.collect()))


def test_dangling_starts(spark, tmp_path):
    t = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    starts = [(1, t(1)), (2, t(1)), (9, t(20))]
    ends = [(1, t(2)), (2, t(4)), (9, t(20, 30))]
    for name, rows in (("s", starts), ("e", ends)):
        spark.createDataFrame(rows, "run int, ts timestamp").coalesce(1).write.parquet(str(tmp_path / name))
    read = lambda name: spark.readStream.schema("run int, ts timestamp").parquet(str(tmp_path / name))
    found = feeds.drain(feeds.dangling(read("s"), read("e"), "run"), str(tmp_path / "out"), str(tmp_path / "state"), "append")
    assert [(r.run, r.start_ts) for r in found.collect()] == [(2, t(1))]
