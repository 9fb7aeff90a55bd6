import os
import random

import pytest
from pyspark.sql import functions as F

from lodestay.operators import changes, numbering, overrides, replay
from lodestay.operators.snapshots import Snapshots
from lodestay.storage import Scratch


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_versions_are_read_undone_and_pruned(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "t"))
    assert table.current is None and table.versions() == []
    with pytest.raises(KeyError):
        table.read()
    one = spark.createDataFrame([(1, "a")], "k int, v string")
    assert table.commit(one) == 1
    assert table.commit(table.read().unionByName(spark.createDataFrame([(2, None)], "k int, v string")), "more") == 2
    assert rows_of(table.read()) == [(1, "a"), (2, None)] and rows_of(table.read(1)) == [(1, "a")]
    assert table.undo() == 1 and rows_of(table.read()) == [(1, "a")]
    with pytest.raises(KeyError):
        table.undo()
    assert table.undo(to=2) == 2 and table.undo(to=1) == 1
    assert table.commit(spark.createDataFrame([(3, "c", 1.0)], "k int, v string, w double")) == 3
    assert table.versions() == [1, 2, 3] and table.prune(1) == [1, 2] and rows_of(table.read()) == [(3, "c", 1.0)]
    assert table.commit(one) == 4 and table.undo() == 3 and table.prune(1) == [] and table.versions() == [3, 4]


def test_a_crash_between_write_and_swap_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    table = Snapshots(spark, str(tmp_path / "t"))
    table.commit(spark.range(3).toDF("k"))
    monkeypatch.setattr(table, "_swap", lambda *_: (_ for _ in ()).throw(OSError("power cut")))
    with pytest.raises(OSError):
        table.commit(spark.range(9).toDF("k"))
    monkeypatch.undo()
    again = Snapshots(spark, str(tmp_path / "t"))
    assert again.read().count() == 3 and len([f for f in os.listdir(tmp_path / "t") if f.startswith("v-")]) == 2
    again.prune(5)
    assert len([f for f in os.listdir(tmp_path / "t") if f.startswith("v-")]) == 1
    assert again.commit(spark.range(4).toDF("k")) == 2 and again.read().count() == 4


def test_a_commit_notices_another_one(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "t"))
    table.commit(spark.range(1).toDF("k"))
    begun = table.manifest()
    Snapshots(spark, str(tmp_path / "t")).commit(spark.range(2).toDF("k"))
    with pytest.raises(RuntimeError):
        table._swap(begun, begun["current"])


def test_only_changed_buckets_are_read(spark, tmp_path):
    rows = [(i, f"v{i}", i % 5 or None) for i in range(300)]
    old = spark.createDataFrame(rows, "key int, v string, w int")
    edit = dict((r[0], r) for r in rows)
    del edit[7]
    edit[8] = (8, None, 3)
    edit[9] = (9, "v9", None)
    edit[1000] = (1000, "new", 1)
    new = spark.createDataFrame(list(edit.values()), "key int, v string, w int")
    table = Snapshots(spark, str(tmp_path / "t"))
    for version in (old, new, new.repartition(7)):
        table.commit(changes.with_bucket(version, "key", 64), partition_by=["bucket"])
    prints = [changes.fingerprint(table.read(v)) for v in (1, 2, 3)]
    differ = changes.changed_buckets(prints[0], prints[1])
    assert 1 <= len(differ) <= 4 and changes.changed_buckets(prints[1], prints[2]) == []
    found = changes.changes(table.read(1), table.read(2), "key", differ)
    assert dict(rows_of(found)) == {7: "deleted", 8: "updated", 9: "updated", 1000: "inserted"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
    assert changes.changed_buckets(prints[0], prints[0].limit(0)) == sorted(r.bucket for r in prints[0].collect())


def test_fingerprints_tell_nulls_swaps_and_copies_apart(spark):
    base = [(1, "a", None), (2, "b", "a")]
    variants = [base, [(1, None, "a"), (2, "b", "a")], [(1, "b", "a"), (2, "a", None)], base * 2, base * 3, [], [(1, "a", "")] + base[1:]]
    prints = [tuple(r) for v in variants for r in changes.fingerprint(spark.createDataFrame([(0, *x) for x in v], "bucket int, k int, v string, w string")).collect()]
    assert len(set(prints)) == len(prints) == 6
    same = changes.fingerprint(spark.createDataFrame([(0, *x) for x in base[::-1]], "bucket int, k int, v string, w string")).first()
    assert tuple(same) == prints[0]


def test_overrides_follow_sets_clears_and_clear_alls(spark):
    r = random.Random(2)
    for _ in range(12):
        events = [(r.choice(["set", "set", "clear", "clear_all"] if r.random() < 0.2 else ["set", "clear"]), r.choice(["a", "b", "c", None]), float(i), r.randrange(6), i) for i in range(r.randrange(25))]
        held = {}
        for kind, key, lat, _, _ in sorted(events, key=lambda e: (e[3], e[4])):
            if kind == "clear_all":
                held = {}
            elif kind == "set" and key:
                held[key] = lat
            else:
                held.pop(key, None)
        df = spark.createDataFrame(events, "kind string, key string, lat double, ts int, seq int")
        assert dict(map(tuple, overrides.current(df, "key", ["lat"]).collect())) == held


def test_relocating_regrades_only_what_moved(spark):
    rows = spark.createDataFrame([("a", 1.0, 1.0, "RED", "DROP", 0), ("b", 2.0, 2.0, "RED", "DROP", 0), ("c", None, None, None, "NEEDS_DATA", None)], "key string, lat double, lon double, tier string, status string, score int")
    points = spark.createDataFrame([("a", 5.0, 5.0), ("b", 2.0, 2.0), ("c", 6.0, 6.0), ("z", 1.0, 1.0)], "key string, lat double, lon double")
    seen = []

    def regrade(moved):
        seen.extend(r.key for r in moved.collect())
        return moved.withColumns({"tier": F.lit("GREEN"), "status": F.lit("MATCH"), "score": F.lit(9)})

    after, report = overrides.relocated(rows, points, "key", regrade)
    assert sorted(seen) == ["a", "c"]
    assert rows_of(after) == [("a", 5.0, 5.0, "GREEN", "MATCH", 9), ("b", 2.0, 2.0, "RED", "DROP", 0), ("c", 6.0, 6.0, "GREEN", "MATCH", 9)]
    assert {(r.key, r.before.status, r.after.status) for r in report.collect()} == {("a", "DROP", "MATCH"), ("c", "NEEDS_DATA", "MATCH")}


def test_replay_takes_posts_in_order_and_can_be_undone(spark, tmp_path):
    r = random.Random(7)
    posts = [(f"s{i}", i, r.choice(["MATCH", "NEEDS_DATA", "DROP", "NOT_AD"]), r.randrange(50), r.choice([None, "k1", "k2", "k3", "k4"]), r.choice([None, f"l{i}"])) for i in range(60)]
    rows = spark.createDataFrame([(s, p, "MATCH", 1, v, n, k, [x for x in (k, f"old-{k}") if x], n, lease) for s, p, v, n, k, lease in posts], "sig string, place int, verdict string, score int, new_verdict string, new_score int, dedup_key string, dedup_keys array<string>, price int, lease string")
    held = {"k1": (5, "first"), "old-k2": (6, None), "other": (7, "x")}
    for _, _, verdict, n, k, lease in posts:
        if verdict in ("MATCH", "NEEDS_DATA") and k:
            held[k] = (n, lease if lease is not None else held.get(k, (None, None))[1])
        elif verdict not in ("MATCH", "NEEDS_DATA") and k:
            held.pop(k, None)
            held.pop(f"old-{k}", None)
    table = Snapshots(spark, str(tmp_path / "t"))
    table.commit(spark.createDataFrame([("k1", 5, "first"), ("old-k2", 6, None), ("other", 7, "x")], "key string, price int, lease string"))
    report = replay.apply(table, rows, "key", ["price"], ["lease"])
    assert {r.key: (r.price, r.lease) for r in table.read().collect()} == held
    assert report["demoted"] == sum(v in ("DROP", "NOT_AD") for _, _, v, *_ in posts) and report["version"] == 2
    table.undo()
    assert table.read().count() == 3


def test_selectors_of_posts(spark):
    posts = spark.createDataFrame([("a", "שכונה ד", None), ("b", "רגר 5", 80), ("c", "רגר", 10), ("d", None, 90)], "sig string, address string, score int")
    assert {r.sig for r in replay.selected(posts, least_score=50).collect()} == {"b", "d"}
    assert {r.sig for r in replay.selected(posts, only_bare_quarter=True).collect()} == {"a"}
    assert {r.sig for r in replay.selected(posts, only_imprecise=True).collect()} == {"a", "c"}
    assert replay.selected(posts).count() == 4
    merged = spark.createDataFrame([("a", "Dana\n3 h\nflat\nDan\n5d\nother"), ("b", "Dana\n3 h\nflat"), ("c", None)], "sig string, text string")
    assert {r.sig for r in replay.selected(merged, only_merged=True).collect()} == {"a"}


def test_a_text_is_cut_where_a_second_post_begins(spark):
    import re

    from lodestay.functions import addresses, text

    def plain(t):
        lines = [x.strip() for x in (t or "").splitlines() if x.strip()]
        for i in range(2, len(lines)):
            if re.match(r"^\d{1,2}\s*[smhdw]$", lines[i]) and len(lines[i - 1]) <= 40:
                return "\n".join(lines[: i - 1])
        return "\n".join(lines)

    r = random.Random(5)
    bits = ["Dana Levi", "3 h", "12d", "x" * 41, "a flat of three rooms", "", "  ", "5 weeks", "99 m "]
    cases = ["\n".join(r.choice(bits) for _ in range(r.randrange(9))) for _ in range(200)] + ["a\r\nb\r\nDana\r\n3h\r\nrest"]
    rows = spark.createDataFrame([(c,) for c in cases], "t string").coalesce(1)
    found = rows.select(text.first_story(F.col("t")).alias("s"), text.holds_another_story(F.col("t")).alias("h")).collect()
    assert [x.s for x in found] == [plain(c) for c in cases]
    assert [x.h for x in found] == [plain(c) != "\n".join(x.strip() for x in c.splitlines() if x.strip()) for c in cases]
    shapes = spark.createDataFrame([("דירה " * 10, None), ("short דירה", None), ("english only " * 5, None), ("short", ["u"]), (None, ["u"]), (None, [])], "t string, i array<string>").coalesce(1)
    assert [x[0] for x in shapes.select(text.is_post(F.col("t"), F.col("i"))).collect()] == [True, False, False, True, True, False]
    places = spark.createDataFrame([("מרכז העיר",), ("רחוב רגר",), ("רגר 5",), ("שכונה ד",), ("5 דקות מהים",), (None,)], "a string").coalesce(1)
    assert [x[0] for x in places.select(addresses.vague(F.col("a"))).collect()] == [True, False, False, False, True, False]
    urls = spark.createDataFrame([("https://x.org/groups/1/posts/22/?a",), ("https://x.org/p?story_fbid=33&id=1",), ("https://x.org",)], "u string").coalesce(1)
    assert [x[0] for x in urls.select(text.post_id(F.col("u"))).collect()] == ["22", "33", None]


def test_numbers_totals_and_batches_of_any_partitioning(spark):
    r = random.Random(1)
    rows = [(r.randrange(40) if r.random() < 0.9 else None, i, r.choice([None, 0, 1, 5])) for i in range(300)]
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "a int, b int, v int").repartition(parts)
        with Scratch(spark) as scratch:
            placed = sorted(numbering.numbered(df, [F.desc_nulls_last("a"), "b"], "n", scratch).collect(), key=lambda x: x.n)
            assert [x.n for x in placed] == list(range(300))
            assert [(x.a, x.b) for x in placed] == [x[:2] for x in sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))]
            total = 0
            for x in sorted(numbering.running_total(df, ["b"], F.col("v"), "t", scratch).collect(), key=lambda x: x.b):
                assert x.t == total
                total += x.v or 0
            batches = numbering.batched(df, ["b"], 7, scratch).collect()
            assert {(x.batch, x["index"]) for x in batches} == {divmod(i, 7) for i in range(300)} and all(x.b == 7 * x.batch + x["index"] for x in batches)
            assert numbering.numbered(df.limit(0), ["b"], "n", scratch).count() == 0


def test_answers_of_a_batch_count_only_when_each_row_has_one(spark):
    rows = spark.createDataFrame([(b, i) for b in range(6) for i in range(3 if b < 5 else 1)], "batch long, index int")
    said = [(0, 0), (0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1), (2, 1), (3, 0), (3, 1), (3, 2), (3, 3), (4, 1), (4, 2), (4, 3), (5, 0), (9, 0)]
    answers = spark.createDataFrame([(b, i, f"{b}.{i}") for b, i in said], "batch long, index int, answer string")
    found = {(r.batch, r["index"]): (r.answer, r.alone) for r in numbering.regrouped(rows, answers, "answer").collect()}
    assert found == {(b, i): ((f"{b}.{i}", False) if b in (0, 5) else (None, True)) for b in range(6) for i in range(3 if b < 5 else 1)}
