import random
import re

import numpy as np
import pytest

from lodestay.llm import ngram_join
from lodestay.llm.ngram_join import linked_pairs, near_duplicates, segment_keys


def brute(rows, size, num, den):
    sets = {}
    for i, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(n, length, seed):
    r = random.Random(seed)
    base = [f"w{r.randrange(400)}" for _ in range(length)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(r.randrange(6)):
            words[r.randrange(len(words))] = f"x{r.randrange(9)}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("limits", [(1024, 1 << 22), (8, 1 << 22), (20, 1500)])
@pytest.mark.parametrize("size,num,den", [(4, 85, 100), (5, 4, 5)])
def test_components_equal_brute_force(spark, monkeypatch, limits, size, num, den):
    monkeypatch.setattr(ngram_join, "TILE_ROWS", limits[0])
    monkeypatch.setattr(ngram_join, "TILE_SHINGLES", limits[1])
    rows = near_copies(60, 90, 1) + [(i + 100, t) for i, t in near_copies(30, 40, 2)]
    a, b = "ab", "ba"
    for _ in range(9):
        a, b = a + b, b + a
    long = " ".join(f"v{i * i % 7919}" for i in range(30_000))
    rows += [(300, a), (301, b), (302, f"p q {a} r"), (303, f"p q {b} r"), (304, a), (310, long), (311, long + " more"), (312, long[: len(long) // 2])]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "One two"), (204, "one TWO\t"), (205, "one"), (206, "Ä b c d e"), (207, "ä b c d e")]
    docs = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, label long")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, size, num, den).collect()}
    assert found == brute(rows, size, num, den)


def test_repeated_and_null_ids_and_empty_table(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (3, "g h i j k l"), (9, "a b c d e f"), (9, "g h i j k l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r.doc_id, r.component_id) for r in near_duplicates(docs).collect()), key=repr)
    assert found == sorted([(5, 3), (5, 3), (None, None), (3, 3), (9, 3), (9, 3)], key=repr)
    assert near_duplicates(docs.limit(0)).collect() == []


def test_scratch_tables_are_deleted(spark, tmp_path, monkeypatch):
    import os

    from lodestay import storage

    monkeypatch.setattr(storage, "shared_dir", lambda _: str(tmp_path))
    docs = spark.createDataFrame(near_copies(20, 30, 3), "doc_id long, text string")
    found = near_duplicates(docs)
    assert [x.split("-")[0] for x in os.listdir(tmp_path)] == ["near"] and found.count() == 20


def test_similar_sets_share_a_segment_key():
    r = np.random.default_rng(0)
    for n in [*range(1, 40), 100, 511, 512, 513, 2000]:
        for _ in range(5):
            a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
            keep = r.random(len(a)) > r.random() * 0.12
            b = np.unique(np.concatenate([a[keep], r.integers(0, 2**64, int(r.integers(0, n // 12 + 1)), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= 85 * (len(a) + len(b) - both):
                assert len(np.intersect1d(segment_keys(a, 85, 100), segment_keys(b, 85, 100)))


def test_tree_finds_all_links():
    r = np.random.default_rng(1)
    base = [np.unique(r.integers(0, 2**64, n, dtype=np.uint64)) for n in (5, 60, 300, 900)]
    sets = [b[r.random(len(b)) > 0.06] for b in base for _ in range(25)]
    sets = [s for s in sets if len(s)]
    wanted = set()
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            both = len(np.intersect1d(x, y))
            if i < j and 5 * both >= 4 * (len(x) + len(y) - both):
                wanted.add((i, j))

    def groups(pairs):
        root = list(range(len(sets)))
        for a, b in pairs:
            x, y = root[a], root[b]
            root = [x if v == y else v for v in root]
        return [root.index(v) for v in root]

    found = list(linked_pairs(sets, np.arange(len(sets)), np.full(len(sets), -1), 4, 5))
    assert groups(found) == groups(wanted) and len(found) < len(sets)
    assert {tuple(sorted(p)) for p in found} <= wanted
    sides = np.arange(len(sets)) % 2
    across = list(linked_pairs(sets, np.arange(len(sets)), sides, 4, 5))
    assert groups(across) == groups({p for p in wanted if sides[p[0]] != sides[p[1]]})
