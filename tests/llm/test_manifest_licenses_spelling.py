import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestay.llm import licenses, spelling
from lodestay.llm.merkle import fold, leaf_digest, manifest, proof_digest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def preimage(*values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def tree(digests):
    """Root, and for each leaf its list of (left, right)."""
    paths, groups = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        above, over = [], []
        for k in range(0, len(digests), 3):
            run = digests[k : k + 3]
            for j in range(len(run)):
                for leaf in groups[k + j]:
                    paths[leaf].append(("".join(run[:j]), "".join(run[j + 1 :])))
            above.append(sha("".join(run)))
            over.append(sum(groups[k : k + 3], []))
        digests, groups = above, over
    return digests[0], paths


def expected_manifest(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    leaves = {s: sorted(((r[0], sha(preimage(r[0], r[3], r[2], r[4], r[1])), r) for r in rows if r[3] == s), key=lambda x: (x[0] is not None, x[0] or 0, x[1])) for s in sources}
    under = {s: tree([x[1] for x in leaves[s]]) for s in sources}
    root, over = tree([under[s][0] for s in sources])
    out = []
    for s, above in zip(sources, over, strict=True):
        for (doc_id, leaf, r), path in zip(leaves[s], under[s][1], strict=True):
            now = leaf
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
                now = sha(preimage(r[0], r[3], r[2], r[4], None if r[1] is None else r[1].replace("\n", "")))
            for left, right in path + above:
                now = sha(left + now + right)
            out.append((doc_id, leaf, under[s][0], root, sha("".join(a + b for a, b in path + above)), now, now == root))
    return sorted(out, key=repr)


def found_manifest(spark, docs, tmp_path, name):
    from lodestay.llm.queries import op11_merkle

    docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    return op11_merkle(spark, f"{tmp_path}/{name}")


def test_manifest_equals_plain_trees(spark, tmp_path):
    rows = [(i, f"line {i}\nnext\n" if i % 3 else f"é {i}", "en" if i % 4 else None, "hot" if i % 2 else f"s{i % 7}", i) for i in range(120)]
    rows += [(None, "a\nb", "en", "hot", 3), (500, None, None, None, None), (500, None, None, None, None), (7, "x", "en", "hot", 1), (7, "a", "en", "hot", 1), (8, "", "", "", 0), (9, "only\n", "en", "lone", 5)]
    rows += [(900, "long \n" * 50_000, "en", "hot", 300_000)] + [(1000, "same\n", "en", "copies", 5)] * 10
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("tree", "place", "digest", "path", "group", "copy", "a.b")})
    found = found_manifest(spark, docs.repartition(3), tmp_path, "a").collect()
    assert sorted(map(tuple, found), key=repr) == expected_manifest(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 4])
def test_manifest_of_few_rows(spark, tmp_path, n):
    rows = [(i, "t\n", None, "one" if i < 3 else "two", i) for i in range(n)]
    found = found_manifest(spark, spark.createDataFrame(rows, DOCS), tmp_path, "a").collect()
    assert sorted(map(tuple, found), key=repr) == (expected_manifest(rows) if rows else [])


def test_manifest_serves_other_columns_and_fold_detects_changes(spark):
    rows = spark.createDataFrame([(k, f"g{k % 2}", f"v{k}") for k in range(20)], "key long, part string, value string")
    leaf = leaf_digest([F.col("key"), F.col("value")])
    found = manifest(spark, rows, "part", "key", leaf, {"changed": leaf_digest([F.col("key"), F.concat("value", F.lit("!"))])}, arity=4)
    good = found.where(fold(F.col("leaf"), F.col("path")) == F.col("root"))
    bad = found.where(fold(F.col("changed"), F.col("path")) == F.col("root"))
    assert found.count() == good.count() == 20 and bad.count() == 0 and found.select(proof_digest(F.col("path"))).distinct().count() == 20


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def pattern(markup):
    """The markup as a regular expression over words that are each followed by a blank."""
    out = ""
    for part in re.findall(r"\[|\]|<[^>]*>|[^\[\]<>]+", markup):
        if part == "[":
            out += "(?:(?:"
        elif part == "]":
            out += "))?"
        elif part[0] == "<" or "|" in part:
            ways = []
            for way in part.strip("<>").split("|"):
                m = re.fullmatch(r"(\d+)-(\d+)", way.strip())
                ways.append(r"(?:[^ ]+ ){%s,%s}" % m.groups() if m else "".join(re.escape(w) + " " for w in WORD.findall(way.lower())))
            out += "(?:" + "|".join(ways) + ")"
        else:
            out += "".join(re.escape(w) + " " for w in WORD.findall(part.lower()))
    return re.compile(out)


def spans_of(text, templates):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    found = set()
    for t, (label, markup) in enumerate(templates):
        p, ends = pattern(markup), {}
        for a in range(len(words)):
            fits = [b for b in range(a + 1, len(words) + 1) if p.fullmatch("".join(w + " " for w in words[a:b]))]
            if fits:
                ends.setdefault(max(fits), a)
        found |= {(t, label, a, b) for b, a in ends.items()}
    return len(words), sorted(found, key=lambda x: (x[2], x[3], x[0]))


SMALL = [
    ("x", "[copyright <1-4>] may be used [and [freely] shared] by <anyone|1-3> at no cost"),
    ("y", "<released|licensed> under [a|the terms of] open <license|licence>"),
    ("z", "all <0-5> end"),
    ("é", "für <1-2> é"),
]
TEXTS = [
    None, "", "...", "Copyright (c) 2020 Jo Doe. May be used and freely shared by anyone at no cost!", "may be used by you and me at no cost", "May be used by one two three four at no cost",
    "may be used and shared by\nhim at no cost. Released under the terms of open license; licensed under a open licence. licensed under an open license", "all end all a b c d e end all all end",
    "Under the MIT License, under the mit license under THE MIT license", "Apache License, Version 2.0; Apache Licence version 2. CC BY-NC 4.0, cc_by-nc", "Für x É für x é für x y é", "under the mit", "mit license version 2 apache license",
    "cc by cc by nc nc", "copyright copyright a b c d may be used by may be used by anyone at no cost",
]


def test_automata_accept_what_the_markup_says(spark):
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, spans string").coalesce(1)
    for row in licenses.license_spans(rows, SMALL).collect():
        n, wanted = spans_of(TEXTS[row.doc_id], licenses.BASE + SMALL)
        assert (row.n_words, [tuple(s) for s in row.spans]) == (n, wanted), TEXTS[row.doc_id]
        assert row.covered == len({w for s in wanted for w in range(s[2], s[3])})


def test_random_texts_of_template_words(spark):
    r = np.random.default_rng(5)
    bag = "copyright may be used and freely shared by anyone at no cost released under the terms of a open license all end mit cc nc apache version 2 für é".split()
    texts = [" ".join(r.choice(bag, int(r.integers(0, 30)))) for _ in range(60)]
    texts += ["may be used by " + " ".join(r.choice(bag, int(r.integers(0, 5)))) + " at no cost" for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    for row in licenses.license_spans(rows, SMALL).collect():
        assert (row.n_words, [tuple(s) for s in row.spans]) == spans_of(texts[row.doc_id], licenses.BASE + SMALL), texts[row.doc_id]


MIT = """Copyright (c) 2019-2024 The Example Project Authors
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE."""


def test_whole_texts_and_notices_of_licenses(spark):
    texts = {
        1: MIT, 2: MIT.replace('"Software"', "“Software”").replace('"AS IS"', "“AS IS”"), 3: MIT.replace("without restriction", "with restriction"), 4: "This work is licensed under the GNU General Public License, version 3.",
        5: "Licensed under CC BY-NC 4.0.", 6: "Released under the MIT License.", 7: "Licensed under the Apache License, Version 2.0.", 8: "Published under a licence of our own.", 9: "word " * 200_000 + "Released under the MIT License. " * 3_000,
    }
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r for r in licenses.digest(licenses.license_spans(rows)).collect()}
    assert {i: r.labels for i, r in found.items()} == {1: "mit", 2: "mit", 3: "", 4: "gpl-3", 5: "cc-by-nc", 6: "mit", 7: "apache-2", 8: "", 9: "mit"}
    assert {i: r.base_labels for i, r in found.items()} == {1: "", 2: "", 3: "", 4: "", 5: "cc-by-nc", 6: "mit", 7: "apache-2", 8: "", 9: "mit"}
    assert found[1].score == 1.0 and found[8].score == 0.0 and (found[9].n_base, found[9].first_word, found[9].last_word) == (3000, 200_001, 200_001 + 5 * 2999)
    assert [tuple(found[6][c] for c in ("n_words", "n_base", "first_word", "last_word"))] == [(5, 1, 1, 1)]
    empty = licenses.digest(licenses.license_spans(rows.limit(0)))
    assert empty.collect() == [] and found[8].first_word is None


def test_every_template_accepts_its_own_mandatory_words():
    for label, markup in licenses.TEMPLATES:
        words = re.sub(r"<([^>]*)>", lambda m: " word" * int(m[1].split("-")[0]) if re.fullmatch(r"\d+-\d+", m[1]) else m[1].split("|")[0], markup)
        while "[" in words:
            words = re.sub(r"\[[^\[\]]*\]", " ", words)
        words = WORD.findall(words.lower())
        automaton = licenses.Automaton([(label, markup)])
        at = automaton.words(*_laid_out(words))
        assert (0, 0, len(words)) in set(zip(*(x.tolist() for x in automaton.match(at, np.full(len(words), len(words)))), strict=True))


def _laid_out(words):
    raw = [w.encode() for w in words]
    stops = np.cumsum([len(w) + 1 for w in raw]) - 1
    return np.frombuffer(b" ".join(raw), np.uint8), stops - [len(w) for w in raw], stops


def expected_variants(rows, noise, times=5, least=5):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if noise and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    n = {w: c for w, c in counts.items() if c >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    close = {w: [o for o in n if near(w, o)] for w in n}
    form = {w: min(c, key=lambda o: (-n[o], o)) for w, c in close.items() if c and n[min(c, key=lambda o: (-n[o], o))] >= times * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(close[w]), n[form[w]] if w in form else None))
    return sorted(out, key=repr)


def test_spelling_variants_equal_brute_force(spark):
    r = np.random.default_rng(3)
    words = ["kitten", "kittens", "sitten", "mitten", "Kitten", "aaaaaa", "aaaaaaa", "aaaaaaaa", "écolière", "ecolière", "écoliêre", "straße", "STRASSE", "ÀÉÎÕÜß", "letter×s", "shorts", "short", "zzzzzz", "zzzzzy", "thousand", "thosand", "thousnd", "tousand"]
    weight = np.array([1 + 700 // (i + 1) ** 2 for i in range(len(words))], float)
    rows = [(i if i % 9 else None, " ".join(r.choice(words, 40, p=weight / weight.sum()))) for i in range(150)] + [(1, None), (2, ""), (2, "日本語 naïveté naïveté"), (3, "kitten " * 3000), (3, "kitten kitten"), (3, "kitten kitten")]
    docs = spark.createDataFrame([(*x, "x") for x in rows], "doc_id long, text string, word string")
    for noise in (None, 3, 199):
        found = spelling.variants(spark, docs.repartition(3), noise=noise)
        assert sorted(map(tuple, found.collect()), key=repr) == expected_variants(rows, noise)
    assert spelling.variants(spark, docs.limit(0)).collect() == []


def test_chains_of_forms_are_followed_to_their_end(spark):
    chain = ["abcdef" + "g" * k for k in range(6)]
    docs = spark.createDataFrame([(k, (w + " ") * 5 ** (k + 1)) for k, w in enumerate(chain)], "doc_id long, text string")
    found = {r.word: r for r in spelling.variants(spark, docs, noise=None).collect()}
    assert {r.root for r in found.values()} == {chain[-1]} and [found[w].form for w in chain] == [*chain[1:], None]


def test_very_long_words_meet_without_all_their_deletions_as_texts(spark):
    long = "".join(np.random.default_rng(1).choice(list("abcdefgh"), 30_000))
    docs = spark.createDataFrame([(1, f"{long} " * 30), (2, (long[:777] + long[778:] + " ") * 5), (3, (long[:9] + "é" + long[10:] + " ") * 6)], "doc_id long, text string")
    found = sorted((r.n, r.n_near, r.form == long, r.root == long) for r in spelling.variants(spark, docs, noise=None).collect())
    assert found == [(5, 1, True, True), (6, 1, True, True), (30, 2, False, True)]


def test_checksums_and_keys_of_spans():
    words = ["a", "abcdef", "é" * 30, "x" * 300, "zürich", ""]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    stops = np.cumsum([len(w.encode()) for w in words])
    starts = stops - [len(w.encode()) for w in words]
    begun = np.array([zlib.crc32(f"{i}:".encode()) for i in range(len(words))], np.uint32)
    assert spelling.checksums(data, starts, stops, begun).tolist() == [zlib.crc32(f"{i}:{w}".encode()) for i, w in enumerate(words)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["abcdef", "abdef", "bbb", "bb", "éab"])], ["id", "word"])
    keys = collections.defaultdict(set)
    for out in spelling._keys([batch]):
        for k, i in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True):
            keys[k].add(i)
    assert sorted(sorted(v) for v in keys.values() if len(v) > 1) == [[0, 1], [2, 3]]
    assert sum(map(len, keys.values())) == sum(1 + len(list(itertools.groupby(w))) for w in ["abcdef", "abdef", "bbb", "bb", "éab"])
