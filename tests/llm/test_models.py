import numpy as np
import pyarrow as pa

from lodestay.llm import langid, quality
from lodestay.llm.hashing import document_rows

SF = "/root/testdata/sf0.1"
LETTERS = {"aa": "abcde", "bb": "vwxyz"}


def _made(spark):
    r = np.random.default_rng(0)
    rows = []
    for i in range(240):
        lang = "aa" if i % 2 else "bb"
        rows.append((i, " ".join("".join(r.choice(list(LETTERS[lang]), 4)) for _ in range(20)), lang, "x"))
    rows += [(900, None, "aa", "x"), (901, "", None, "x"), (902, "12 !!", "aa", "x"), (None, "abc abc", "aa", "x"), (1, "abcd" * 3000, "aa", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_gradient_of_the_network():
    r = np.random.default_rng(0)
    model = langid.ByteTagger.new(["a", "b"], hidden=3)
    for g in (model.ahead, model.behind):
        g.table, g.turn = g.table.astype(float), g.turn.astype(float)
    steps = r.integers(0, 256, (6, 4))
    upstream = r.normal(size=(6, 3, 4))
    loss = lambda: float((model.ahead.read_for_training(steps)[0] * upstream).sum())
    table, turn = model.ahead.slopes(model.ahead.read_for_training(steps)[1], upstream)
    for values, slope, at in [(model.ahead.turn, turn, (2, 1)), (model.ahead.turn, turn, (7, 0)), (model.ahead.table, table, (4, steps[2, 1]))]:
        values[at] += 1e-6
        up = loss()
        values[at] -= 2e-6
        assert abs((up - loss()) / 2e-6 - slope[at]) < 1e-5
        values[at] += 1e-6
    assert np.allclose(model.ahead.read(steps), model.ahead.read_for_training(steps)[0], atol=1e-5)


def test_language_of_made_texts(spark):
    found = {r.doc_id: r for r in langid.identify(_made(spark)).collect()}
    assert np.mean([found[i].lang_pred == ("aa" if i % 2 else "bb") for i in range(240)]) > 0.97
    assert [found[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and found[None].held_out is False
    assert all(0 <= r.score <= 1 for r in found.values())
    assert langid.identify(_made(spark).limit(0)).collect() == []


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    both = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert both.selectExpr("avg(cast(lang = lang_pred as int))").first()[0] > 0.98


def test_linear_time_pairs_equal_all_pairs():
    rows = document_rows(pa.array(["a b a c!", "", None, "D e f g"]), 64)
    r = np.random.default_rng(0)
    model = quality.FactorisationMachine(r.normal(size=100), r.normal(size=(100, 3)))
    for i, p in enumerate(model.scores(rows)):
        c, x = (v[rows.start[i] : rows.start[i + 1]] for v in (rows.column, rows.value.astype(float)))
        total = model.weight[c] @ x + sum(model.factor[c[a]] @ model.factor[c[b]] * x[a] * x[b] for a in range(len(c)) for b in range(a))
        assert abs(p - 1 / (1 + np.exp(-total))) < 1e-4


def test_quality_held_out_accuracy_and_odd_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    both = quality.classify_quality(docs, labels).join(labels, "doc_id").where("held_out")
    assert both.selectExpr("avg(cast(quality = predicted as int))").first()[0] > 0.98
    odd = spark.createDataFrame([(1, None, 1), (1, "", 1), (None, "x " * 9000, 1)], "doc_id long, text string, label int")
    for some in (labels, labels.limit(0)):
        rows = quality.classify_quality(odd, some).collect()
        assert len(rows) == 3 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert quality.classify_quality(odd.limit(0), labels).collect() == []
