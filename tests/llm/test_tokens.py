import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from lodestay.llm.packing import SumOfSquares, pack  # noqa: E402
from lodestay.llm.sentencepieces import ViterbiEncoder, decode, encode, load, merged_path, merged_paths  # noqa: E402
from lodestay.llm.tokens import UnitEncoder  # noqa: E402
from lodestay.llm.wavelet import WaveletMatrix, read_documents, write_tokens  # noqa: E402

ODD = [None, "", " ", "a   b", "a \n b", "\n \n", "a\n", "x  y", "don't 'S IT'S", "ﬁ é é ΑΣ İI", "12 3a b4", "<|endoftext|> a", "日本 テ", "\x1c \x1d", "a  b", "a\n　b", "word\x1c!! x", "<|endoftext|>", "a<|endoftext|>b", "two <|endoftext|> <|endoftext|>\n<|startoftext|>.", "it's<|startoftext|>  x<|EndOfText|>", "é<|endoftext|>́ <|endoftext|", "!<|endoftext|>!! a\n<|endoftext|>\n\nb <|endoftext|>"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_units_equal_whole_texts(name):
    path = public_tokenizers.path(name)
    whole = Tokenizer.from_file(path)
    wanted = [whole.encode(x or "", add_special_tokens=False).ids for x in ODD]
    ids, lengths = UnitEncoder(path).encode(pa.array(ODD, pa.string()))
    assert lengths.tolist() == [len(w) for w in wanted] and ids.tolist() == [i for w in wanted for i in w]


def test_packing_places_every_id_once(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    texts = [*ODD, "word " * 5000, "a long text of words, " * 20_000, *thue_morse(9), *["some words here. " * k for k in range(40)]]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, offset long").coalesce(2)
    rows = pack(docs, path).collect()
    sequences = {}
    for i, t in enumerate(texts):
        want = whole.encode(t or "", add_special_tokens=False).ids + [1]
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        got = np.concatenate([np.frombuffer(r.ids, "<u4") for r in mine])
        assert got.tolist() == want and all(r.doc_tokens == len(want) for r in mine)
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or at & (at - 1) == 0
    assert pack(docs.limit(0), path).collect() == []


def test_sum_of_squares_chooses_the_least_change():
    p = SumOfSquares(10)
    r = np.random.default_rng(0)
    for _ in range(300):
        n = int(r.integers(1, 10))
        count = p.count.copy()

        def cost(level, count=count, n=n):
            c = count[1:10].copy()
            if level:
                c[level - 1] -= 1
            if level + n < 10:
                c[level + n - 1] += 1
            return int((c**2).sum())

        options = [0, *[h for h in range(1, 11 - n) if count[h]]]
        assert cost(p.level_for(n)) == min(map(cost, options))
        list(p.add(0, np.arange(n)))


def test_wavelet_access_count_and_occurrence():
    for n in (0, 1, 511, 512, 513, 16384, 40000):
        ids = np.random.default_rng(n).integers(0, 70000, n)
        ids[: n // 3] %= 40
        m = WaveletMatrix.from_bytes(WaveletMatrix.build(ids).to_bytes())
        assert (m.to_array() == ids).all()
        places = np.arange(0, n, 41)
        assert (m.access(places) == ids[places]).all()
        tokens = np.array([3, 39, 69999, 1 << 30, -1, *ids[-1:]])
        assert m.count(tokens).tolist() == [(ids == t).sum() for t in tokens]
        assert m.count(tokens, np.full(len(tokens), n // 2)).tolist() == [(ids[: n // 2] == t).sum() for t in tokens]
        for t in tokens.tolist():
            found = np.flatnonzero(ids == t).tolist()
            assert m.occurrence(t, np.arange(-1, len(found) + 1)).tolist() == [-1, *found, -1]
    assert (m.supers.nbytes + m.blocks.nbytes) / m.planes.nbytes < 0.1


def test_wavelet_questions_to_shard_files(spark, tmp_path, monkeypatch):
    from lodestay.llm import wavelet

    monkeypatch.setattr(wavelet, "MATRIX_TOKENS", 500)
    r = np.random.default_rng(1)
    docs = spark.createDataFrame([(i, " ".join(r.choice(["ant", "bee", "cow", "dog"], int(r.integers(0, 900))))) for i in range(20)], "doc_id long, text string")
    path = str(tmp_path / "t")
    write_tokens(docs.repartition(3), path, public_tokenizers.path("byte_bpe_50k.json"), shards=3)
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = np.array([x for d in docs.orderBy("doc_id").collect() for x in [*whole.encode(d.text, add_special_tokens=False).ids, 2]])
    asked = spark.createDataFrame([(int(i),) for i in [0, 1, 499, 500, 501, len(ids) - 1, len(ids), 10**9, -1, *r.integers(0, len(ids), 60)]], "position long")
    found = {x.position: x.token for x in wavelet.access(spark, path, asked).collect()}
    assert found == {x.position: ids[x.position] for x in asked.collect() if 0 <= x.position < len(ids)}
    tokens = [2, int(ids[0]), int(ids[700]), 49999]
    assert {x.token: x.occurrences for x in wavelet.count(spark, path, tokens).collect()} == {t: (ids == t).sum() for t in tokens}
    places = np.flatnonzero(ids == ids[700])
    ks = [0, 1, 5, len(places) // 2, len(places) - 1, len(places), -1]
    assert {x.k: x.position for x in wavelet.occurrence(spark, path, int(ids[700]), ks).collect()} == {k: places[k] for k in ks[:5]}


def test_token_files_in_id_order(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    docs = spark.createDataFrame([(9 - i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    write_tokens(docs, str(tmp_path / "t"), path)
    at, wanted = 0, []
    for i, t in sorted((9 - i, t) for i, t in enumerate(ODD)):
        ids = whole.encode(t or "", add_special_tokens=False).ids + [2]
        wanted.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, read_documents(spark, str(tmp_path / "t")).collect())) == wanted


def test_token_files_of_odd_tables(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    long = "many words in a very long text. " * 40_000
    rows = [(4, "b", 1), (4, "a", 2), (None, "c", 3), (2, None, 4), (3, long, 5), (4, "a", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long")
    write_tokens(docs, str(tmp_path / "t"), path)
    found = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in read_documents(spark, str(tmp_path / "t")).collect())
    whole = Tokenizer.from_file(path)
    wanted, at = [], 0
    for i, t in [(None, "c"), (2, ""), (3, long), (4, "a"), (4, "a"), (4, "b")]:
        ids = [*whole.encode(t, add_special_tokens=False).ids, 2]
        wanted.append((at, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert found == wanted
    write_tokens(docs.limit(0), str(tmp_path / "u"), path)
    assert read_documents(spark, str(tmp_path / "u")).collect() == []


def thue_morse(doublings):
    """Two words that every polynomial hash modulo a power of two takes for each other."""
    a, b = "ab", "ba"
    for _ in range(doublings):
        a, b = a + b, b + a
    return a, b


def test_words_with_equal_polynomial_hashes_are_told_apart(spark):
    import sentencepiece

    pair = [w for k in (7, 8, 9, 10) for w in thue_morse(k)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        whole = Tokenizer.from_file(path)
        ids, lengths = UnitEncoder(path).encode(pa.array(pair))
        wanted = [whole.encode(x, add_special_tokens=False).ids for x in pair]
        assert lengths.tolist() == list(map(len, wanted)) and ids.tolist() == sum(wanted, [])
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = spark.createDataFrame(list(enumerate(pair)), "doc_id long, text string")
    assert all(np.frombuffer(r.ids, "<u4").tolist() == library.encode(r.text) for r in encode(rows, path).collect())


def test_colliding_units_keep_their_own_ids():
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)

    class Poor(UnitEncoder):
        def _hashes(self, data, starts, stops):
            return (stops - starts).astype(np.uint64) % np.uint64(3)

        def doubtful(self, sizes):
            return sizes > 0

    coder, texts = Poor(path), ["the cat sat on the mat", "a dog and the cat ate a bat", None, "", "mat sat", *thue_morse(7)]
    for some in (texts, texts[::-1], [*texts, "quite new words"]):
        ids, _ = coder.encode(pa.array(some, pa.string()))
        assert ids.tolist() == [i for t in some for i in whole.encode(t or "", add_special_tokens=False).ids]


def test_share_of_windows_taken_apart_is_small():
    r = np.random.default_rng(2)
    packer, windows = SumOfSquares(2048), []
    for n in r.lognormal(5.5, 1.1, 1250).astype(int):
        windows += packer.add(0, np.arange(n))
    windows += packer.close()
    assert all(sum(len(p[3]) for p in w) in {1 << b for b in range(12)} for w in windows)
    placed = [(len(p[3]), p[4]) for w in windows for p in w if len(p[3]) < 2048]
    assert sum(n for n, recut in placed if recut) < 0.2 * sum(n for n, _ in placed)


def test_pieces_of_odd_tables(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    long = "".join(np.random.default_rng(0).choice(list("abcdefgh+/019XYZ"), 100_000))
    rows = [(1, "twice", b"x"), (1, "twice", b"x"), (None, None, b"x"), (2, long, b"x"), (3, "", b"x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids binary")
    back = decode(encode(docs, path), path).collect()
    assert len(back) == 5 and all(r.decoded == (r.text or "") and np.frombuffer(r.ids, "<u4").tolist() == library.encode(r.text or "") for r in back)
    assert encode(docs.limit(0), path).collect() == []


def test_viterbi_reaches_the_best_score_and_decodes(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    v = load(path)
    plain = {v.pieces[i]: i for i in v.ids.tolist() if i >= 0}

    def best(word):
        score = [0.0] + [-1e300] * len(word)
        for e in range(1, len(word) + 1):
            for s in range(max(0, e - v.longest), e):
                i = plain.get(word[s:e])
                gain = v.scores[i] if i is not None else v.unknown_score if e - s == 1 else None
                if gain is not None:
                    score[e] = max(score[e], score[s] + gain)
        return score[-1]

    def reached(ids):
        total, run = 0.0, 0
        for i in ids:
            if i in plain.values():
                total += v.scores[i]
            else:
                run += 1
        return total, run

    encoder = ViterbiEncoder(path)
    for word in ["hello", "unbelievable", "and", "Zürich", "aaaa", "internationalisation"]:
        assert reached(encoder.encode(pa.array([word]))[0].tolist()) == (best("▁" + word), 0)
    rows = spark.createDataFrame(list(enumerate([*ODD, "a\nb 😀", "end  "])), "doc_id long, text string")
    for r in decode(encode(rows, path), path).collect():
        assert r.decoded == (r.text or "")


def test_bpe_ids_equal_the_library_on_whole_texts(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += [*ODD, "the information", "      six     blanks ", "日本語の文章です" * 40, "ab" * 500, "x▁y ▁▁ z", "▁  a ▁ ▁b", "a\u2581  b  \u2581", "▁", "▁ ", " ▁▁  c▁", "aaaaaaaaaaaaaaaaaaaaaaa", "😀" * 70]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in encode(rows, path).collect():
        assert np.frombuffer(r.ids or b"", "<u4").tolist() == library.encode(r.text or ""), r.text


def test_bpe_merges_batched_and_by_heap_equal_the_library():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, v = sentencepiece.SentencePieceProcessor(model_file=path), load(path)
    random = np.random.default_rng(0)
    for length in (1, 2, 3, 7, 20, 60):
        words = ["".join(random.choice(list("etaoinshrdlu▁"), length)) for _ in range(200)]
        wanted = [library.encode(w) for w in words]
        given = ["▁" + w for w in words]
        codes = np.frombuffer("".join(given).encode("utf-32-le"), "<u4").reshape(200, -1)
        assert merged_paths(codes, v) == wanted and [merged_path(w, v) for w in given] == wanted
