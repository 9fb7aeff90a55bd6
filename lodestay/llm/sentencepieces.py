"""SentencePiece encoding and decoding by batched searches in numpy.

A text is cut before every run of blanks; no piece crosses such a place, so each distinct word is solved once
per task. Words of one length advance together, and hashes of substrings probe the sorted hashes of the pieces.
The scores of a BPE model are ranks of merges: each pass joins the best-ranked adjacent pair of every word, the
leftmost of equal ones. The scores of a unigram model are log-probabilities: a Viterbi search takes for each end
position the maximum over the piece lengths. Characters that no piece covers become byte pieces. Long words are cut
further, between characters that stand side by side in no piece. A path is spelt out and compared with its word, so
that a collision of hashes is found out, and the word solved by the pieces themselves.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestay.llm.common import text_buffers, text_slices
from lodestay.llm.shingles import mix
from lodestay.llm.tokens import UnitCache

BLANK = "▁"
#: How far below the lowest piece score an uncovered character lies.
UNKNOWN_PENALTY = 10.0
#: Longer words, and words of a length that fewer share, are merged one by one with a heap: a pass joins one pair a word.
LONG, FEW = 64, 16
UNIGRAM, BPE = 1, 2
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Vocabulary:
    pieces: list[str]
    bytes: np.ndarray
    hashes: np.ndarray  # sorted, with an end mark
    ids: np.ndarray
    bucket: np.ndarray  # where the hashes of each value of the upper 16 bits begin
    fullest: int
    scores: np.ndarray
    unknown: int
    unknown_score: float
    longest: int
    plain: dict[str, int]
    kind: int  # UNIGRAM or BPE
    pairs: np.ndarray  # sorted pairs of code points that stand side by side in a piece

    def probe(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, or -1."""
        at = self.bucket[(hashes >> np.uint64(48)).astype(np.int64)]
        found = np.full(hashes.shape, -1)
        last = len(self.hashes) - 1
        for step in range(self.fullest):
            place = np.minimum(at + step, last)
            hit = self.hashes[place] == hashes
            found[hit] = self.ids[place[hit]]
        return found


_INVERSE = pow(int(_STEP), -1, 1 << 64)


def _prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes of rows of code points."""
    power = np.multiply.accumulate(np.array([1] + [int(_STEP)] * (codes.shape[1] - 1), np.uint64))
    out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power, axis=1, out=out[:, 1:])
    return out


def _substring_hashes(prefixes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all substrings of one width, by their start; equal strings have equal hashes."""
    n = prefixes.shape[1] - width
    inverse = np.multiply.accumulate(np.array([1] + [_INVERSE] * (n - 1), np.uint64))
    return mix((prefixes[:, width:] - prefixes[:, :n]) * inverse)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if data[at - 1] < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protocol buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def _kind(proto: bytes) -> int:
    """The model type; what this module does not search right is refused."""
    trainer, user_defined = {}, False
    for number, value in _fields(proto):
        if number == 1:
            user_defined |= dict(_fields(value)).get(3, 1) == 4
        elif number == 2:
            trainer = dict(_fields(value))
    kind = trainer.get(3, UNIGRAM)
    if kind not in (UNIGRAM, BPE) or user_defined:
        raise ValueError("only unigram and BPE models without user-defined symbols are encoded")
    return kind


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    """Pieces, scores and kinds of a model file, read through the sentencepiece library."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(n)]
    scores = np.array([model.get_score(i) for i in range(n)])
    plain = [i for i in range(n) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    kind = _kind(model.serialized_model_proto())
    if kind == BPE and (any(map(model.is_unused, range(n))) or not any(map(model.is_byte, range(n)))):
        raise ValueError("BPE models are encoded with byte pieces and without unused ones only")
    if any(BLANK in pieces[i].lstrip(BLANK) for i in plain):
        raise ValueError("a piece crosses the place where texts are cut")
    by_length: dict[int, list[int]] = {}
    for i in plain:
        by_length.setdefault(len(pieces[i]), []).append(i)
    hashes, ids = [], []
    for length, group in by_length.items():
        codes = np.frombuffer("".join(pieces[i] for i in group).encode("utf-32-le"), "<u4").reshape(-1, length)
        hashes.append(_substring_hashes(_prefix_hashes(codes), length)[:, 0])
        ids.append(np.array(group))
    flat, numbers = np.concatenate(hashes), np.concatenate(ids)
    order = np.argsort(flat)
    of_bytes = np.full(256, model.unk_id())
    for i in range(n):
        if model.is_byte(i):
            of_bytes[int(pieces[i][3:5], 16)] = i
    lowest = float(scores[plain].min())
    flat, numbers = np.append(flat[order], np.uint64(2**64 - 1)), np.append(numbers[order], -1)
    bucket = np.searchsorted(flat[:-1], np.arange((1 << 16) + 1, dtype=np.uint64) << np.uint64(48), "left")
    bucket[-1] = len(flat) - 1
    pairs = np.array(sorted({ord(a) << 32 | ord(b) for i in plain for a, b in zip(pieces[i], pieces[i][1:], strict=False)}), np.uint64)
    return Vocabulary(
        pieces, of_bytes, flat, numbers, bucket, int(np.diff(bucket).max()), scores, model.unk_id(), lowest - UNKNOWN_PENALTY,
        max(by_length), {pieces[i]: i for i in plain}, kind, pairs,
    )


def best_paths(codes: np.ndarray, vocabulary: Vocabulary) -> list[list[int]]:
    """Ids of words of one length, given as rows of code points; -1 - place for a character without a piece."""
    rows, length = codes.shape
    longest = min(length, vocabulary.longest)
    prefixes = _prefix_hashes(codes)
    numbers = [vocabulary.probe(_substring_hashes(prefixes, w)) for w in range(1, longest + 1)]
    scores = [np.where(n >= 0, vocabulary.scores[n], -np.inf) for n in numbers]
    scores[0][numbers[0] < 0] = vocabulary.unknown_score
    best = np.full((rows, length + 1), -np.inf)
    best[:, 0] = 0
    back = np.zeros((rows, length + 1), np.int64)
    piece = np.zeros((rows, length + 1), np.int64)
    take = np.arange(rows)
    for end in range(1, length + 1):
        widths = range(min(end, longest), 0, -1)
        reached = np.stack([best[:, end - w] + scores[w - 1][:, end - w] for w in widths], 1)
        pick = np.argmax(reached, 1)  # of equal scores the longest piece wins
        best[:, end] = reached[take, pick]
        back[:, end] = end - widths[0] + pick
        piece[:, end] = np.stack([numbers[w - 1][:, end - w] for w in widths], 1)[take, pick]
    paths = np.zeros((rows, length), np.int64)
    count = np.zeros(rows, np.int64)
    end = np.full(rows, length)
    for step in range(length):
        alive = np.flatnonzero(end)
        if not len(alive):
            break
        number, start = piece[alive, end[alive]], back[alive, end[alive]]
        paths[alive, length - 1 - step] = np.where(number >= 0, number, -1 - start)
        count[alive] += 1
        end[alive] = start
    return [path[length - n :] for path, n in zip(paths.tolist(), count.tolist(), strict=True)]


def merged_paths(codes: np.ndarray, vocabulary: Vocabulary) -> list[list[int]]:
    """As ``best_paths``, by merges: the best-scored adjacent pair first, the leftmost of equal ones.

    A symbol is known by its first character. ``after`` and ``before`` are the symbols beside it, ``joined`` is the
    piece that it makes with the next one.
    """
    rows, length = codes.shape
    prefixes = _prefix_hashes(codes)
    inverse = np.multiply.accumulate(np.array([1] + [_INVERSE] * length, np.uint64))
    piece = vocabulary.probe(_substring_hashes(prefixes, 1))
    begins = np.ones((rows, length), bool)
    joined = np.full((rows, length + 1), -1)  # the last column takes what is written beside the word
    if length > 1:
        joined[:, : length - 1] = vocabulary.probe(_substring_hashes(prefixes, 2))
    score = np.where(joined >= 0, vocabulary.scores[joined], -np.inf)
    after = np.tile(np.minimum(np.arange(1, length + 2), length), (rows, 1))
    before = np.tile(np.arange(-1, length), (rows, 1))  # -1, before the first, is the last column too
    alive = np.arange(rows)

    def join(first: np.ndarray, ends: np.ndarray, real: np.ndarray) -> None:
        number = np.full(len(alive), -1)
        some, a, b = alive[real], first[real], ends[real]
        number[real] = vocabulary.probe(mix((prefixes[some, b] - prefixes[some, a]) * inverse[a]))
        joined[alive, first] = number
        score[alive, first] = np.where(number >= 0, vocabulary.scores[number], -np.inf)

    while True:
        best = np.argmax(score[alive], 1)
        more = score[alive, best] > -np.inf
        alive, left = alive[more], best[more]
        if not len(alive):
            break
        right = after[alive, left]
        end = after[alive, right]
        piece[alive, left] = joined[alive, left]
        begins[alive, right] = False
        score[alive, right] = -np.inf
        after[alive, left] = end
        before[alive, end] = left
        join(left, after[alive, end], end < length)
        join(before[alive, left], end, left > 0)
    path = np.where(piece >= 0, piece, -1 - np.arange(length))[begins].tolist()
    ends = np.cumsum(begins.sum(1)).tolist()
    return [path[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def merged_path(word: str, vocabulary: Vocabulary) -> list[int]:
    """The same for one word, with a heap of its pairs."""
    plain, scores, length = vocabulary.plain, vocabulary.scores, len(word)
    after, before = list(range(1, length + 2)), list(range(-1, length))
    piece = [plain.get(c, -1 - i) for i, c in enumerate(word)]
    heap: list[tuple[float, int, int, int, int]] = []

    def join(a: int, b: int) -> None:
        if a < 0 or b >= length or after[b] - a > vocabulary.longest:
            return
        number = plain.get(word[a : after[b]])
        if number is not None:
            heapq.heappush(heap, (-scores[number], a, b, after[b], number))

    for i in range(length - 1):
        join(i, i + 1)
    while heap:
        _, left, right, end, number = heapq.heappop(heap)
        if after[left] != right or after[right] != end:
            continue
        piece[left], after[left], after[right], before[end] = number, end, -1, left
        join(left, end)
        join(before[left], left)
    out, at = [], 0
    while at < length:
        out.append(piece[at])
        at = after[at]
    return out


def best_path(word: str, vocabulary: Vocabulary) -> list[int]:
    """As ``best_paths`` for one word, by the pieces themselves."""
    best, back = [0.0], [(0, 0)]
    for end in range(1, len(word) + 1):
        options = []
        for start in range(max(0, end - vocabulary.longest), end):
            number = vocabulary.plain.get(word[start:end])
            if number is not None:
                options.append((best[start] + vocabulary.scores[number], -start, number))
        if word[end - 1] not in vocabulary.plain:
            options.append((best[end - 1] + vocabulary.unknown_score, 1 - end, -end))
        score, start, number = max(options)
        best.append(score)
        back.append((-start, number))
    path, end = [], len(word)
    while end:
        end, number = back[end]
        path.append(number)
    return path[::-1]


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)


def _parted(word: str, vocabulary: Vocabulary) -> list[str]:
    """The word cut between characters that no piece has side by side."""
    codes = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.uint64)
    pair = codes[:-1] << np.uint64(32) | codes[1:]
    place = np.minimum(np.searchsorted(vocabulary.pairs, pair), len(vocabulary.pairs) - 1)
    cuts = (np.flatnonzero(vocabulary.pairs[place] != pair) + 1).tolist()
    return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]


class ViterbiEncoder(UnitCache):
    """Units are the words with the blanks before them; a blank goes before the whole text, as its dummy prefix."""

    def __init__(self, path: str):
        self.vocabulary = load(path)
        super().__init__()

    def _bytes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, ends = text_buffers(texts)
        marks = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81))
        if len(marks):  # the pieces' own sign for a blank is one, and makes one run with blanks beside it
            data, kept = data.copy(), np.ones(len(data), bool)
            data[marks] = 32
            kept[marks + 1] = kept[marks + 2] = False
            ends = np.concatenate([[0], np.cumsum(kept)])[ends]
            data = data[kept]
        filled = ends[:-1][np.diff(ends) > 0]
        added = np.concatenate([[0], np.cumsum(np.diff(ends) > 0)])
        return np.insert(data, filled, 32), ends + added

    def _cut(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        blank = data == 32
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = blank[1:] & ~blank[:-1]
        cut[ends] = True
        cuts = np.flatnonzero(cut)
        return cuts[:-1], cuts[1:]

    def _paths(self, words: list[str]) -> list[list[int]]:
        """Ids of words of one length, as ``best_paths`` gives them."""
        return best_paths(_codes(words), self.vocabulary)

    def _path(self, word: str) -> list[int]:
        return best_path(word, self.vocabulary)

    def _solve(self, words: list[str]) -> list[list[int]]:
        """Ids of distinct words, those of one length together."""
        out: list[list[int]] = [[]] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_length.setdefault(len(word), []).append(i)
        pieces, of_bytes = self.vocabulary.pieces, self.vocabulary.bytes
        for length, group in by_length.items():
            step = max(1, (1 << 18) // (length * min(length, self.vocabulary.longest)))
            for lo in range(0, len(group), step):
                some = group[lo : lo + step]
                for i, path in zip(some, self._paths([words[i] for i in some]), strict=True):
                    word = words[i]
                    if "".join([pieces[p] if p >= 0 else word[-1 - p] for p in path]) != word:
                        path = self._path(word)
                    if min(path) < 0:
                        spelt = [of_bytes[list(word[-1 - p].encode())].tolist() if p < 0 else [p] for p in path]
                        path = [x for part in spelt for x in part]
                    out[i] = path
        return out

    def _encode(self, units: list[str]) -> list[list[int]]:
        words = [u.replace(" ", BLANK) for u in units]
        long = {i: _parted(w, self.vocabulary) for i, w in enumerate(words) if len(w) > LONG}
        parts = list(dict.fromkeys(part for cut in long.values() for part in cut))
        known = dict(zip(parts, self._solve(parts), strict=True))
        short = iter(self._solve([w for i, w in enumerate(words) if i not in long]))
        return [[x for part in long[i] for x in known[part]] if i in long else next(short) for i in range(len(words))]


class MergeEncoder(ViterbiEncoder):
    """The same units, merged as the scores of a BPE model rank them."""

    def _paths(self, words: list[str]) -> list[list[int]]:
        if len(words) < FEW or len(words[0]) > LONG:
            return [merged_path(w, self.vocabulary) for w in words]
        return merged_paths(_codes(words), self.vocabulary)

    def _path(self, word: str) -> list[int]:
        return merged_path(word, self.vocabulary)


def encoder(path: str) -> ViterbiEncoder:
    """The encoder that gives the ids of the model: merges for BPE, the best sum of scores for unigram."""
    return (MergeEncoder if load(path).kind == BPE else ViterbiEncoder)(path)


class Speller:
    """Texts of ids: byte pieces join into UTF-8, the dummy prefix goes, blanks return."""

    def __init__(self, path: str):
        v = load(path)
        spelt = [p.replace(BLANK, " ").encode() for p in v.pieces]
        for b, i in enumerate(v.bytes.tolist()):
            if i != v.unknown:
                spelt[i] = bytes([b])
        self.count = np.array([len(p) for p in spelt])
        self.start = np.cumsum(self.count) - self.count
        self.flat = np.frombuffer(b"".join(spelt), np.uint8)

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
        """One text for each of ``lengths`` ids in turn; bytes that are no UTF-8 become replacement marks."""
        n = self.count[ids]
        done = np.concatenate([[0], np.cumsum(n)])
        data = self.flat[np.repeat(self.start[ids] - done[:-1], n) + np.arange(done[-1])]
        ends = done[np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])]
        prefix = ends[:-1][np.diff(ends) > 0]
        keep = np.ones(len(data), bool)
        keep[prefix] = data[prefix] != 32
        data, ends = data[keep], np.concatenate([[0], np.cumsum(keep)])[ends]
        texts = pa.StringArray.from_buffers(len(lengths), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:
            raw = data.tobytes()
            texts = pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)], pa.string())
        return texts


def _encode(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for part in text_slices(batch, "text"):
                ids, lengths = coder.encode(part.column(1))
                ends = np.concatenate([[0], np.cumsum(4 * lengths)]).astype(np.int32)
                packed = pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), packed], ["doc_id", "text", "ids"])

    return run


def _decode(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(path)
        for batch in batches:
            for part in text_slices(batch, "text"):
                packed = part.column(2).to_pylist()
                lengths = np.array([len(b or b"") // 4 for b in packed])
                ids = np.frombuffer(b"".join(b or b"" for b in packed), "<u4")
                yield pa.RecordBatch.from_arrays([*part.columns, speller.decode(ids, lengths)], ["doc_id", "text", "ids", "decoded"])

    return run


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, text, ids) for every row of ``docs``; null and empty texts have no ids. Further columns are ignored.

    ids, as little-endian unsigned 32-bit, are those of the sentencepiece library for BPE models; for unigram models the path of the
    highest summed piece score, of equal ones that whose last piece is the longest. A character ``▁`` of a text counts as a blank.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encode(model), "doc_id long, text string, ids binary")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """The rows of ``encoded`` (doc_id, text, ids) with the text that the ids spell as ``decoded``."""
    rows = encoded.select("doc_id", "text", "ids")
    return rows.mapInArrow(_decode(model), "doc_id long, text string, ids binary, decoded string")
