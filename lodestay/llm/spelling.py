"""Spelling variants: frequent words, the near words of each, and the form that a rarer spelling stands for.

Words are counted in map tasks, then grouped by a symmetric-delete join: every word emits itself and its distinct single
deletions, words that share a key are candidates, and an edit distance of exactly one is verified on the words.
The near word of largest count is the form of a word if it is frequent enough, and forms are followed to their
last by joins that double the distance covered.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestay.llm.common import text_buffers, text_slices
from lodestay.llm.shingles import _LOWER, padded, same_spans, span_hashes
from lodestay.operators.numbering import numbered
from lodestay.storage import Scratch

#: Every how many-th checksum of a document's word deletes one of its code points; None for none.
NOISE = 199
LEAST_POINTS, LEAST_COUNT, TIMES = 6, 5, 5
#: First byte of U+00C0 to U+00FF in UTF-8; it is never another character's.
_LEAD = 0xC3
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[_LEAD] = True
#: The checksum's state after each byte from state zero.
_STEPS = np.array([zlib.crc32(bytes([i ^ 0xFF])) ^ 0xFF000000 for i in range(256)], np.uint32)
#: Bytes up to which checksums are computed for all words together, one byte at a time.
_TOGETHER = 48
#: Moduli and bases of the keys' hashes; candidates only, distances are verified.
_PRIMES, _BASES = (2147483647, 2147483629), (1103515245, 1140671485)


def letter_runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the maximal runs of letters in lower-cased bytes; no run crosses the end of a row."""
    inside = _LETTER[data]
    inside[1:] |= data[:-1] == _LEAD
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def checksums(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """crc32 of each span, carried on from the crc32 ``begun`` of what stands before it."""
    out = begun.astype(np.uint32)
    sizes = stops - starts
    few = np.flatnonzero(sizes <= _TOGETHER)
    few = few[np.argsort(-sizes[few], kind="stable")]
    state, size, at = out[few] ^ np.uint32(0xFFFFFFFF), sizes[few], starts[few]
    for j in range(int(size[0]) if len(few) else 0):
        n = int(np.searchsorted(-size, -j, "left"))  # spans longer than j
        now = state[:n]
        state[:n] = _STEPS[(now ^ data[at[:n] + j]) & np.uint32(255)] ^ (now >> np.uint32(8))
    out[few] = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(sizes > _TOGETHER).tolist():
        out[i] = zlib.crc32(data[starts[i] : stops[i]], int(begun[i]))
    return out


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.StringArray:
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=ends[1:])
    place = np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(data[place]))


def _counted(noise: int | None, least: int) -> Callable:
    names = ["word", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch, "text"):
                raw, ends = text_buffers(rows.column(1))
                data = _LOWER[raw]
                starts, stops = letter_runs(data, ends)
                wide = np.zeros(len(data) + 1, np.int64)
                np.cumsum(data == _LEAD, out=wide[1:])
                points = stops - starts - (wide[stops] - wide[starts])
                long = points >= least
                starts, stops, points = starts[long], stops[long], points[long]
                if not len(starts):
                    continue
                if noise:
                    begun = np.array([zlib.crc32(f"{'' if d is None else d}:".encode()) for d in rows.column(0).to_pylist()], np.uint32)
                    check = checksums(data, starts, stops, begun[np.searchsorted(ends, starts, "right") - 1])
                    hit = check % noise == 0
                    changed = []
                    for a, b, k, n in zip(starts[hit].tolist(), stops[hit].tolist(), check[hit].tolist(), points[hit].tolist(), strict=True):
                        if n > least:
                            word = data[a:b].tobytes().decode()
                            changed.append(word[: k % n] + word[k % n + 1 :])
                    if changed:
                        yield pa.RecordBatch.from_arrays([pa.array(changed, pa.string()), pa.array(np.ones(len(changed), np.int64))], names)
                    starts, stops = starts[~hit], stops[~hit]
                if not len(starts):
                    continue
                sizes, spaced = stops - starts, padded(data)
                _, lead, which, n = np.unique(span_hashes(data, starts, stops), return_index=True, return_inverse=True, return_counts=True)
                alike = sizes == sizes[lead][which]
                same = np.flatnonzero(alike)
                alike[same] = same_spans(spaced, starts[same], sizes[same], spaced, starts[lead[which[same]]])
                rest = np.flatnonzero(~alike)  # other words of the same hash are counted one by one
                np.subtract.at(n, which[rest], 1)
                at, n = np.concatenate([lead, rest]), np.concatenate([n, np.ones(len(rest), np.int64)])
                yield pa.RecordBatch.from_arrays([_gather(data, starts[at], sizes[at]), pa.array(n)], names)

    return run


def word_counts(docs: DataFrame, noise: int | None = NOISE, least_points: int = LEAST_POINTS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of ``docs`` (doc_id, text) with enough code points and occurrences.

    Words are maximal runs of Latin letters up to U+00FF, A-Z lower-cased. Where ``noise`` divides the crc32 of
    ``doc_id:word``, the word loses the code point at the crc32 modulo its length. Null texts have no words, a
    null doc_id is an empty one, every row counts. Tasks count before anything is shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(_counted(noise, least_points), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _powers(base: int, prime: int, count: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < count:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
    return out[:count]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows (id, word): a hash of the word and of each of its distinct single deletions.

    Hashes are polynomials of the code points, so that all deletions of a word take time in proportion to its length.
    """
    for batch in batches:
        for rows in text_slices(batch, "word"):
            raw, ends = text_buffers(rows.column(1))
            if not len(raw):
                continue
            lead = raw == _LEAD
            letters = raw.astype(np.uint64)
            letters[1:][lead[:-1]] += np.uint64(64)
            letters = letters[~lead]
            stop = np.cumsum(~lead)[ends[1:] - 1]
            size = np.diff(np.concatenate([[0], stop]))
            first = stop - size
            word = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(letters)) - first[word]
            whole, cut = np.zeros(len(size), np.uint64), np.zeros(len(letters), np.uint64)
            for base, prime in zip(_BASES, _PRIMES, strict=True):
                p = np.uint64(prime)
                upto = np.zeros(len(letters) + 1, np.uint64)
                np.cumsum(letters * _powers(base, prime, int(size.max()))[place] % p, out=upto[1:])
                total = (upto[stop] - upto[first]) % p
                after = (upto[stop][word] - upto[1:]) % p * np.uint64(pow(base, -1, prime))
                cut = cut << np.uint64(31) | (upto[:-1] - upto[first][word] + after) % p
                whole = whole << np.uint64(31) | total
            apart = place == 0
            apart[1:] |= letters[1:] != letters[:-1]
            ids = rows.column(0).to_numpy()
            key = np.concatenate([whole, cut[apart]]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.concatenate([ids, ids[word[apart]]]))], ["key", "id"])


def near_words(words: DataFrame) -> DataFrame:
    """(id, other, other_n) for each two of ``words`` (id, word, n) at an edit distance of one, in both directions.

    A key is shared by words that come from one string by one letter put in, so the alphabet and the length of a word bound them,
    not the number of words.
    """
    keys = words.select("id", "word").mapInArrow(_keys, "key long, id long")
    a, b = keys.toDF("key", "a"), keys.toDF("key", "b")
    pairs = a.join(b, "key").where("a < b").select("a", "b").distinct()
    left, right = words.toDF("a", "a_word", "a_n"), words.toDF("b", "b_word", "b_n")
    near = pairs.join(left, "a").join(right, "b").where(F.levenshtein("a_word", "b_word", 1) == 1)
    return near.selectExpr("stack(2, a, b, b_n, b, a, a_n) as (id, other, other_n)")


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root) for the words that have a form (id, form); counts grow along forms, so there is an end."""
    now = scratch.write(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        next_ = now.select(F.col("id").alias("root"), F.col("root").alias("beyond"))
        moved = scratch.write(now.join(next_, "root", "left"), "roots")
        now = moved.select("id", F.coalesce("beyond", "root").alias("root"))
        if moved.where("beyond is not null").isEmpty():
            return now


def variants(spark: SparkSession, docs: DataFrame, noise: int | None = NOISE, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every frequent word of ``docs`` (doc_id, text); see ``word_counts``.

    Near words differ by one code point inserted, deleted or replaced. The form is the near word of largest n (of
    equal ones the first in code-point order) if that is at least ``times`` n, else null; the root is where forms lead
    to, the word itself without one. Rows that repeat an id count; an empty table has no words; other columns are ignored.
    """
    with Scratch(spark) as scratch:
        # In the order of words, so that of two ids the smaller one belongs to the first in code-point order.
        words = scratch.write(numbered(word_counts(docs, noise), ["word"], "id", scratch).select("id", "word", "n"), "words")
        best = F.max(F.struct(F.col("other_n").alias("n"), (-F.col("other")).alias("other"))).alias("best")
        found = near_words(words).groupBy("id").agg(F.count("*").alias("n_near"), best)
        found = scratch.write(words.join(found, "id", "left"), "near")
        strong = F.col("best.n") >= times * F.col("n")
        found = found.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, -F.col("best.other")).alias("form"))
        roots = _roots(found.where("form is not null"), scratch)
        named = found.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        named = named.join(words.toDF("form", "form_word", "form_n"), "form", "left").join(words.toDF("root", "root_word", "root_n"), "root")
        out = named.select("word", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "n", "n_near", "form_n")
        return scratch.keep(out, "variants")
