"""Word shingles of whole texts as 64-bit hashes, one numpy pass over many documents at a time.

Words are runs of bytes other than space and 0x09-0x0D; A-Z are lower-cased. A set of n-word shingles is a
sorted array of distinct hashes; a text of fewer words has its whole sequence as one shingle, a text without
words has none. Hashes stand for shingles. A word's hash mixes each eight bytes with their place before they are
added up, so it is no polynomial of the bytes, for which words exist that collide whatever the base.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lodestay.llm.common import text_buffers

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.uint64(0xD6E8FEB86659FD93)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Keeps the lowest 0 to 8 bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def padded(data: np.ndarray) -> np.ndarray:
    """``data`` with zeros behind it, so that eight bytes can be read at each of its places."""
    return np.concatenate([data, np.zeros(8, np.uint8)])


def span_blocks(spaced: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of ``padded`` bytes, one after another, as words of eight bytes; the place of each in its span; first words."""
    count = (sizes + 7) >> 3
    ends = np.cumsum(count)
    first = ends - count
    place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(first, count)
    eight = np.ndarray(len(spaced) - 7, "<u8", spaced, 0, (1,))
    words = eight[np.repeat(starts, count) + 8 * place]
    words &= _FIRST[np.minimum(np.repeat(sizes, count) - 8 * place, 8)]
    return words, place, first


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of the non-empty byte spans [start, stop) of ``data``; equal spans have equal hashes wherever they lie.

    Up to eight bytes the hash is one-to-one among spans of one size.
    """
    sizes = stops - starts
    spaced = padded(data)
    out = np.ndarray(len(spaced) - 7, "<u8", spaced, 0, (1,))[starts]
    out &= _FIRST[np.minimum(sizes, 8)]
    out = mix(out + mix(_STEP[None]))
    long = np.flatnonzero(sizes > 8)
    if len(long):
        words, place, first = span_blocks(spaced, starts[long], sizes[long])
        out[long] = np.add.reduceat(mix(words + mix((place.astype(np.uint64) + np.uint64(1)) * _STEP)), first)
    return mix(out ^ (sizes.astype(np.uint64) * _STEP))


def same_spans(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, other: np.ndarray, other_starts: np.ndarray) -> np.ndarray:
    """Whether each non-empty span of ``data`` has the bytes of the span of ``other``, both ``padded`` and of one size."""
    if not len(starts):
        return np.zeros(0, bool)
    words, _, first = span_blocks(data, starts, sizes)
    return ~np.logical_or.reduceat(words != span_blocks(other, other_starts, sizes)[0], first)


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each row the index of its first word (one entry more at the end)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    word = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[ends] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | edge[1:n]
    last[:-1] &= ~word[1:] | edge[1:n]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last)
    return span_hashes(_LOWER[data], starts, stops + 1), np.searchsorted(starts, ends)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; null is an empty text."""
    words, at = word_hashes(*text_buffers(texts))
    n = len(words) - size + 1
    with np.errstate(over="ignore"):
        grams = np.full(max(n, 0), np.uint64(size), np.uint64)
        for i in range(size if n > 0 else 0):
            grams = grams * _FOLD + words[i : i + n]
        grams = mix(grams)
        out = []
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if hi - lo >= size:
                out.append(np.unique(grams[lo : hi - size + 1]))
            elif hi > lo:
                whole = np.array([hi - lo], np.uint64)
                for w in words[lo:hi]:
                    whole = whole * _FOLD + w
                out.append(mix(whole))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
