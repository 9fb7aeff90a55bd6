"""Documents as sparse rows of hashed words and structure statistics, built in numpy for many texts at a time."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from lodestay.llm.common import text_buffers
from lodestay.llm.shingles import word_hashes

#: Names of the structure columns that follow the hashed words.
STRUCTURE = (
    "bias", "log_bytes", "log_words", "mean_word", "upper", "digit", "punctuation", "pipe", "exclamation", "symbol",
    "line_breaks", "wide", "space", "distinct_words", "repeats_last_word", "top_word", "no_text", "symbol_words",
)
_KINDS = np.zeros((256, 8), np.float32)
for _i, _members in enumerate((range(65, 91), range(48, 58), b".,;:?'\"()-", b"|", b"!", b"#$%&*<>@^~=+_\\/[]{}`", b"\n\r", range(128, 256))):
    _KINDS[list(_members), _i] = 1


@dataclass
class SparseRows:
    """Row r has entries start[r]:start[r+1] of (column, value)."""

    start: np.ndarray
    column: np.ndarray
    value: np.ndarray


def document_rows(texts: pa.Array, buckets: int) -> SparseRows:
    """Hashed words with log-scaled counts, scaled to length one, then the structure columns from ``buckets`` on."""
    data, ends = text_buffers(texts)
    n = len(ends) - 1
    words, at = word_hashes(data, ends)
    doc = np.repeat(np.arange(n), np.diff(at))
    combined, counts = np.unique(doc * buckets + (words >> np.uint64(40)).astype(np.int64) % buckets, return_counts=True)
    row, column = combined // buckets, combined % buckets
    value = np.log1p(counts).astype(np.float32)
    norm = np.sqrt(np.bincount(row, value**2, n)).astype(np.float32)
    value /= norm[row]

    size = np.diff(ends)
    word_count = np.diff(at)
    kinds = np.zeros((n, 8))
    for i in range(8):
        sums = np.concatenate([[0], np.cumsum(_KINDS[data, i], dtype=np.int64)])
        kinds[:, i] = sums[ends[1:]] - sums[ends[:-1]]
    many = np.maximum(word_count, 1)
    same = np.zeros(len(words) + 1, np.int64)
    if len(words) > 1:
        same[1:-1] = np.cumsum((words[1:] == words[:-1]) & (doc[1:] == doc[:-1]))
        same[-1] = same[-2]
    repeats = np.maximum(same[at[1:]] - same[at[:-1]], 0)
    top = np.zeros(n)
    np.maximum.at(top, row, counts)
    stats = np.zeros((n, len(STRUCTURE)), np.float32)
    stats[:, 0] = 1
    stats[:, 1], stats[:, 2] = np.log1p(size) / 10, np.log1p(word_count) / 10
    stats[:, 3] = np.minimum(size / many, 40) / 10
    share = kinds / np.maximum(size, 1)[:, None]
    stats[:, 4:12] = np.sqrt(share)
    stats[:, 12] = 1 - np.minimum(word_count / np.maximum(size, 1), 1)
    stats[:, 13] = np.bincount(row, minlength=n) / many
    stats[:, 14] = repeats / many
    stats[:, 15] = top / many
    stats[:, 16] = word_count == 0
    stats[:, 17] = np.minimum(kinds[:, 5] / many, 4)

    structure = len(STRUCTURE)
    first = np.searchsorted(row, np.arange(n + 1))
    start = first + structure * np.arange(n + 1)
    out_column, out_value = np.empty(start[-1], np.int32), np.empty(start[-1], np.float32)
    place = np.arange(len(row)) + structure * row
    out_column[place], out_value[place] = column, value
    place = (first[1:, None] + structure * np.arange(n)[:, None]) + np.arange(structure)
    out_column[place], out_value[place] = buckets + np.arange(structure), stats
    return SparseRows(start, out_column, out_value)
