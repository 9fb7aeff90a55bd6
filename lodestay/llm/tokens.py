"""Token ids of whole texts by a public tokenizer, encoding each distinct unit of text once per task.

A text is cut at places where its vocabulary always ends a pre-token, so that the ids of a text are those of its
units in order: around all white space if the vocabulary drops it, else before a space, and on both sides of a line
break, that has no white space beside it. A task keeps the bytes and ids of the units it has met; only new ones go
to the tokenizers library. Units are looked up by 64-bit hashes; where these could collide, bytes are compared with what was stored.
"""

from __future__ import annotations

import gc
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa

from lodestay.llm.common import text_buffers
from lodestay.llm.shingles import mix, padded, same_spans, span_hashes

#: Units that a task remembers, and their bytes; beyond either, it forgets them all and goes on.
REMEMBERED, REMEMBERED_BYTES = 1_000_000, 1 << 26

_WORD = re.compile("( ?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")
#: Added tokens that units cannot hold whole: with white space inside, or of the form of a plain word and its marks.
_PLAIN = re.compile(r".*\s.*|[A-Za-zÀ-ÖØ-öø-ÿ]*[!-&(-/:-@\[-`{-~]*", re.DOTALL)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: First two bytes of white space beyond ASCII, and the third bytes that go with them (none: there are only two).
_WIDE = {(0xC2, 0x85): (), (0xC2, 0xA0): (), (0xE1, 0x9A): (0x80,), (0xE2, 0x80): (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF), (0xE2, 0x81): (0x9F,), (0xE3, 0x80): (0x80,)}


def _white(data: np.ndarray) -> np.ndarray:
    """Bytes of white space and of separators, ASCII or not."""
    white = _SPACE[data] | ((data >= 28) & (data <= 31))
    for lead in {a for a, _ in _WIDE}:
        for i in np.flatnonzero(data[:-1] == lead):
            third = _WIDE.get((lead, int(data[i + 1])))
            if third == () or third and i + 2 < len(data) and data[i + 2] in third:
                white[i : i + 2 + bool(third)] = True
    return white


def _byte_alphabet() -> dict[int, str]:
    """Printable stand-ins of byte-level BPE: visible Latin-1 bytes stand for themselves, others follow from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in set(shown))
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class UnitCache:
    """Encodes texts by their units; a subclass says where units begin and end, and what their ids are."""

    def __init__(self) -> None:
        self._forget()

    def _forget(self) -> None:
        self.known, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 20, np.int32), 0
        #: By number: where the ids and the bytes of a unit begin, and how many there are.
        self.start, self.count = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)
        self.place, self.size = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)
        self.spelt, self.spelt_used = np.zeros(1 << 22, np.uint8), 0

    def _bytes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that are cut, and the row offsets into them."""
        return text_buffers(texts)

    def _cut(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def _encode(self, units: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def _hashes(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return span_hashes(data, starts, stops)

    def doubtful(self, sizes: np.ndarray) -> np.ndarray:
        """Which units of one size and one hash may have different bytes."""
        return sizes > 8

    def _learn(self, hashes: np.ndarray, units: list[bytes]) -> None:
        collecting = gc.isenabled()
        gc.disable()  # a pass over so many small lists costs more than the encoding
        try:
            found = self._encode([u.decode() for u in units])
            n = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter(chain.from_iterable(found), np.int32, int(n.sum()))
            del found
        finally:
            if collecting:
                gc.enable()
        k, more = len(self.known), len(units)
        size = np.fromiter(map(len, units), np.int64, more)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.spelt_used + int(size.sum()) + 8 > len(self.spelt):
            self.spelt = np.concatenate([self.spelt, np.zeros_like(self.spelt)])
        while k + more > len(self.count):
            self.start, self.count, self.place, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count, self.place, self.size))
        self.ids[self.used : self.used + len(flat)] = flat
        self.start[k : k + more], self.count[k : k + more] = self.used + np.cumsum(n) - n, n
        self.spelt[self.spelt_used : self.spelt_used + int(size.sum())] = np.frombuffer(b"".join(units), np.uint8)
        self.place[k : k + more], self.size[k : k + more] = self.spelt_used + np.cumsum(size) - size, size
        self.used, self.spelt_used = self.used + len(flat), self.spelt_used + int(size.sum())
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.number = np.insert(self.number, at, np.arange(k, k + more))

    def _find(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Numbers of the units, learning new ones. A unit whose hash belongs to other bytes takes the next hash of it."""
        hashes, sizes, spaced = self._hashes(data, starts, stops), stops - starts, padded(data)
        while True:
            distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
            same = sizes == sizes[first][which]
            rest = np.flatnonzero(same & self.doubtful(sizes))
            same[rest] = same_spans(spaced, starts[rest], sizes[rest], spaced, starts[first][which[rest]])
            place = np.searchsorted(self.known, distinct)
            met = self.known[np.minimum(place, len(self.known) - 1)] == distinct if len(self.known) else np.zeros(len(distinct), bool)
            old, lead = self.number[place[met]], first[met]
            alike = self.size[old] == sizes[lead]
            rest = np.flatnonzero(alike & self.doubtful(sizes[lead]))
            alike[rest] = same_spans(spaced, starts[lead[rest]], sizes[lead[rest]], self.spelt, self.place[old[rest]])
            other = np.zeros(len(distinct), bool)
            other[np.flatnonzero(met)[~alike]] = True
            # Of a new hash the first unit has it; of a known one that is stored under other bytes, none.
            again = np.where(other[which], True, ~same)
            if not again.any():
                break
            hashes[again] = mix(hashes[again] + np.uint64(1))
        if not met.all():
            spans = zip(starts[first[~met]].tolist(), stops[first[~met]].tolist(), strict=True)
            raw = data.tobytes()
            self._learn(distinct[~met], [raw[a:b] for a, b in spans])
        return self.number[np.searchsorted(self.known, distinct)][which]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each text has; null is an empty text."""
        if len(self.known) > REMEMBERED or self.spelt_used > REMEMBERED_BYTES:
            self._forget()
        data, ends = self._bytes(texts)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        starts, stops = self._cut(data, ends)
        at = self._find(data, starts, stops)
        n = self.count[at]
        done = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=done[1:])
        place = np.repeat(self.start[at] - done[:-1], n) + np.arange(done[-1])
        return self.ids[place], np.diff(done[np.searchsorted(starts, ends)])


class UnitEncoder(UnitCache):
    """Encodes lists of texts into one flat id array with lengths; equal to the library's ``encode`` of each text.

    Added tokens of the file, such as an end mark, are found in the text as the library finds them.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        for token in self.tokenizer.get_added_tokens_decoder().values():
            # Such a token could reach over the end of a unit, or hide in a plain word.
            if token.lstrip or token.rstrip or token.single_word or _PLAIN.fullmatch(token.content):
                raise ValueError(f"added token {token.content!r} cannot be told from plain text unit by unit")
        self.model = self.tokenizer.model
        self.lower = self.tokenizer.normalizer is not None
        self.bytes = str.maketrans({bytes([b]).decode("latin-1"): c for b, c in _byte_alphabet().items()})
        self.marks: dict[str, list[int]] = {"": []}
        super().__init__()

    def _piece(self, text: str) -> list[int]:
        if not text.isascii() or text[0] == " ":
            text = text.encode().decode("latin-1").translate(self.bytes)
        return [t.id for t in self.model.tokenize(text)]

    def _encode(self, units: list[str]) -> list[list[int]]:
        """Plain words with closing punctuation go straight to the model; all else through the whole tokenizer."""
        out: list[list[int]] = []
        rest: list[int] = []
        for u in units:
            m = _WORD.fullmatch(u)
            if m is None:
                rest.append(len(out))
                out.append([])
                continue
            space, word, marks = m.groups()
            if marks not in self.marks:
                self.marks[marks] = self._piece(marks)
            out.append(self._piece(word.lower() if self.lower else space + word) + self.marks[marks])
        if rest:
            done = self.tokenizer.encode_batch_fast([units[i] for i in rest], add_special_tokens=False)
            for i, e in zip(rest, done, strict=True):
                out[i] = e.ids
        return out

    def _cut(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where units start and stop. Words alone if the vocabulary drops white space, else all bytes."""
        if self.lower:
            inside = ~_SPACE[data]
            edge = np.zeros(len(data) + 1, bool)
            edge[ends] = True
            first, last = inside.copy(), inside.copy()
            first[1:] &= ~inside[:-1] | edge[1:-1]
            last[:-1] &= ~inside[1:] | edge[1:-1]
            return np.flatnonzero(first), np.flatnonzero(last) + 1
        solid = np.zeros(len(data) + 2, bool)  # no white space; text ends count as white space
        solid[1:-1] = ~_white(data)
        alone = np.zeros(len(data), bool)
        alone[1:-1] = solid[1:-3] & solid[3:-1]
        edge = np.zeros(len(data) + 1, bool)
        edge[ends] = True
        near = edge[:-1] | edge[1:]
        alone &= ~near
        cut = edge.copy()
        cut[:-1] |= alone & ((data == 32) | (data == 10))
        cut[1:] |= alone & (data == 10)
        cuts = np.flatnonzero(cut)
        return cuts[:-1], cuts[1:]
