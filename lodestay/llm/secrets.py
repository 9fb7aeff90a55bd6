"""Secret scans: three base patterns, and dictionary-primed zstandard novelty.

A candidate is an unbroken token on the line of a sensitive word, near it or in a block of a private key, or the
password of a connection string; unbroken lines beside a found one belong to it. Its novelty is what it adds to the
zstandard frame of the text around it, copies of itself left out, with a dictionary already known to the compressor:
common identifiers, and the words of the sensitive lines of all documents that stand in the most different ones. Words and
identifiers repeat what is near them or in the dictionary and add little; random strings add nearly their whole
length: a whole byte for each character, or, beside tokens of their kind, what their alphabet needs. A token that is novel once
is reported wherever it stands in the text. The novelty of base spans is measured too.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestay.llm.common import by_place, list_array, text_slices

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: A text without any of these has no base match but a hexadecimal one, and no sensitive context.
_SENSITIVE = re.compile(r"password|passwd|secret|token|api[_-]?key|credential|private[_ -]?key|access[_ -]?key|bearer|authorization|auth_|passphrase|client_id", re.IGNORECASE | re.ASCII)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_KEY_BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY[A-Z ]*-----.*?(?=-----END |\Z)", re.DOTALL)
_TOKEN_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
#: A line that is one token but for marks around it, and what may follow a token on its line.
_ALONE = re.compile(r"[^A-Za-z0-9+/_=\n-]*([A-Za-z0-9+/_=-]+)(?:\\[nr]|[^A-Za-z0-9+/_=\n-])*(?=\n|\Z)")
_LINE_REST = re.compile(r"(?:\\[nr]|[^A-Za-z0-9+/_=\n-])*\n")
_URL_PASSWORD = re.compile(r"://[^\s:/@]+:([^\s@/]{8,})@")
#: What the dictionary is learned from: runs of letters of one case, a capital before them or not.
_PART = re.compile(r"[A-Z]?[a-z]{3,23}|[A-Z]{4,24}")
_JOINTS = re.compile(r"[/_=+-]+")
_UNBROKEN = re.compile(r"^[^A-Za-z0-9+/_=\n-]*[A-Za-z0-9+/_=-]{16,}[^A-Za-z0-9+/_=\n-]*$", re.MULTILINE)
#: Characters on both sides of a sensitive word that count as its context beside its line, and characters kept around a candidate.
REACH, AROUND = 64, 256
#: A candidate is reported when it adds this many bytes for each of its characters, or this share of what a random string of its
#: alphabet adds at least: tokens of one kind close to each other teach the compressor their alphabet, which makes a hexadecimal
#: digit half a byte, but never less.
NOVELTY, ALPHABET_SHARE = 0.7, 0.8
#: Words of the learned dictionary at most, and the different lines that one must stand in.
WORDS, LEAST_LINES = 2000, 3
_IDENTIFIERS = (
    "import from return class function const public private static void string integer boolean true false null none self this "
    "password passwd secret token api_key apikey access_key secret_key private_key credential authorization bearer client_id "
    "username user_name user_id session_id request response config configuration settings environment database connection "
    "http https www com org net html localhost example test value default name type length index error exception message "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 sha1 sha256 md5 base64 uuid json xml utf-8 "
)


def core(token: str) -> str:
    """The longest part of a token between equals signs, or all of it if no part is long enough for a candidate."""
    longest = max(token.split("="), key=len)
    return longest if len(longest) >= 16 else token


def least_novelty(token: str) -> float:
    """Bytes for each character from which on a token is reported: ``NOVELTY``, less for a small alphabet."""
    plain = "".join(c for c in token if c.isalnum())
    hexed = re.fullmatch("[0-9a-f]*|[0-9A-F]*", plain) is not None
    letters = 6 * any(c.isalpha() for c in plain) if hexed else 26 * any(c.islower() for c in plain) + 26 * any(c.isupper() for c in plain)
    size = letters + 10 * any(c.isdigit() for c in plain) + len(set(token) - set(plain))
    return min(NOVELTY, ALPHABET_SHARE * math.log2(max(size, 10)) / 8)


def _without(text: str, value: str, lo: int, hi: int, least: int, most: int) -> str:
    """text[lo:hi] without what belongs to copies of ``value`` that lie in text[least:most]."""
    kept, at = [], lo
    place = text.find(value, least, most)
    while place >= 0:
        kept.append(text[at : min(place, hi)])
        at = place + len(value)
        place = text.find(value, at, most)
    return "".join([*kept, text[at:hi]])


class NoveltyMeter:
    """Measures candidates against their surroundings; ``words`` add to the dictionary, the commonest first."""

    def __init__(self, words: list[str] | None = None) -> None:
        # What the compressor needs most should be nearest to the text, at the end.
        known = " ".join(reversed(words or [])) + " " + _IDENTIFIERS
        primed = zstandard.ZstdCompressionDict(known.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=9, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)
        self.text, self.known = "", {}

    def of(self, text: str, start: int, end: int) -> float:
        """``measure``, once for each place of a text."""
        if text is not self.text:
            self.text, self.known = text, {}
        if (start, end) not in self.known:
            self.known[start, end] = self.measure(text, start, end)
        return self.known[start, end]

    def novel(self, text: str, start: int, end: int) -> bool:
        return self.of(text, start, end) >= least_novelty(text[start:end])

    def measure(self, text: str, start: int, end: int) -> float:
        """Compressed bytes that text[start:end] adds to its surroundings, for each of its characters.

        Copies of itself do not count as surroundings, else a secret that stands twice would be no news at both places;
        nor do unbroken lines, which may be parts of the same key.
        """
        same, lo, hi = core(text[start:end]), max(0, start - AROUND), end + AROUND
        before = _without(text, same, lo, start, max(0, lo - len(same) + 1), start)
        after = _without(text, same, end, hi, end, hi + len(same) - 1)
        around = (_UNBROKEN.sub("", before) + _UNBROKEN.sub("", after)).encode("utf-8", "replace")
        value = text[start:end].encode()
        added = len(self.compressor.compress(around + b"\n" + value)) - len(self.compressor.compress(around + b"\n"))
        return added / len(value)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns' matches that are long enough."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _contexts(text: str, words: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What belongs to the sensitive words: their lines, ``REACH`` characters on both sides, and whole blocks of private keys."""
    found = [(m.start(), m.end()) for m in _KEY_BLOCK.finditer(text)]
    line_end = -1
    for start, end in words:
        lo = start
        if end > line_end:
            lo = text.rfind("\n", 0, start) + 1
            line_end = text.find("\n", end)
            line_end = len(text) if line_end < 0 else line_end
        found.append((min(lo, start - REACH), max(line_end, end + REACH)))
    merged: list[tuple[int, int]] = []
    for lo, hi in sorted(found):
        if merged and lo <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(hi, merged[-1][1]))
        else:
            merged.append((lo, hi))
    return merged


def _plain(token: str) -> bool:
    """Whether a token is words of one case, alone or joined as in paths and identifiers, with short numbers at most."""
    parts = [p for p in _JOINTS.split(token) if p]
    return bool(parts) and all(p.isalpha() and (p.islower() or p.isupper() or p.istitle()) or p.isdigit() and len(p) <= 4 for p in parts)


def _parts(text: str, start: int, end: int, words: list[tuple[int, int]], ends: list[int]) -> list[tuple[int, int]]:
    """What of an unbroken token may be the secret, widest first: a sensitive word may be part of the token."""
    at = bisect_left(words, (start, start))
    inside = at < len(words) and words[at][1] <= end
    if not inside:
        return [(start, end)]
    first, last = words[at]
    digit = lambda a, b: any(c.isdigit() for c in text[a:b])
    led = bisect_right(ends, start)
    whole = led and start - ends[led - 1] <= REACH or digit(start, end)
    return [(start, end)] * bool(whole) + [(last, end)] + [(start, first)] * digit(start, first)


def _carried(text: str, start: int, end: int, taken: bytearray) -> Iterator[tuple[int, int]]:
    """Unbroken lines that go on from a found span, after it and before it, as those of a wrapped key do.

    ``taken`` is 1 under base spans and 2 under novel ones, which are carried on by themselves.
    """
    head = start
    while head and text[head - 1] != "\n" and text[head - 1] not in _TOKEN_CHARACTERS:
        head -= 1
    alone = not head or text[head - 1] == "\n"
    at, body = end, alone and end - start >= 16
    while (rest := _LINE_REST.match(text, at)) and (line := _ALONE.match(text, rest.end())):
        a, b = line.span(1)
        token, last = text[a:b], text.startswith("-----END", line.end() + 1)
        full = len(token) >= 16 and not (_plain(token) or token.strip("-_=") == "")
        if not full and not (token.strip("-_=") and (last or body and not _plain(token) or token.endswith("="))):
            break
        if 2 in taken[a:b]:
            break
        if 0 in taken[a:b]:
            yield a, b
        at, body = b, full
        if not full:
            break
    while alone and head:
        lo = text.rfind("\n", 0, head - 1) + 1
        line = _ALONE.match(text, lo, head - 1)
        if not line or len(line[1]) < 16 or _plain(line[1]) or not line[1].strip("-_=") or 2 in taken[line.start(1) : line.end(1)]:
            break
        if 0 in taken[line.start(1) : line.end(1)]:
            yield line.span(1)
        head = lo


def novel_spans(text: str, base: list[tuple[int, int, int]], meter: NoveltyMeter) -> list[tuple[int, int, int]]:
    """Incompressible tokens with a digit or mixed case in a sensitive context that no base span touches.

    Unbroken lines beside a found token belong to it, however many there are; a base span may touch those.
    """
    words = [m.span() for m in _SENSITIVE.finditer(text)]
    urls = [m.span(1) for m in _URL_PASSWORD.finditer(text)] if "://" in text else []
    if not words and not urls:
        return []
    ends = [e for _, e in words]
    taken = bytearray(len(text))
    for a, _, b in base:
        taken[a:b] = b"\1" * (b - a)
    contexts, found = _contexts(text, words), []
    for a, b in urls:
        if not _plain(text[a:b]) and 1 not in taken[a:b] and meter.novel(text, a, b):
            found.append((a, 3, b))
            taken[a:b] = b"\1" * (b - a)
    at = 0
    for m in _CANDIDATE.finditer(text):
        while at < len(contexts) and contexts[at][1] <= m.start():
            at += 1
        if at == len(contexts):
            break
        if m.end() <= contexts[at][0]:
            continue
        for a, b in _parts(text, m.start(), m.end(), words, ends):
            if b - a >= 16 and not _plain(text[a:b]) and 1 not in taken[a:b] and meter.novel(text, a, b):
                found.append((a, 3, b))
                break
    for a, _, b in found:
        taken[a:b] = b"\2" * (b - a)
    for a, _, b in [*found, *(x for x in base if x[1] == 0)]:
        for c, d in _carried(text, a, b, taken):
            found.append((c, 3, d))
            taken[c:d] = b"\2" * (d - c)
    return found + repeats(text, base, [x for x in found if x[2] - x[0] >= 16])


def repeats(text: str, base: list[tuple[int, int, int]], found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Every further occurrence of a found token in the text that no span touches; one pass finds those of all tokens."""
    taken = bytearray(len(text))
    for a, _, b in [*base, *found]:
        taken[a:b] = b"\1" * (b - a)
    places: dict[str, list[int]] = {core(text[a:b]): [] for a, _, b in found}
    if not places:
        return []
    automaton = ahocorasick.Automaton()
    for value in places:
        automaton.add_word(value, value)
    automaton.make_automaton()
    for last, value in automaton.iter(text):
        place = last + 1 - len(value)
        if not places[value] or place >= places[value][-1] + len(value):
            places[value].append(place)
    more = []
    for value in sorted(places, key=lambda v: (-len(v), v)):
        for place in places[value]:
            end = place + len(value)
            if 1 not in taken[place:end]:
                more.append((place, 3, end))
                taken[place:end] = b"\1" * len(value)
    return more


def _long_hex_rows(texts: pa.Array) -> np.ndarray:
    """Rows whose bytes hold 32 hexadecimal digits in a row, found for all rows at once."""
    from lodestay.llm.common import text_buffers

    data, ends = text_buffers(texts)
    digit = ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 102))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], digit.view(np.int8), [0]])))
    start = edge[0::2][edge[1::2] - edge[0::2] >= 32]
    return np.unique(np.searchsorted(ends, start, "right") - 1)


def _spans(text: str, hexed: bool, meter: NoveltyMeter) -> list[tuple[int, int, int]]:
    """All spans of a text by start and kind; ``hexed`` says that it holds 32 hexadecimal digits in a row."""
    if not (hexed or "AKIA" in text or _SENSITIVE.search(text) or "://" in text):
        return []
    base = base_spans(text)
    return sorted(base + novel_spans(text, base, meter))


def _scan(words_of) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = NoveltyMeter(words_of.value)
        for batch in batches:
            for part in text_slices(batch, "text"):
                hexed = set(_long_hex_rows(part.column(1)).tolist())
                columns, counts = ([], [], [], []), []
                for i, text in enumerate(part.column(1).to_pylist()):
                    spans = _spans(text, i in hexed, meter) if text else []
                    counts.append(len(spans))
                    for start, kind, end in spans:
                        for column, value in zip(columns, (start, kind, end, meter.of(text, start, end)), strict=True):
                            column.append(value)
                arrays = [list_array(np.array(x, np.int64), counts) for x in columns[:3]] + [list_array(np.array(columns[3], np.float64), counts)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], ["doc_id", "starts", "kinds", "ends", "novelties"])

    return run


def _line_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each sensitive line, with a hash of the line."""
    for batch in batches:
        for part in text_slices(batch, "text"):
            words, lines = [], []
            for text in part.column(0).to_pylist():
                at = 0
                while text and (m := _SENSITIVE.search(text, at)):
                    lo = text.rfind("\n", 0, m.start()) + 1
                    at = text.find("\n", m.end())
                    at = len(text) if at < 0 else at
                    line = text[max(lo, m.start() - AROUND) : min(at, m.end() + AROUND)]
                    at = min(at, m.end() + AROUND)
                    found = sorted(set(_PART.findall(line)))
                    words += found
                    lines += [int.from_bytes(hashlib.blake2b(line.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(lines, pa.int64())], ["word", "line"])


def learn_words(docs: DataFrame, most: int = WORDS) -> list[str]:
    """The ``most`` words of sensitive lines of all ``docs`` (text) that stand in the most different lines, commonest first.

    Copies of a line count once, so a secret that many documents repeat is no word. Lines are counted approximately.
    """
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_line_words, "word string, line long")
    counted = rows.groupBy("word").agg(F.approx_count_distinct("line").alias("lines")).where(F.col("lines") >= LEAST_LINES)
    return [r["word"] for r in counted.orderBy(F.desc("lines"), "word").limit(most).collect()]


def scan(docs: DataFrame, words: list[str] | None = None) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, novelty>>) for every row of ``docs`` (doc_id, text).

    Spans are in code points, the end exclusive, by start and then by kind as listed in ``KINDS``; null and empty
    texts have none, repeated rows have theirs each, an empty table gives no rows. novelty is in bytes for each
    character. ``words`` are the dictionary's, learned from ``docs`` if not given. Further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn_words(docs) if words is None else words)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(_scan(shared), "doc_id long, starts array<long>, kinds array<long>, ends array<long>, novelties array<double>")
    names = F.array(*(F.lit(k) for k in KINDS))
    span = lambda x: F.struct(
        F.element_at(names, (x["kinds"] + 1).cast("int")).alias("kind"), x["starts"].alias("start"), x["ends"].alias("end"), x["novelties"].alias("novelty")
    )
    return found.select("doc_id", F.transform(F.arrays_zip("starts", "kinds", "ends", "novelties"), span).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, novelties): counts and joined spans of ``scan``'s rows.

    novelties has what each span adds in bytes for each of its characters, to two decimals.
    """
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    measured = F.array_join(F.transform("spans", lambda s: F.format_string("%.2f", s["novelty"])), ",")
    return found.select("doc_id", *counts, F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), measured.alias("novelties"))


def redact(docs: DataFrame, mark: str = "[SECRET]", words: list[str] | None = None) -> DataFrame:
    """``docs`` with every secret of the text replaced by ``mark``, overlapping ones by one; all other columns stay.

    Texts without a secret and null texts stay as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn_words(docs) if words is None else words)
    at, plain = docs.columns.index("text"), by_place(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = NoveltyMeter(shared.value)
        for batch in batches:
            for part in text_slices(batch, batch.schema.names[at]):
                hexed = set(_long_hex_rows(part.column(at)).tolist())
                texts = part.column(at).to_pylist()
                clean = [_redacted(t, _spans(t, i in hexed, meter), mark) if t else t for i, t in enumerate(texts)]
                yield part.set_column(at, part.schema.field(at), pa.array(clean, part.schema.field(at).type))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def _redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])
