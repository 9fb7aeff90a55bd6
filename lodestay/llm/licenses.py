"""License scans by template markup: wordings with optional and replaceable regions, compiled into one token automaton.

In a template, ``[...]`` is a region that may be left out, ``<a|b c>`` one that must have one of its wordings, and ``<1-9>``
one of so many words of any kind; all other words are mandatory. The automata of all templates are made deterministic
together; a table then takes all words of many texts at once, as possible beginnings, one word further at a time, so that
only beginnings of a template stay in play. A text is accepted where a template's mandatory wording stands, word by word.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestay.llm.common import text_buffers, text_slices
from lodestay.llm.shingles import _LOWER, padded, same_spans, span_hashes

#: Phrases that are always sought, and their labels.
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]

_HOLDER = "[copyright [c] <1-16>] [all rights reserved]"
_QUOTED = "<as is|“as is”>"
_UNDER = "<licensed|released|distributed|available|published> under [a|the terms of] [the]"
_FSF = "[as published by the free software foundation] [either]"
_LATER = "[of the license] [or] [at your option] [any later version]"
#: Public license texts and notices as templates.
TEMPLATES = [
    ("mit", _UNDER + " mit <license|licence>"),
    ("mit", f"""{_HOLDER} permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation
     files the <software|“software”> to deal in the software without restriction including without limitation the rights to use copy modify merge
     publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to
     the following conditions the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or
     substantial portions of the software the software is provided {_QUOTED} without warranty of any kind express or implied including but not limited
     to the warranties of merchantability fitness for a particular purpose and <noninfringement|non infringement> in no event shall
     <the authors or copyright holders|1-12> be liable for any claim damages or other liability whether in an action of contract tort or otherwise
     arising from out of or in connection with the software or the use or other dealings in the software"""),
    ("isc", f"""{_HOLDER} permission to use copy modify <and or|and> distribute this software for any purpose with or without fee is hereby granted provided that
     the above copyright notice and this permission notice appear in all copies the software is provided {_QUOTED} and <the author|isc|1-6> disclaims all
     warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <the author|isc|1-6> be liable
     for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of
     contract negligence or other tortious action arising out of or in connection with the use or performance of this software"""),
    ("bsd", f"""{_HOLDER} redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions
     are met [1] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [2]
     redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and
     or other materials provided with the distribution [[3] neither the name of <1-12> nor the names of <its|1-3> contributors may be used to endorse or
     promote products derived from this software without specific prior written permission] this software is provided by <1-12> {_QUOTED} and any express or
     implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"""),
    ("zlib", f"""{_HOLDER} this software is provided <as is|‘as is’|“as is”> without any express or implied warranty in no event will the <author|authors> be held
     liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial
     applications and to alter it and redistribute it freely subject to the following restrictions"""),
    ("unlicense", """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute
     this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"""),
    ("bsl-1", _UNDER + " boost software license version 1 [0]"),
    ("apache-2", _UNDER + " apache <license|licence> [version] <2|v2> [0]"),
    ("apache-2", """licensed under the apache license version 2 0 the <license|“license”> you may not use <this file|1-6> except in compliance with the
     license [you may obtain a copy of the license at <0-10> unless required by applicable law or agreed to in writing software distributed under the license is
     distributed on an <as is|“as is”> basis without warranties or conditions of any kind either express or implied]"""),
    ("gpl-2", f"{_UNDER} gnu <general public license|gpl> {_FSF} <version 2|v2|2> [0] {_LATER}"),
    ("gpl-3", f"{_UNDER} gnu <general public license|gpl> {_FSF} <version 3|v3|3> [0] {_LATER}"),
    ("lgpl-2.1", f"{_UNDER} gnu <lesser general public license|lgpl> {_FSF} <version 2 1|v2 1|2 1> {_LATER}"),
    ("lgpl-3", f"{_UNDER} gnu <lesser general public license|lgpl> {_FSF} <version 3|v3|3> [0] {_LATER}"),
    ("agpl-3", f"{_UNDER} gnu <affero general public license|agpl> {_FSF} <version 3|v3|3> [0] {_LATER}"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", _UNDER + " [creative commons] <cc by nc|attribution noncommercial|attribution non commercial> [<1|2|3|4> <0|5>] [international] [<license|licence>]"),
    ("cc-by-nc-sa", _UNDER + " [creative commons] <cc by nc sa|attribution noncommercial sharealike> [<1|2|3|4> <0|5>] [international] [<license|licence>]"),
    ("cc-by-sa", _UNDER + " [creative commons] <cc by sa|attribution sharealike|attribution share alike> [<1|2|3|4> <0|5>] [international] [<license|licence>]"),
    ("cc-by", _UNDER + " [creative commons] <cc by|attribution> <1|2|3|4> <0|5> [international] [<license|licence>]"),
    ("cc0", "<released|dedicated|published> <under|to> [the] [creative commons] <cc0|public domain under cc0> [1 0] [universal]"),
]

_WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_MARKUP = re.compile(r"\[|\]|<[^>]*>|[^\[\]<>]+")
#: Bytes of words once A-Z are lower-cased: digits, letters, and all of other characters.
_WORD_BYTE = np.ones(256, bool)
_WORD_BYTE[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False


class _Graph:
    """States with edges by a word, edges by any word (None), and free steps."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[str | None, int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def chain(self, at: int, words: list[str | None]) -> int:
        for word in words:
            after = self.state()
            self.edges[at].append((word, after))
            at = after
        return at

    def region(self, at: int, wordings: list[str]) -> int:
        """A region that one of ``wordings`` fills, each of them words or a range of a number of words."""
        end = self.state()
        for wording in wordings:
            span = re.fullmatch(r"\s*(\d+)-(\d+)\s*", wording)
            if span is None:
                self.free[self.chain(at, _WORDS.findall(wording.lower()))].append(end)
                continue
            now, (least, most) = at, map(int, span.groups())
            for n in range(most + 1):
                if n >= least:
                    self.free[now].append(end)
                if n < most:
                    now = self.chain(now, [None])
        return end

    def add(self, template: str) -> tuple[int, int]:
        """First and last state of a template."""
        first = at = self.state()
        opened: list[int] = []
        for part in _MARKUP.findall(template):
            if part == "[":
                opened.append(at)
                at = self.chain_free(at)
            elif part == "]":
                after = self.state()
                self.free[at].append(after)
                self.free[opened.pop()].append(after)
                at = after
            elif part[0] == "<":
                at = self.region(at, part[1:-1].split("|"))
            elif "|" in part:  # alternatives inside an optional region
                at = self.region(at, part.split("|"))
            else:
                at = self.chain(at, _WORDS.findall(part.lower()))
        if opened:
            raise ValueError(f"an optional region is not closed: {template[:60]}")
        return first, at

    def chain_free(self, at: int) -> int:
        after = self.state()
        self.free[at].append(after)
        return after

    def closed(self, states: set[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


class Automaton:
    """The deterministic automaton of templates (label, markup); state 0 is dead, state 1 the beginning."""

    def __init__(self, templates: list[tuple[str, str]]):
        graph = _Graph()
        ends = [graph.add(markup) for _, markup in templates]
        sets = {frozenset(): 0, graph.closed({first for first, _ in ends}): 1}
        rows: list[tuple[int, dict[str, int]]] = [(0, {})]
        todo = [s for s in sets if s]
        for now in todo:
            steps = [e for s in now for e in graph.edges[s]]
            always = {t for w, t in steps if w is None}
            targets = {w: graph.closed(always | {t for x, t in steps if x == w}) for w in {w for w, _ in steps if w is not None}}
            for target in [graph.closed(always), *targets.values()]:
                if target not in sets:
                    sets[target] = len(sets)
                    todo.append(target)
            rows.append((sets[graph.closed(always)], {w: sets[t] for w, t in targets.items()}))
        self.vocabulary = sorted({w for _, step in rows for w in step})
        number = {w: i + 1 for i, w in enumerate(self.vocabulary)}
        self.table = np.zeros((len(rows), len(number) + 1), np.int32)
        for i, (default, step) in enumerate(rows):
            self.table[i] = default
            for w, t in step.items():
                self.table[i, number[w]] = t
        last = {end: i for i, (_, end) in enumerate(ends)}
        self.accepted = [[last[s] for s in states if s in last] for states in sorted(sets, key=sets.get)]
        if self.accepted[1]:
            raise ValueError("a template has no mandatory word")
        self.accepts = np.array([bool(x) for x in self.accepted])
        raw = [w.encode() for w in self.vocabulary]
        self.spelt, sizes = padded(np.frombuffer(b"".join(raw), np.uint8)), np.fromiter(map(len, raw), np.int64)
        starts = np.cumsum(sizes) - sizes
        hashes = span_hashes(self.spelt[:-8], starts, starts + sizes)
        order = np.argsort(hashes)
        self.hashes, self.number, self.starts, self.sizes = hashes[order], order + 1, starts[order], sizes[order]

    def words(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Numbers of the words in the vocabulary, 0 for those outside it; bytes are compared where hashes are equal."""
        hashes, sizes = span_hashes(data, starts, stops), stops - starts
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        like = np.flatnonzero((self.hashes[at] == hashes) & (self.sizes[at] == sizes))
        same = like[same_spans(padded(data), starts[like], sizes[like], self.spelt, self.starts[at[like]])]
        out = np.zeros(len(starts), np.int64)
        out[same] = self.number[at[same]]
        return out

    def match(self, words: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(template, start, end) of every match in the words; ``stops`` is where the text of each word ends.

        Of the matches of a template from one start the longest counts, and of those to one end the first.
        """
        found: list[np.ndarray] = []
        state = self.table[1][words]
        start = np.flatnonzero(state)
        state, end = state[start], start + 1
        while len(start):
            hit = np.flatnonzero(self.accepts[state])
            for s in np.unique(state[hit]).tolist():
                of = hit[state[hit] == s]
                found += [np.stack([np.full(len(of), t), start[of], end[of]]) for t in self.accepted[s]]
            on = end < stops[start]
            start, end, state = start[on], end[on], state[on]
            state = self.table[state, words[end]]
            on = state > 0
            start, end, state = start[on], end[on] + 1, state[on]
        template, start, end = np.concatenate([np.zeros((3, 0), np.int64), *found], 1)
        order = np.lexsort((-end, start, template))
        template, start, end = template[order], start[order], end[order]
        first = np.ones(len(order), bool)
        first[1:] = (template[1:] != template[:-1]) | (start[1:] != start[:-1])
        template, start, end = template[first], start[first], end[first]
        order = np.lexsort((start, end, template))
        template, start, end = template[order], start[order], end[order]
        first = np.ones(len(order), bool)
        first[1:] = (template[1:] != template[:-1]) | (end[1:] != end[:-1])
        return template[first], start[first], end[first]


_SPAN = "array<struct<template:int,label:string,start:long,end:long>>"
_FIELDS = [("template", pa.int32()), ("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]


def _scan(templates: list[tuple[str, str]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(templates)
        labels = pa.array([label for label, _ in templates])
        for batch in batches:
            for rows in text_slices(batch, "text"):
                raw, ends = text_buffers(rows.column(1))
                data = _LOWER[raw]
                inside = _WORD_BYTE[data]
                edge = np.zeros(len(data) + 1, bool)
                edge[ends] = True
                first, last = inside.copy(), inside.copy()
                first[1:] &= ~inside[:-1] | edge[1:-1]
                last[:-1] &= ~inside[1:] | edge[1:-1]
                starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
                bounds = np.searchsorted(starts, ends)
                n = np.diff(bounds)
                row = np.repeat(np.arange(len(n)), n)
                if len(starts):
                    template, start, end = automaton.match(automaton.words(data, starts, stops), bounds[1:][row])
                else:
                    template = start = end = np.zeros(0, np.int64)
                order = np.lexsort((template, end, start))
                template, start, end = template[order], start[order], end[order]
                edges = np.zeros(len(starts) + 1, np.int64)
                np.add.at(edges, start, 1)
                np.add.at(edges, end, -1)
                covered = np.concatenate([[0], np.cumsum(np.cumsum(edges[:-1]) > 0)])
                of = row[start] if len(start) else start
                values = [pa.array(template, pa.int32()), labels.take(pa.array(template)), pa.array(start - bounds[of]), pa.array(end - bounds[of])]
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(n) + 1)).astype(np.int32)), pa.StructArray.from_arrays(values, fields=[pa.field(*f) for f in _FIELDS]))
                columns = [rows.column(0), pa.array(n.astype(np.int64)), pa.array(np.diff(covered[bounds]).astype(np.int64)), spans]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "covered", "spans"])

    return run


def license_spans(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, n_words, covered, spans) of every row of ``docs`` (doc_id, text).

    spans (template, label, start, end) are places of words from 0, end exclusive, in order; the first templates are the
    ``BASE`` phrases. covered counts the words inside any span. Null and empty texts have no words and no spans;
    rows that repeat an id are scanned each; an empty table stays empty; other columns are ignored. Nothing is shuffled.
    """
    every = BASE + (TEMPLATES if templates is None else templates)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan(every), f"doc_id long, n_words long, covered long, spans {_SPAN}")


def _joined(spans: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts and labels of ``license_spans``; score is the share of a text's words inside spans, 0 without words."""
    base = F.filter("spans", lambda s: s["template"] < len(BASE))
    starts = F.transform("base", lambda s: s["start"])
    return found.withColumn("base", base).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        _joined(F.col("base")).alias("base_labels"), _joined(F.col("spans")).alias("labels"),
        F.when(F.col("n_words") > 0, F.col("covered") / F.col("n_words")).otherwise(0.0).alias("score"),
    )
