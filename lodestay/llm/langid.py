"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read in windows of consecutive bytes. Two recurrent networks read each window, one from either end, with a
margin of the neighbouring bytes before and after it, so that their states know what surrounds the window; from both
states a softmax labels every position once, and the mean over all positions of all windows gives the document's
probabilities. The network is trained here, in numpy, by backpropagation through time over whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestay.llm.common import by_place, held_out, text_buffers, text_slices, with_field

#: Documents that training takes at most (those of the smallest hashed ids), and bytes of their texts: a document is
#: taken whole or, if it would not fit any more, not at all.
SAMPLE, SAMPLE_BYTES = 3000, 1 << 20
#: Bytes of a window and of the margin on either side of it; hidden units of each direction; passes over the windows.
WINDOW, MARGIN, HIDDEN, EPOCHS = 128, 16, 8, 8
#: Windows that are read side by side, and those of one training step.
_SIDE, _STEP = 2048, 256
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Gru:
    """One direction. Rows of ``table`` (one column per byte) and ``turn`` are update, reset and candidate units."""

    table: np.ndarray
    turn: np.ndarray

    @classmethod
    def new(cls, hidden: int, random: np.random.Generator) -> Gru:
        draw = lambda *shape: random.normal(0, 0.3, shape).astype(np.float32)
        return cls(draw(3 * hidden, 256), draw(3 * hidden, hidden))

    def read(self, steps: np.ndarray) -> np.ndarray:
        """States (step, unit, window) after each byte of ``steps`` (step, window)."""
        h = self.turn.shape[1]
        out = np.zeros((len(steps) + 1, h, steps.shape[1]), np.float32)
        for t, codes in enumerate(steps):
            given = np.take(self.table, codes, axis=1)
            kept = self.turn @ out[t]
            gates = given[: 2 * h]
            gates += kept[: 2 * h]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            new = kept[2 * h :]
            new *= gates[h:]
            new += given[2 * h :]
            np.tanh(new, out=new)
            np.subtract(out[t], new, out=out[t + 1])
            out[t + 1] *= gates[:h]
            out[t + 1] += new
        return out[1:]

    def read_for_training(self, steps: np.ndarray) -> tuple[np.ndarray, list]:
        h = self.turn.shape[1]
        state = np.zeros((h, steps.shape[1]), np.float32)
        states, saved = [], []
        for codes in steps:
            given, kept = self.table[:, codes], self.turn @ state
            gates = 0.5 * (1 + np.tanh(0.5 * (given[: 2 * h] + kept[: 2 * h])))
            new = np.tanh(given[2 * h :] + gates[h:] * kept[2 * h :])
            saved.append((codes, state, gates, new, kept[2 * h :]))
            state = new + gates[:h] * (state - new)
            states.append(state)
        return np.stack(states), saved

    def slopes(self, saved: list, upstream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of table and turn, from those of the states (step, unit, window)."""
        h = self.turn.shape[1]
        of_turn, by_step = np.zeros_like(self.turn), []
        back = np.zeros_like(upstream[0])
        for t in reversed(range(len(saved))):
            codes, state, gates, new, kept = saved[t]
            update, reset = gates[:h], gates[h:]
            d = upstream[t] + back
            d_new = d * (1 - update) * (1 - new**2)
            d_update = d * (state - new) * update * (1 - update)
            d_reset = d_new * kept * reset * (1 - reset)
            d_given = np.concatenate([d_update, d_reset, d_new])
            d_kept = np.concatenate([d_update, d_reset, d_new * reset])
            by_step.append(d_given)
            of_turn += d_kept @ state.T
            back = d * update + self.turn.T @ d_kept
        codes = np.concatenate([x[0] for x in reversed(saved)])
        of_bytes = np.concatenate(by_step, 1)
        return np.stack([np.bincount(codes, row, 256) for row in of_bytes]).astype(self.table.dtype), of_turn


@dataclass
class ByteTagger:
    languages: list[str]
    ahead: Gru
    behind: Gru
    out: np.ndarray
    bias: np.ndarray
    _moments: dict = field(default_factory=dict)

    @classmethod
    def new(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 5) -> ByteTagger:
        random = np.random.default_rng(seed)
        n = len(languages)
        return cls(languages, Gru.new(hidden, random), Gru.new(hidden, random), random.normal(0, 0.3, (n, 2 * hidden)).astype(np.float32), np.zeros((n, 1), np.float32))

    def _softmax(self, ahead: np.ndarray, behind: np.ndarray) -> np.ndarray:
        h = ahead.shape[1]
        scores = np.matmul(self.out[:, :h], ahead) + np.matmul(self.out[:, h:], behind) + self.bias
        scores -= scores.max(1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(1, keepdims=True)
        return scores

    def window_sums(self, windows: Windows) -> np.ndarray:
        """Summed position probabilities (window, language), margins left out."""
        out = np.zeros((len(windows.row), len(self.languages)), np.float32)
        order = np.argsort(windows.length, kind="stable")  # windows of like lengths need the fewest steps together
        for lo in range(0, len(order), _SIDE):
            pick = order[lo : lo + _SIDE]
            steps, valid = windows.steps(pick)
            p = self._softmax(self.ahead.read(steps), self.behind.read(steps[::-1])[::-1])
            out[pick] = np.einsum("tlb,tb->bl", p, valid)
        return out

    def learn(self, steps: np.ndarray, valid: np.ndarray, labels: np.ndarray, rate: float) -> float:
        """One Adam step on the mean cross-entropy over the ``valid`` positions (step, window)."""
        valid = valid / max(valid.sum(), 1)
        ahead, saved_ahead = self.ahead.read_for_training(steps)
        behind, saved_behind = self.behind.read_for_training(steps[::-1])
        behind = behind[::-1]
        p = self._softmax(ahead, behind)
        picked = p[:, labels, np.arange(len(labels))]
        loss = float(-(np.log(np.maximum(picked, 1e-9)) * valid).sum())
        p[:, labels, np.arange(len(labels))] -= 1
        p *= valid[:, None]
        h = ahead.shape[1]
        up_ahead, up_behind = np.matmul(self.out[:, :h].T, p), np.matmul(self.out[:, h:].T, p)
        of_out = np.concatenate([np.einsum("tlb,thb->lh", p, ahead), np.einsum("tlb,thb->lh", p, behind)], 1)
        table_a, turn_a = self.ahead.slopes(saved_ahead, up_ahead)
        table_b, turn_b = self.behind.slopes(saved_behind, up_behind[::-1])
        slopes = [table_a, turn_a, table_b, turn_b, of_out, p.sum((0, 2))[:, None]]
        values = [self.ahead.table, self.ahead.turn, self.behind.table, self.behind.turn, self.out, self.bias]
        count = self._moments["count"] = self._moments.get("count", 0) + 1
        for i, (value, slope) in enumerate(zip(values, slopes, strict=True)):
            first, second = self._moments.get(i, (0, 0))
            first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
            self._moments[i] = (first, second)
            value -= (rate * (first / (1 - 0.9**count)) / (np.sqrt(second / (1 - 0.99**count)) + 1e-8)).astype(np.float32)
        return loss

    @classmethod
    def fit(cls, languages: list[str], windows: Windows, labels: np.ndarray, epochs: int = EPOCHS) -> ByteTagger:
        """Learn from windows, each with the number of its language."""
        model, random = cls.new(languages), np.random.default_rng(9)
        total = epochs * max(1, len(labels) // _STEP)
        done = 0
        for _ in range(epochs if len(languages) > 1 else 0):
            order = random.permutation(len(labels))
            for lo in range(0, len(order), _STEP):
                pick = order[lo : lo + _STEP]
                model.learn(*windows.steps(pick), labels[pick], 0.02 * max(0.1, 1 - done / total))
                done += 1
        model._moments = {}
        return model


@dataclass
class Windows:
    """Windows of the bytes of several texts: where each begins with its margin, its length, the positions that count
    (from ``head`` on, ``counted`` of them) and the row of its text."""

    data: np.ndarray
    start: np.ndarray
    length: np.ndarray
    head: np.ndarray
    counted: np.ndarray
    row: np.ndarray

    @classmethod
    def cut(cls, data: np.ndarray, ends: np.ndarray, size: int = WINDOW, margin: int = MARGIN) -> Windows:
        """Every byte of every row counts in one window."""
        sizes = np.diff(ends)
        count = -(-sizes // size)
        row = np.repeat(np.arange(len(sizes)), count)
        begin = ends[row] + size * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
        counted = np.minimum(size, ends[row + 1] - begin)
        start = np.maximum(begin - margin, ends[row])
        length = np.minimum(begin + counted + margin, ends[row + 1]) - start
        return cls(np.concatenate([data, np.zeros(size + 2 * margin, np.uint8)]), start, length, begin - start, counted, row)

    def steps(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes (step, window) of some windows, and which of their positions count."""
        step = np.arange(int(self.length[pick].max(initial=1)))[:, None]
        head = self.head[pick]
        valid = (step >= head) & (step < head + self.counted[pick])
        codes = self.data[self.start[pick] + step].astype(np.intp)
        codes[step >= self.length[pick]] = 0
        return codes, valid.astype(np.float32)


def train(docs: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> ByteTagger:
    """Fit on whole documents with a text, a language and an id that is not held out, within both bounds."""
    usable = docs.where("text is not null and text <> '' and lang is not null and doc_id is not null").where(~held_out("doc_id"))
    sized = usable.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length("text").alias("bytes"), F.xxhash64("doc_id").alias("h"))
    chosen, left = {}, sample_bytes
    for doc_id, size, _ in sized.orderBy("h", "doc_id", "bytes").limit(sample).collect():
        if doc_id not in chosen and (size <= left or not chosen):
            chosen[doc_id], left = size, left - size
    ids = docs.sparkSession.createDataFrame([(i,) for i in chosen], "doc_id long")
    rows = usable.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    found = rows.groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("d")).select("doc_id", "d.lang", "d.text").toArrow().sort_by("doc_id")
    names = found.column("lang").to_pylist()
    languages = sorted(set(names))
    windows = Windows.cut(*text_buffers(found.column("text").combine_chunks())) if names else Windows.cut(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    labels = np.array([languages.index(x) for x in names], np.int64)
    return ByteTagger.fit(languages, windows, labels[windows.row])


def _has_letter(texts: pa.Array, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    sums = np.concatenate([[0], np.cumsum(ascii_letter)])
    has = sums[ends[1:]] > sums[ends[:-1]]
    for i in np.flatnonzero(~has):
        has[i] = bool(_LETTER.search(texts[i].as_py() or ""))
    return has


def label_batch(model: ByteTagger, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """The language of each text, ``und`` if it has no letter, and the pooled probability."""
    data, ends = text_buffers(texts)
    pooled = np.zeros((len(texts), len(model.languages)))
    if len(model.languages):
        windows = Windows.cut(data, ends)
        np.add.at(pooled, windows.row, model.window_sums(windows))
    pooled /= np.maximum(np.diff(ends), 1)[:, None]
    known = _has_letter(texts, data, ends) & (len(model.languages) > 0)
    best = pooled.argmax(1) if len(model.languages) else np.zeros(len(texts), np.int64)
    names = [model.languages[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
    score = np.where(known, pooled.max(1, initial=0), 0.0).clip(0, 1)
    return names, score


def keep_known(docs: DataFrame, least: float) -> DataFrame:
    """The rows of ``docs`` with a language of probability ``least`` or more, all their columns as they are.

    Null texts and texts without a letter have none.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs))
    at, plain = docs.columns.index("text"), by_place(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, batch.schema.names[at]):
                names, score = label_batch(model.value, part.column(at))
                score = np.where(np.array(names) == "und", -1.0, score)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score, pa.float64())], [*part.schema.names, "score"])

    found = plain.mapInArrow(run, with_field(plain.schema, "score", T.DoubleType()))
    return found.where(F.col("score") >= least).drop("score").toDF(*docs.columns)


def identify(docs: DataFrame, model: ByteTagger | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs`` (doc_id, text, lang).

    Only the text is an input of a prediction. Null texts and texts without a letter are ``und`` with score 0, as
    are all texts if no language can be learned. Further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(_labels(shared), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def _labels(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                names, score = label_batch(model.value, part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run
