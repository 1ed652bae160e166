"""Quality rules: exact text statistics and a calibrated n-gram classifier.

The classifier is a logistic regression over hashed word n-grams (one and two
words) and hashed character trigrams (counts through log(1+x), rows scaled to unit
length), fitted on at most ``most`` labelled rows drawn by a hash of their id,
calibrated by Platt scaling on a fifth of them that the fit has not seen, and scored
in Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.shared import arrow_map, mix64, runs, slices, strings
from sparkwright.llm.wordhash import SPACE, Words, slice_hashes

#: Buckets for word n-grams and as many for character trigrams.
WIDTH = 2048
SYMBOLS = np.zeros(256, bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
#: Fixed thresholds of the base rules and of the classifier.
LEAST_WORDS, MOST_REPEATED_PERCENT, LEAST_PROBABILITY = 10, 20, 0.5


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeated_words(words: Words, size: int = 5) -> np.ndarray:
    """Words of each row inside windows of ``size`` words that occur twice or more in it."""
    n = len(words.start)
    out = np.zeros(len(words.count), np.int64)
    if n < size:
        return out
    grams = words.grams(size)
    fits = np.arange(n) + size <= words.first[1:][words.row]
    at = np.flatnonzero(fits)
    if not len(at):
        return out
    order = at[np.lexsort((grams[at], words.row[at]))]
    same = (grams[order[1:]] == grams[order[:-1]]) & (words.row[order[1:]] == words.row[order[:-1]])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, order[twice], 1)
    np.add.at(change, order[twice] + size, -1)
    covered = np.cumsum(change[:-1]) > 0
    return np.bincount(words.row[covered], minlength=len(out)).astype(np.int64)


def _repeated_lines(words: Words) -> np.ndarray:
    """Lines of each row with a word that equal an earlier line of it."""
    data, offsets = words.data, words.offsets
    rows = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    start = np.concatenate((offsets[:-1], breaks + 1))
    row = np.concatenate((np.arange(rows), np.searchsorted(offsets, breaks, "right") - 1))
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    last = np.concatenate((row[1:] != row[:-1], [True])) if len(row) else np.zeros(0, bool)
    end = np.where(last, offsets[1:][row], np.concatenate((start[1:], [0])) - 1)
    filled = np.concatenate(([0], np.cumsum(~SPACE[data], dtype=np.int64)))
    has = filled[end] > filled[start]
    start, end, row = start[has], end[has], row[has]
    h = slice_hashes(data, start, end)
    order = np.lexsort((h, row))
    again = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
    return np.bincount(row[order][1:][again], minlength=rows).astype(np.int64)


def _characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The start and the bytes (as one number) of each character."""
    start = np.flatnonzero((data & 0xC0) != 0x80)
    value = data[start].astype(np.uint32)
    if len(start) < len(data):
        length = np.diff(np.append(start, len(data)))
        for k in range(1, 4):
            more = np.flatnonzero(length > k)
            value[more] = value[more] << 8 | data[start[more] + k]
    return start, value


def _features(words: Words) -> np.ndarray:
    """Rows by 2 * WIDTH, unit length."""
    data, rows = words.data, len(words.count)
    out = np.zeros((rows, 2 * WIDTH), np.float32)
    pairs = np.flatnonzero(np.arange(len(words.row)) + 2 <= words.first[1:][words.row])
    grams = np.concatenate((words.hash, words.grams(2)[pairs]))
    cell = np.concatenate((words.row, words.row[pairs])) * WIDTH + (grams & np.uint64(WIDTH - 1)).astype(np.int64)
    out[:, :WIDTH] = np.bincount(cell, minlength=rows * WIDTH).reshape(rows, WIDTH)
    start, char = _characters(data)
    if len(char) >= 3:
        tri = char[:-2] * np.uint32(2654435761) + char[1:-1] * np.uint32(2246822519) + char[2:] * np.uint32(3266489917)
        tri = (tri >> np.uint32(32 - WIDTH.bit_length() + 1)).astype(np.int64)
        row = np.searchsorted(words.offsets, start, "right") - 1
        fits = row[:-2] == row[2:]
        out[:, WIDTH:] = np.bincount((row[:-2] * WIDTH + tri)[fits], minlength=rows * WIDTH).reshape(rows, WIDTH)
    np.log1p(out, out=out)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.maximum(norm, 1e-9)


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, features: np.ndarray) -> np.ndarray:
        z = self.slope * (features @ self.weights + self.bias) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by accelerated gradient steps."""
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    pw, pb = w, b
    rate = 4.0
    for k in range(steps):
        m = k / (k + 3)
        vw, vb = w + m * (w - pw), b + m * (b - pb)
        r = weight * (1 / (1 + np.exp(-(x @ vw + vb))) - y)
        pw, pb = w, b
        w, b = vw - rate * (x.T @ r + ridge * vw), vb - rate * float(r.sum())
    return w, b


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = 4000) -> QualityModel | None:
    """Fit on the labelled rows (label 1: good, 0: bad) with the ``most`` smallest
    hashes of their id. None where both labels do not occur.

    Only hashed feature rows of fixed width reach the driver (at most ``most`` of
    them, 16 KB each). Rows with a null id, label or text are not used; of texts that
    share an id, the one of the smallest hash is."""
    drawn = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
        .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
        .orderBy(F.xxhash64("id"), "id").limit(most)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")

    def rows(batch: pa.RecordBatch):
        data, offsets = strings(batch.column(2))
        for lo, hi in runs(offsets):
            x = _features(Words(data, offsets[lo : hi + 1])).astype(np.float16)
            yield pa.RecordBatch.from_arrays([*(batch.column(k)[lo:hi] for k in (0, 1, 3)), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "y", "h", "x"])

    seen = arrow_map(texts.join(drawn, "id").select("id", "y", "text", F.xxhash64("text").alias("h")), rows, "id long, y int, h long, x binary")
    got = seen.groupBy("id").agg(F.min_by(F.struct("y", "x"), "h").alias("r")).select("id", "r.y", "r.x").toArrow().sort_by("id")
    y = got["y"].to_numpy().astype(np.float32)
    if not len(y) or y.min() == y.max():
        return None
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float16).reshape(len(y), -1).astype(np.float32)
    held = (mix64(got["id"].to_numpy().astype(np.uint64)) % np.uint64(5)) == 0
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        held = np.zeros(len(y), bool)
    xt, yt = x[~held], y[~held]
    # Both classes weigh the same.
    weight = np.where(yt == 1, 0.5 / max(1, (yt == 1).sum()), 0.5 / max(1, (yt == 0).sum())).astype(np.float32)
    w, b = _logistic(xt, yt, weight, 1e-4, 400)
    slope, shift = 1.0, 0.0
    if held.any():
        z, t = x[held] @ w + b, y[held]
        scale = float(np.abs(z).mean()) or 1.0
        a, shift = _logistic((z / scale)[:, None].astype(np.float32), t, np.full(len(t), 1 / len(t), np.float32), 1e-3, 400)
        slope = float(a[0]) / scale
    return QualityModel(w, float(b), max(slope, 1e-6), float(shift))


def judge(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, probability (of good quality), kept.

    A null text counts as empty and fails the base rules (too few words). A text of
    any length is judged whole. Without a model every text that passes them is kept.
    Ids are passed through as they are, null or repeated; other columns are not
    looked at. An empty table gives an empty result."""

    def rows(batch: pa.RecordBatch):
        data, offsets = strings(batch.column(1))
        for lo, hi in runs(offsets):
            words = Words(data, offsets[lo : hi + 1])
            n = words.count.astype(np.int64)
            chars = _per_row(~SPACE[words.data] & ((words.data & 0xC0) != 0x80), words.offsets)
            symbols = _per_row(SYMBOLS[words.data], words.offsets)
            repeat = _repeated_words(words)
            failed = (n < LEAST_WORDS) | (100 * repeat > MOST_REPEATED_PERCENT * n)
            p = model.probability(_features(words)).astype(np.float64) if model is not None else np.ones(len(n))
            kept = ~failed & (p >= LEAST_PROBABILITY)
            columns = [n, chars, symbols, _repeated_lines(words), repeat, failed, p, kept]
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], *map(pa.array, columns)], names=names)

    names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"]
    schema = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"
    out = arrow_map(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), rows, schema)
    return out.withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: QualityModel | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is kept, unchanged, with all their columns."""
    at = docs.columns.index(text_col)

    def rows(batch: pa.RecordBatch):
        data, offsets = strings(batch.column(at))
        keep = np.zeros(batch.num_rows, bool)
        for lo, hi in runs(offsets):
            words = Words(data, offsets[lo : hi + 1])
            n, repeat = words.count, _repeated_words(words)
            good = (n >= LEAST_WORDS) & (100 * repeat <= MOST_REPEATED_PERCENT * n)
            if model is not None:
                good &= model.probability(_features(words)) >= LEAST_PROBABILITY
            keep[lo:hi] = good
        yield batch.filter(pa.array(keep))

    return docs.mapInArrow(lambda batches: (x for b in batches for part in slices(b, at) for x in rows(part)), docs.schema)
