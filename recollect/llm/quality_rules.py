"""Quality rules: exact text statistics, fixed base limits, and a calibrated n-gram classifier.

The classifier is a logistic regression over hashed word n-grams (one and two
words) and hashed character trigrams, fitted on labelled quality rows (at most
``MAX_TRAIN_ROWS``, a documented bound), Platt-calibrated on a part that the
fit doesn't see, and scored in Arrow batches against ``THRESHOLD``.

Defined results: a null text has no words, so it fails the base rule like any
text under 20 words; with no usable labels only the base rules decide; repeated
rows give equal results; extra columns are ignored; an empty table stays empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, linear, runtime

WORD_BITS = CHAR_BITS = 11
DIM = (1 << WORD_BITS) + (1 << CHAR_BITS)
#: Labelled rows that the classifier is fitted on, at most.
MAX_TRAIN_ROWS = 5_000
THRESHOLD = 0.5
MIN_WORDS = 20
#: Most percent of words that may stand in repeated windows.
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that stand in a window of ``window`` words found twice or more (all places count).

    Windows are ranked exactly by doubling: a run of 2k words is the pair of
    the ranks of its two runs of k words.  ``window`` is a power of two.  Most
    texts need no ranks: if all hashes of windows differ, so do the windows.
    """
    n = len(ids)
    if n <= window:
        return 0
    h = np.uint64(0)
    number = ids.astype(np.uint64) + np.uint64(1)
    for k in range(window):
        h = h * np.uint64(0x9E3779B97F4A7C15) + number[k : n - window + 1 + k]
    h.sort()
    if (h[1:] != h[:-1]).all():
        return 0
    rank, k = ids.astype(np.int64), 1
    while k < window:
        width = np.int64(rank.max()) + 1
        both = rank[:-k] * width + rank[k:]
        values, rank, counts = np.unique(both, return_inverse=True, return_counts=True)
        if len(values) == len(both):
            return 0
        k *= 2
    twice = counts[rank] > 1
    if not twice.any():
        return 0
    mark = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    mark[at] += 1
    np.subtract.at(mark, at + window, 1)
    return int((np.cumsum(mark[:n]) > 0).sum())


def statistics(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one text."""
    data = text.encode()
    words = data.split()
    n = len(words)
    if not n:
        return 0, 0, sum(map(text.count, SYMBOLS)), 0, 0
    spaces = sum(map(text.count, " \t\n\v\f\r"))
    lines = [x for x in data.split(b"\n") if x.strip()]
    ids: dict[bytes, int] = {}
    number = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n) if n > WINDOW else None
    repeats = repeated_words(number) if number is not None and len(ids) < n else 0
    return n, len(text) - spaces, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats


def _codes(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(code, first of each document, offset into the feature space is already added) for both kinds."""
    w = blocks.Words(data, offsets, blocks.SOLID)
    h = w.hashes(salt=3)
    one = (h & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)
    two = np.zeros(len(h), np.int64)
    if len(h) > 1:
        same = h[1:] == h[:-1]
        pair = (blocks.mix(h[:-1] + (h[1:] << np.uint64(1)), 4) & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)
        two[1:] = np.where(same, 0, np.maximum(pair, 1))  # code 0: a word after itself
    starts = w.first[:-1][np.diff(w.first) > 0]
    two[starts] = one[starts]
    # Behind a document's end stand zeros, so no trigram holds a byte of the next one.
    chars = data.astype(np.uint32)
    second, third = np.append(chars[1:], np.uint32(0))[: len(chars)], np.append(chars[2:], np.zeros(2, np.uint32))[: len(chars)]
    sizes = np.diff(offsets)
    second[offsets[1:][sizes > 0] - 1] = 0
    third[offsets[1:][sizes > 0] - 1] = 0
    third[offsets[1:][sizes > 1] - 2] = 0
    tri = chars * np.uint32(0x9E3779B1) + second * np.uint32(0x85EBCA77) + third * np.uint32(0xC2B2AE3D)
    tri ^= tri >> np.uint32(15)
    tri *= np.uint32(0x2C1B3C6D)
    c = (tri >> np.uint32(32 - CHAR_BITS)).astype(np.int64) + (1 << WORD_BITS)
    return [(one, w.first), (two, w.first), (c, offsets)]


def vectors(col: pa.Array) -> np.ndarray:
    """Square roots of relative n-gram frequencies, one row per text."""
    out = np.zeros((len(col), DIM), np.float32)
    for first, last, data, offsets in blocks.blocks(col, most=256):
        n = last - first
        for code, cuts in _codes(data, offsets):
            doc = np.repeat(np.arange(n), np.diff(cuts))
            counts = np.bincount(doc * DIM + code, minlength=n * DIM).reshape(n, DIM)
            out[first:last] += counts / np.maximum(1, np.diff(cuts))[:, None]
    return out


def fit(x: np.ndarray, y: np.ndarray, steps: int = 250) -> dict:
    """A model of ``vectors`` rows with labels 0 or 1; one row in five is left for calibration."""
    n = len(y)
    if not n or y.min() == y.max():
        return {"weights": np.zeros(DIM), "bias": 0.0, "scale": (0.0, 40.0)}
    held = np.arange(n) % 5 == 0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    xt, yt = x[~held], y[~held]
    scale = 1.0 / np.maximum(1e-3, xt.std(axis=0))
    xt = xt * scale
    weight = linear.class_weights(yt) / len(yt)

    def gradient(p):
        d = (linear.sigmoid(xt @ p[0] + p[1][0]) - yt) * weight
        return [(xt.T @ d.astype(np.float32)) + 1e-3 * p[0], np.array([d.sum()])]

    w, b = linear.adam([np.zeros(DIM, np.float32), np.zeros(1)], gradient, steps, 0.02)
    w = (w * scale).astype(np.float64)
    xc, yc = (x[held], y[held]) if held.any() else (x, y)
    return {"weights": w, "bias": float(b[0]), "scale": linear.platt(xc @ w + b[0], yc)}


def probabilities(col: pa.Array, model: dict) -> np.ndarray:
    """Calibrated probability of label 1 for each text."""
    out = np.empty(len(col))
    w = model["weights"]
    for first, last, data, offsets in blocks.blocks(col):
        z = np.full(last - first, model["bias"])
        for code, cuts in _codes(data, offsets):
            z += blocks.segment_sums(w[code], cuts) / np.maximum(1, np.diff(cuts))
        out[first:last] = linear.sigmoid(model["scale"][0] * z + model["scale"][1])
    return out


def train(docs: DataFrame, labels: DataFrame, use=None, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", bound: int = MAX_TRAIN_ROWS) -> dict:
    """Fit on at most ``bound`` labelled documents for which the column ``use`` holds."""
    sample = runtime.bounded_labels(labels, label, F.lit(True) if use is None else use, bound, id_col, docs)
    texts = runtime.labelled_texts(docs, sample, id_col, text_col)
    got = runtime.map_text(texts, lambda col: [[v.astype(np.float16).tobytes() for v in vectors(col)]], [("v", "binary")], keep=("y",)).toArrow()
    y = got.column("y").to_numpy().astype(float)
    rows = got.column("v").to_pylist()
    order = sorted(range(len(rows)), key=lambda i: rows[i])
    x = np.array([np.frombuffer(rows[i], np.float16) for i in order], np.float32).reshape(len(rows), DIM)
    return fit(x, y[order])


def assess(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Statistics, base verdict, probability and verdict of every document; no shuffle."""

    def kernel(col: pa.Array) -> list:
        s = np.array([statistics(t) for t in col.to_pylist()], np.int64).reshape(len(col), 5)
        p = probabilities(col, model)
        failed = (s[:, 0] < MIN_WORDS) | (100 * s[:, 4] > MAX_REPEAT_PERCENT * s[:, 0])
        return [*(np.ascontiguousarray(s[:, i]) for i in range(5)), failed, p, ~failed & (p >= threshold)]

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return runtime.map_text(docs, kernel, [*((n, "bigint") for n in names), ("base_failed", "boolean"), ("probability", "double"), ("kept", "boolean")], text_col, (id_col,))
