"""Quality classifier: random-indexing word vectors, pooled per document, into a small network.

Fitting, on at most ``MAX_TRAIN_ROWS`` labelled texts (a documented bound):
every hashed word has a sparse ternary index vector given by its hash; a word's
vector is the sum of the index vectors of the words around it.  A document is
the mean of its words' vectors and of their index vectors.  A network with one
hidden layer gives a logit; a temperature, chosen on rows the fit doesn't see,
turns it into a probability.

Runs of letters, runs of punctuation, and two marks (a word in capitals, a word
after itself) are the words.

Defined results: null and empty texts pool to the zero vector, so they get the
network's score of that vector; with no usable labels every score is 0.5;
repeated rows score alike; extra columns are ignored; an empty table stays empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, linear, runtime

VOCAB_BITS = 14
VOCAB = 1 << VOCAB_BITS
DIM = 32
HIDDEN = 16
SPAN = 2
#: Words at which a text's pooled vector counts half.
SHRINK = 10
#: Labelled rows that the classifier is fitted on, at most.
MAX_TRAIN_ROWS = 6_000
THRESHOLD = 0.7
CAPS, SAME = 0, 1
_PUNCT = np.array([32 < b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 127 for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words of a block in order, and where each document's begin."""
    w = blocks.Words(data, offsets, blocks.ALNUM)
    h = w.hashes(salt=11)
    words = ((h % np.uint64(VOCAB - 2)) + np.uint64(2)).astype(np.int64)
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    size = w.ends - w.starts
    caps = (size > 1) & (upper[w.ends] - upper[w.starts] == size)
    same = np.zeros(len(words), bool)
    same[1:] = h[1:] == h[:-1]
    same[w.first[:-1][np.diff(w.first) > 0]] = False  # a document's first word has none before it
    p = _PUNCT[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # runs end with their document
    before, behind = np.concatenate([[False], p])[:-1] & ~edge[:-1], np.concatenate([p, [False]])[1:] & ~edge[1:]
    runs, stops = np.flatnonzero(p & ~before), np.flatnonzero(p & ~behind) + 1
    # A run's word is its first byte and its length, up to three.
    marks = ((data[runs].astype(np.int64) * 3 + np.minimum(stops - runs, 3)) * 2654435761 % (VOCAB - 2)) + 2
    at = np.concatenate([w.starts * 4, w.starts[same] * 4 + 1, w.starts[caps] * 4 + 2, runs * 4])
    code = np.concatenate([words, np.full(int(same.sum()), SAME), np.full(int(caps.sum()), CAPS), marks])
    order = np.argsort(at, kind="stable")
    return code[order], np.searchsorted(at[order], offsets * 4)


def index_vectors(seed: int = 7) -> np.ndarray:
    """A sparse ternary vector for each hashed word: four places, signs at random."""
    rng = np.random.default_rng(seed)
    out = np.zeros((VOCAB, DIM), np.float32)
    place = rng.random((VOCAB, DIM)).argpartition(4, axis=1)[:, :4]
    np.put_along_axis(out, place, rng.choice([-1.0, 1.0], (VOCAB, 4)).astype(np.float32), axis=1)
    return out


def word_vectors(sequences: list[np.ndarray]) -> np.ndarray:
    """Unit context vectors of hashed words: sums of the index vectors within ``SPAN`` words."""
    index = index_vectors()
    out = np.zeros((VOCAB, DIM), np.float64)
    group: list[np.ndarray] = []
    gap = np.full(SPAN, -1)
    for i, s in enumerate(sequences):
        group += [s.astype(np.int64), gap]
        if i == len(sequences) - 1 or sum(map(len, group)) > 300_000:
            flat = np.concatenate(group)
            group = []
            vec = np.where(flat[:, None] >= 0, index[flat], np.float32(0))
            near = np.zeros_like(vec)
            for k in range(1, SPAN + 1):
                near[k:] += vec[:-k]
                near[:-k] += vec[k:]
            real = flat >= 0
            for d in range(DIM):
                out[:, d] += np.bincount(flat[real], weights=near[real, d], minlength=VOCAB)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def pool(codes: np.ndarray, first: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Mean rows of ``table`` per document."""
    return blocks.segment_sums(table[codes], first) / np.maximum(1, np.diff(first))[:, None]


def standardise(pooled: np.ndarray, sizes: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    """Pooled vectors in standard deviations from the mean, drawn to it where few words were pooled."""
    return (pooled - mean) / std * (sizes / (sizes + SHRINK))[:, None]


def fit(sequences: list[np.ndarray], y: np.ndarray, steps: int = 250, seed: int = 5) -> dict | None:
    """Word vectors and network; None without two classes of labelled rows."""
    n = len(y)
    if not n or y.min() == y.max():
        return None
    table = np.concatenate([word_vectors(sequences), index_vectors() / 2], axis=1)
    sizes = np.array([len(s) for s in sequences])
    x = np.concatenate([pool(s.astype(np.int64), np.array([0, len(s)]), table) for s in sequences])
    mean, std = x.mean(axis=0), np.maximum(1e-4, x.std(axis=0))
    x = standardise(x, sizes, mean, std).astype(np.float32)
    held = np.arange(n) % 5 == 0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    xt, yt = x[~held], y[~held]
    weight = (linear.class_weights(yt) / len(yt)).astype(np.float32)
    rng = np.random.default_rng(seed)

    def gradient(p):
        w1, b1, w2, b2 = p
        a = np.tanh(xt @ w1 + b1)
        d = (linear.sigmoid(a @ w2 + b2[0]) - yt) * weight
        back = d[:, None] * w2[None, :] * (1 - a * a)
        return [xt.T @ back + 1e-4 * w1, back.sum(axis=0), a.T @ d + 1e-4 * w2, np.array([d.sum()])]

    start = [rng.normal(0, 0.15, (x.shape[1], HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32), rng.normal(0, 0.3, HIDDEN).astype(np.float32), np.zeros(1, np.float32)]
    w1, b1, w2, b2 = linear.adam(start, gradient, steps, 0.01)
    xc, yc = (x[held], y[held]) if held.any() else (x, y)
    t = linear.temperature(np.tanh(xc @ w1 + b1) @ w2 + b2[0], yc)
    return {"table": table.astype(np.float32), "mean": mean, "std": std, "net": (w1, b1, w2, float(b2[0])), "temperature": t}


def projected(model: dict) -> tuple[np.ndarray, np.ndarray]:
    """The word table seen through the network's first layer, and what the mean takes off.

    Pooling is linear, so words can be projected once instead of every document.
    """
    w1 = model["net"][0] / model["std"][:, None]
    return (model["table"] @ w1).astype(np.float32), (model["mean"] @ w1).astype(np.float64)


def probabilities(col: pa.Array, model: dict | None) -> np.ndarray:
    out = np.full(len(col), 0.5)
    if model is None:
        return out
    table, off = model.setdefault("projected", None) or projected(model)
    model["projected"] = table, off
    _, b1, w2, b2 = model["net"]
    for first, last, data, offsets in blocks.blocks(col):
        code, cuts = tokens(data, offsets)
        sizes = np.diff(cuts)
        sums = np.zeros((last - first, HIDDEN))
        some = sizes > 0
        if some.any():
            sums[some] = np.add.reduceat(table[code], cuts[:-1][some], axis=0)
        x = (sums / np.maximum(1, sizes)[:, None] - off) * (sizes / (sizes + SHRINK))[:, None]
        out[first:last] = linear.sigmoid(((np.tanh(x + b1) * w2).sum(axis=1) + b2) / model["temperature"])  # a sum for each row, so no text's last bits depend on the others
    return out


def train(docs: DataFrame, labels: DataFrame, use=None, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", bound: int = MAX_TRAIN_ROWS) -> dict | None:
    """Fit on at most ``bound`` labelled documents for which the column ``use`` holds."""
    sample = runtime.bounded_labels(labels, label, F.lit(True) if use is None else use, bound, id_col, docs)
    texts = runtime.labelled_texts(docs, sample, id_col, text_col)

    def kernel(col: pa.Array) -> list:
        out: list[bytes] = []
        for _, _, data, offsets in blocks.blocks(col):
            code, first = tokens(data, offsets)
            out += [x.astype(np.uint16).tobytes() for x in np.split(code, first[1:-1])]
        return [out]

    got = runtime.map_text(texts, kernel, [("codes", "binary")], keep=("y",)).toArrow()
    y = got.column("y").to_numpy().astype(float)
    rows = got.column("codes").to_pylist()
    order = sorted(range(len(rows)), key=lambda i: (len(rows[i]), rows[i]))
    return fit([np.frombuffer(rows[i], np.uint16) for i in order], y[order])


def score(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, score, predicted) of every document; no shuffle."""

    def kernel(col: pa.Array) -> list:
        p = probabilities(col, model)
        return [p, (p >= threshold).astype(np.int32)]

    return runtime.map_text(docs, kernel, [("score", "double"), ("predicted", "int")], text_col, (id_col,))
