"""Toxicity: a counterfactual-regularised linear classifier over hashed words.

Fitting: a bounded, documented sample of labelled texts is turned into sets of
hashed features (whole words and their first bytes, so that inflected forms
share evidence).  Features are screened by a two-proportion z-test; a logistic
regression is fitted on those that pass.  For every sentence that names a group
(``IDENTITY_TERMS``) a copy with that term swapped for the others is made, and
the squared change of the score is added to the loss, so the names themselves
carry no weight; what is left is what is said about them.

Defined results: null and empty texts score as a text without features; with no
usable labels every score is the least that the sigmoid gives (below 1e-17); repeated rows score alike; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, linear, runtime

BITS = 20
MASK = np.uint64((1 << BITS) - 1)
#: Labelled rows that the classifier is fitted on, at most.
MAX_TRAIN_ROWS = 12_000
THRESHOLD = 0.5
MIN_Z = 5.0
MIN_ROWS = 3
#: Weight of the squared score changes between a sentence and its swapped copies.
COUNTERFACTUAL = 10.0
#: Groups that are swapped for each other, by kind.
IDENTITY_TERMS = (
    ("women", "men", "frauen", "männer", "mujeres", "hombres", "femmes", "hommes"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "muslime", "christen", "juden", "musulmanes", "cristianos", "judíos", "musulmans", "chrétiens", "juifs"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "natives", "foreigners", "einwanderer", "inmigrantes", "immigrés"),
    ("disabled", "blind", "deaf", "elderly", "young"),
)


def _codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature) pairs of a block, sorted."""
    w = blocks.Words(data, offsets, blocks.ALNUM)
    doc = w.documents().astype(np.uint64) << np.uint64(BITS + 2)
    long = (w.ends - w.starts) >= 4
    s, e, d = w.starts[long], w.ends[long], doc[long]
    # Words of a block repeat, so most of the sort is saved by dropping repeats of whole words first.
    whole = np.unique(doc | (w.hashes(salt=1) & MASK))
    prefixes = [d | (w.hashes(s, np.minimum(e, s + k), salt=k) & MASK) for k in (4, 5)]
    pairs = np.unique(np.concatenate([whole, *prefixes]))
    return (pairs >> np.uint64(BITS + 2)).astype(np.int64), (pairs & MASK).astype(np.int64)


def features(col: pa.Array) -> list[np.ndarray]:
    """The distinct hashed features of each text."""
    out = []
    for first, last, data, offsets in blocks.blocks(col):
        doc, code = _codes(data, offsets)
        cuts = np.searchsorted(doc, np.arange(1, last - first))
        out += np.split(code.astype(np.int32), cuts)
    return out


def _features_of(words: list[str]) -> set[int]:
    return set(map(int, features(pa.array([" ".join(words)]))[0]))


def swaps() -> list[tuple[set[int], list[set[int]]]]:
    """For each identity term: its features, and those of each term it is swapped for."""
    out = []
    for group in IDENTITY_TERMS:
        codes = [_features_of([t]) for t in group]
        out += [(c, codes[:i] + codes[i + 1 :]) for i, c in enumerate(codes)]
    return out


def fit(rows: list[np.ndarray], y: np.ndarray, steps: int = 300) -> dict:
    """A model of the feature sets ``rows`` with labels ``y`` (0 or 1)."""
    n, n1 = len(y), int(y.sum())
    if not n or n1 == 0 or n1 == n:
        return {"codes": np.zeros(0, np.int64), "weights": np.zeros(0), "bias": -40.0, "scale": (1.0, 0.0)}
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    size = 1 << BITS
    all_ = np.bincount(flat, minlength=size)
    pos = np.bincount(flat[y[row] > 0], minlength=size)
    p = all_ / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / (n - n1)))
    z = (pos / n1 - (all_ - pos) / (n - n1)) / spread
    chosen = np.flatnonzero((all_ >= MIN_ROWS) & (np.abs(z) >= MIN_Z))
    identity = sorted(set().union(*(c for c, _ in swaps())))
    chosen = np.union1d(chosen, identity)
    at = np.full(size, -1)
    at[chosen] = np.arange(len(chosen))
    keep = at[flat] >= 0
    col, row = at[flat[keep]], row[keep]
    differences = _differences(rows, at, len(chosen))
    weight = linear.class_weights(y) / n

    def gradient(params):
        w, b = params
        score = b[0] + np.bincount(row, weights=w[col], minlength=n)
        d = (linear.sigmoid(score) - y) * weight
        g = np.bincount(col, weights=d[row], minlength=len(w)) + 1e-4 * w
        if len(differences[0]):
            which, cols, signs, count = differences
            change = np.bincount(which, weights=w[cols] * signs, minlength=count)
            g += COUNTERFACTUAL / count * np.bincount(cols, weights=change[which] * signs, minlength=len(w))
        return [g, np.array([d.sum()])]

    w, b = linear.adam([np.zeros(len(chosen)), np.array([-1.0])], gradient, steps, 0.05)
    score = b[0] + np.bincount(row, weights=w[col], minlength=n)
    return {"codes": chosen, "weights": w, "bias": float(b[0]), "scale": linear.platt(score, y)}


def _differences(rows, at, width):
    """Sparse feature differences between labelled texts and their identity-swapped copies."""
    which, cols, signs, k = [], [], [], 0
    table = swaps()
    for r in rows:
        have = None
        for own, others in table:
            probe = next(iter(own))
            i = np.searchsorted(r, probe)
            if i == len(r) or r[i] != probe:
                continue
            have = have or set(map(int, r))
            if not own <= have:
                continue
            for other in others:
                delta = [(c, 1.0) for c in own - other] + [(c, -1.0) for c in other - have]
                delta = [(at[c], s) for c, s in delta if at[c] >= 0]
                which += [k] * len(delta)
                cols += [c for c, _ in delta]
                signs += [s for _, s in delta]
                k += 1
    # The swap itself must not matter in any text, so each pair of terms also counts once without context.
    for own, others in table:
        for other in others:
            delta = [(at[c], 1.0) for c in own - other] + [(at[c], -1.0) for c in other - own]
            which += [k] * len(delta)
            cols += [c for c, _ in delta]
            signs += [s for _, s in delta]
            k += 1
    return np.array(which, np.int64), np.array(cols, np.int64), np.array(signs), k


def score_texts(col: pa.Array, table: np.ndarray, bias: float, scale: tuple[float, float]) -> np.ndarray:
    out = np.empty(len(col))
    for first, last, data, offsets in blocks.blocks(col):
        doc, code = _codes(data, offsets)
        z = bias + np.bincount(doc, weights=table[code], minlength=last - first)
        out[first:last] = linear.sigmoid(scale[0] * z + scale[1])
    return out


def train(docs: DataFrame, labels: DataFrame, use=None, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", bound: int = MAX_TRAIN_ROWS) -> dict:
    """Fit on at most ``bound`` labelled documents for which the column ``use`` holds."""
    use = F.lit(True) if use is None else use
    sample = runtime.bounded_labels(labels, label, use, bound, id_col, docs)
    texts = runtime.labelled_texts(docs, sample, id_col, text_col)
    got = runtime.map_text(texts, lambda col: [[f.tobytes() for f in features(col)]], [("codes", "binary")], keep=("y",)).toArrow()
    y = got.column("y").to_numpy().astype(float)
    rows = [np.frombuffer(x, np.int32) for x in got.column("codes").to_pylist()]
    order = sorted(range(len(rows)), key=lambda i: (y[i], len(rows[i]), rows[i].tobytes()))  # the same fit whatever order the rows come in
    return fit([rows[i] for i in order], y[order])


def _kernel(model: dict, threshold: float):
    packed = pickle.dumps(model)
    state: dict = {}

    def kernel(col: pa.Array) -> list:
        if not state:
            m = pickle.loads(packed)
            table = np.zeros(1 << BITS, np.float32)
            table[m["codes"]] = m["weights"]
            state.update(table=table, bias=m["bias"], scale=m["scale"])
        s = score_texts(col, state["table"], state["bias"], state["scale"])
        return [s, (s >= threshold).astype(np.int32)]

    return kernel


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, score, predicted) of every document; no shuffle."""
    return runtime.map_text(docs, _kernel(model, threshold), [("score", "double"), ("predicted", "int")], text_col, (id_col,))


def keep_clean(docs: DataFrame, model: dict, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    cols = list(docs.columns)
    made = runtime.map_text(docs, _kernel(model, threshold), [("score", "double"), ("predicted", "int")], text_col, cols, condition=lambda r: pa.array(r[1] == 0))
    return made.toDF(*[f"c{i}" for i in range(len(cols) + 2)]).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)])
