"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counting: every document that may be learned from adds its n-grams of one to
three characters (lower-cased; ASCII characters other than letters count as
spaces) to the counts of its language, in numpy within each Arrow batch, and
Spark sums the partial counts.  Log-probabilities are a bounded matrix
(``2 ** BITS`` rows, at most ``MAX_LANGUAGES`` columns).  Scoring adds up the
matrix's rows for the n-grams of each text.  More languages make more matrices,
which are fetched and broadcast one after another; each text carries the best
language and the sum of probabilities from one to the next, so the result is
that of one wide matrix.

Defined results: a text that is null or has no letter is ``und`` with score 0;
with nothing to learn from, every text is; ties go to the first language in
alphabetical order; repeated rows give equal results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, runtime

BITS = 15
SIZE = 1 << BITS
ORDERS = (1, 2, 3)
ALPHA = 0.5
#: Languages of one matrix.
MAX_LANGUAGES = 256
UNKNOWN = "und"
_PLAIN = np.arange(128, dtype=np.uint32)
_PLAIN[[c for c in range(128) if not chr(c).isalpha()]] = 32
_MUL = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def _characters(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, code points, offsets) for runs of lower-cased texts."""
    low = pc.utf8_lower(col)
    sizes = np.asarray(pc.utf8_length(low)).astype(np.int64)
    for first, last, data, _ in blocks.blocks(low):
        chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        chars = np.where(chars < 128, _PLAIN[np.minimum(chars, 127)], chars)
        yield first, last, chars, np.concatenate([[0], np.cumsum(sizes[first:last])])


def _grams(chars: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(k, hashed n-grams of k characters that start at each place)."""
    h = np.zeros(len(chars), np.uint32)
    for k in ORDERS:
        if len(chars) < k:
            return
        h = h[: len(chars) - k + 1] * _MUL[0] + chars[k - 1 :] * _MUL[1] + np.uint32(k)
        g = h ^ (h >> np.uint32(15))
        yield k, ((g * _MUL[2]) >> np.uint32(32 - BITS)).astype(np.int64)


def count(docs: DataFrame, use=None, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, code, n): n-gram counts of all documents with a language for which ``use`` holds; code -1: documents."""
    d = docs if use is None else docs.where(use)
    d = d.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    runtime.share_package(docs.sparkSession)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0).to_pylist()
            known = {x: i for i, x in enumerate(dict.fromkeys(names))}
            which = np.array([known[x] for x in names])
            counts = np.zeros(len(known) * (SIZE + 1), np.int64)
            for first, last, chars, offsets in _characters(batch.column(1)):
                at = np.repeat(which[first:last] * (SIZE + 1), np.diff(offsets))
                doc = np.repeat(np.arange(last - first), np.diff(offsets))
                for k, code in _grams(chars):
                    inside = doc[: len(code)] == doc[k - 1 :]
                    counts += np.bincount((at[: len(code)] + code)[inside], minlength=len(counts))
            counts = counts.reshape(len(known), SIZE + 1)
            counts[:, SIZE] += np.bincount(which, minlength=len(known))
            for name, i in known.items():
                total[name] = total[name] + counts[i] if name in total else counts[i]
        for name, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(np.where(at == SIZE, -1, at).astype(np.int32)), pa.array(c[at])], names=["lang", "code", "n"])

    return d.mapInArrow(stage, "lang string, code int, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def model_of(counts: DataFrame, most: int = MAX_LANGUAGES) -> dict:
    """Log-probability matrix of summed counts, of the first ``most`` languages; ``rest``: how to get the others."""
    counts = runtime.materialize(counts, "grams")
    langs = [r.lang for r in counts.where("code = -1").select("lang").orderBy("lang").collect()]  # one row a language
    total = counts.where("code = -1").agg(F.sum("n")).first()[0] or 0
    return _matrix(counts, langs, 0, most, total)


def _matrix(counts: DataFrame, langs: list[str], first: int, most: int, total: int) -> dict:
    own = langs[first : first + most]
    got = counts.where((F.col("lang") >= own[0]) & (F.col("lang") <= own[-1])).toArrow() if own else None
    m = np.zeros((SIZE + 1, len(own)))
    if got is None:
        return {"langs": [], "logp": np.zeros((SIZE, 0)), "prior": np.zeros(0)}
    at = {x: i for i, x in enumerate(own)}
    m[got.column("code").to_numpy(), [at[x] for x in got.column("lang").to_pylist()]] = got.column("n").to_numpy()
    logp = np.log(m[:SIZE] + ALPHA) - np.log(m[:SIZE].sum(axis=0) + ALPHA * SIZE)
    model = {"langs": own, "logp": np.ascontiguousarray(logp), "prior": np.log(m[SIZE] / total)}
    if first + most < len(langs):
        model["rest"] = lambda: _matrix(counts, langs, first + most, most, total)
    return model


def _log_scores(col: pa.Array, model: dict) -> np.ndarray:
    """Log of prior times likelihood, a row for each text and a column for each language."""
    langs, logp = model["langs"], model["logp"]
    z = np.empty((len(col), len(langs)))
    table = np.concatenate([logp, np.zeros((1, len(langs)))])
    for first, last, chars, offsets in _characters(col):
        doc = np.repeat(np.arange(last - first), np.diff(offsets))
        values = None
        for k, code in _grams(chars):
            if values is None:
                values = table[code]
                continue
            code[doc[: len(code)] != doc[k - 1 :]] = SIZE  # n-grams across documents count nothing
            values[: len(code)] += table[code]
        z[first:last] = model["prior"] + (blocks.segment_sums(values, offsets) if values is not None else 0.0)
    return z


def predict_texts(col: pa.Array, model: dict, so_far: tuple | None = None) -> tuple:
    """(languages, scores) of texts; with ``so_far`` or more matrices to come (languages, logs of the best, sums) instead.

    ``so_far`` are the languages, the best log score and the sum of scores over
    the best, from the matrices before.
    """
    if not model["langs"]:
        return [UNKNOWN] * len(col), np.zeros(len(col))
    z = _log_scores(col, model)
    best = z.argmax(axis=1)
    top = z[np.arange(len(z)), best]
    total = np.exp(z - top[:, None]).sum(axis=1)
    names = [model["langs"][b] for b in best]
    if so_far is not None:
        known, other, held = so_far
        both = np.maximum(top, other)
        total = total * np.exp(top - both) + held * np.exp(other - both)
        names = [a if o >= t else b for a, b, o, t in zip(known, names, other, top)]
        top = both
    if so_far is not None or "rest" in model:
        return names, top, total
    return finish(col, names, total)


def finish(col: pa.Array, names: list[str], total: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Languages and scores, with ``und`` for texts without a letter."""
    letters = np.asarray(pc.match_substring_regex(col, r"\p{L}"))
    return [n if ok else UNKNOWN for n, ok in zip(names, letters)], np.where(letters, np.minimum(1 / total, 1.0), 0.0)


def _predicted(docs: DataFrame, model: dict, cols: list[str], text_col: str) -> DataFrame:
    """``cols`` of ``docs`` by position (c0, c1, ...) with lang_pred and score."""
    own = docs.select(*[F.col(runtime._q(c)).alias(f"c{i}") for i, c in enumerate(cols)], F.col(runtime._q(text_col)).cast("string").alias("t"))
    keep = [f"c{i}" for i in range(len(cols))]
    if "rest" not in model:
        return runtime.map_text(own, lambda col: list(predict_texts(col, model)), [("lang_pred", "string"), ("score", "double")], "t", keep)
    fields = [("lang_pred", "string"), ("top", "double"), ("total", "double")]
    at = runtime.map_text(own, _part_kernel(model), fields, "t", [*keep, "t"])
    while "rest" in model:
        model = model["rest"]()
        at = _next_matrix(at, {k: v for k, v in model.items() if k != "rest"}, [*keep, "t"])
    return runtime.map_batch(at, lambda b: list(finish(blocks.no_nulls(b[len(keep)]), b[len(keep) + 1].to_pylist(), b[len(keep) + 3].to_numpy())), [("lang_pred", "string"), ("score", "double")], keep)


def _part_kernel(model: dict):
    plain = {k: v for k, v in model.items() if k != "rest"} | {"rest": None}
    return lambda col: list(predict_texts(col, plain))


def _next_matrix(at: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    n = len(keep)
    return runtime.map_batch(at, lambda b: list(predict_texts(blocks.no_nulls(b[n - 1]), model, (b[n].to_pylist(), b[n + 1].to_numpy(), b[n + 2].to_numpy()))), [("lang_pred", "string"), ("top", "double"), ("total", "double")], keep)


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every document; no shuffle."""
    return _predicted(docs, model, [id_col], text_col).withColumnRenamed("c0", id_col)


def keep_identified(docs: DataFrame, model: dict, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The documents whose language is identified with a score of at least ``least``, with all their columns."""
    cols = list(docs.columns)
    made = _predicted(docs, model, cols, text_col).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return made.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)])
