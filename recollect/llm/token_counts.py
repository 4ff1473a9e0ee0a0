"""Token counts with a whole-token shortcut.

A sentencepiece BPE vocabulary without pieces that hold a space mark behind
another character can't merge across the places where a mark follows one, so a
text falls apart there into pre-tokens that encode independently (checked by
``splittable``).  Offline, on the driver, ``whole_tokens`` proves which
vocabulary strings encode alone as exactly one token.  Counting looks each
pre-token up in that set; only the rest goes through the library's merges,
once per distinct pre-token that a worker meets (a bounded memo).

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows
give equal results; extra columns are ignored; an empty table stays empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import runtime

MARK = "▁"
LIMIT = 4096
#: Pre-tokens that a worker remembers, and their characters, at most (besides one batch).
MEMO, MEMO_CHARS = 400_000, 32_000_000
_SEGMENT = re.compile(f"{MARK}+[^{MARK}]*")


def load(proto: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=proto)


def splittable(pieces: Iterable[str]) -> bool:
    """True if no piece has a space mark behind another character."""
    return not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)


def whole_tokens(proto: bytes) -> frozenset[str]:
    """Pre-tokens (without their first space mark) that provably encode alone as one token."""
    sp = load(proto)
    names = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
    if not splittable(names):
        raise ValueError("this vocabulary has pieces across words; the shortcut doesn't hold for it")
    words = [p[1:] for p in names if p.startswith(MARK) and len(p) > 1 and MARK not in p[1:]]
    return frozenset(w for w, ids in zip(words, sp.encode(words, num_threads=1)) if len(ids) == 1)


def pretokens(text: str) -> list[str]:
    """Pre-tokens without their first space mark; joined again they are the marked text."""
    if not text:
        return []
    if "  " in text or text[0] == " " or MARK in text:
        return [s[1:] for s in _SEGMENT.findall(MARK + text.replace(" ", MARK))]
    return text.split(" ")


class Counter:
    """Counts tokens; holds the proven whole tokens and a bounded memo of merged pre-tokens."""

    def __init__(self, proto: bytes, whole: frozenset[str], memo: int = MEMO):
        self.sp, self.whole, self.limit = load(proto), whole, memo
        self.reset()

    def reset(self) -> None:
        self.known = dict.fromkeys(self.whole, 1)
        self.known[""] = 1  # a space mark alone
        self.held = 0

    def counts(self, texts: list[str]) -> list[int]:
        split = [pretokens(t) for t in texts]
        rest = list(set().union(*split).difference(self.known))
        if len(self.known) + len(rest) > self.limit + len(self.whole) or self.held > MEMO_CHARS:
            self.reset()
            rest = list(set().union(*split).difference(self.known))
        self.held += sum(map(len, rest))
        self.known.update(zip(rest, map(len, self.sp.encode(rest, num_threads=1))))
        get = self.known.__getitem__
        return [sum(map(get, words)) for words in split]


def count(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every document; no shuffle."""
    with open(path, "rb") as f:
        proto = f.read()
    whole = whole_tokens(proto)
    state: dict = {}

    def kernel(col: pa.Array) -> list:
        counter = state.setdefault("c", None) or state.update(c=Counter(proto, whole)) or state["c"]
        n = []
        for i in range(0, len(col), 256):
            n += counter.counts(col.slice(i, 256).to_pylist())
        n = np.array(n, np.int64)
        return [pc.cast(pc.binary_length(col), pa.int64()), n, n > limit]

    return runtime.map_text(docs, kernel, [("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")], text_col, (id_col,))
