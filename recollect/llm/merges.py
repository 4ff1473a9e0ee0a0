"""Ranked merges of many words at once, for byte-level BPE vocabularies."""

from __future__ import annotations

import json

import numpy as np

#: Longer words (in bytes) are left to the library.
LONGEST = 40
_NONE = np.int32(2**31 - 1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_ROWS = 1 << 14


def byte_names() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in plain else next(free)) for b in range(256)]


class Merges:
    """The merge table of a tokenizer file, applied to words of one pre-token each.

    All words of one length are rows of a matrix of symbols; each round merges
    the pair of least rank (the leftmost of equals) of every row, so rows that
    still have pairs stay of one length.
    """

    def __init__(self, spec: str):
        model = json.loads(spec)["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.usable = model["type"] == "BPE" and bool(end) and not (model.get("continuing_subword_prefix") or model.get("dropout") or model.get("ignore_merges"))
        names = byte_names()
        self.usable = self.usable and all(c in vocab and c + end in vocab for c in names)
        if not self.usable:
            return
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        inner, last = np.array([vocab[c] for c in names], np.int32), np.array([vocab[c + end] for c in names], np.int32)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.uint64)
        self._build(inner, last, keys, np.arange(len(pairs), dtype=np.int32), np.array([vocab[a + b] for a, b in pairs], np.int32))

    @classmethod
    def of_ranks(cls, ranks: dict[bytes, int]) -> Merges:
        """The table of a vocabulary of byte strings, in which a pair's rank is that of its two pieces joined."""
        self = cls.__new__(cls)
        self.usable = all(bytes([b]) in ranks for b in range(256))
        if self.usable:
            bytes_ = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
            found = [(a << 32 | b, r) for t, r in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None]
            keys, values = np.array([k for k, _ in found], np.uint64), np.array([r for _, r in found], np.int32)
            self._build(bytes_, bytes_, keys, values, np.arange(max(ranks.values()) + 1, dtype=np.int32))
        return self

    def _build(self, inner: np.ndarray, last: np.ndarray, keys: np.ndarray, values: np.ndarray, merged: np.ndarray) -> None:
        """Symbols of bytes within and at the end of a word; pairs, their ranks, and the symbol that each rank makes."""
        self.inner, self.last, self.merged = inner, last, merged
        self.bits = max(10, int(len(keys) * 2).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, np.uint64(2**64 - 1)), np.full(1 << self.bits, _NONE)
        left = np.arange(len(keys))
        at = self._slot(keys)
        while len(left):  # open addressing: of those that want a free slot the first gets it
            taken = self.ranks[at[left]] != _NONE
            free = left[~taken]
            _, first = np.unique(at[free], return_index=True)
            now = free[first]
            self.keys[at[now]], self.ranks[at[now]] = keys[now], values[now]
            left = np.setdiff1d(left, now)
            at[left] = (at[left] + 1) % (1 << self.bits)
        #: Ranks of pairs of bytes, within a word and at its end.
        self.of_bytes = [self.rank(*np.broadcast_arrays(inner[:, None], end)) for end in (inner, last)]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; the largest int32 where there is no merge."""
        keys = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        at = self._slot(keys)
        found = self.ranks[at]
        wrong = np.nonzero((self.keys[at] != keys) & (found != _NONE))
        while len(wrong[0]):
            at[wrong] = (at[wrong] + 1) % (1 << self.bits)
            slot = at[wrong]
            found[wrong] = self.ranks[slot]
            bad = (self.keys[slot] != keys[wrong]) & (found[wrong] != _NONE)
            wrong = tuple(w[bad] for w in wrong)
        return found

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, lengths, ids): ids of ``words[order[0]]``, ``words[order[1]]``, and so on, one after another."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        return self.encode_at(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size)

    def encode_at(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``encode`` of the words that start at ``start`` in ``data`` and have ``size`` bytes (none has none)."""
        order, lengths, ids = [], [], []
        by_size = np.argsort(size, kind="stable")
        for rows in np.split(by_size, np.flatnonzero(np.diff(size[by_size])) + 1):
            for lo in range(0, len(rows), _ROWS):
                own = rows[lo : lo + _ROWS]
                raw = data[start[own][:, None] + np.arange(size[own[0]])]
                symbols = self.inner[raw]
                symbols[:, -1] = self.last[raw[:, -1]]
                ranks = self.of_bytes[0][raw[:, :-1], raw[:, 1:]]
                if ranks.shape[1]:
                    ranks[:, -1] = self.of_bytes[1][raw[:, -2], raw[:, -1]]
                for at, done in self._merge(symbols, ranks):
                    order.append(own[at])
                    lengths.append(np.full(len(at), done.shape[1]))
                    ids.append(done.ravel())
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        return join(order, np.int64), join(lengths, np.int64), join(ids, np.uint32)

    def _merge(self, symbols: np.ndarray, ranks: np.ndarray):
        """(rows, their final symbols), for each final length; ``ranks`` are those of the pairs."""
        rows = np.arange(len(symbols))
        while ranks.shape[1] and len(rows):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            live = best != _NONE
            if not live.all():
                yield rows[~live], symbols[~live]
                rows, symbols, ranks, at, best = rows[live], symbols[live], ranks[live], at[live], best[live]
            n = np.arange(len(rows))
            behind = np.arange(symbols.shape[1] - 1) > at[:, None]
            symbols = np.where(behind, symbols[:, 1:], symbols[:, :-1])
            symbols[n, at] = self.merged[best]
            ranks = np.where(behind[:, :-1], ranks[:, 1:], ranks[:, :-1])
            if ranks.shape[1]:
                for place, ok in ((at - 1, at > 0), (at, at < ranks.shape[1])):
                    i, p = n[ok], place[ok]
                    ranks[i, p] = self.rank(symbols[i, p], symbols[i, p + 1])
        if len(rows):
            yield rows, symbols
