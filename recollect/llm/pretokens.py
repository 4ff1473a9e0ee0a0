"""Pre-tokens of whole blocks of Latin text, lower-cased and cut in numpy, for one kind of tokenizer file."""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa

#: Normal form, white space as one blank, lower case; then contractions, runs of letters, single digits, runs of symbols.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Characters from here on (and the few below it that aren't letters, symbols or ASCII) are left to the library.
FIRST_OTHER = 0x130
_SPACE, _LETTER, _DIGIT, _SYMBOL, _OTHER = range(5)


def fits(spec: str) -> bool:
    """True if the tokenizer file normalizes and cuts as ``cut`` does; no added token is met without ``<|``."""
    found = json.loads(spec)
    steps = (found.get("pre_tokenizer") or {}).get("pretokenizers") or []
    return (
        found.get("normalizer") == NORMALIZER
        and [s["type"] for s in steps] == ["Split", "ByteLevel"]
        and (steps[0]["pattern"], steps[0]["behavior"], steps[0]["invert"]) == ({"Regex": PATTERN}, "Removed", True)
        and not (steps[1]["add_prefix_space"] or steps[1].get("use_regex", True))
        and all(t["content"].startswith("<|") and not (t["normalized"] or t["lstrip"] or t["rstrip"]) for t in found.get("added_tokens") or [])
    )


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kinds of code points below ``FIRST_OTHER``, their lower case, and the kind of each byte (the first of several: other)."""
    kind, low = np.full(0x800, _OTHER, np.uint8), np.arange(0x800)
    for i in range(FIRST_OTHER):
        c, group = chr(i), unicodedata.category(chr(i))[0]
        low[i] = ord(c.lower())
        if c in " \t\n\v\f\r":
            kind[i] = _SPACE
        elif group == "L":
            kind[i] = _LETTER
        elif group in "PS":
            kind[i] = _SYMBOL
        elif c in "0123456789":
            kind[i] = _DIGIT
    byte = np.full(256, _OTHER, np.uint8)
    byte[:128] = kind[:128]
    return kind, low, byte


_KIND, _LOW, _BYTE = _tables()
_LOW_BYTE = np.concatenate([_LOW[:128], np.arange(128, 256)]).astype(np.uint8)


def kinds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kind of each byte's character and its bytes in lower case (of other characters the bytes as they are)."""
    kind, low = _BYTE[data], _LOW_BYTE[data]
    two = np.flatnonzero((data >= 0xC2) & (data <= 0xC4))
    if len(two):
        point = (data[two].astype(np.int64) & 31) << 6 | data[two + 1] & 63
        kind[two] = kind[two + 1] = _KIND[point]
        low[two], low[two + 1] = 0xC0 | _LOW[point] >> 6, 0x80 | _LOW[point] & 63
    return kind, low


def are_words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts are letters below ``FIRST_OTHER`` in lower case alone (empty ones too)."""
    kind, low = kinds(data)
    wrong = np.cumsum(np.append(False, (kind != _LETTER) | (low != data)), dtype=np.int32)
    return wrong[offsets[1:]] == wrong[offsets[:-1]]


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """Units of the texts ``data[offsets[i]:offsets[i + 1]]`` (UTF-8), one after another, and the offsets of each text's.

    A unit is a pre-token in lower case or, where a run without ASCII white
    space holds a character that isn't dealt with here or ``<|``, that run as it
    is.  The library gives a text's ids as those of its units, each alone.
    """
    n = len(data)
    kind, low = kinds(data)
    begin = np.zeros(n + 3, bool)  # first bytes of texts; all behind the end
    begin[offsets[:-1]] = begin[n:] = True
    solid = kind != _SPACE
    other = kind == _OTHER
    mark = np.flatnonzero(data == ord("<"))
    mark = mark[mark + 1 < n]
    other[mark[(data[mark + 1] == ord("|")) & ~begin[mark + 1]]] = True
    if other.any():
        first = np.flatnonzero(solid & (begin[:n] | ~np.append(False, solid[:-1])))
        last = np.flatnonzero(solid & (begin[1 : n + 1] | ~np.append(solid[1:], False)))
        of = np.zeros(len(first), bool)
        of[np.searchsorted(first, np.flatnonzero(other), side="right") - 1] = True
        edge = np.zeros(n + 1, np.int8)
        edge[first[of]] += 1
        edge[last[of] + 1] -= 1
        left = np.cumsum(edge[:n], dtype=np.int8).view(bool)
        kind[left], low[left] = _OTHER, data[left]
    start = begin[:n] | (kind == _DIGIT)
    start[1:] |= kind[1:] != kind[:-1]
    start &= solid
    _contract(start, begin, np.concatenate([kind, np.zeros(3, np.uint8)]), np.concatenate([low, np.zeros(3, np.uint8)]))
    at = np.flatnonzero(start)
    ends = np.append(np.flatnonzero(start[solid]), np.count_nonzero(solid)).astype(np.int32)
    units = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(low[solid]))
    return units, np.searchsorted(at, offsets)


def _contract(start: np.ndarray, begin: np.ndarray, kind: np.ndarray, low: np.ndarray) -> None:
    """Move starts behind contractions: a lone apostrophe takes the letters of one along."""
    q = np.flatnonzero(start & (low[:-3] == ord("'")))
    q = q[(kind[q] == _SYMBOL) & (kind[q + 1] == _LETTER) & ~begin[q + 1]]
    one, two = low[q + 1], low[q + 2]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ~begin[q + 2] & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
    start[q[short | long] + 1] = False
    behind = np.concatenate([q[short] + 2, q[long] + 3])
    start[behind[(kind[behind] == _LETTER) & ~begin[behind]]] = True
