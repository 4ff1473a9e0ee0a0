"""Byte-level BPE: ranked merges as a Spark fold, applied by distinct words.

1. Every task splits its texts into words (matches of the pattern) and counts
   them; Spark sums the counts of distinct words over the whole corpus.
2. The most frequent distinct words (at most ``HOT_WORDS``, by a count threshold
   taken from a histogram, so the bound is exact) are encoded by Spark
   higher-order functions: ``aggregate`` folds the byte array of a word, merging
   the adjacent pair of the lowest rank, with ranks looked up in a literal map.
3. The bounded dictionary of step 2 is broadcast; each text's ids are its words'
   ids.  Words outside the dictionary are merged by the same ranked merges in
   the Arrow stage (``merge``), which the README explains with figures.
4. Decoding concatenates the binary pieces of the ids.

Defined results: a null text counts as empty (no tokens, digests of nothing);
repeated rows give equal results; extra columns are ignored; an empty table
stays empty.  Very long words are merged with a heap in n log n.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import uuid
from array import array
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks, runtime
from .merges import LONGEST, Merges

#: Words of the broadcast dictionary, at most.
HOT_WORDS = 1 << 17
#: Longer words aren't folded in Spark: the fold copies the word's pieces at each merge.
FOLD_BYTES = 48
#: Bytes that a worker's memo of chunks and words may take, about; it starts anew beyond them.
MEMO_BYTES = 120_000_000
#: Bytes of text that are split at a time (a longer text is split by itself).
BLOCK_BYTES = 1 << 23
_BUCKETS = 1 << 14
_NONE = 2**31 - 1
_SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: In a pattern with this part a run of letters is one match, and one punctuation mark behind it another.
_LETTERS_ALONE = r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|"
_LATIN = "\u0250"
_CLOSING = (".", ",", "!", "?", ";", ":")


def load_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and their ranks, which are their ids."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def compile_pattern(pattern: str):
    """``pattern`` with white space as Unicode's White_Space, the same in every regex library."""
    import regex

    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and pattern[i + 1] in "sS":
            out.append(_SPACES if inside and pattern[i + 1] == "s" else f"[{_SPACES}]" if pattern[i + 1] == "s" else f"[^{_SPACES}]")
            i += 2
            continue
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        inside = c == "[" or inside and c != "]"
        out.append(c)
        i += 1
    return regex.compile("".join(out))


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word by ranked merges."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > 64:
        return _merge_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    get = ranks.get
    rank = [get(a + b, _NONE) for a, b in zip(parts, parts[1:])]
    while rank:
        best = min(rank)
        if best == _NONE:
            break
        i = rank.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del rank[i]
        if i < len(rank):
            rank[i] = get(parts[i] + parts[i + 1], _NONE)
        if i:
            rank[i - 1] = get(parts[i - 1] + parts[i], _NONE)
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(word)
    end, prev = [*range(1, n + 1)], [*range(-1, n - 1)]
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if end[i] < 0 or end[i] >= n or end[end[i]] != stop:
            continue
        j = end[i]
        end[i], end[j] = stop, -1
        if stop < n:
            prev[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if prev[i] >= 0 and (r := ranks.get(word[prev[i] : stop])) is not None:
            heapq.heappush(heap, (r, prev[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def rank_literal(ranks: dict[bytes, int], spark) -> Column:
    """The ranks as one literal: an array of small maps from hex pieces to ranks, by hash of the piece."""
    import xxhash

    buckets: list[dict[str, int]] = [{} for _ in range(_BUCKETS)]
    for piece, rank in ranks.items():
        name = piece.hex().upper()
        buckets[xxhash.xxh64_intdigest(name.encode(), 42) & (_BUCKETS - 1)][name] = rank
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(word_hex: Column, table: Column) -> Column:
    """Ids of a word, given as hex text, by a fold of ranked merges over its byte array."""

    def of(table: Column) -> Column:
        def rank(piece: Column) -> Column:
            bucket = F.xxhash64(piece).bitwiseAND(F.lit(_BUCKETS - 1)).cast("int")
            return F.coalesce(F.try_element_at(F.get(table, bucket), piece), F.lit(_NONE))

        def start(p: Column) -> Column:
            pairs = F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p)), lambda a, b: rank(F.concat(a, b)))
            return F.struct(p.alias("p"), F.concat(pairs, F.array(F.lit(_NONE))).alias("r"))

        def merged(p: Column, r: Column, i: Column) -> Column:
            def put(m: Column) -> Column:
                left = F.when(i > 1, F.array(rank(F.concat(F.get(p, i - 2), m)))).otherwise(F.array().cast("array<int>"))
                right = F.when(i + 1 < F.size(p), rank(F.concat(m, F.get(p, i + 1)))).otherwise(F.lit(_NONE))
                pieces = F.concat(F.slice(p, F.lit(1), i - 1), F.array(m), F.slice(p, i + 2, F.size(p)))
                around = F.concat(F.slice(r, F.lit(1), F.greatest(i - 2, F.lit(0))), left, F.array(right), F.slice(r, i + 2, F.size(r)))
                return F.struct(pieces.alias("p"), around.alias("r"))

            return _let(F.concat(F.get(p, i - 1), F.get(p, i)), put)

        def step(acc: Column, _: Column) -> Column:
            return _let(F.array_min(acc.r), lambda best: F.when(best < _NONE, _let(F.array_position(acc.r, best).cast("int"), lambda i: merged(acc.p, acc.r, i))).otherwise(acc))

        n = (F.length(word_hex) / 2).cast("int")
        pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(word_hex, i * 2 + 1, F.lit(2)))
        done = F.aggregate(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), _let(pieces, start), step)
        return _let(rank(word_hex), lambda whole: F.when(whole < _NONE, F.array(whole)).otherwise(F.transform(done.p, rank)))

    return _let(table, of)


class Splitter:
    """Texts as codes of words; a memo of chunks and their words that a worker's tasks share within a job.

    The memo grows by what a block brings and starts anew at a block's
    beginning once it has more than ``MEMO_BYTES``, so it is bounded however
    long the chunks are.
    """

    def __init__(self, pattern: str):
        self.find, self.plain, self.epoch = compile_pattern(pattern).findall, _LETTERS_ALONE in pattern, 0
        self.forget()

    def forget(self) -> None:
        """Chunk i has the words of codes[starts[i]:starts[i + 1]]; ``part`` are chunks of one part behind a space, without it."""
        self.part: dict[str, int] = {}
        self.chunk: dict[str, int] = {}
        self.starts, self.codes = array("q", [0]), array("I")
        self.word: dict[str, int] = {}
        self.names: list[str] = []
        self.held = 0
        self.epoch += 1

    @property
    def full(self) -> bool:
        return self.held > MEMO_BYTES

    def _number(self, words: list[str]) -> list[int]:
        """Codes of words, new ones for new words."""
        known = list(map(self.word.get, words))
        new = list(dict.fromkeys([w for w, k in zip(words, known) if k is None]))
        if new:
            self.word.update(zip(new, range(len(self.names), len(self.names) + len(new))))
            self.names += new
            self.held += 200 * len(new) + 2 * sum(map(len, new))
            return list(map(self.word.__getitem__, words))
        return known

    def _put(self, table: dict[str, int], keys: list[str], codes: list[int], ends: Iterable[int]) -> None:
        """Enter chunks with the codes of their words, one after another, and where each chunk's end."""
        first, at = len(self.starts) - 1, len(self.codes)
        table.update(zip(keys, range(first, first + len(keys))))
        self.codes.extend(codes)
        self.starts.extend([at + e for e in ends])
        self.held += 150 * len(keys) + sum(map(len, keys))

    def _learn_parts(self, parts: list[str]) -> None:
        """Enter new parts behind a space; runs of Latin letters, with closing punctuation or not, need no search."""
        rest = parts
        if self.plain:
            kind = [(1 if p.isalpha() else 2 if p[-1:] in _CLOSING and p[:-1].isalpha() else 0) if p.isascii() or max(p) < _LATIN else 0 for p in parts]
            letters = [p for p, k in zip(parts, kind) if k == 1]
            closed = [p for p, k in zip(parts, kind) if k == 2]
            rest = [p for p, k in zip(parts, kind) if k == 0]
            self._put(self.part, letters, self._number([" " + p for p in letters]), range(1, len(letters) + 1))
            both = zip(self._number([" " + p[:-1] for p in closed]), self._number([p[-1] for p in closed]))
            self._put(self.part, closed, [k for pair in both for k in pair], range(2, 2 * len(closed) + 1, 2))
        self._learn(self.part, rest, " ")

    def _learn(self, table: dict[str, int], chunks: list[str], before: str = "") -> None:
        found = [self.find(before + c) for c in chunks]
        self._put(table, chunks, self._number([w for words in found for w in words]), accumulate(map(len, found)))

    def _codes_of(self, table: dict[str, int], chunks: list[str], learn) -> np.ndarray:
        codes = list(map(table.get, chunks))
        if None in codes:
            learn(list(dict.fromkeys([c for c, k in zip(chunks, codes) if k is None])))
            codes = list(map(table.__getitem__, chunks))
        return np.array(codes, np.int64)

    def block(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Chunk codes of all texts of ``col`` (no nulls), one after another, and the offsets of each text's.

        Texts are cut before single spaces between other characters, where no
        match of a pattern of this kind crosses.
        """
        split = pc.split_pattern(col, " ")
        coded = split.flatten().dictionary_encode()
        names, at = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
        offs = np.asarray(split.offsets).astype(np.int64)
        offs = offs - offs[0]
        first = np.zeros(len(at), bool)
        first[offs[:-1]] = True  # a split text has one part at least
        clean = np.asarray(pc.equal(pc.utf8_trim_whitespace(names), names)) & (np.asarray(pc.binary_length(names)) > 0)
        opens, ends = clean, clean
        if not clean.all():
            opens, ends = clean.copy(), clean.copy()
            for k in np.flatnonzero(~clean).tolist():
                name = names[k].as_py()
                opens[k], ends[k] = name != "" and not name[0].isspace(), name != "" and not name[-1].isspace()
        head = first.copy()
        head[1:] |= ends[at[:-1]] & opens[at[1:]]
        begin = np.flatnonzero(head)
        size = np.diff(np.append(begin, len(at)))
        single = (size == 1) & ~first[begin]
        seen = np.zeros(len(names), bool)
        seen[at[begin[single]]] = True
        used = np.flatnonzero(seen)
        code_of = np.zeros(len(names), np.int64)
        said = names.to_pylist()
        code_of[used] = self._codes_of(self.part, [said[k] for k in used.tolist()], self._learn_parts)
        others = np.flatnonzero(~single)
        joined = [("" if f else " ") + " ".join([said[k] for k in at[b : b + n].tolist()]) for f, b, n in zip(first[begin[others]].tolist(), begin[others].tolist(), size[others].tolist())]
        out = np.empty(len(begin), np.int64)
        out[single] = code_of[at[begin[single]]]
        out[others] = self._codes_of(self.chunk, joined, lambda new: self._learn(self.chunk, new))
        return out, np.searchsorted(begin, offs)

    def words_of(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word codes of chunk codes, one after another, and the end of each chunk's."""
        starts = np.frombuffer(self.starts, np.int64)
        own = starts[chunks + 1] - starts[chunks]
        ends = np.cumsum(own)
        words = np.frombuffer(self.codes, np.uint32) if self.codes else np.zeros(0, np.uint32)
        total = int(ends[-1]) if len(ends) else 0
        return words[np.repeat(starts[chunks] - (ends - own), own) + np.arange(total)], ends


#: The memo of a worker's latest job; a job's tasks share it.
_OF_JOB: dict[str, dict] = {}


def _of_job(job: str, pattern: str) -> dict:
    if job not in _OF_JOB:
        _OF_JOB.clear()
        _OF_JOB[job] = {"splitter": Splitter(pattern)}
    return _OF_JOB[job]


def word_counts(docs: DataFrame, pattern: str, text_col: str = "text", job: str = "") -> DataFrame:
    """(word, n): distinct words of all texts; each task sums its own first."""
    texts = docs.select(F.col(text_col).cast("string").alias("t")).where("t IS NOT NULL AND t <> ''")
    runtime.share_package(docs.sparkSession)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = _of_job(job, pattern)["splitter"]
        total = np.zeros(0, np.int64)

        def drain() -> pa.RecordBatch:
            at = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array([splitter.names[i].encode() for i in at.tolist()], pa.binary()), pa.array(total[at])], names=["word", "n"])

        for batch in batches:
            for lo, hi, _, _ in blocks.blocks(batch.column(0), BLOCK_BYTES):
                if splitter.full:
                    yield drain()
                    splitter.forget()
                    total = np.zeros(0, np.int64)
                chunks, _ = splitter.block(batch.column(0).slice(lo, hi - lo))
                seen, n = np.unique(chunks, return_counts=True)
                words, ends = splitter.words_of(seen)
                more = np.bincount(words, weights=np.repeat(n, np.diff(ends, prepend=0)), minlength=len(total)).astype(np.int64)
                more[: len(total)] += total
                total = more
        yield drain()

    return texts.mapInArrow(stage, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def dictionary(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", most: int = HOT_WORDS, job: str = "") -> DataFrame:
    """(word, ids) of the at most ``most`` most frequent distinct words, folded in Spark."""
    counts = runtime.materialize(word_counts(docs, pattern, text_col, job).where(F.length("word") <= FOLD_BYTES), "words")
    level = F.when(F.col("n") < 1024, F.col("n")).otherwise((F.lit(1024) + F.floor(F.log2(F.col("n") / 1024) * 32))).cast("bigint")
    histogram = {r.level: r["count"] for r in counts.groupBy(level.alias("level")).count().collect()}  # at most some 2,800 levels
    total, least = 0, 1 << 40
    for at in sorted(histogram, reverse=True):
        total += histogram[at]
        if total > most:
            break
        least = at
    spark = docs.sparkSession
    parts = max(1, spark.sparkContext.defaultParallelism * 4)
    hot = counts.where(level >= least).repartition(parts)
    return hot.select("word", fold(F.hex("word"), rank_literal(ranks, spark)).alias("ids"))


class Encoder:
    """Encodes blocks of texts by a dictionary of words; other words are merged here, many at a time."""

    def __init__(self, ranks: dict[bytes, int], splitter: Splitter, words: dict[bytes, bytes]):
        self.ranks, self.words, self.splitter, self.epoch = ranks, words, splitter, -1
        self.merges = Merges.of_ranks(ranks)
        self.pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.names = [b"%d," % i for i in range(len(self.pieces))]

    def ids_of(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(i, ids of word i), in any order: from the dictionary, as whole pieces, or by ranked merges."""
        rest = []
        for i, (w, known) in enumerate(zip(words, map(self.words.get, words))):
            if known:
                yield i, memoryview(known).cast("I").tolist()
            elif (r := self.ranks.get(w)) is not None:
                yield i, [r]
            elif len(w) <= LONGEST and self.merges.usable:
                rest.append(i)
            else:
                yield i, merge(w, self.ranks)
        if rest:
            order, lengths, flat = self.merges.encode([words[i] for i in rest])
            made, at = flat.tolist(), 0
            for i, n in zip(order.tolist(), lengths.tolist()):
                yield rest[i], made[at : at + n]
                at += n

    def _learn(self) -> None:
        """For the splitter's new words: how many ids, the ids as decimal text with a comma behind each, and the pieces they decode to."""
        s = self.splitter
        if self.epoch != s.epoch:
            self.epoch, self.said, self.spelt, self.sizes = s.epoch, [], [], np.zeros(0, np.int64)
        new = [w.encode() for w in s.names[len(self.said) :]]
        if new:
            name, piece, join = self.names.__getitem__, self.pieces.__getitem__, b"".join
            first, sizes = len(self.said), np.zeros(len(new), np.int64)
            self.said += [b""] * len(new)
            self.spelt += [b""] * len(new)
            for i, ids in self.ids_of(new):
                self.said[first + i], self.spelt[first + i], sizes[i] = join(map(name, ids)), join(map(piece, ids)), len(ids)
            self.sizes = np.append(self.sizes, sizes)
            s.held += 150 * len(new) + 10 * int(sizes.sum())

    def encode(self, col: pa.Array) -> Iterator[tuple[int, bytes, bytes]]:
        """(number of ids, their decimal text with commas, the decoded bytes) of each text."""
        s = self.splitter
        if s.full:
            s.forget()
        chunks, offs = s.block(col)
        self._learn()
        words, ends = s.words_of(chunks)
        cut = np.append(0, ends)[offs]
        sums = np.append(0, np.cumsum(self.sizes[words]))
        n = (sums[cut[1:]] - sums[cut[:-1]]).tolist()
        codes, said, spelt = words.tolist(), self.said, self.spelt
        for i, (a, b) in enumerate(zip(cut.tolist(), cut[1:].tolist())):
            own = codes[a:b]
            yield n[i], b"".join([said[k] for k in own]), b"".join([spelt[k] for k in own])


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, most: int = HOT_WORDS) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) of every document."""
    ranks, job = load_ranks(path), uuid.uuid4().hex
    got = dictionary(docs, ranks, pattern, text_col, most, job).toArrow()  # bounded by ``most``
    words = {w: array("I", ids).tobytes() for w, ids in zip(got.column("word").to_pylist(), got.column("ids").to_pylist())}
    shared = docs.sparkSession.sparkContext.broadcast((ranks, words))

    def kernel(col: pa.Array) -> list:
        state = _of_job(job, pattern)
        if "encoder" not in state:
            ranks, words = shared.value
            state["encoder"] = Encoder(ranks, state["splitter"], words)
        out = []
        for lo, hi, _, _ in blocks.blocks(col, BLOCK_BYTES):
            for n, said, spelt in state["encoder"].encode(col.slice(lo, hi - lo)):
                row = [n, hashlib.sha256(said[:-1]).hexdigest(), hashlib.sha256(spelt).hexdigest()]
                out.append(row + [[int(x) for x in said.split(b",")[:-1]], spelt] if with_ids else row)
        return [list(x) for x in zip(*out)]

    fields = [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    return runtime.map_text(docs, kernel, fields + [("ids", "array<int>"), ("decoded", "binary")] * with_ids, text_col, (id_col,))
