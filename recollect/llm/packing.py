"""Best-fit packing of token sequences, improved by swap-based local search.

Only lengths matter for packing, and there are at most ``CAPACITY`` of them, so
the plan is made on the histogram of lengths: a bounded table however large the
corpus is.  Bins with the same content are one class with a count.

1. Best fit decreasing on classes: each length goes to the fullest class of bins
   that it fits, for as many bins as there are.
2. Local search on all classes of underfull bins: exchange one document for one,
   two for one, or move one, whenever the sum of squared fills grows, for as many
   pairs of bins at once as the two classes have, until the lower bound is met
   or no move helps.
3. The plan's places are dealt out by the rank of a piece among the pieces of
   its length: ranks within a task come with the tokens, and a window over
   (task, length) counts adds the ranks before the task.

Defined results: a null text is empty, one piece of the end token alone; every
piece of every row is placed once, repeated rows too; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import uuid
import zlib
from array import array
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks, pretokens, runtime
from .merges import LONGEST, Merges

CAPACITY = 2048
#: Distinct units of text whose ids a worker remembers.  Most new units never come again, so more are hardly worth their memory.
MEMO = 150_000
#: Bytes of text that are encoded at a time (a longer text is encoded by itself).
BLOCK_BYTES = 1 << 21
#: Characters that the library gets at a time (a longer chunk by itself): what it returns takes many times as much.
LIBRARY_CHARS = 1 << 18
_END = b"\0\0\0\0"
_CLOSING = ".,!?;:"


def _runs(chunks: list[str], limit: int) -> Iterator[list[str]]:
    """Runs of ``chunks`` of at most ``limit`` characters together, or of one that is longer."""
    first = size = 0
    for i, c in enumerate(chunks):
        size += len(c)
        if size > limit and i > first:
            yield chunks[first:i]
            first, size = i, len(c)
    if chunks:
        yield chunks[first:]


class Tokenizer:
    """Ids of whole texts by the library, put together from those of chunks between white space.

    The tokenizer must drop white space before it merges, so that chunks encode
    independently.  Texts are cut at ASCII white space only; other white space
    stays within a chunk and is the library's to drop.  If the tokenizer file is
    of the kind that ``pretokens`` knows, chunks of Latin text are cut further,
    into pre-tokens in lower case: far fewer of these are distinct.
    """

    def __init__(self, spec: str, memo: int = MEMO):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer as Library

        self.library, self.merges, self.limit = Library.from_str(spec), Merges(spec), memo
        self.fine = pretokens.fits(spec)
        self.many = getattr(self.library, "encode_batch_fast", self.library.encode_batch)
        self._forget()

    def _forget(self) -> None:
        """Chunk i of the memo has the ids from starts[i] to starts[i + 1]."""
        self.memo: dict[str, int] = {}
        self.ids, self.starts = array("I"), array("q", [0])

    def _put(self, chunk: str, ids: array) -> None:
        self.memo[chunk] = len(self.starts) - 1
        self.ids.extend(ids)
        self.starts.append(len(self.ids))

    def _keep(self, chunks: list[str], code: list[int | None]) -> list[str]:
        """Forget all but those of ``chunks`` that have a ``code``; the others.

        What comes again comes in most blocks, so it is copied and not merged anew.
        """
        kept = [c for c, k in zip(chunks, code) if k is not None]
        at = np.array([k for k in code if k is not None], np.int64)
        starts, ids = np.frombuffer(self.starts, np.int64), np.frombuffer(self.ids, np.uint32) if self.ids else np.zeros(0, np.uint32)
        length = starts[at + 1] - starts[at]
        ends = np.cumsum(length)
        own = ids[np.repeat(starts[at] - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)]
        del starts, ids  # arrays that are viewed can't grow
        self._forget()
        self.memo.update(zip(kept, range(len(kept))))
        self.starts.frombytes(ends.tobytes())
        self.ids.frombytes(own.tobytes())
        return [c for c, k in zip(chunks, code) if k is None]

    def _known(self, chunk: str) -> array:
        i = self.memo[chunk]
        return self.ids[self.starts[i] : self.starts[i + 1]]

    def _merge_words(self, chunks: list[str]) -> list[str]:
        """Put those of ``chunks`` that are words of letters below U+0130 in lower case into the memo; the others."""
        if not self.merges.usable or not chunks:
            return chunks
        data, offsets = blocks.raw(pa.array(chunks, pa.large_string()))
        data = data[: offsets[-1]]
        start, size = offsets[:-1], np.diff(offsets)
        is_word = pretokens.are_words(data, offsets) & (size > 0) & (size <= LONGEST)
        at = np.flatnonzero(is_word)
        order, lengths, ids = self.merges.encode_at(data, start[at], size[at])
        self.memo.update(zip(map(chunks.__getitem__, at[order].tolist()), range(len(self.starts) - 1, len(self.starts) - 1 + len(at))))
        self.starts.frombytes((np.cumsum(lengths) + self.starts[-1]).tobytes())
        self.ids.frombytes(ids.tobytes())
        return list(map(chunks.__getitem__, np.flatnonzero(~is_word).tolist()))

    def _learn(self, chunks: list[str]) -> None:
        """Put the ids of ``chunks``, none of which it has, into the memo.

        Chunks that differ in case or in closing punctuation share the work:
        the library lower-cases, and punctuation behind a letter or digit is a
        word of its own.  This holds for characters below U+0130, which Python
        and the library lower-case alike and which are in normal form.  Words of
        such letters alone are one pre-token each and are merged many at a time.
        """
        parts = {}
        chunks = self._merge_words(chunks)
        for c in chunks:
            if c and (c.isascii() or max(c) < "\u0130") and "<|" not in c:
                low = c.lower()
                stem = low.rstrip(_CLOSING)
                if stem != c and stem and stem[-1].isalnum() and (stem[-1].isalpha() or stem[-1].isdecimal()):
                    parts[c] = stem, low[len(stem) :]
        need = [c for c in {c for c in chunks if c not in parts}.union(*parts.values()) if c not in self.memo]
        need = self._merge_words(need)
        for part in _runs(need, LIBRARY_CHARS):
            for c, e in zip(part, self.many(part, add_special_tokens=False)):
                self._put(c, array("I", e.ids))
        for c, (stem, closing) in parts.items():
            self._put(c, self._known(stem) + self._known(closing))

    def _split(self, col: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Units of all texts of ``col``, which encode independently, and the offsets of each text's."""
        if not len(col):
            return pa.array([], pa.string()), np.zeros(1, np.int64)
        if self.fine:
            data, offsets = blocks.raw(col)
            return pretokens.cut(data[offsets[0] : offsets[-1]], offsets - offsets[0])
        split = pc.ascii_split_whitespace(col)
        return split.flatten(), np.asarray(split.offsets) - split.offsets[0].as_py()

    def encode_block(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of ``col`` (no nulls), one after another, and the offsets of each text's."""
        units, offs = self._split(col)
        words = units.dictionary_encode()
        chunks = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        code = list(map(self.memo.get, chunks))
        rest = [c for c, k in zip(chunks, code) if k is None]
        if rest:
            if len(self.memo) + len(rest) > self.limit or len(self.ids) > 8 * self.limit:
                rest = self._keep(chunks, code)
            self._learn(rest)
            code = list(map(self.memo.__getitem__, chunks))
        starts = np.frombuffer(self.starts, np.int64)
        code = np.array(code, np.int64)
        first, length = starts[code], starts[code + 1] - starts[code]
        at = np.asarray(words.indices)
        own = length[at]
        ends = np.cumsum(own)
        ids = np.frombuffer(self.ids, np.uint32) if self.ids else np.zeros(0, np.uint32)
        total = int(ends[-1]) if len(ends) else 0
        got = ids[np.repeat(first[at] - (ends - own), own) + np.arange(total)]
        return got, np.concatenate([[0], ends])[offs]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids, at = self.encode_block(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(at, at[1:])]


#: The memo of a worker's latest job; a job's tasks share it.
_OF_JOB: dict[str, Tokenizer] = {}
runtime.MEMOS.append(_OF_JOB)


def _tokenizer(job: str, spec: str) -> Tokenizer:
    if job not in _OF_JOB:
        runtime.release()
        _OF_JOB[job] = Tokenizer(spec)
    return _OF_JOB[job]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, task, nth): the pieces, and which of its length in its task each is."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    job = uuid.uuid4().hex
    runtime.share_package(docs.sparkSession)
    inner = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    kind = inner.schema["i"].dataType.simpleString()

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, nth, tok = TaskContext.get().partitionId(), Counter(), _tokenizer(job, spec)
        names = ["i", "piece", "start", "length", "ids_crc32", "task", "nth"]
        for batch in batches:
            for lo, hi, _, _ in blocks.blocks(batch.column(1), BLOCK_BYTES):
                ids, at = tok.encode_block(batch.column(1).slice(lo, hi - lo))
                rows, of = [], []
                for k, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist())):
                    own = ids[a:b].tobytes() + _END
                    for p, c in enumerate(range(0, len(own), capacity * 4)):
                        cut = own[c : c + capacity * 4]
                        n = len(cut) // 4
                        rows.append((p, c // 4, n, zlib.crc32(cut), task, nth[n]))
                        nth[n] += 1
                        of.append(lo + k)
                cols = [pa.array(np.array(c), t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), *cols], names=names)

    return inner.mapInArrow(stage, f"i {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, nth bigint").withColumnRenamed("i", id_col)


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[tuple[int, ...], int]:
    """Bins as {lengths in descending order: how many such bins}, by best fit decreasing."""
    by_gap: list[dict[tuple[int, ...], int]] = [defaultdict(int) for _ in range(capacity + 1)]
    open_ = np.zeros(capacity + 1, bool)

    def put(bins: tuple[int, ...], gap: int, n: int) -> None:
        by_gap[gap][bins] += n
        open_[gap] = True

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            fits = np.flatnonzero(open_[length:])
            if len(fits):
                gap = int(fits[0]) + length
                bins, have = next(iter(by_gap[gap].items()))
                n = min(have, left)
                if n == have:
                    del by_gap[gap][bins]
                    open_[gap] = bool(by_gap[gap])
                else:
                    by_gap[gap][bins] = have - n
                put((*bins, length), gap - length, n)
                left -= n
            else:
                each = capacity // length
                n = left // each or 1
                put((length,) * min(each, left), capacity - length * min(each, left), n)
                left -= n * min(each, left)
    out: dict[tuple[int, ...], int] = defaultdict(int)
    for level in by_gap:
        for bins, n in level.items():
            out[tuple(sorted(bins, reverse=True))] += n
    return dict(out)


def local_search(bins: list[list[int]], capacity: int = CAPACITY) -> list[list[int]]:
    """``search_classes`` of single bins."""
    found = search_classes(Counter(tuple(sorted(b, reverse=True)) for b in bins), capacity)
    return [list(b) for b, n in found.items() for _ in range(n)]


def search_classes(bins: dict[tuple[int, ...], int], capacity: int = CAPACITY) -> dict[tuple[int, ...], int]:
    """Moves, swaps and two-for-one exchanges between bins that raise the sum of squared fills.

    From the emptiest class of bins on, documents go to fuller ones: the largest
    gain that still fits is taken each time, for as many pairs of bins as the
    two classes have.  A bin without documents is dropped.  It ends at the lower
    bound or when no exchange helps; each exchange raises a sum of whole numbers
    that is bounded, so one of the two comes.
    """
    count = Counter({b: n for b, n in bins.items() if b and n})
    least = -(-sum(sum(b) * n for b, n in count.items()) // capacity)
    spare = sum(count.values()) - least
    barren: dict[tuple[int, ...], set[tuple[int, ...]]] = defaultdict(set)  # pairs without an exchange, which is for good
    better = True
    while better and spare > 0:
        better = False
        order = sorted((b for b, n in count.items() if n and sum(b) < capacity), key=lambda b: (sum(b), b))
        for i, a in enumerate(order):
            for b in reversed(order[i:]):
                if not count[a]:
                    break
                n = count[a] // 2 if a == b else min(count[a], count[b])
                if not n or b in barren[a]:
                    continue
                best = _exchange(a, b, capacity - sum(b))
                if not best:
                    barren[a].add(b)
                else:
                    _, give, take = best
                    count[a] -= n
                    count[b] -= n
                    for lost, got, own in ((give, take, a), (take, give, b)):
                        left = list(own)
                        for x in lost:
                            left.remove(x)
                        made = tuple(sorted(left + got, reverse=True))
                        if made:
                            count[made] += n
                        else:
                            spare -= n
                    better = True
        count = +count
        barren = defaultdict(set, {a: known for a, known in barren.items() if a in count})
    return dict(+count)


def _exchange(emptier: tuple[int, ...], fuller: tuple[int, ...], gap: int) -> tuple[int, list[int], list[int]] | None:
    """(gain, given, taken): what fills most of the fuller bin's gap."""
    best: tuple[int, list[int], list[int]] | None = None
    have = sorted(set(emptier))
    count = Counter(emptier)

    def offer(gain: int, give: list[int], take: list[int]) -> None:
        nonlocal best
        if 0 < gain <= gap and (best is None or gain > best[0]):
            best = gain, give, take

    for x in have:
        offer(x, [x], [])
    if best and best[0] == gap:
        return best
    for y in set(fuller):
        for i, x in enumerate(have):
            offer(x - y, [x], [y])
            # Two for one: the second as large as still fits.
            room = bisect_right(have, gap + y - x) - 1
            if 0 <= room <= i:
                z = have[room]
                if z != x or count[x] > 1:
                    offer(x + z - y, [x, z], [y])
    return best


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[tuple[int, ...], int]:
    """Classes of bins for a histogram of lengths: best fit, then local search."""
    return search_classes(best_fit(histogram, capacity), capacity)


def places(classes: dict[tuple[int, ...], int]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: (first rank, first sequence, copies in a bin, offset of the first copy), by rank."""
    rank: Counter = Counter()
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    sequence = 0
    for bins in sorted(classes, reverse=True):
        offset = 0
        for length, k in sorted(Counter(bins).items(), reverse=True):
            rows[length].append((rank[length], sequence, k, offset))
            rank[length] += k * classes[bins]
            offset += k * length
        sequence += classes[bins]
    return {n: tuple(np.array(c) for c in zip(*r)) for n, r in rows.items()}


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    with runtime.small_batches(docs.sparkSession):
        cut = runtime.materialize(pieces(docs, path, capacity, id_col, text_col), "pieces")
    counts = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    at = pickle.dumps(places(plan(histogram, capacity)))
    shared = docs.sparkSession.sparkContext.broadcast(at)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = cut.join(starts, ["task", "length"]).select(id_col, "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    kind = cut.schema[id_col].dataType.simpleString()

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pickle.loads(shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = np.asarray(batch.column(3)), np.asarray(batch.column(5))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for own in np.split(order, cuts):
                first, seq, k, off = table[int(length[own[0]])]
                i = np.searchsorted(first, rank[own], side="right") - 1
                r = rank[own] - first[i]
                sequence[own] = seq[i] + r // k[i]
                offset[own] = off[i] + r % k[i] * length[own]
            cols = [batch.column(i) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(offset)], names=["i", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(stage, f"i {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint").withColumnRenamed("i", id_col)
