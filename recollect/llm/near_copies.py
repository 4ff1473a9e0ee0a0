"""Near copies by multi-index hashing of wide SimHash fingerprints, then an exact way for what it leaves.

Two texts are near copies if the sets of their five-word shingles have a Jaccard
similarity of at least ``similarity`` (0.8).  ``simhash`` links fingerprints of
64 bits within two bits, which reaches hardly more than equal sets; a similarity
of 0.8 leaves 15 % of the bits different, so here

* a fingerprint has ``tables`` segments of ``bits`` bits, and both numbers come
  from the number of documents and the wanted ``recall`` (``plan``): a segment is
  some bits longer than the logarithm of the table, so that chance matches stay in
  proportion to the documents at every size, and there are as many segments as the
  recall needs at that length;
* around each segment a small Hamming ball is enumerated: the segment itself and
  it with one of its ``FLIPS`` bits flipped whose sums are nearest to a tie, as
  these are the bits in which near copies differ.  The documents that list the
  same value of the same segment are compared with one leader, the one that shares
  most entries (the original that many were copied from).

That makes a star an entry however many meet there, and links most of what is to
be linked; ``RECALL`` is that of this search alone.  All pairs that it leaves are
decided exactly, so the result doesn't depend on it:

* in any one order of all shingles, two sets of a similarity of 0.8 have a common
  member among the first ``prefix_length`` of each.  The order puts the shingles
  last that are frequent in a sample of texts, which only saves pairs.  The sample
  is a fixed share of the texts, so a shingle that comes first has few texts at every size;
* sets with a common member there are compared if they are of different
  components by now, of possible sizes, and if the parities of their members' hashes
  (``WORDS`` times 64 bits, more for large sets) differ in no more bits than the
  sets may: a pair within the similarity always passes.  In crowded entries a star goes first,
  so that a large group of copies is one component before pairs are made;
* what passes is compared by its shingle sets, as the pairs of the first search.

So a passage that ever more texts quote makes no pairs of texts that have a fifth
of their own.  Texts that share nearly all of their shingles with a group and yet
are no near copies are still met there with the square of its size, in a join's condition.

Which rows are meant (those of distinct sets, those of the pairs) goes to the
sketches as bitmaps, an eighth of a byte a row, so no sketch is shuffled for it.

Defined results: a null text is empty; texts without words are copies of each
other; texts of fewer words are one shingle; a null id never is the smallest id;
of repeated rows one stays; extra columns are kept; an empty table stays empty.
Texts of equal shingle sets count as equal; a shingle is its XXH64, of which the
last comparison takes 32 bits.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import runtime
from .simhash import components

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.5
FLIPS = 7
SPARE_BITS = 5
BUCKET = 64
WORDS, FOLDED = 16, 4
SAMPLE, RATE, FREQUENT, MOST_FREQUENT = 4096, 8, 3, 1 << 20
SEED = 42
_ROWS = 256  # texts that are hashed at once
_SEGMENT_AT = 48  # an entry's key: the segment's number above its value
_FLIP_BITS = 6  # the number of a bit in a segment
_MAP_BITS = 15  # rows of one bitmap, as Spark's bitmap functions have it


@dataclass(frozen=True)
class Plan:
    """``tables`` segments of ``bits`` bits."""

    shingle: int
    bits: int
    tables: int

    @property
    def words(self) -> int:
        return -(-self.bits * self.tables // 64)


def plan(n: int, shingle: int = SHINGLE, similarity: float = SIMILARITY, recall: float = RECALL) -> Plan:
    """Segments for ``n`` documents.

    The sums behind two texts' bits are nearly normal with the correlation of
    the shingle sets, so the rate at which two balls meet is simulated.
    """
    bits = min(_SEGMENT_AT - 1, max(16, math.ceil(math.log2(max(n, 2))) + SPARE_BITS))
    rho = 2 * similarity / (1 + similarity)
    rng = np.random.default_rng(0)
    x = rng.standard_normal((8192, bits))
    y = rho * x + math.sqrt(1 - rho * rho) * rng.standard_normal((8192, bits))
    met = [bool(np.isin(a, b).any()) for a, b in zip(_balls(x), _balls(y))]
    tables = max(1, math.ceil(math.log(1 - recall) / math.log1p(-max(float(np.mean(met)), 1e-3))))
    return Plan(shingle, bits, tables)


def _segments(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of sums the value of its bits, and the numbers of its least certain bits."""
    powers = np.int64(1) << np.arange(sums.shape[1], dtype=np.int64)
    return ((sums > 0) * powers).sum(axis=1, dtype=np.int64), np.argsort(np.abs(sums), axis=1, kind="stable")[:, :FLIPS]


def _balls(sums: np.ndarray) -> np.ndarray:
    """Of each row the value, then the values with one of the least certain bits flipped."""
    value, least = _segments(sums)
    return np.concatenate([value[:, None], value[:, None] ^ (np.int64(1) << least)], axis=1)


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct XXH64 of the shingles of one text; words as in ``simhash``."""
    from xxhash import xxh64_intdigest as digest

    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-shingle]]).tolist()
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())), np.uint64, len(starts)))


def _mixed(h: np.ndarray, words: int) -> np.ndarray:
    """``words`` independent hashes of each hash (a multiply and shift mix of 64 bits), in columns."""
    with np.errstate(over="ignore"):
        h = h[:, None] + np.uint64(0x9E3779B97F4A7C15) * np.arange(1, words + 1, dtype=np.uint64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def sketch(h: np.ndarray, p: Plan) -> tuple[np.ndarray, np.ndarray]:
    """The segments of the fingerprint, and of each its ``FLIPS`` least certain bits, packed.

    A text without shingles has no segments, so it is in no table.
    """
    if not len(h):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ones = np.zeros(p.words * 64, np.int64)
    for i in range(0, len(h), 255):  # sums of 255 bits fit in a byte, which is much faster
        bits = np.unpackbits(_mixed(h[i : i + 255], p.words).view(np.uint8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    cores, least = _segments((2 * ones - len(h))[: p.bits * p.tables].reshape(p.tables, p.bits))
    return cores, (least << (_FLIP_BITS * np.arange(FLIPS))).sum(axis=1, dtype=np.int64)


def _print(h: np.ndarray) -> int:
    from xxhash import xxh64_digest

    return int.from_bytes(xxh64_digest(h.tobytes(), SEED), "little", signed=True)


def prefix_length(n: int, similarity: float = SIMILARITY) -> int:
    """Of ``n`` shingles so many, in an order that all sets share, meet those of each set within the similarity."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def prefix(h: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """The first ``prefix_length`` of the sorted ``h``: by value, but those of ``frequent`` (sorted, with ranks) last, by rank."""
    wanted, (known, ranks) = prefix_length(len(h), similarity), frequent
    if not len(known) or not len(h):
        return h[:wanted]
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    often = known[at] == h
    rare = h[~often]
    if len(rare) >= wanted:
        return rare[:wanted]
    return np.concatenate([rare, h[often][np.argsort(ranks[at[often]], kind="stable")][: wanted - len(rare)]])


def parities(h: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Bit k is set if an odd number of ``h`` end in k: two sets differ in as many members as bits, or more.

    ``words`` is a power of two; the halves of an array make that of half the words.
    """
    bits = np.bincount((h & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def wide(h: np.ndarray) -> np.ndarray:
    """Parities of a bit a member for a set that is too large for ``WORDS``, or is near to such sets."""
    if len(h) <= 32 * WORDS:
        return np.empty(0, np.int64)
    return parities(h, max(WORDS, 1 << math.ceil(math.log2(len(h) / 64))))


def _lists(parts: list[np.ndarray], dtype: type) -> pa.Array:
    ends = np.cumsum([0, *(len(x) for x in parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, dtype), *parts])))


Frequent = tuple[np.ndarray, np.ndarray]
_NONE: Frequent = (np.empty(0, np.uint64), np.empty(0, np.int64))


def frequent(docs: DataFrame, n: int, shingle: int, text_col: str) -> Frequent:
    """Shingles of several texts of a sample, sorted, and their ranks by frequency.

    They order the shingles and nothing else: any order gives the same links.
    One text in ``RATE`` is in the sample, of few texts about ``SAMPLE`` or all: in a sample
    of one size the shingles that it misses have more and more texts as the table grows.
    """
    sample = docs.where(F.pmod(F.xxhash64(F.col(text_col)), F.lit(max(1, min(RATE, n // SAMPLE)))) == 0).select(text_col)
    some = runtime.map_text(sample, lambda col: [_lists([shingles(t.as_py(), shingle).view(np.int64) for t in col], np.int64)], [("h", "array<bigint>")], text_col, (), rows=_ROWS)
    counts = some.select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    top = counts.orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).toArrow()
    h, seen = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(h)
    ranks = np.empty(len(h), np.int64)
    ranks[np.lexsort((h, seen))] = np.arange(len(h))
    return h[order], ranks[order]


def sketches(docs: DataFrame, p: Plan, id_col: str, text_col: str, often: Frequent = _NONE, similarity: float = SIMILARITY) -> DataFrame:
    """(row, id, print, n, cores, flips, parities, wide, prefix, shingles) of every document; no shuffle.

    ``row`` numbers the rows once the result is written, ``print`` is a hash of
    the set of ``n`` shingles; shingles are cut to 32 bits, but those of the prefix.
    """

    def kernel(col: pa.Array) -> list:
        sets = [shingles(t.as_py(), p.shingle) for t in col]
        made = [sketch(h, p) for h in sets]
        cut = [(h & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32) for h in sets]
        return [
            pa.array([_print(h) for h in sets], pa.int64()),
            pa.array([len(h) for h in sets], pa.int32()),
            _lists([c for c, _ in made], np.int64),
            _lists([f for _, f in made], np.int64),
            _lists([parities(h) for h in sets], np.int64),
            _lists([wide(h) for h in sets], np.int64),
            _lists([prefix(h, often, similarity).view(np.int64) for h in sets], np.int64),
            _lists(cut, np.int32),
        ]

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(runtime._q(id_col)).alias("id"), F.col(runtime._q(text_col)).alias("text"))
    fields = [("print", "bigint"), ("n", "int"), ("cores", "array<bigint>"), ("flips", "array<bigint>"), ("parities", "array<bigint>"), ("wide", "array<bigint>"), ("prefix", "array<bigint>"), ("shingles", "array<int>")]
    return runtime.map_text(rows, kernel, fields, "text", ("row", "id"), rows=_ROWS)


def distinct(made: DataFrame) -> DataFrame:
    """(node, print, first) of each set of shingles: a row that has it, and the smallest id."""
    return made.groupBy("print").agg(F.min("row").alias("node"), F.min("id").alias("first"))


def bitmaps(nodes: DataFrame) -> DataFrame:
    """(block, bits): of each block of rows the bitmap of those that are in ``nodes``; a few bytes for what would be a join's shuffle."""
    blocks = nodes.select(F.shiftright("node", _MAP_BITS).alias("block"), F.col("node").bitwiseAND((1 << _MAP_BITS) - 1).alias("bit")).repartition("block")
    return blocks.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))


def _of(made: DataFrame, maps: DataFrame, *columns: str, row: str = "row") -> DataFrame:
    """``columns`` of the rows of ``made`` that are in ``maps``, with their number as ``node``."""
    bit = F.col("node").bitwiseAND((1 << _MAP_BITS) - 1)
    held = made.select(F.col(row).alias("node"), *columns).join(F.broadcast(maps), F.shiftright("node", _MAP_BITS) == F.col("block"))
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return held.where(F.getbit(byte, bit.bitwiseAND(7).cast("int")) == 1).select("node", *columns)


def _entries(nodes: DataFrame) -> DataFrame:
    """(node, key): the balls of all segments; a key is the segment's number above a value."""
    one = F.lit(1).cast("bigint")
    flipped = [F.call_function("shiftleft", one, F.shiftright("s.flips", _FLIP_BITS * k).bitwiseAND((1 << _FLIP_BITS) - 1).cast("int")) for k in range(FLIPS)]
    segments = nodes.select("node", F.posexplode(F.arrays_zip("cores", "flips")).alias("segment", "s"))
    values = segments.select("node", "segment", "s.cores", F.explode(F.array(F.lit(0).cast("bigint"), *flipped)).alias("flip"))
    return values.select("node", F.col("cores").bitwiseXOR(F.col("flip")).bitwiseOR(F.shiftleft(F.col("segment").cast("bigint"), _SEGMENT_AT)).alias("key"))


def _shared(entries: DataFrame) -> DataFrame:
    """``entries`` (node, key) of the keys of several nodes, with their number ``size``."""
    each = Window.partitionBy("key")
    met = entries.withColumns({"least": F.min("node").over(each), "most": F.max("node").over(each), "size": F.count("*").over(each)})
    return met.where("least < most").drop("least", "most")


def _stars(shared: DataFrame) -> DataFrame:
    """(a, b): each member of an entry with the leader, the member that shares most."""
    weights = shared.groupBy("node").agg(F.sum("size").alias("weight"))
    leaders = shared.join(weights, "node").groupBy("key").agg(F.max(F.struct("weight", "node")).alias("top")).select("key", F.col("top.node").alias("leader"))
    led = shared.join(leaders, "key").where("node <> leader")
    return led.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()


def _possible(similarity: float, words: int, a: str = "a", b: str = "b") -> Column:
    """Whether sizes and parities (columns n and w of a and b) leave room for the similarity."""
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}w{i}").bitwiseXOR(F.col(f"{b}w{i}"))) for i in range(words)])
    return (F.least(n, m) >= similarity * F.greatest(n, m) - 1e-6) & (apart <= (n + m) * ((1 - similarity) / (1 + similarity)) + 1e-6)


def _side(marks: DataFrame, side: str) -> DataFrame:
    """``marks`` (node, n, parities) as columns of one side of a pair."""
    return marks.select(F.col("node").alias(side), F.col("n").alias(f"{side}n"), *[F.col("parities")[i].alias(f"{side}w{i}") for i in range(WORDS)])


def _folded(side: str, words: Column) -> Column:
    """``words`` of the parities of a side, which has as many or twice as many."""
    w = F.col(side)
    return F.transform(F.slice(w, 1, words), lambda x, i: F.when(F.size(w) > words, x.bitwiseXOR(F.get(w, i + words))).otherwise(x))


def _ends(pairs: DataFrame) -> DataFrame:
    """(node): the ends of ``pairs`` (a, b), with repeats."""
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))


def _near(pairs: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) that may have the similarity by their sizes and parities, of large sets by the wide ones too."""
    marks = runtime.materialize(_of(marks, bitmaps(_ends(pairs)), "n", "parities", "wide", row="node"), "ends")
    some = pairs.join(_side(marks, "a"), "a").join(_side(marks, "b"), "b").where(_possible(similarity, WORDS))
    some = runtime.materialize(some.select("a", "b", F.greatest("an", "bn").alias("n"), (F.col("an") + F.col("bn")).alias("total")), "possible")
    large = some.where(F.col("n") > 64 * WORDS)
    held = marks.where(F.size("wide") > 0)
    words = F.least(F.size("wa"), F.size("wb"))
    apart = F.aggregate(F.zip_with(_folded("wa", words), _folded("wb", words), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    large = large.join(held.select(F.col("node").alias("a"), F.col("wide").alias("wa")), "a").join(held.select(F.col("node").alias("b"), F.col("wide").alias("wb")), "b")
    large = large.where(apart <= F.col("total") * ((1 - similarity) / (1 + similarity)) + 1e-6)
    return some.where(F.col("n") <= 64 * WORDS).select("a", "b").unionByName(large.select("a", "b"))


def _alike(pairs: DataFrame, made: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose shingle sets have at least the Jaccard similarity."""
    sets = runtime.materialize(_of(made, bitmaps(_ends(pairs)), "shingles"), "sets")
    one, other = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    sizes = F.size("sa") + F.size("sb")
    fit = (F.least(F.size("sa"), F.size("sb")) >= similarity * F.greatest(F.size("sa"), F.size("sb"))) & (both >= similarity * (sizes - both))
    return pairs.join(one, "a").join(other, "b").where(fit).select("a", "b")


def _contracted(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``edges`` (a, b) between the roots of their nodes, without repeats and loops."""
    one, other = labels.select(F.col("node").alias("a"), F.col("root").alias("ra")), labels.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    roots = edges.join(one, "a", "left").join(other, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    return roots.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def grown(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The components ``labels`` (node, root) with further ``edges`` (a, b) between nodes.

    Each node is joined to its smallest neighbour and the edges are contracted to
    what is left between the trees, so a dense group is walked along a forest only.
    """
    while True:
        edges = runtime.materialize(_contracted(edges, labels), "contracted")
        if edges.isEmpty():
            return labels
        forest = edges.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        new = components(forest).select(F.col("node").alias("at"), F.col("root").alias("further"))
        moved = labels.join(new, labels.root == new["at"], "left").select("node", F.coalesce("further", "root").alias("root"))
        fresh = new.join(labels, new["at"] == labels.node, "left_anti").select(F.col("at").alias("node"), F.col("further").alias("root"))
        labels = runtime.materialize(moved.unionByName(fresh), "grown")


def links(nodes: DataFrame, made: DataFrame, p: Plan, similarity: float = SIMILARITY, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that connect all ``nodes`` that are alike, and the components (node, root).

    ``made`` has the sketches of the nodes, by row.
    """
    maps = runtime.materialize(bitmaps(nodes), "maps")
    marks = runtime.materialize(_of(made, maps, "n", "parities", "wide"), "marks")
    found: list[DataFrame] = []
    roots = nodes.sparkSession.sql("SELECT CAST(NULL AS BIGINT) AS node, CAST(NULL AS BIGINT) AS root WHERE false")  # unlike createDataFrame it starts no Python workers

    def link(pairs: DataFrame) -> None:
        nonlocal roots
        pairs = runtime.materialize(pairs, "pairs")
        near = runtime.materialize(_near(pairs, marks, similarity), "near")
        found.append(runtime.materialize(_alike(near, made, similarity), "links"))
        roots = grown(roots, found[-1])

    link(_stars(runtime.materialize(_shared(_entries(_of(made, maps, "cores", "flips"))), "shared")))
    shared = runtime.materialize(_shared(_of(made, maps, "prefix").select("node", F.explode("prefix").alias("key"))), "prefixes")
    crowded = apart(shared.where(F.col("size") > bucket), roots)
    link(_stars(crowded.select("key", "node", "size")))
    folded = [reduce(lambda x, y: x.bitwiseXOR(y), [F.col("parities")[k] for k in range(i, WORDS, FOLDED)]).alias(f"w{i}") for i in range(FOLDED)]
    left = runtime.materialize(apart(shared, roots).join(marks.select("node", "n", *folded), "node"), "apart")
    sides = [left.select("key", F.col("node").alias(x), *[F.col(c).alias(f"{x}{c}") for c in ("root", "n", *(f"w{i}" for i in range(FOLDED)))]) for x in "ab"]
    met = sides[0].join(sides[1].withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & (F.col("a") < F.col("b")) & (F.col("aroot") != F.col("broot")) & _possible(similarity, FOLDED))
    link(met.select("a", "b").distinct())
    return reduce(DataFrame.unionByName, found), roots


def apart(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, node, size, root) of the entries that hold members of several components of ``roots`` (node, root)."""
    each = Window.partitionBy("key")
    known = shared.join(roots, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"))
    return known.withColumns({"least": F.min("root").over(each), "most": F.max("root").over(each)}).where("least < most").drop("least", "most")


def keep_first(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    bucket: int = BUCKET,
) -> DataFrame:
    """One document of each group of near copies, that of the smallest id, with all its columns."""
    cols = list(docs.columns)
    own = docs.toDF(*[f"c{i}" for i in range(len(cols))])
    at, text = f"c{cols.index(id_col)}", f"c{cols.index(text_col)}"
    n = docs.count()
    p = plan(n, shingle, similarity, recall)
    made = runtime.materialize(sketches(own, p, at, text, frequent(own, n, shingle, text), similarity), "sketches")
    nodes = runtime.materialize(distinct(made), "nodes")
    roots = links(nodes, made, p, similarity, bucket)[1].withColumnRenamed("node", "linked")
    known = nodes.select("node", "print", "first").join(roots, F.col("node") == F.col("linked"), "left").select("print", "first", F.coalesce("root", "node").alias("root"))
    least = known.groupBy("root").agg(F.min(F.struct(F.col("first").isNull(), "first", "print")).alias("keep"))
    kept = least.select("root", F.col("keep.first").alias("keep_id"), F.col("keep.print").alias("keep_print"))
    marked = own.join(kept, own[at].eqNullSafe(kept.keep_id))
    if made.groupBy("id").count().where("count > 1").isEmpty():
        left = marked
    else:  # the fingerprint tells rows of one id apart, the last step equal rows
        again = runtime.map_text(marked, lambda col: [pa.array([_print(shingles(t.as_py(), p.shingle)) for t in col], pa.int64())], [("print", "bigint")], text, (*own.columns, "keep_print", "root"))
        left = again.where("print = keep_print").dropDuplicates(["root"])
    return left.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)])
