"""SimHash near-duplicates by multi-index hashing.

Fingerprints: 64 bits of three-word shingles, hashed with XXH64 (seed 42).
Links: two fingerprints that differ in at most ``DISTANCE`` (2) bits.

Multi-index hashing: a fingerprint is cut into two segments of 32 bits.  If two
fingerprints differ in at most two bits, then their high segments differ in at
most one bit or their low segments are equal, so it is enough to enumerate the
Hamming ball of radius 1 around the high segment and of radius 0 around the low
one, to fetch what the segments' tables hold there, and to verify the distance
of the whole fingerprints.  Of two high segments that differ in one bit one has
a 0 there, so flips of 0 to 1 suffice.

A table entry with more than ``BUCKET`` fingerprints isn't expanded into pairs.
The fingerprints that hold or probe such an entry are linked exactly in another
way: two fingerprints are within two bits if and only if some value is within
one bit of both, so each lists its 65 neighbours and is linked to the smallest
fingerprint that lists the same value, after the same verification.  This makes
at most 65 links a fingerprint however many are alike.

Equal fingerprints are one node; links and components are computed on distinct
fingerprints, in DataFrames, and joined back.

Defined results: null and empty texts have fingerprint zero; a null id never is
the smallest id (a component of only null ids has a null component_id);
repeated rows keep a row each; extra columns are ignored; an empty table stays
empty.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runtime

SHINGLE = 3
DISTANCE = 2
BUCKET = 64
SEED = 42
_ROWS = 1 << 15


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of one text, as a signed integer."""
    from xxhash import xxh64_intdigest as digest

    words = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    n = len(words) - shingle + 1
    if not words:
        return 0
    joined = b" ".join(words)
    if n < 1:
        n, ends, starts = 1, [len(joined)], [0]
    else:
        ends = list(accumulate([len(w) + 1 for w in words]))
        starts = [0, *ends]
        ends = [e - 1 for e in ends[shingle - 1 :]]
    h = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts, ends)], np.uint64, n).view(np.uint8)
    ones = np.zeros(64, np.int64)
    for i in range(0, n * 8, _ROWS * 8):
        ones += np.unpackbits(h[i : i + _ROWS * 8], bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) of every document; no shuffle."""

    def kernel(col: pa.Array) -> list:
        return [pa.array([fingerprint(t.as_py(), shingle) for t in col], pa.int64())]

    return runtime.map_text(docs, kernel, [("fp", "bigint")], text_col, (id_col,))


def _close(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= DISTANCE


def _high(fp: Column) -> Column:
    return F.shiftrightunsigned(fp, 32)


def _tables(nodes: DataFrame) -> DataFrame:
    """(segment, value, fp): the entry of each fingerprint in the table of each segment."""
    return nodes.select("fp", F.inline(F.array(F.struct(F.lit(0).alias("segment"), _high(F.col("fp")).alias("value")), F.struct(F.lit(1).alias("segment"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("value")))))


def _flips(nodes: DataFrame) -> DataFrame:
    """(value, fp): the high segment with one 0 bit set, for each such bit."""
    bits = F.filter(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), k)), lambda m: _high(F.col("fp")).bitwiseAND(m) == 0)
    return nodes.select("fp", F.explode(bits).alias("m")).select("fp", _high(F.col("fp")).bitwiseOR(F.col("m")).alias("value"))


def links(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b), a < b: links that connect all distinct fingerprints ``fp`` of ``nodes`` within ``DISTANCE`` bits.

    All links where table entries are small; else a star per shared neighbour,
    which connects the same fingerprints.
    """
    table, flips = _tables(nodes), _flips(nodes)
    heavy = table.groupBy("segment", "value").agg(F.count("*").alias("n")).where(F.col("n") > bucket)
    heavy = runtime.materialize(heavy.select("segment", "value"), "heavy")
    light = table.join(heavy, ["segment", "value"], "left_anti")
    left, right = light.alias("l"), light.alias("r")
    equal = left.join(right, (F.col("l.segment") == F.col("r.segment")) & (F.col("l.value") == F.col("r.value")) & (F.col("l.fp") < F.col("r.fp")) & _close(F.col("l.fp"), F.col("r.fp"))).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))
    entries = light.where("segment = 0").alias("t")
    flipped = flips.alias("p").join(entries, (F.col("p.value") == F.col("t.value")) & _close(F.col("p.fp"), F.col("t.fp"))).select(F.least("p.fp", "t.fp").alias("a"), F.greatest("p.fp", "t.fp").alias("b"))
    crowded = table.join(heavy, ["segment", "value"], "left_semi").select("fp").unionByName(flips.join(heavy.where("segment = 0"), "value", "left_semi").select("fp")).distinct()
    return equal.unionByName(flipped).unionByName(_stars(crowded)).distinct()


def _stars(nodes: DataFrame) -> DataFrame:
    """Links through shared neighbours: each fingerprint to the smallest that lists the same value."""
    around = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), k)))
    ball = nodes.select("fp", F.explode(around).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("value"))
    least = ball.groupBy("value").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1").select("value", "least")
    return ball.join(least, "value").where((F.col("fp") > F.col("least")) & _close(F.col("fp"), F.col("least"))).select(F.col("least").alias("a"), F.col("fp").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) is connected to.

    Rounds of taking the smallest label around and then the label's label
    (pointer jumping); each round is a written table, so no lineage grows and
    nothing but a count reaches the driver.  Labels only fall, so it ends; a
    chain halves each round.
    """
    both = runtime.materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = runtime.materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).select(F.col("a").alias("node"), "root"), "labels")
    if labels.isEmpty():
        return labels
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        met = labels.join(near, labels.node == near.a, "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("root"))
        jump = labels.select(F.col("node").alias("j"), F.col("root").alias("next"))
        new = met.join(jump, met.root == jump.j, "left").select("node", "old", F.least("root", F.coalesce("next", "root")).alias("root"))
        new = runtime.materialize(new, "labels")
        changed = not new.where("root <> old").isEmpty()
        labels = new.select("node", "root")
        if not changed:
            return labels


def group(prints: DataFrame, id_col: str = "doc_id", bucket: int = BUCKET) -> DataFrame:
    """``prints`` (id, fp) with (root, component_id): the component's smallest fingerprint and id."""
    per = runtime.materialize(prints.groupBy("fp").agg(F.min(id_col).alias("first")), "nodes")
    roots = components(links(per.select("fp"), bucket))
    known = per.join(roots, per.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    # Only components of several fingerprints need their ids brought together.
    least = known.where("root IS NOT NULL").groupBy("root").agg(F.min("first").alias("component_id"))
    named = known.join(least, "root").select("fp", "root", "component_id")
    return prints.join(named, "fp").select(id_col, "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(id, fingerprint, component_id) of every document."""
    prints = runtime.materialize(fingerprints(docs, id_col, text_col), "prints")
    return group(prints, id_col, bucket).select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """One document of each component, that of the smallest id, with all its columns."""
    cols = list(docs.columns)
    own = docs.toDF(*[f"c{i}" for i in range(len(cols))])
    at, text = f"c{cols.index(id_col)}", f"c{cols.index(text_col)}"
    prints = runtime.materialize(fingerprints(own, at, text), "prints")
    kept = group(prints, at, bucket).where(F.col(at).eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("fp").alias("keep_fp"), F.min(at).alias("keep_id"))
    # Several rows of one id may be left (the id is repeated); the fingerprint tells texts apart, the last step equal rows.
    marked = own.join(kept, own[at].eqNullSafe(kept.keep_id))
    if prints.groupBy(at).count().where("count > 1").isEmpty():
        left = marked
    else:
        again = runtime.map_text(marked, lambda col: [pa.array([fingerprint(t.as_py()) for t in col], pa.int64())], [("fp", "bigint")], text, (*own.columns, "keep_fp", "keep_id", "root"))
        left = again.where("fp = keep_fp").dropDuplicates(["keep_id", "root"])
    return left.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)])
