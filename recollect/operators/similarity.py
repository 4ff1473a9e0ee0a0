"""Similarity joins and what is built on them: pairs, bands, nearest rows, clusters, centroids."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scores, vectors
from ..sources.storage import materialize


#: Rows of one block of vectors, at most, and rows that are multiplied at once.
BLOCK_ROWS, TILE_ROWS = 1 << 15, 1024


def pairs(v: DataFrame, lower: float, upper: float | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, similarity), a < b, of rows with lower <= similarity (< upper).

    Exact: rows are dealt into blocks by a hash of the id, at least as many as
    keep all cores busy and at most ``block_rows`` rows each; every pair of
    blocks is one row of an Arrow stage, multiplied in tiles.  Blocks travel as
    32-bit floats (sums are of 64 bits), so n rows of d numbers shuffle
    4 d n^2 / (2 block_rows) bytes.  Vectors that are null, hold nulls or differ
    in length make no pair.
    """
    kind = v.schema["id"].dataType
    usable = v.select("id", "embedding").where("embedding IS NOT NULL AND id IS NOT NULL AND NOT exists(embedding, x -> x IS NULL)")
    n, cores = usable.count(), v.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n // block_rows), min(-(-n // TILE_ROWS), math.isqrt(2 * cores)))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    number = "float" if v.schema["embedding"].dataType.elementType.typeName() == "float" else "double"
    packed = usable.groupBy(F.size("embedding").alias("dim"), block.alias("x")).agg(F.collect_list(F.struct("id", F.col("embedding").cast(f"array<{number}>").alias("e"))).alias("rows"))
    packed = packed.select("dim", "x", F.transform("rows", lambda r: r.id).alias("ids"), F.flatten(F.transform("rows", lambda r: r.e)).alias("m"))
    left = packed.withColumn("y", F.explode(F.sequence(F.col("x"), F.lit(blocks - 1))))
    right = packed.select("dim", F.col("x").alias("y"), F.col("ids").alias("ids2"), F.col("m").alias("m2"))
    met = left.join(right, ["dim", "y"]).select("dim", (F.col("x") == F.col("y")).alias("same"), "ids", "m", "ids2", "m2")
    schema = T.StructType().add("a", kind).add("b", kind).add("similarity", "double")

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim, same = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                ids, ids2 = batch.column(2)[i].values, batch.column(4)[i].values
                one, two = (batch.column(c)[i].values.to_numpy(zero_copy_only=False).reshape(-1, dim) for c in (3, 5))
                for r in range(0, len(one), TILE_ROWS):
                    tile = one[r : r + TILE_ROWS].astype(np.float64)
                    for q in range(r if same else 0, len(two), TILE_ROWS):
                        s = np.clip(tile @ two[q : q + TILE_ROWS].astype(np.float64).T, -1.0, 1.0)
                        hit = s >= lower if upper is None else (s >= lower) & (s < upper)
                        at, to = np.nonzero(np.triu(hit, 1) if same and r == q else hit)
                        for k in range(0, len(at), 1 << 16):
                            x, y = at[k : k + (1 << 16)], to[k : k + (1 << 16)]
                            a, b = ids.take(pa.array(x + r)), ids2.take(pa.array(y + q))
                            first = pc.less(a, b)
                            made = [pc.if_else(first, a, b), pc.if_else(first, b, a), pa.array(s[x, y])]
                            yield pa.RecordBatch.from_arrays(made, names=["a", "b", "similarity"]).filter(pc.not_equal(a, b))

    return met.mapInArrow(stage, schema)


def _usable(v: DataFrame) -> DataFrame:
    return v.where("embedding IS NOT NULL AND id IS NOT NULL AND NOT exists(embedding, x -> x IS NULL)")


def _dealt(n: int, v: DataFrame, block_rows: int | None) -> int:
    """Blocks of one side: enough that pairs of blocks keep all cores busy, each of at most ``block_rows`` rows."""
    cores = v.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-n // (block_rows or BLOCK_ROWS)), min(-(-n // TILE_ROWS), math.isqrt(8 * cores)))


def _packed(usable: DataFrame, blocks: int, *more: str) -> DataFrame:
    """(dim, x, ids, m) of each block x of vectors of ``dim`` numbers: ids, and the numbers one after another; ``more`` columns as lists."""
    number = "float" if usable.schema["embedding"].dataType.elementType.typeName() == "float" else "double"
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    packed = usable.groupBy(F.size("embedding").alias("dim"), block.alias("x")).agg(F.collect_list(F.struct("id", F.col("embedding").cast(f"array<{number}>").alias("e"), *more)).alias("rows"))
    return packed.select("dim", "x", F.transform("rows", lambda r: r.id).alias("ids"), F.flatten(F.transform("rows", lambda r: r.e)).alias("m"), *[F.col(f"rows.{c}").alias(f"{c}s") for c in more])


def _products(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """All dot products, and by how much they may differ from ``_dots``, which depends on no neighbour."""
    return x @ y.T, 1e-12 * (1.0 + float(np.sqrt((x * x).sum(axis=1).max() * (y * y).sum(axis=1).max())))


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products row by row, summed in order as the SQL does."""
    total = np.zeros(len(x))
    for k in range(x.shape[1]):
        total += x[:, k] * y[:, k]
    return total


def distribution(v: DataFrame, quantiles: tuple[float, ...], threshold: float, bins: int = 1 << 12) -> DataFrame:
    """One row (lo, hi, mean, p50 and so on, n) over the similarities of all pairs, n of them at or above the threshold.

    Exact, without bringing all pairs together: a histogram of partial counts
    finds the bin of each wanted rank, and a second pass counts the values of
    those bins alone.
    """
    s = F.col("similarity")
    p = pairs(v, -1.0)
    bin_ = F.floor((s + 1.0) * (bins / 2)).cast("int")
    seen = p.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.sum(s).alias("total"), F.min(s).alias("lo"), F.max(s).alias("hi"), F.count_if(s >= threshold).alias("above"))
    rows = sorted(seen.collect())  # at most bins + 1
    count, spark = sum(r.n for r in rows), v.sparkSession
    names = [f"p{round(q * 100)}" for q in quantiles]
    if not count:
        return spark.createDataFrame([(None,) * (3 + len(names)) + (0,)], ", ".join(f"{c} double" for c in ("lo", "hi", "mean", *names)) + ", n bigint")
    wanted = {k for q in quantiles for k in (math.floor(q * (count - 1)), math.ceil(q * (count - 1)))}
    first, at, own = 0, {}, set()
    for r in rows:
        inside = [k for k in wanted if first <= k < first + r.n]
        at |= dict.fromkeys(inside, (r.bin, first))
        own |= {r.bin} if inside else set()
        first += r.n
    picked = p.where(bin_.isin(sorted(own))).groupBy(bin_.alias("bin"), s.alias("s")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("bin").orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = picked.withColumn("upto", upto)
    conditions = [F.when((F.col("bin") == b) & (F.col("upto") > k - f) & (F.col("upto") - F.col("n") <= k - f), F.col("s")) for k, (b, f) in sorted(at.items())]
    got = ranked.agg(*[F.max(c).alias(f"k{i}") for i, c in enumerate(conditions)]).first()
    value = dict(zip(sorted(at), got))
    points = [value[math.floor(q * (count - 1))] + (value[math.ceil(q * (count - 1))] - value[math.floor(q * (count - 1))]) * (q * (count - 1) % 1) for q in quantiles]
    row = [min(r.lo for r in rows), max(r.hi for r in rows), math.fsum(r.total for r in rows) / count, *points]
    return spark.createDataFrame([(*[round(float(x), 6) for x in row], sum(r.above for r in rows))], ", ".join(f"{c} double" for c in ("lo", "hi", "mean", *names)) + ", n bigint")


def weave(v: DataFrame, known: DataFrame, lower: float, upper: float, limit: int) -> DataFrame:
    """The strongest pairs of a band without an edge in ``known`` (source_id, target_id), with a confidence."""
    linked = known.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct()
    return pairs(v, lower, upper).join(linked, ["a", "b"], "left_anti").orderBy(F.desc("similarity"), "a", "b").limit(limit).withColumn("confidence", scores.relation_confidence(F.col("similarity")))


def weave_apart(v: DataFrame, key: str, lower: float, upper: float, limit: int, block_rows: int | None = None) -> DataFrame:
    """``weave`` where all rows of equal ``key`` are known to each other (a null one makes no pair).

    Neither the known pairs nor those of the band are listed: each pair of
    blocks leaves its ``limit`` strongest pairs.
    """
    kind = v.schema["id"].dataType
    usable = _usable(v.select("id", "embedding", F.col(key).alias("key"))).where("key IS NOT NULL")
    blocks = _dealt(usable.count(), usable, block_rows)
    packed = _packed(usable, blocks, "key")
    left = packed.withColumn("y", F.explode(F.sequence(F.col("x"), F.lit(blocks - 1))))
    right = packed.select("dim", F.col("x").alias("y"), F.col("ids").alias("ids2"), F.col("m").alias("m2"), F.col("keys").alias("keys2"))
    met = left.join(right, ["dim", "y"]).select("dim", (F.col("x") == F.col("y")).alias("same"), "ids", "m", "keys", "ids2", "m2", "keys2").repartition(blocks * (blocks + 1) // 2)
    schema = T.StructType().add("a", kind).add("b", kind).add("similarity", "double")

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim, same = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                ids, ids2 = batch.column(2)[i].values, batch.column(5)[i].values
                x, y = (batch.column(c)[i].values.to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64) for c in (3, 6))
                codes = pa.concat_arrays([batch.column(4)[i].values, batch.column(7)[i].values]).dictionary_encode().indices.to_numpy()
                own, other = codes[: len(x)], codes[len(x) :]
                best: pa.Table | None = None
                for r in range(0, len(x), TILE_ROWS):
                    for q in range(r if same else 0, len(y), TILE_ROWS):
                        s, slack = _products(x[r : r + TILE_ROWS], y[q : q + TILE_ROWS])
                        least = best["similarity"][-1].as_py() if best is not None and len(best) == limit else lower
                        at, to = np.nonzero(s >= max(lower, least) - slack)
                        fit = (own[at + r] != other[to + q]) & (s[at, to] < upper + slack) & ((at < to) if same and r == q else True)
                        at, to = at[fit] + r, to[fit] + q
                        for k in range(0, len(at), 1 << 18):
                            d, e = at[k : k + (1 << 18)], to[k : k + (1 << 18)]
                            exact = _dots(x[d], y[e])
                            a, b = ids.take(pa.array(d)), ids2.take(pa.array(e))
                            first = pc.less(a, b)
                            made = pa.table([pc.if_else(first, a, b), pc.if_else(first, b, a), pa.array(exact)], names=["a", "b", "similarity"])
                            made = made.filter(pc.and_(pc.not_equal(a, b), pa.array((exact >= lower) & (exact < upper))))
                            both = made if best is None else pa.concat_tables([best, made])
                            best = both.take(pc.sort_indices(both, sort_keys=[("similarity", "descending"), ("a", "ascending"), ("b", "ascending")])[:limit]).combine_chunks()
                if best is not None:
                    yield from best.to_batches()

    return met.mapInArrow(stage, schema).orderBy(F.desc("similarity"), "a", "b").limit(limit).withColumn("confidence", scores.relation_confidence(F.col("similarity")))


def top_k(v: DataFrame, query, k: int, threshold: float = -1.0) -> DataFrame:
    """The k most similar rows, then those at or above the threshold."""
    return v.select("id", vectors.dot(F.col("embedding"), vectors.literal(query)).alias("score")).orderBy(F.desc("score"), "id").limit(k).where(F.col("score") >= threshold)


def _shares(rows: DataFrame, most: int = 1 << 15) -> int:
    """In how many blocks a side is dealt: for all cores, and no more than ``most`` rows each."""
    return max(math.isqrt(rows.sparkSession.sparkContext.defaultParallelism) + 1, -(-rows.count() // most))


def top_k_each(v: DataFrame, queries: DataFrame, k: int, blocks: int | None = None) -> DataFrame:
    """(query, id, rank, score): the k most similar rows of each query of (query, query_vector).

    Rows and queries meet in a grid of blocks, as many as the queries fill; each
    task keeps its own k best of a query before the shuffle by query.
    """
    blocks = blocks or _shares(queries)
    left = v.select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("x")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.select("query", "query_vector", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    s = left.join(right, ["x", "y"]).select("query", "id", vectors.dot(F.col("embedding"), F.col("query_vector")).alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def approximate_top_k(v: DataFrame, queries: DataFrame, k: int, tables: int = 56, bits: int = 6, seed: int = 11) -> DataFrame:
    """``top_k_each`` among the rows that share a bucket with the query: ``tables`` signatures of ``bits`` random signs.

    Only ids and vectors of common buckets meet.  A table's bucket of a query
    may be crowded, so buckets are dealt by a salt of the row.  The tests measure
    the recall (0.9 or more on test vectors, whose nearest are at a similarity of
    only 0.3 to 0.5; neighbours at 0.7 are found with 12 tables).
    """
    first = v.select(F.size("embedding")).where("embedding IS NOT NULL").first()
    planes = np.random.default_rng(seed).normal(size=(tables, bits, first[0] if first else 1))

    def signed(df: DataFrame, id_col: str, vec: str) -> DataFrame:
        kind = df.schema[id_col].dataType.simpleString()

        def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
                    codes = ((np.einsum("nd,tbd->ntb", x, planes) > 0) * (1 << np.arange(bits))).sum(axis=2)
                    n = len(x)
                    rows = pa.array(np.repeat(np.arange(n), tables))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.tile(np.arange(tables), n)), pa.array(codes.ravel())], names=["i", "v", "t", "c"])

        return df.select(F.col(id_col).alias("i"), F.col(vec).cast("array<double>").alias("v")).where("v IS NOT NULL").mapInArrow(stage, f"i {kind}, v array<double>, t bigint, c bigint")

    salts = 8
    rows = signed(v, "id", "embedding").withColumnsRenamed({"i": "id", "v": "embedding"}).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    asked = signed(queries, "query", "query_vector").withColumnsRenamed({"i": "query", "v": "query_vector"}).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    s = rows.join(asked, ["t", "c", "salt"]).select("query", "id", vectors.dot(F.col("embedding"), F.col("query_vector")).alias("score"))
    best = s.groupBy("query", "id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def nearest(rows: DataFrame, centres: DataFrame, threshold: float, block_rows: int | None = None) -> DataFrame:
    """Each row's best centre of (centre, centre_vector) at or above the threshold; of equal ones the smallest.

    Both sides are dealt into blocks of at most ``block_rows`` rows; every block
    of rows meets every block of centres as one row of an Arrow stage, so neither
    side is broadcast, and leaves one row an id.  Vectors that are null, hold
    nulls or differ in length don't meet.
    """
    kind, centre_kind = rows.schema["id"].dataType, centres.schema["centre"].dataType
    left, right = _usable(rows.select("id", "embedding")), _usable(centres.select(F.col("centre").alias("id"), F.col("centre_vector").alias("embedding")))
    across, down = _dealt(left.count(), left, block_rows), _dealt(right.count(), right, block_rows)
    one = _packed(left, across).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    two = _packed(right, down).select("dim", F.col("x").alias("y"), F.col("ids").alias("ids2"), F.col("m").alias("m2"))
    met = one.join(two, ["dim", "y"]).select("dim", "ids", "m", "ids2", "m2").repartition(across * down)
    schema = T.StructType().add("id", kind).add("centre", centre_kind).add("s", "double")

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column(0)[i].as_py()
                ids, ids2 = batch.column(1)[i].values, batch.column(3)[i].values
                x, y = (batch.column(c)[i].values.to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64) for c in (2, 4))
                order = pc.sort_indices(ids2).to_numpy()
                ids2, y = ids2.take(pa.array(order)), y[order]
                best, to = np.full(len(x), -np.inf), np.zeros(len(x), np.int64)
                for r in range(0, len(x), TILE_ROWS):
                    for q in range(0, len(y), TILE_ROWS):
                        s, slack = _products(x[r : r + TILE_ROWS], y[q : q + TILE_ROWS])
                        at, near = np.nonzero(s >= np.maximum(s.max(axis=1), best[r : r + TILE_ROWS])[:, None] - slack)
                        exact = _dots(x[at + r], y[near + q])
                        first = np.lexsort((near, -exact, at))
                        first = first[np.unique(at[first], return_index=True)[1]]
                        first = first[exact[first] > best[at[first] + r]]  # of equal ones an earlier tile has the smaller centre
                        best[at[first] + r], to[at[first] + r] = exact[first], near[first] + q
                yield pa.RecordBatch.from_arrays([ids, ids2.take(pa.array(to)), pa.array(best)], names=["id", "centre", "s"])

    best = met.mapInArrow(stage, schema).groupBy("id").agg(F.min_by(F.struct("centre", "s"), F.struct(-F.col("s"), "centre")).alias("m"))
    return best.select("id", F.col("m.centre").alias("centre"), F.col("m.s").alias("similarity")).where(F.col("similarity") >= threshold)


def centroids(v: DataFrame, key: str) -> DataFrame:
    """(key, centroid): mean vectors, scaled to length one."""
    means = v.select(key, F.posexplode("embedding").alias("pos", "x")).groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    listed = means.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("c"))
    return listed.select(key, vectors.unit(F.transform("c", lambda p: p.x)).alias("centroid"))


def clusters(edges: DataFrame) -> DataFrame:
    """(node, root) of the components of (a, b): the smallest node that each is connected to.

    Each round takes the smallest label around and then that label's own label,
    so chains halve; labels only fall, so it ends.  Edges and labels are written
    tables: no round computes the pairs anew, and a lost executor costs its
    running tasks.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        met = labels.join(near, "a").select("a", F.col("root").alias("old"), F.least("root", "near").alias("met"))
        jump = labels.select(F.col("a").alias("met"), F.col("root").alias("next"))
        new = materialize(met.join(jump, "met", "left").select("a", "old", F.least("met", F.coalesce("next", "met")).alias("root")), "labels")
        labels = new.select("a", "root")
        if new.where("root < old").isEmpty():
            return labels.withColumnRenamed("a", "node")


def ranked_weight(base: float, step: float, floor: float, rank: Column) -> Column:
    """floor or base less a step for each rank (from 0)."""
    return F.greatest(F.lit(floor), F.lit(base) - step * rank)


def members(labels: DataFrame) -> DataFrame:
    """(root, size, key): component sizes and the md5 of the sorted, comma-joined ids."""
    return labels.groupBy("root").agg(F.count("*").alias("size"), F.md5(F.concat_ws(",", F.array_sort(F.collect_set(F.col("node").cast("string")))).cast("binary")).alias("key"))


def stratified(n: DataFrame, cycle: int, batch: int) -> DataFrame:
    """A rotating sample: a window of each tier by creation, the most important rows of all."""
    per = max(4, batch // 3)
    start = (cycle * per) % (per * 10)
    w = Window.partitionBy("tier").orderBy("created_at", "id")
    at = scores.by_tier(F.col("tier"), {"working": 0, "semantic": start + per, "episodic": start + 2 * per}, None)
    # A fixed last rank lets every partition drop its later rows before the shuffle.
    rn = n.where(F.col("tier").isin("working", "semantic", "episodic")).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= start + 3 * per)
    return rn.where((F.col("rn") > at) & (F.col("rn") <= at + per)).orderBy(F.desc("importance"), "created_at", "id").limit(batch)
