"""The memory model over stored tables: nodes, edges and logs, and how they are changed.

Changes are functions from tables to tables (union, anti-join, keep-latest), so
they run as one shuffle each on the key and need no row-level store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIERS = ("working", "episodic", "semantic", "procedural", "archived")
TYPES = ("fact", "concept", "summary")
EPOCH = 1704067200
AS_OF = 1706659200.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str, rated: bool = True) -> DataFrame:
    """Documents as memory nodes; with ``rated`` their importance comes from the labels, else there is no such column and no join."""
    d = table(spark, sf_dir, "documents")
    if rated:
        d = d.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    pick = lambda names, key: F.element_at(F.array(*map(F.lit, names)), (key % len(names) + 1).cast("int"))
    importance = [F.when(F.col("quality") == 1, 0.9).when(F.col("quality") == 0, 0.3).otherwise(0.5).alias("importance")] if rated else []
    return d.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("text").alias("content"),
        "source",
        F.array("lang", "source").alias("tags"),
        *importance,
        (F.col("doc_id") % 17 == 0).alias("pinned"),
        pick(TIERS, F.col("doc_id")).alias("tier"),
        pick(TYPES, F.col("doc_id")).alias("node_type"),
        (F.lit(EPOCH) + F.col("doc_id")).cast("double").alias("created_at"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("label"))


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part_of edges from orders up to regions."""
    edge = lambda t, a, ca, b, cb: table(spark, sf_dir, t).select(F.concat(F.lit(a), F.col(ca).cast("string")).alias("source_id"), F.concat(F.lit(b), F.col(cb).cast("string")).alias("target_id"))
    return edge("nation", "n:", "n_nationkey", "r:", "n_regionkey").unionByName(edge("customer", "c:", "c_custkey", "n:", "c_nationkey")).unionByName(edge("orders", "o:", "o_orderkey", "c:", "o_custkey"))


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, ts): events as accesses, with epoch seconds."""
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("node_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).withColumn("ts", F.col("us") / 1e6).drop("us")


def scan(n: DataFrame, tier: str | list[str] | None = None, node_type: str | list[str] | None = None, limit: int = 1000, offset: int = 0) -> DataFrame:
    """A page of nodes by one or several tiers and types, in order of creation and id."""
    for name, allowed in (("tier", tier), ("node_type", node_type)):
        if allowed:
            n = n.where(F.col(name).isin([allowed] if isinstance(allowed, str) else list(allowed)))
    return n.orderBy("created_at", "id").offset(offset).limit(limit)


def get(n: DataFrame, ids: list[str]) -> DataFrame:
    """Rows of the asked ids, once each, in the order of the request (``pos``).

    The request is a list that the caller holds, so it goes into the filter,
    which the scan can use, and is small enough to broadcast.
    """
    asked = n.sparkSession.createDataFrame(list(enumerate(dict.fromkeys(ids))), "pos int, id string")
    return n.where(F.col("id").isin(list(dict.fromkeys(ids)))).join(F.broadcast(asked), "id").orderBy("pos")


def upsert(old: DataFrame, new: DataFrame, key: str = "id", order: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key; columns of ``keep`` stay as they were.

    Of repeated new keys the row of the largest ``order`` stays, of equal ones
    the largest row; an aggregate decides, so the result is the same each time.
    """
    rest = [c for c in old.columns if c != key]
    pick = F.max(F.struct(*([F.col(order).alias("_order")] if order else []), F.struct(*rest).alias("r")))
    once = new.groupBy(key).agg(pick.alias("_m")).select(key, *[F.col(f"_m.r.{c}").alias(c) for c in rest])
    if keep:
        have = old.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in keep])
        once = once.join(have, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in keep}).drop(*[f"_{c}" for c in keep])
    return old.join(once.select(key), key, "left_anti").select(*old.columns).unionByName(once.select(*old.columns))


def delete(n: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the ids of ``gone`` and the edges at them."""
    kept = n.join(gone, "id", "left_anti")
    left = edges.join(gone, edges.source_id == gone.id, "left_anti")
    return kept, left.join(gone, left.target_id == gone.id, "left_anti")


def incident(edges: DataFrame, node: str, direction: str = "both") -> DataFrame:
    """Edges at a node; a loop counts once."""
    out, into = F.col("source_id") == node, F.col("target_id") == node
    return edges.where({"out": out, "in": into, "both": out | into}[direction])


def export(page: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct edges that touch a page of nodes."""
    ids = page.select("id")
    return edges.join(ids, edges.source_id == ids.id, "left_semi").unionByName(edges.join(ids, edges.target_id == ids.id, "left_semi")).distinct()
