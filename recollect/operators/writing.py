"""The write path as functions from tables to tables, and reports on what it does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, text
from ..sources.tables import TIERS

#: Columns that a stored node gets where the caller gives none.
DEFAULTS = {"node_type": "fact", "tier": "episodic", "importance": 0.5, "decay_score": 1.0, "access_count": 0, "pinned": False}


def store(new: DataFrame, as_of: float) -> DataFrame:
    """New nodes with defaults filled in, numbers within [0, 1] checked, and an id from the content where there is none."""
    cols = set(new.columns)
    out = new
    for name, value in DEFAULTS.items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in cols else F.lit(value))
    for name in ("created_at", "last_accessed"):
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(as_of)) if name in cols else F.lit(as_of))
    made = F.sha2(F.concat_ws("\x1f", "node_type", F.coalesce("content", F.lit(""))), 256)
    out = out.withColumn("id", F.coalesce(F.col("id").cast("string"), made) if "id" in cols else made)
    bad = ~F.col("importance").between(0, 1) | ~F.col("tier").isin(*TIERS)
    return out.withColumn("id", F.when(bad, F.raise_error(F.concat(F.lit("importance or tier out of bounds: "), F.col("id")))).otherwise(F.col("id")))


def upsert_edges(old: DataFrame, new: DataFrame, n: DataFrame | None = None, order: str = "created_at") -> DataFrame:
    """Edges after ``new`` ones replace those of their ids; weight and confidence are clamped.

    With nodes given, edges without both ends are dropped.  Of repeated new ids
    the one of the largest ``order`` stays, of equal ones the largest row.
    """
    for c in ("weight", "confidence"):
        new = new.withColumn(c, scores.clamp(F.coalesce(F.col(c), F.lit(1.0))))
    if n is not None:
        ids = n.select("id")
        new = new.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    cols = old.columns
    last = new.groupBy("id").agg(F.max(F.struct(order, F.struct(*[c for c in cols if c != "id"]).alias("r"))).alias("m"))
    kept = last.select(*["id" if c == "id" else F.col(f"m.r.{c}").alias(c) for c in cols])
    return old.join(kept.select("id"), "id", "left_anti").select(*cols).unionByName(kept)


def replace_source(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes after all rows of the sources in ``new`` are replaced by its rows."""
    return old.join(new.select("source").where("source IS NOT NULL").distinct(), "source", "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def upsert_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(…, action): each row of ``new`` (key, content), once per key, as an update of the node of that key or an insert.

    Of several nodes of one key the smallest id is taken; of repeated new keys
    the largest content.
    """
    have = old.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias("id"))
    once = new.where(F.col(key).isNotNull()).groupBy(key).agg(F.max("content").alias("content"))
    return once.join(have, key, "left").select(key, F.coalesce("id", F.sha2(F.col(key), 256)).alias("id"), "content", F.when(F.col("id").isNull(), "insert").otherwise("update").alias("action"))


def touch(n: DataFrame, log: DataFrame) -> DataFrame:
    """Nodes after the accesses of ``log`` (id, ts): count and last access rise, the decay score recovers at each.

    One access makes d into min(1, 1.2 d + 0.1); k of them have a closed form.
    """
    seen = log.groupBy("id").agg(F.count("*").alias("_k"), F.max("ts").alias("_t")).withColumnRenamed("id", "_id")
    k = F.coalesce("_k", F.lit(0))
    grown = F.pow(F.lit(1.2), k) * (F.col("decay_score") + 0.5) - 0.5
    j = n.join(seen, n.id == F.col("_id"), "left")
    return j.withColumns({
        "access_count": F.col("access_count") + k,
        "last_accessed": F.greatest("last_accessed", "_t"),
        "decay_score": F.when(k > 0, F.least(F.lit(1.0), grown)).otherwise(F.col("decay_score")),
    }).drop("_id", "_k", "_t")


def drop_collection(n: DataFrame, edges: DataFrame, clusters: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, clusters without the collection, counts (kind, deleted))."""
    own = F.col("collection") == name
    parts = {"edges": edges, "nodes": n, "clusters": clusters}
    counts = [d.agg(F.count_if(own).alias("deleted")).select(F.lit(k).alias("kind"), "deleted") for k, d in parts.items()]
    keep = lambda d: d.where(~F.coalesce(own, F.lit(False)))
    return keep(n), keep(edges), keep(clusters), counts[0].unionByName(counts[1]).unionByName(counts[2])


def change_members(clusters: DataFrame, changes: DataFrame, as_of: float) -> DataFrame:
    """Clusters (id, node_ids, updated_at) after ``changes`` (id, node_id, action add or remove): absent ones added, others removed."""
    per = changes.groupBy(F.col("id").alias("_id")).agg(*[F.array_sort(F.collect_set(F.when(F.col("action") == a, F.col("node_id")))).alias(a) for a in ("add", "remove")])
    j = clusters.join(per, clusters.id == F.col("_id"), "left")
    none = F.array().cast("array<string>")
    ids = F.array_except(F.array_union("node_ids", F.coalesce("add", none)), F.coalesce("remove", none))
    return j.withColumns({"node_ids": ids, "updated_at": F.when(F.col("_id").isNotNull(), as_of).otherwise(F.col("updated_at"))}).withColumn("size", F.size("node_ids")).drop("_id", "add", "remove")


def working_cluster(n: DataFrame, clusters: DataFrame) -> DataFrame:
    """Memberships (cluster, node_id) after the working-memory cluster is rebuilt from the working tier; rows, so no list grows."""
    others = clusters.where("cluster <> 'working_memory'").select("cluster", "node_id")
    return others.unionByName(n.where("tier = 'working'").select(F.lit("working_memory").alias("cluster"), F.col("id").alias("node_id")))


def index_rows(n: DataFrame, hot_only: bool = False) -> DataFrame:
    """(id, embedding, content): what vector search reads; ``hot_only`` keeps the working tier."""
    rows = n.where("embedding IS NOT NULL")
    return (rows.where("tier = 'working'") if hot_only else rows).select("id", "embedding", "content")


def dedupe_report(n: DataFrame, source: str = "source", version: str = "document_hash", time: str = "ingested_at") -> tuple[DataFrame, DataFrame]:
    """(ids that go, report): rows of stale source versions first, then equal contents among the others.

    Of a source the version of the latest row stays; of equal contents the most
    important, then the oldest row.
    """
    versioned = n.where((F.coalesce(F.col(source), F.lit("")) != "") & (F.coalesce(F.col(version), F.lit("")) != ""))
    per = versioned.groupBy(source, version).agg(F.max(F.coalesce(F.col(time), F.lit(0.0))).alias("t"))
    last = per.groupBy(source).agg(F.max_by(version, F.struct("t", version)).alias("_last"))
    stale = versioned.join(last, source).where(F.col(version) != F.col("_last")).select("id")
    rest = n.join(stale, "id", "left_anti")
    own = F.coalesce(F.when(F.col("content_hash") != "", F.col("content_hash")), text.content_hash(F.coalesce("content", F.lit("")))) if "content_hash" in n.columns else text.content_hash(F.coalesce("content", F.lit("")))
    best = rest.groupBy(own.alias("h")).agg(F.min(F.struct((-F.col("importance")).alias("i"), "created_at", "id")).alias("m"))
    same = rest.select("id").join(best.select(F.col("m.id").alias("id")), "id", "left_anti")
    gone = stale.withColumn("cause", F.lit("source_version")).unionByName(same.withColumn("cause", F.lit("content_hash")))
    counts = gone.agg(F.count_if(F.col("cause") == "source_version").alias("source_version_dupes"), F.count_if(F.col("cause") == "content_hash").alias("content_hash_dupes"))
    report = n.agg(F.count("*").alias("scanned")).join(counts).withColumn("total_duplicates", F.col("source_version_dupes") + F.col("content_hash_dupes"))
    return gone, report.withColumn("remaining", F.col("scanned") - F.col("total_duplicates"))


def compact(df: DataFrame, path: str, bytes_per_row: int = 1000, file_bytes: int = 256 << 20) -> DataFrame:
    """Rewrite a table into files of about ``file_bytes`` and read it again; a rebalance, so a hot key is split."""
    parts = max(1, df.count() * bytes_per_row // file_bytes)
    df.hint("rebalance").write.mode("overwrite").parquet(path) if parts > 1 else df.coalesce(1).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def newest_traces(traces: DataFrame, collection: str | None = None, event_type: str | None = None, limit: int = 100) -> DataFrame:
    """The latest traces of a collection and an event type."""
    for c, value in (("collection", collection), ("event_type", event_type)):
        if value is not None:
            traces = traces.where(F.col(c) == value)
    return traces.orderBy(F.desc("timestamp"), F.desc("trace_id")).limit(limit)


def last_per_key(rows: DataFrame, key: str, order: list[Column], keep: int) -> DataFrame:
    """The last ``keep`` rows of each key; the rank limit drops rows before the shuffle."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_rn") <= keep).drop("_rn")


def status(traces: DataFrame) -> DataFrame:
    """(collection, events, last, last_event): counts and the latest event of each collection."""
    return traces.groupBy("collection").agg(F.count("*").alias("events"), F.max("timestamp").alias("last"), F.max_by("event_type", F.struct("timestamp", "trace_id")).alias("last_event"))
