"""Merging clusters, prefetching from past queries, expansion from seeds and source versions, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cluster_similarity(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """(root, similarity): the mean over a cluster's members of each one's best similarity."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"), "similarity")
    best = ends.groupBy("node").agg(F.max("similarity").alias("s"))
    return labels.join(best, "node").groupBy("root").agg(F.avg("s").alias("similarity"))


def merge(nodes: DataFrame, labels: DataFrame, pairs: DataFrame, lineage_safe: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merge each cluster (node, root) of nodes into a summary: (summaries, nodes after, edges).

    A summary's text is its members' texts in order of their ids; its lineage is
    the edges, a row for each member, so no list grows with a cluster.
    """
    member = labels.select(F.col("node").cast("string").alias("id"), F.concat(F.lit("m:"), F.col("root").cast("string")).alias("summary_id"))
    s = cluster_similarity(labels, pairs).select(F.concat(F.lit("m:"), F.col("root").cast("string")).alias("summary_id"), "similarity")
    held = nodes.join(member, "id")
    text = F.array_sort(F.collect_list(F.struct("id", F.trim("content").alias("t"))))
    made = held.groupBy("summary_id").agg(F.count("*").alias("size"), (F.max("importance") * 0.95).alias("importance"), F.concat(F.lit("[SUMMARY] "), F.array_join(F.transform(text, lambda x: x.t), " | ")).alias("content"))
    gone = F.col("summary_id").isNotNull()
    after = nodes.join(member, "id", "left").withColumns({
        "tier": F.when(gone, "archived").otherwise(F.col("tier")),
        "importance": F.when(gone, F.col("importance") * 0.5).otherwise(F.col("importance")),
        "pinned": F.col("pinned") | gone if lineage_safe else F.col("pinned"),
    })
    edges = held.join(s, "summary_id").select(F.col("summary_id").alias("source_id"), F.col("id").alias("target_id"), F.lit("derived_from").alias("relation"), F.col("similarity").alias("weight"))
    return made.join(s, "summary_id"), after, edges


def prefetch(history: DataFrame, now: float, records: int = 5, limit: int = 20, threshold: float = 0.65, half_life: float = 24.0) -> DataFrame:
    """(node_id, score): nodes of the most similar past queries of (query, similarity, ts, node_ids), older ones counting less."""
    near = history.where(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), "query").limit(records)
    fresh = F.pow(F.lit(2.0), -((F.lit(now) - F.col("ts")) / 3600.0) / half_life)
    each = near.select((F.col("similarity") * fresh).alias("s"), F.explode("node_ids").alias("node_id"))
    return each.groupBy("node_id").agg(F.max("s").alias("score")).orderBy(F.desc("score"), "node_id").limit(limit)


def stale_versions(n: DataFrame, source: str, version: str, time: str, id_col: str) -> DataFrame:
    """Ids of rows that aren't of their source's latest version (that of the latest row; of equal ones the largest)."""
    per = n.where(F.col(source).isNotNull()).groupBy(source, version).agg(F.max(time).alias("t"))
    last = per.groupBy(source).agg(F.max_by(version, F.struct("t", version)).alias("_last"))
    return n.join(last, source).where(~F.col(version).eqNullSafe(F.col("_last"))).select(id_col)


def synthesis_similarity(labels: DataFrame, pairs: DataFrame, lower: float) -> DataFrame:
    """(root, size, similarity): the mean over all pairs of a cluster's members, a pair outside the band counting as its lower bound.

    The pairs that the band lacks are counted, not made.
    """
    own = labels.select(F.col("node").alias("a"), "root").join(pairs, "a").groupBy("root").agg(F.count("*").alias("k"), F.sum("similarity").alias("s"))
    sizes = labels.groupBy("root").agg(F.count("*").alias("size"))
    all_ = F.col("size") * (F.col("size") - 1) / 2
    return sizes.join(own, "root").select("root", "size", ((F.col("s") + (all_ - F.col("k")) * lower) / all_).alias("similarity"))


def chosen_clusters(labels: DataFrame, nodes: DataFrame, limit: int = 40) -> DataFrame:
    """(node, root) of the ``limit`` clusters of the largest mean importance."""
    per = labels.join(nodes.select(F.col("id").alias("node"), "importance"), "node").groupBy("root").agg(F.avg("importance").alias("m"))
    return labels.join(per.orderBy(F.desc("m"), "root").limit(limit).select("root"), "root").select("node", "root")


def synthesise(nodes: DataFrame, labels: DataFrame, similarity: DataFrame, old: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Synthesis of clusters: (summaries with action, edges that replace a summary's, nodes after).

    ``similarity`` is (root, similarity); ``old`` (summary_id, key) are summaries
    that exist.  A cluster's key is the md5 of its sorted, comma-joined ids, so
    the same cluster updates the same summary.  Members keep their tier and gain
    0.02 of importance (up to 0.9).
    """
    from .similarity import members

    keys = members(labels)
    held = nodes.join(labels.select(F.col("node").cast("string").alias("id"), "root"), "id")
    top = held.groupBy("root").agg(F.least(F.lit(0.9), F.max("importance") + 0.05).alias("importance"))
    made = keys.join(top, "root").join(similarity.select("root", "similarity"), "root").join(old, "key", "left")
    made = made.select("root", F.coalesce("summary_id", F.concat(F.lit("s:"), "key")).alias("summary_id"), "key", "size", "importance", "similarity", F.when(F.col("summary_id").isNull(), "insert").otherwise("update").alias("action"))
    rank = F.row_number().over(Window.partitionBy("root").orderBy("id"))
    edges = held.select("root", "id", rank.alias("rank")).join(made.select("root", "summary_id", "similarity"), "root")
    edges = edges.select(F.col("summary_id").alias("source_id"), F.col("id").alias("target_id"), F.lit("summarizes").alias("relation"), F.greatest(F.lit(0.5), F.col("similarity") - (F.col("rank") - 1) * 0.02).alias("weight"), "rank")
    gain = nodes.join(held.select("id", F.lit(True).alias("_in")), "id", "left")
    after = gain.withColumn("importance", F.when(F.coalesce("_in", F.lit(False)) & (F.col("importance") < 0.9), F.least(F.lit(0.9), F.col("importance") + 0.02)).otherwise(F.col("importance"))).drop("_in")
    return made.drop("root"), edges, after


def absorb(summaries: DataFrame, others: DataFrame) -> DataFrame:
    """Summaries (id, content, embedding) after absorbing ``others`` (summary_id, id, content, embedding, similarity) in order of their ids.

    The embedding is the unit mean of the summary's and each other's in turn; a
    text that the summary holds already isn't added.  Both depend on the order,
    so what one summary absorbs is folded in one task; a cycle absorbs a batch of
    rows, which bounds it.
    """
    import pandas as pd

    kind = summaries.schema
    taken = others.join(summaries.select(F.col("id").alias("summary_id")), "summary_id", "left_semi")

    def fold(key, one: "pd.DataFrame", more: "pd.DataFrame") -> "pd.DataFrame":
        import numpy as np

        if not len(one):
            return one
        text, e = one["content"].iloc[0], np.asarray(one["embedding"].iloc[0], np.float64)
        for content, vector in more.sort_values("id")[["content", "embedding"]].itertuples(index=False):
            e = (e + np.asarray(vector, np.float64)) / 2
            norm = np.linalg.norm(e)
            e = e / norm if norm > 0 else e
            part = content.strip()
            if part not in text:
                text = f"{text.rstrip()} | {part}"
        out = one.copy()
        out["content"], out["embedding"] = [text], [e.tolist()]
        return out

    return summaries.groupBy("id").cogroup(taken.groupBy("summary_id")).applyInPandas(fold, kind)


def cycle(nodes: DataFrame, vectors: DataFrame, now: float, merge_at: float = 0.88, lower: float = 0.55) -> dict[str, DataFrame]:
    """One consolidation cycle: merge, synthesise, exact duplicates, prune, working set; written tables between the steps.

    Returns the nodes after it, the new summaries and edges, the deleted ids
    (with the step that deleted them) and the working set.
    """
    from ..functions import scores
    from ..sources.storage import materialize
    from . import memory as M
    from . import similarity as S

    free = vectors.join(nodes.where("NOT pinned").select(F.col("id").cast(vectors.schema["id"].dataType).alias("id")), "id", "left_semi")
    near = materialize(S.pairs(free, merge_at), "near")
    made, after, edges = merge(nodes, S.clusters(near), near)
    after = materialize(after, "merged")
    band = materialize(S.pairs(vectors, lower, merge_at), "band")
    labels = S.clusters(band)
    sums, links, after = synthesise(after, labels, synthesis_similarity(labels, band, lower), after.sparkSession.createDataFrame([], "summary_id string, key string"))
    after = materialize(after, "synthesised")
    twice = materialize(M.exact_duplicates(after), "twice")
    after = after.join(twice, "id", "left_anti")
    old = (F.col("tier") == "archived") & ~F.col("pinned") & (scores.decay(F.col("importance"), F.col("created_at"), F.lit(now)) < 0.05)
    dead = materialize(after.where(old).select("id"), "dead")
    after = materialize(after.where(~old), "after")
    gone = twice.withColumn("step", F.lit("duplicate")).unionByName(dead.withColumn("step", F.lit("prune")))
    summaries = made.select("summary_id", "size", "importance", "similarity").withColumn("kind", F.lit("merge")).unionByName(sums.select("summary_id", "size", "importance", "similarity").withColumn("kind", F.lit("synthesis")))
    return {"nodes": after, "summaries": summaries, "edges": edges.select("source_id", "target_id", "relation", "weight").unionByName(links.select("source_id", "target_id", "relation", "weight")), "deleted": gone, "working": after.where("tier = 'working'").select("id")}
