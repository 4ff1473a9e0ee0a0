"""Search, expansion, deduplication, statistics and lifecycle over nodes, edges and logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import phrases, scores, text
from ..sources.storage import materialize


def source_filter(n: DataFrame, names: list[str]) -> DataFrame:
    """Rows whose source holds one of the names (or, with a leading minus on each, none of them)."""
    deny = [x[1:] for x in names if x.startswith("-")]
    if deny and len(deny) < len(names):
        raise ValueError("allowed and denied sources can't be mixed")
    hit = F.lit(False)
    for x in deny or names:
        hit = hit | F.coalesce(F.lower("source").contains(x.lower()), F.lit(False))
    return n.where(~hit if deny else hit) if names else n


def tag_filter(n: DataFrame, tags: list[str]) -> DataFrame:
    return n.where(F.arrays_overlap(F.transform("tags", F.lower), F.array(*[F.lit(t.lower()) for t in tags])))


def keyword(n: DataFrame, query: str, k: int) -> DataFrame:
    """Keyword search: working and semantic rows first, episodic ones only if those are fewer than k.

    Rows of the first kind come first in one order, so the first k rows are
    those that two searches would give.
    """
    s = text.keyword_score(F.col("content"), F.col("tags"), text.query_terms(query))
    hits = n.where(F.col("tier").isin("working", "semantic", "episodic")).withColumn("score", s).where("score > 0").withColumn("stage", F.when(F.col("tier") == "episodic", 2).otherwise(1))
    return hits.orderBy("stage", F.desc("score"), "id").limit(k).select("id", "tier", "score")


def hybrid(kw: DataFrame, sem: DataFrame, weight: float, k: int, threshold: float = 0.0) -> DataFrame:
    """Full outer merge of two scored lists; a missing score is 0."""
    both = kw.select("id", F.col("score").alias("k")).join(sem.select("id", F.col("score").alias("s")), "id", "full")
    score = weight * F.coalesce("s", F.lit(0.0)) + (1 - weight) * F.coalesce("k", F.lit(0.0))
    return both.select("id", score.alias("score")).where(F.col("score") >= threshold).orderBy(F.desc("score"), "id").limit(k)


def rerank(hits: DataFrame) -> DataFrame:
    boost = F.when(F.col("tier") == "working", 0.15).otherwise(0.0) + F.greatest(F.lit(0.0), (F.col("importance") - 0.5) * 0.1)
    return hits.withColumn("score", F.col("score") + boost)


def neighbours(edges: DataFrame, starts: DataFrame, depth: int, direction: str = "both", relations: list[str] = ()) -> DataFrame:
    """(start, id, hop): what is reached within ``depth`` hops, each node once per start, starts excluded.

    ``relations`` keeps edges of these types only, at every hop.  Each hop but
    the last is a written table, so the plan doesn't grow with the depth.
    """
    if relations:
        edges = edges.where(F.col("relation_type").isin(list(relations)))
    out = edges.select(F.col("source_id").alias("f"), F.col("target_id").alias("t"))
    back = out.select(F.col("t").alias("f"), F.col("f").alias("t"))
    step = {"out": out, "in": back, "both": out.unionByName(back)}[direction].distinct()
    if depth > 1:
        step, starts = materialize(step, "step"), materialize(starts.select("id"), "starts")
    hops = [starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("hop"))]
    for hop in range(1, depth + 1):
        seen = reduce(DataFrame.unionByName, hops)
        new = hops[-1].join(step, F.col("id") == F.col("f")).select("start", F.col("t").alias("id")).distinct().join(seen, ["start", "id"], "left_anti").withColumn("hop", F.lit(hop))
        hops.append(materialize(new, "hop") if hop < depth else new)
    return reduce(DataFrame.unionByName, hops[1:], starts.sparkSession.createDataFrame([], hops[0].schema)) if depth > 0 else hops[0].where("hop > 0")


def keep_best(n: DataFrame, key, order: list) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return n.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def duplicate_key(columns) -> Column:
    """What makes two nodes one: a question, a place in a document, or a type with a content hash."""
    has = lambda c: F.col(c) if c in columns else F.lit(None).cast("string")
    own = F.coalesce(F.when(has("content_hash") != "", has("content_hash")), text.content_hash(F.col("content")))
    return F.coalesce(
        F.concat(F.lit("question:"), F.when(has("question_key") != "", has("question_key"))),
        F.concat(F.lit("document:"), F.when(has("document_hash") != "", has("document_hash")), F.lit(":"), has("chunk").cast("string")),
        F.concat(F.lit("content:"), "node_type", F.lit(":"), own),
    )


def exact_duplicates(n: DataFrame, pinned: bool = False) -> DataFrame:
    """Ids that exact-duplicate pruning deletes: all but the best of each key by tier, importance, accesses and the last of these.

    ``pinned`` takes pinned rows as well.  The best of a group is an aggregate
    with partial results, and the rest are found by id, so a group of a third of
    all rows lands in no single task.
    """
    last = [(-F.col(c)).alias(c) for c in ("access_count", "last_accessed") if c in n.columns] or [(-F.col("created_at")).alias("c")]
    order = F.struct((-scores.by_tier(F.col("tier"), scores.TIER_PRIORITY, 0)).alias("p"), (-F.col("importance")).alias("i"), *last, F.col("id").alias("id"))
    rows = n if pinned else n.where(~F.col("pinned"))
    best = rows.groupBy(duplicate_key(n.columns).alias("h")).agg(F.min(order).alias("first"))
    return rows.select("id").join(best.select(F.col("first.id").alias("id")), "id", "left_anti")


def stats(n: DataFrame) -> DataFrame:
    """Counts by tier, by type and in all, in one pass."""
    return n.groupingSets([[F.col("tier")], [F.col("node_type")], []], F.col("tier"), F.col("node_type")).agg(F.count("*").alias("n"))


def document_frequency(n: DataFrame, limit: int, stop: list[str] = ()) -> DataFrame:
    """The terms of most nodes."""
    t = n.select(F.explode(text.terms(F.col("content"))).alias("term"))
    return t.where(~F.col("term").isin(*stop) if stop else F.lit(True)).groupBy("term").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "term").limit(limit)


def access_scores(log: DataFrame, now: float, keep: int = 100) -> DataFrame:
    """(node_id, freq, rec, score): of each node's last accesses those of 24 hours, and the time since the last."""
    w = Window.partitionBy("node_id").orderBy(F.desc("ts"), F.desc("event_id"))
    last = log.where(F.col("ts") <= now).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= keep)
    got = last.groupBy("node_id").agg(F.count_if(F.col("ts") >= now - 86400).alias("n24"), F.max("ts").alias("last"))
    f, r = scores.frequency(F.col("n24")), scores.recency(F.col("last"), F.lit(now))
    return got.select("node_id", f.alias("freq"), r.alias("rec"), scores.combined(f, r).alias("score"))


def plan_tiers(n: DataFrame, access: DataFrame, now: float, hot: float = 0.65, cold: float = 0.26, capacity: int = 256) -> DataFrame:
    """(id, action): promotions of the hottest up to the working set's room, demotions, archive candidates.

    A row can be an archive candidate beside another action.  Rows from internal
    sources are only ever demoted.
    """
    used = n.agg(F.count_if(F.col("tier") == "working").alias("used"))
    j = n.where(~F.col("pinned")).join(access, n.id == access.node_id.cast("string"), "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    internal = F.coalesce(F.col("source").isin(*phrases.INTERNAL_SOURCES), F.lit(False))
    working = F.col("tier") == "working"
    # Only rows that can be promoted are ranked, and no more of them than there is room for.
    top = j.where(~internal & ~working & (F.col("score") >= hot)).orderBy(F.desc("score"), "id").limit(capacity).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    promoted = top.join(F.broadcast(used)).where(F.col("rank") <= capacity - F.col("used")).select("id", F.lit("promote").alias("action"))
    old = scores.decay(F.col("importance"), F.col("created_at"), F.lit(now)) < 0.08
    rest = j.select("id", F.explode(F.array_compact(F.array(F.when(working & (internal | (F.col("score") < cold)), "demote"), F.when(~internal & old, "archive")))).alias("action"))
    return promoted.unionByName(rest)


def last_turns(messages: DataFrame, keep: int = 10) -> DataFrame:
    """The last turns of each conversation as one text."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    kept = messages.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= keep)
    listed = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.upper("role"), F.lit(": "), F.col("text")).alias("line"))))
    return kept.groupBy("conv_id").agg(F.count("*").alias("turns"), F.concat_ws("\n", F.transform(listed, lambda x: x.line)).alias("flat"))


def active() -> Column:
    """Not archived and not a summary that the engine wrote itself."""
    own = (F.col("node_type") == "summary") & F.coalesce(F.col("source").isin("agent-reflection", "agent-maintenance"), F.lit(False))
    return (F.col("tier") != "archived") & ~own


def mergeable() -> Column:
    """Embedded and not pinned."""
    return F.col("embedding").isNotNull() & ~F.col("pinned")


def synthesisable() -> Column:
    """Embedded and no summary."""
    return F.col("embedding").isNotNull() & (F.col("node_type") != "summary")
