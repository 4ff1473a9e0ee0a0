"""Retrieval metrics, sample summaries and connection indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def retrieval_metrics(questions: DataFrame, ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(question_id, question_type, recall_any, recall_all, ndcg) of each question.

    ``ranked`` has (question_id, doc_id, rank from 1) and ``relevant`` distinct
    (question_id, doc_id).  Without relevant rows recall_all holds, recall_any
    doesn't and ndcg is 0.
    """
    hits = ranked.where(F.col("rank") <= k).join(relevant, ["question_id", "doc_id"]).groupBy("question_id").agg(F.count_distinct("doc_id").alias("found"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    wanted = relevant.groupBy("question_id").agg(F.count("*").alias("wanted"))
    n = F.coalesce("wanted", F.lit(0))
    found = F.coalesce("found", F.lit(0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(k)).cast("int")), F.lit(0.0), lambda a, r: a + 1 / F.log2(r + 1))
    return (
        questions.join(wanted, "question_id", "left")
        .join(hits, "question_id", "left")
        .select("question_id", "question_type", (found > 0).alias("recall_any"), (found == n).alias("recall_all"), F.when(n > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0).alias("ndcg"))
    )


def metrics_by_type(metrics: DataFrame) -> DataFrame:
    """Means of the metrics for each question type."""
    return metrics.groupBy("question_type").agg(F.count("*").alias("n"), *[F.avg(F.col(c).cast("double")).alias(c) for c in ("recall_any", "recall_all", "ndcg")])


def sample_summary(samples: DataFrame, key: str, value: str) -> DataFrame:
    """Count, interpolated p50 and p95, and mean of each key's samples; memory is that of a key's distinct values."""
    v = F.col(value)
    return samples.groupBy(key).agg(F.count(v).alias("n"), F.percentile(v, 0.5).alias("p50"), F.percentile(v, 0.95).alias("p95"), F.avg(v).alias("mean"))


def connection_index(*entries: DataFrame) -> DataFrame:
    """The union of index entries: of each connection the one of least rank, then of largest weight.

    Entries have (summary_id, node_id, relation, role, direction, rank, weight);
    a missing rank or one below 1 counts as 1, a missing weight as 1 and one below
    0 as 0; ids are trimmed and blank ones dropped.  ``pos`` is a connection's
    place in its summary.
    """
    every = entries[0]
    for e in entries[1:]:
        every = every.unionByName(e)
    every = every.withColumn("node_id", F.trim(F.col("node_id").cast("string"))).where("node_id <> ''")
    rank = F.greatest(F.lit(1), F.coalesce("rank", F.lit(1)))
    weight = F.greatest(F.lit(0.0), F.coalesce(F.col("weight").cast("double"), F.lit(1.0)))
    best = every.groupBy("summary_id", "node_id", "relation", "role", "direction").agg(F.min(F.struct(rank.alias("rank"), (-weight).alias("w"))).alias("m"))
    flat = best.select("summary_id", "node_id", "relation", "role", "direction", F.col("m.rank").alias("rank"), (-F.col("m.w")).alias("weight"))
    return flat.withColumn("pos", F.row_number().over(Window.partitionBy("summary_id").orderBy("rank", F.desc("weight"), "node_id", "relation", "role", "direction")))
