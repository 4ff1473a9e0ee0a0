"""Connection indexes of summaries: entries from typed lists, related ids and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import connection_index

#: Older list columns with the relation, role and weight that their ids have.
LEGACY = (
    ("supporting_node_ids", "summarizes", "support", 1.0),
    ("synthesized_from", "summarizes", "support", 1.0),
    ("source_node_ids", "summarizes", "source", 1.0),
    ("focus_node_ids", "references", "focus", 0.8),
    ("merged_from", "derived_from", "source", 1.0),
    ("parent_node_ids", "derived_from", "parent", 1.0),
)
_ENTRY = "node_id string, relation string, role string, direction string, rank int, weight double"


def from_lists(summaries: DataFrame, id_col: str = "summary_id") -> DataFrame:
    """Entries (summary_id, node_id, relation, role, direction, rank, weight) of the legacy lists that ``summaries`` has.

    An id's rank is its place in its list, from 1; ``source_lineage`` may be an
    array of structs with a node_id and optionally a weight.
    """
    made = [_listed(name, relation, role, weight) for name, relation, role, weight in LEGACY if name in summaries.columns]
    if "source_lineage" in summaries.columns:
        has_weight = "weight" in summaries.schema["source_lineage"].dataType.elementType.names
        lineage = F.transform("source_lineage", lambda x, i: _entry(x["node_id"], "derived_from", "lineage", i + 1, F.coalesce(x["weight"], F.lit(1.0)) if has_weight else F.lit(1.0)))
        made.append(F.coalesce(lineage, F.array().cast(f"array<struct<{_ENTRY.replace(' ', ':').replace(',:', ',')}>>")))
    if not made:
        raise ValueError("no legacy list among the columns")
    return summaries.select(F.col(id_col).alias("summary_id"), F.inline(F.concat(*made)))


def _listed(name: str, relation: str, role: str, weight: float) -> Column:
    return F.transform(F.coalesce(F.col(name), F.array().cast("array<string>")), lambda x, i: _entry(x, relation, role, i + 1, F.lit(weight)))


def _entry(node_id: Column, relation: str, role: str, rank: Column, weight: Column) -> Column:
    return F.struct(node_id.cast("string").alias("node_id"), F.lit(relation).alias("relation"), F.lit(role).alias("role"), F.lit("out").alias("direction"), rank.cast("int").alias("rank"), weight.cast("double").alias("weight"))


def related_ids(entries: DataFrame, limit: int | None = None) -> DataFrame:
    """(summary_id, node_id, at): distinct ids of an index in its order, the summary's own left out; ``limit`` counts entries."""
    index = connection_index(entries)
    if limit is not None:
        index = index.where(F.col("pos") <= limit)
    first = index.where(F.col("node_id") != F.col("summary_id").cast("string")).groupBy("summary_id", "node_id").agg(F.min("pos").alias("pos"))
    return first.select("summary_id", "node_id", F.row_number().over(Window.partitionBy("summary_id").orderBy("pos")).alias("at"))


def snapshot(summary_id: Column, kind: Column, source: Column, content_hash: Column, node_ids: Column) -> Column:
    """sha1 over a summary's fields and its sorted distinct ids; the same for the same connections in any order."""
    name = lambda prefix, c: F.concat(F.lit(prefix), F.coalesce(c.cast("string"), F.lit("")))
    ids = F.transform(F.array_sort(F.array_distinct(node_ids)), lambda x: F.concat(F.lit("node:"), x))
    return F.sha1(F.array_join(F.concat(F.array(name("summary:", summary_id), name("kind:", kind), name("source:", source), name("content:", content_hash)), ids), "|").cast("binary"))
