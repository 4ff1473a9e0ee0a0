"""Range joins over character positions, and plans applied to nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def line_ranges(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line, a, b): the characters [a, b) of each line that isn't empty; lines count from 1."""
    lines = docs.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(F.split(text_col, "\n")).alias("no", "line"))
    w = Window.partitionBy(id_col).orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = lines.select(id_col, (F.col("no") + 1).alias("line"), F.length("line").alias("size"), (F.sum(F.length("line").cast("bigint") + 1).over(w) - 1).alias("b"))
    return ends.where("size > 0").select(id_col, "line", (F.col("b") - F.col("size")).alias("a"), "b")


def overlaps(left: DataFrame, right: DataFrame, key: str, size: int) -> DataFrame:
    """Pairs of ranges [a, b) of equal key that overlap; the other columns of both come along.

    Ranges are listed in bins of ``size`` positions and joined by key and bin,
    so a long document meets itself only near the same place; a pair that
    shares several bins counts in the first.
    """

    def binned(d: DataFrame, side: str) -> DataFrame:
        d = d.where("b > a")
        first, last = F.floor(F.col("a") / size), F.floor((F.col("b") - 1) / size)
        d = d.withColumn("bin", F.explode(F.sequence(first, last))).withColumn("first", first)
        return d.withColumnsRenamed({c: f"{side}_{c}" for c in ("a", "b", "first")})

    met = binned(left, "l").join(binned(right, "r"), [key, "bin"])
    return met.where("l_a < r_b AND l_b > r_a AND bin = greatest(l_first, r_first)").drop("bin", "l_first", "r_first")


def apply_plan(n: DataFrame, plan: DataFrame, gain: float = 0.05) -> DataFrame:
    """Nodes after a plan (id, action): promoted ones are working and gain importance (1 at most), demoted ones semantic."""
    p = plan.groupBy("id").agg(F.max("action").alias("_action"))
    promoted: Column = F.col("_action") == "promote"
    j = n.join(p, "id", "left")
    tier = F.when(promoted, "working").when(F.col("_action") == "demote", "semantic").otherwise(F.col("tier"))
    return j.withColumns({"tier": tier, "importance": F.when(promoted, F.least(F.lit(1.0), F.col("importance") + gain)).otherwise(F.col("importance"))}).drop("_action")
