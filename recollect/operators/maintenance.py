"""Maintenance planning: which questions a collection's summaries leave open, as ranked tables.

A node is covered if a summary refers to it.  Every plan is a table of
(kind, label, priority, nodes) with a total order, so its parts can be united
and ranked; groups are counted with partial aggregates and focus nodes are
ranked with group limits, so a large source or tag lands in no single task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that are no terms.
STOP = (
    "a an and are as at be been by for from has have how in into is it its of on or "
    "that the their this to was what when where which who why with without using used use "
    "can there them these those such than then will would could should about collection collections document "
    "documents paper section sections example examples upload uploaded file files chunk chunks summary summaries "
    "agent agents reasoning model models system demo tmp pdf txt md data information"
).split()
TERM = "[a-z][a-z0-9_-]{2,}"
#: Patterns of named entities by kind; the group is the name.
ENTITIES = {
    "class": r"\bclass\s+([A-Z][A-Za-z0-9_]{2,})",
    "function": r"\bdef\s+([a-z_][a-z0-9_]{3,})\s*\(",
    "config": r"\b(config|cfg|settings)\.[a-z_][a-z0-9_.]{3,}\b",
    "flag": r"--([a-z][a-z0-9-]{3,})\b",
}


def term_set(content: Column) -> Column:
    """Distinct lower-case terms without stop words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(content), F.lit(TERM), F.lit(0)))
    return F.array_except(found, F.array(*map(F.lit, STOP)))


def generic(term: Column) -> Column:
    """Terms that say too little to ask about."""
    return (F.length(term) <= 3) | term.startswith("tmp") | term.isin(*STOP)


def mark_covered(n: DataFrame, covered: DataFrame) -> DataFrame:
    """Nodes with ``open``: no summary refers to them (``covered`` holds their ids)."""
    c = covered.select(F.col("id").alias("_covered")).distinct()
    return n.join(c, n.id == c._covered, "left").withColumn("open", F.col("_covered").isNull()).drop("_covered")


def _order(columns) -> list[Column]:
    """Importance, accesses and the last of these; creation where accesses aren't known."""
    return [F.desc("importance"), *([F.desc("access_count"), F.desc("last_accessed")] if "access_count" in columns else [F.desc("created_at")]), F.col("id")]


def top_nodes(n: DataFrame, limit: int) -> DataFrame:
    """The most important nodes, those of more and later accesses first among equals."""
    return n.orderBy(*_order(n.columns)).limit(limit)


def top_terms(n: DataFrame, limit: int) -> DataFrame:
    """(term, df): of the 4 x limit terms of most nodes the first that aren't generic."""
    counts = n.select(F.explode(term_set(F.col("content"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    first = counts.orderBy(F.desc("df"), "term").limit(4 * limit)
    return first.where(~generic(F.col("term"))).orderBy(F.desc("df"), "term").limit(limit)


def fingerprint(n: DataFrame, content_hash: Column) -> DataFrame:
    """(nodes, mark): changes whenever a node's type or content does, in any order of rows.

    A sum of hashes rather than the hash of a sorted list, so partial sums are
    all that is shuffled.
    """
    h = F.sha1(F.concat_ws(":", "node_type", content_hash).cast("binary"))
    part = F.conv(F.substring(h, 1, 10), 16, 10).cast("bigint")
    return n.agg(F.count("*").alias("nodes"), F.sum(part.cast("decimal(38,0)")).alias("total")).select("nodes", F.sha1(F.concat_ws(":", F.col("nodes").cast("string"), F.coalesce("total", F.lit(0)).cast("string")).cast("binary")).alias("mark"))


def source_questions(n: DataFrame, limit: int = 3) -> DataFrame:
    """Sources by the number and share of their open nodes."""
    g = n.where(F.coalesce(F.col("source"), F.lit("")) != "").groupBy("source").agg(F.count("*").alias("n"), F.count_if("open").alias("k"))
    p = 0.7 + F.least(F.lit(0.25), F.col("k") * 0.03) + F.col("k") / F.col("n") * 0.2
    return _plan(g.select(F.lit("source_summary").alias("kind"), F.col("source").alias("label"), p.alias("priority"), F.least(F.lit(8), F.when(F.col("k") > 0, F.col("k")).otherwise(F.col("n"))).alias("nodes")), limit)


def tag_questions(n: DataFrame, limit: int = 2) -> DataFrame:
    """Tags of two nodes or more that aren't generic, by their open nodes."""
    t = n.select("open", F.explode("tags").alias("t")).where("t <> ''").groupBy(F.lower("t").alias("tag")).agg(F.count("*").alias("n"), F.count_if("open").alias("k"))
    t = t.where((F.col("n") >= 2) & ~generic(F.col("tag")))
    p = 0.55 + F.least(F.lit(0.2), F.col("k") * 0.04)
    return _plan(t.select(F.lit("tag_summary").alias("kind"), F.col("tag").alias("label"), p.alias("priority"), F.least(F.lit(6), F.when(F.col("k") > 0, F.col("k")).otherwise(F.col("n"))).alias("nodes")), limit)


def gap_questions(n: DataFrame, limit: int = 3) -> DataFrame:
    """The leading terms of open nodes."""
    t = top_terms(n.where("open"), 8).orderBy(F.desc("df"), "term").limit(limit)
    k = F.least(F.lit(6), F.col("df"))
    return _plan(t.select(F.lit("topic_gap").alias("kind"), F.col("term").alias("label"), (0.6 + F.least(F.lit(0.2), k * 0.03)).alias("priority"), k.alias("nodes")), limit)


def relationship_question(n: DataFrame) -> DataFrame:
    """The two leading terms, if three nodes or more hold one of them."""
    pair = top_terms(n, 6).orderBy(F.desc("df"), "term").limit(2)
    held = pair.agg(F.array_sort(F.collect_list(F.struct((-F.col("df")).alias("o"), "term"))).alias("p")).where(F.size("p") == 2).select(F.transform("p", lambda x: x.term).alias("pair"))
    k = n.join(F.broadcast(held), F.arrays_overlap(term_set(F.col("content")), F.col("pair"))).groupBy("pair").agg(F.count("*").alias("k")).where("k >= 3")
    return k.select(F.lit("relationship").alias("kind"), F.concat_ws(" + ", "pair").alias("label"), F.lit(0.58).alias("priority"), F.least(F.lit(8), F.col("k")).alias("nodes"))


def entity_mentions(n: DataFrame) -> DataFrame:
    """(kind, name, mentions) of classes, functions, settings and flags; every mention counts."""

    def found(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(F.col("content"), F.lit(pattern), F.lit(1)), lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("name")))

    return n.select(F.explode(F.concat(*[found(k, p) for k, p in ENTITIES.items()])).alias("e")).groupBy("e.kind", "e.name").agg(F.count("*").alias("mentions"))


def entity_questions(n: DataFrame, limit: int = 3) -> DataFrame:
    """Entities mentioned twice or more in open nodes that aren't summaries."""
    m = entity_mentions(n.where(F.col("open") & (F.col("node_type") != "summary"))).where("mentions >= 2").orderBy(F.desc("mentions"), "kind", "name").limit(limit)
    p = 0.92 + F.least(F.lit(0.18), F.col("mentions") * 0.02)
    return _plan(m.select(F.lit("entity_summary").alias("kind"), F.concat_ws(":", "kind", "name").alias("label"), p.alias("priority"), F.least(F.lit(6).cast("bigint"), F.col("mentions")).alias("nodes")), limit)


def overview_question(n: DataFrame) -> DataFrame:
    """One question on all, more urgent the more nodes are open."""
    k = F.count_if("open")
    g = n.agg(F.count("*").alias("n"), k.alias("k"))
    return g.select(F.lit("collection_overview").alias("kind"), F.lit("overview").alias("label"), (1.0 + 0.02 * F.col("k")).alias("priority"), F.least(F.lit(10), F.when(F.col("k") > 0, F.col("k")).otherwise(F.col("n"))).alias("nodes"))


def verification_question(n: DataFrame, terms: list[str], sources: list[str] = ()) -> DataFrame:
    """One question if two of the top nodes or more touch the given terms by content, tag or source."""
    want = F.array(*map(F.lit, terms))
    by_source = reduce(lambda a, s: a | F.coalesce(F.lower("source").contains(s), F.lit(False)), sources, F.lit(False))
    hit = F.arrays_overlap(term_set(F.col("content")), want) | F.arrays_overlap(F.transform("tags", F.lower), want) | by_source
    g = top_nodes(n.where(hit), 10).agg(F.count("*").alias("n"), F.count_if("open").alias("k")).where("n >= 2")
    p = 1.15 + F.least(F.lit(0.2), F.col("k") * 0.02)
    return g.select(F.lit("workflow_verification").alias("kind"), F.lit("workflow").alias("label"), p.alias("priority"), F.when(F.col("k") > 0, F.col("k")).otherwise(F.col("n")).alias("nodes"))


def _plan(candidates: DataFrame, limit: int) -> DataFrame:
    return candidates.orderBy(F.desc("priority"), F.desc("nodes"), F.desc("label")).limit(limit)


def question_plan(n: DataFrame, limit: int, terms: list[str], sources: list[str] = ()) -> DataFrame:
    """The most urgent of all candidate questions, each (kind, label) once."""
    parts = [overview_question(n), verification_question(n, terms, sources), source_questions(n), tag_questions(n), gap_questions(n), relationship_question(n), entity_questions(n)]
    both = reduce(DataFrame.unionByName, [p.withColumn("nodes", F.col("nodes").cast("bigint")) for p in parts])
    return _plan(both.groupBy("kind", "label").agg(F.max("priority").alias("priority"), F.max("nodes").alias("nodes")), limit)


#: How many focus nodes a question of each kind has, at most.
FOCUS = {"source_summary": 8, "tag_summary": 6, "topic_gap": 6, "relationship": 8, "collection_overview": 10}


def focus_nodes(plan: DataFrame, n: DataFrame) -> DataFrame:
    """(kind, label, at, id): the nodes that each question of ``plan`` is about, the first ``FOCUS`` of its kind.

    Open nodes alone if a question has any, else all of its nodes.  Rows, not
    lists; rank limits drop the rest of a large source or tag before the shuffle.
    """
    order = _order(n.columns)
    cols = ["id", "open", *[c for c in ("importance", "access_count", "last_accessed", "created_at") if c in n.columns]]
    own = plan.select("kind", "label")
    terms = F.explode(term_set(F.col("content"))).alias("label")
    halves = own.where("kind = 'relationship'").select("label", F.explode(F.split("label", r" \+ ")).alias("term"))
    parts = [
        n.select(F.lit("source_summary").alias("kind"), F.col("source").alias("label"), *cols),
        n.select(F.lit("tag_summary").alias("kind"), F.explode(F.transform("tags", F.lower)).alias("label"), *cols).distinct(),
        n.where("open").select(F.lit("topic_gap").alias("kind"), terms, *cols),
        n.select(terms.alias("term"), *cols).join(F.broadcast(halves), "term").select(F.lit("relationship").alias("kind"), "label", *cols).distinct(),
        n.select(F.lit("collection_overview").alias("kind"), F.lit("overview").alias("label"), *cols),
    ]
    met = reduce(DataFrame.unionByName, parts).join(F.broadcast(own), ["kind", "label"])  # a plan has a few rows
    some = met.groupBy("kind", "label").agg(F.max("open").alias("some"))
    most = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in FOCUS.items()])
    rows = met.join(F.broadcast(some), ["kind", "label"]).where(F.col("open") | ~F.col("some") | F.col("kind").isin("relationship"))
    at = F.row_number().over(Window.partitionBy("kind", "label").orderBy(*order))
    return rows.withColumn("at", at).where(F.col("at") <= max(FOCUS.values())).where(F.col("at") <= most).select("kind", "label", "at", "id")


def follow_ups(n: DataFrame, limit: int = 4) -> DataFrame:
    """(question, label, priority, id) from past questions of 10 characters or more that weren't generated, each once, the first by creation."""
    from ..functions import phrases

    q = phrases.stripped(F.col("question"))
    past = n.where(F.length("question") >= 10).withColumn("q", q).withColumn("low", F.lower(q)).where(~phrases.has_any(F.col("low"), phrases.GENERATED_PHRASES))
    first = past.groupBy("low").agg(F.min_by(F.struct("q", "importance", "id"), F.struct("created_at", "id")).alias("m"), F.min(F.struct("created_at", "id")).alias("o"))
    words = phrases.stripped(F.regexp_replace(F.col("m.q"), r"\?+$", ""))
    made = first.orderBy("o").limit(limit).select(phrases.follow_up(words).alias("question"), F.concat(F.lit("Follow-up: "), F.left(words, F.lit(60))).alias("label"), (0.85 + F.least(F.lit(0.2), F.col("m.importance") * 0.2)).alias("priority"), F.col("m.id").alias("id"))
    return made.where("question <> ''")


def due(n: DataFrame, content_hash: Column, past: DataFrame) -> DataFrame:
    """(nodes, mark) of a collection if its fingerprint isn't that of ``past`` (mark); no row if nothing changed."""
    return fingerprint(n, content_hash).join(past.select("mark"), "mark", "left_anti")
