"""Registered queries of maintenance plans, range joins, updates and code graphs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, vectors
from ..operators import code_graph as C
from ..operators import consolidation as K
from ..operators import maintenance as U
from ..operators import ranges as R
from ..operators import similarity as S
from ..sources import tables as T
from ..streaming import access
from .queries import EDGES, HASH, LOW, NODES, PAIRS, first_vector, query, r6

WORDS = ["license", "die", "los", "les"]
_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_SET = "list_distinct(list_filter(regexp_extract_all(lower({0}), '" + U.TERM.replace("{", "{{").replace("}", "}}") + "'), lambda w: NOT list_contains(" + _LIST(U.STOP) + ", w)))"
_GENERIC = "(length({0}) <= 3 OR starts_with({0}, 'tmp') OR list_contains(" + _LIST(U.STOP) + ", {0}))"
MARKED = NODES + ", covered AS (SELECT DISTINCT doc_id::varchar AS id FROM labels WHERE quality = 1), marked AS (SELECT *, id NOT IN (SELECT id FROM covered) AS open FROM nodes)"


def _terms(name: str, rows: str, limit: int) -> str:
    return f"""{name}_first AS (SELECT term, count(*) AS df FROM (SELECT unnest({_SET.format('content')}) AS term FROM {rows}) GROUP BY term ORDER BY df DESC, term LIMIT {4 * limit}),
{name} AS (SELECT term, df FROM {name}_first WHERE NOT {_GENERIC.format('term')} ORDER BY df DESC, term LIMIT {limit})"""


def _ranked(limit: int) -> str:
    return f"ORDER BY priority DESC, nodes DESC, label DESC LIMIT {limit}"


SOURCES = f"""sources AS (SELECT 'source_summary' AS kind, source AS label, 0.7 + least(0.25, k * 0.03) + k / n * 0.2 AS priority, least(8, CASE WHEN k > 0 THEN k ELSE n END) AS nodes
  FROM (SELECT source, count(*) AS n, count(*) FILTER (open) AS k FROM marked WHERE source <> '' GROUP BY 1) {_ranked(3)})"""
TAGS = f"""tagged AS (SELECT 'tag_summary' AS kind, tag AS label, 0.55 + least(0.2, k * 0.04) AS priority, least(6, CASE WHEN k > 0 THEN k ELSE n END) AS nodes
  FROM (SELECT lower(t) AS tag, count(*) AS n, count(*) FILTER (open) AS k FROM (SELECT unnest(tags) AS t, open FROM marked) WHERE t <> '' GROUP BY 1) WHERE n >= 2 AND NOT {_GENERIC.format('tag')} {_ranked(2)})"""
GAPS = _terms("gap_terms", "marked WHERE open", 8) + f""", gaps AS (SELECT 'topic_gap' AS kind, term AS label, 0.6 + least(0.2, least(6, df) * 0.03) AS priority, least(6, df) AS nodes FROM (SELECT * FROM gap_terms ORDER BY df DESC, term LIMIT 3) {_ranked(3)})"""
RELATED = _terms("all_terms", "marked", 6) + f""", two AS (SELECT list(term ORDER BY df DESC, term) AS pair FROM (SELECT * FROM all_terms ORDER BY df DESC, term LIMIT 2) HAVING count(*) = 2),
related AS (SELECT 'relationship' AS kind, pair[1] || ' + ' || pair[2] AS label, 0.58 AS priority, least(8, count(*)) AS nodes FROM marked, two WHERE list_has_any({_SET.format('content')}, pair) GROUP BY pair HAVING count(*) >= 3)"""
OVERVIEW = "overview AS (SELECT 'collection_overview' AS kind, 'overview' AS label, 1.0 + 0.02 * count(*) FILTER (open) AS priority, least(10, CASE WHEN count(*) FILTER (open) > 0 THEN count(*) FILTER (open) ELSE count(*) END) AS nodes FROM marked)"
VERIFY = f"""verify AS (SELECT 'workflow_verification' AS kind, 'workflow' AS label, 1.15 + least(0.2, count(*) FILTER (open) * 0.02) AS priority, CASE WHEN count(*) FILTER (open) > 0 THEN count(*) FILTER (open) ELSE count(*) END AS nodes
  FROM (SELECT * FROM marked WHERE list_has_any({_SET.format('content')}, {_LIST(WORDS)}) OR list_has_any(list_transform(tags, lambda t: lower(t)), {_LIST(WORDS)}) OR contains(lower(source), 'src1')
    ORDER BY importance DESC, created_at DESC, id LIMIT 10) HAVING count(*) >= 2)"""


def _mentions(rows: str) -> str:
    parts = " UNION ALL ".join(f"SELECT '{k}' AS kind, unnest(regexp_extract_all(content, '{p}', 1)) AS name FROM {rows}" for k, p in U.ENTITIES.items())
    return f"SELECT kind, name, count(*) AS mentions FROM ({parts}) GROUP BY 1, 2"


ENTITIES = f"""entities AS (SELECT 'entity_summary' AS kind, kind || ':' || name AS label, 0.92 + least(0.18, mentions * 0.02) AS priority, least(6, mentions) AS nodes
  FROM (SELECT * FROM ({_mentions("(SELECT * FROM marked WHERE open AND node_type <> 'summary')")}) WHERE mentions >= 2 ORDER BY mentions DESC, kind, name LIMIT 3) {_ranked(3)})"""
#: Lines that read like code, one for each part.
CODE = "'class ' || replace(p_brand, '#', '') || ': def size_' || (1000 + p_size) || '(self): return cfg.limits --' || lower(split_part(p_type, ' ', 2))"
COLUMNS = "SELECT kind, label, round(priority, 6) AS priority, nodes::bigint AS nodes FROM "


def marked(spark, sf):
    """Nodes with ``open``; those that are labelled good count as covered."""
    covered = T.table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("id"))
    return U.mark_covered(T.nodes(spark, sf), covered)


def shown(plan):
    return plan.select("kind", "label", r6(F.col("priority")).alias("priority"), F.col("nodes").cast("bigint").alias("nodes"))


@query(f"WITH {MARKED} SELECT id FROM marked WHERE open")
def c18_open_nodes(spark, sf):
    return marked(spark, sf).where("open").select("id")


@query(f"""WITH {NODES}, m AS (SELECT count(*) AS nodes, sum(('0x' || left(sha1(node_type || ':' || {HASH.format('content')}), 10))::bigint) AS total FROM nodes)
SELECT nodes, sha1(nodes || ':' || total) AS mark FROM m""")
def d14_fingerprint(spark, sf):
    return U.fingerprint(T.nodes(spark, sf), text.content_hash(F.col("content")))


@query(f"WITH {NODES}, {_terms('t', 'nodes', 20)} SELECT term, df FROM t")
def d15_top_terms(spark, sf):
    return U.top_terms(T.nodes(spark, sf), 20)


@query(f"WITH {MARKED}, {SOURCES} {COLUMNS} sources")
def d16_source_questions(spark, sf):
    return shown(U.source_questions(marked(spark, sf)))


@query(f"WITH {MARKED}, {TAGS} {COLUMNS} tagged")
def d17_tag_questions(spark, sf):
    return shown(U.tag_questions(marked(spark, sf)))


@query(f"WITH code AS (SELECT {CODE} AS content FROM part) {_mentions('code')}")
def d18_entity_mentions(spark, sf):
    p = F.concat(F.lit("class "), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(": def size_"), (F.col("p_size") + 1000).cast("string"), F.lit("(self): return cfg.limits --"), F.lower(F.split_part("p_type", F.lit(" "), F.lit(2))))
    return U.entity_mentions(T.table(spark, sf, "part").select(p.alias("content")))


@query(f"WITH {MARKED}, {GAPS} {COLUMNS} gaps")
def d19_topic_gaps(spark, sf):
    return shown(U.gap_questions(marked(spark, sf)))


@query(f"WITH {MARKED}, {RELATED} {COLUMNS} related")
def d20_relationship(spark, sf):
    return shown(U.relationship_question(marked(spark, sf)))


@query(f"WITH {MARKED}, {OVERVIEW} {COLUMNS} overview")
def d27_overview(spark, sf):
    return shown(U.overview_question(marked(spark, sf)))


@query(f"WITH {MARKED}, {VERIFY} {COLUMNS} verify")
def d28_verification(spark, sf):
    return shown(U.verification_question(marked(spark, sf), WORDS, ["src1"]))


@query(f"WITH {NODES} SELECT id, importance FROM nodes ORDER BY importance DESC, created_at DESC, id LIMIT 25")
def f14_top_nodes(spark, sf):
    return U.top_nodes(T.nodes(spark, sf), 25).select("id", "importance")


@query(f"""WITH {MARKED}, {SOURCES}, {TAGS}, {GAPS}, {RELATED}, {OVERVIEW}, {VERIFY}, {ENTITIES}
{COLUMNS} (SELECT * FROM overview UNION ALL SELECT * FROM verify UNION ALL SELECT * FROM sources UNION ALL SELECT * FROM tagged UNION ALL SELECT * FROM gaps UNION ALL SELECT * FROM related UNION ALL SELECT * FROM entities) ORDER BY priority DESC, nodes DESC, label DESC LIMIT 8""")
def f15_question_plan(spark, sf):
    return shown(U.question_plan(marked(spark, sf), 8, WORDS, ["src1"]))


@query("""WITH q AS (SELECT vec_id AS query, embedding::double[] AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query, vec_id AS id, list_dot_product(embedding::double[], q) AS score FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) SELECT query, id, rank, round(score, 6) AS score FROM r WHERE rank <= 5""")
def f11_multi_query_search(spark, sf):
    v = T.vectors(spark, sf)
    q = v.where("id % 50 = 0").select(F.col("id").alias("query"), F.col("embedding").alias("query_vector"))
    return S.top_k_each(v, q, 5).withColumn("score", r6(F.col("score"))).withColumn("rank", F.col("rank").cast("bigint"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, no, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY no) AS after, length(line) AS size FROM l),
e AS (SELECT doc_id, no, after - 1 - size AS a, after - 1 AS b FROM p WHERE size > 0),
c AS (SELECT doc_id, i, i * 800 AS a, least(i * 800 + 1000, n) AS b FROM (SELECT doc_id, length(text) AS n, unnest(range(0, 1 + ceil(greatest(0, length(text) - 1000) / 800.0)::bigint)) AS i FROM documents WHERE length(text) > 0))
SELECT c.doc_id, c.i::int AS chunk, e.no::int AS line FROM c JOIN e ON c.doc_id = e.doc_id AND e.a < c.b AND e.b > c.a""")
def c13_c14_chunk_lines(spark, sf):
    d = T.table(spark, sf, "documents").select("doc_id", "text")
    starts = d.select("doc_id", F.length("text").alias("n"), F.posexplode(text.chunk_starts(F.col("text"), 1000, 200)).alias("chunk", "a"))
    chunks = starts.select("doc_id", "chunk", "a", F.least(F.col("a") + 1000, F.col("n")).alias("b"))
    return R.overlaps(chunks, R.line_ranges(d, "doc_id", "text"), "doc_id", 1000).select("doc_id", "chunk", "line")


@query(f"WITH {NODES}, up AS (SELECT id FROM nodes WHERE importance >= 0.9 AND tier = 'semantic'), down AS (SELECT id FROM nodes WHERE tier = 'working' AND importance < 0.4) SELECT id, CASE WHEN id IN (SELECT id FROM up) THEN 'working' WHEN id IN (SELECT id FROM down) THEN 'semantic' ELSE tier END AS tier, round(CASE WHEN id IN (SELECT id FROM up) THEN least(1.0, importance + 0.05) ELSE importance END, 6) AS importance FROM nodes")
def i3_apply_plan(spark, sf):
    n = T.nodes(spark, sf)
    plan = n.where("importance >= 0.9 AND tier = 'semantic'").select("id", F.lit("promote").alias("action")).unionByName(n.where("tier = 'working' AND importance < 0.4").select("id", F.lit("demote").alias("action")))
    return R.apply_plan(n, plan).select("id", "tier", r6(F.col("importance")).alias("importance"))


@query()
def j5_code_graph(spark, sf):
    """Nodes and edges of a small module for each part type."""
    name = F.regexp_replace(F.initcap(F.lower("p_type")), "[^A-Za-z]", "")
    source = F.concat(F.lit('"""Parts."""\nimport json as j\nfrom os import path\n\nclass '), name, F.lit("(Base):\n    def size(self):\n        return helper(self)\n\ndef helper(x):\n    return j.dumps(x)\n"))
    return C.code_graph(T.table(spark, sf, "part").select("p_type").distinct().select(F.concat(name, F.lit(".py")).alias("path"), source.alias("source")))


MERGED = f"""{NODES}, {PAIRS}, e AS (SELECT a, b FROM pairs WHERE s >= {LOW} UNION SELECT b, a FROM pairs WHERE s >= {LOW}),
walk AS (SELECT a AS node, a AS other FROM e UNION SELECT w.node, e.b FROM walk w JOIN e ON e.a = w.other),
c AS (SELECT node, min(other) AS root FROM walk GROUP BY node), best AS (SELECT a AS node, max(s) AS s FROM (SELECT a, s FROM pairs UNION ALL SELECT b, s FROM pairs) WHERE s >= {LOW} GROUP BY 1),
sim AS (SELECT 'm:' || root AS summary_id, avg(s) AS similarity FROM c JOIN best ON c.node = best.node GROUP BY 1), member AS (SELECT node::varchar AS id, 'm:' || root AS summary_id FROM c)"""


def merged(spark, sf):
    p = S.pairs(T.vectors(spark, sf), LOW)
    return K.merge(T.nodes(spark, sf), S.clusters(p), p)


@query(f"""WITH RECURSIVE {MERGED} SELECT m.summary_id, count(*) AS size, round(max(importance) * 0.95, 6) AS importance, '[SUMMARY] ' || string_agg(trim(content, ' '), ' | ' ORDER BY n.id) AS content, round(any_value(similarity), 6) AS similarity
FROM nodes n JOIN member m ON n.id = m.id JOIN sim ON sim.summary_id = m.summary_id GROUP BY 1""")
def i5_merge_summaries(spark, sf):
    return merged(spark, sf)[0].select("summary_id", "size", r6(F.col("importance")).alias("importance"), "content", r6(F.col("similarity")).alias("similarity"))


@query(f"WITH RECURSIVE {MERGED} SELECT id, CASE WHEN id IN (SELECT id FROM member) THEN 'archived' ELSE tier END AS tier, CASE WHEN id IN (SELECT id FROM member) THEN importance * 0.5 ELSE importance END AS importance, pinned OR id IN (SELECT id FROM member) AS pinned FROM nodes")
def i5_merge_sources(spark, sf):
    return merged(spark, sf)[1].select("id", "tier", "importance", "pinned")


@query(f"WITH RECURSIVE {MERGED} SELECT m.summary_id AS source_id, m.id AS target_id, 'derived_from' AS relation, round(similarity, 6) AS weight FROM member m JOIN sim ON sim.summary_id = m.summary_id JOIN nodes n ON n.id = m.id")
def i5_merge_edges(spark, sf):
    return merged(spark, sf)[2].withColumn("weight", r6(F.col("weight")))


@query("""WITH q AS (SELECT embedding::double[] AS q FROM embeddings WHERE vec_id = 0), h AS (SELECT vec_id AS query, list_dot_product(embedding::double[], q) AS similarity, 1706659200 - vec_id * 600 AS ts, [vec_id, vec_id + 1, vec_id // 2] AS node_ids FROM embeddings, q),
near AS (SELECT * FROM h WHERE similarity >= 0.2 ORDER BY similarity DESC, query LIMIT 5), each AS (SELECT unnest(node_ids) AS node_id, similarity * pow(2.0, -((1706659200 - ts) / 3600.0) / 24.0) AS s FROM near)
SELECT node_id, round(max(s), 6) AS score FROM each GROUP BY 1 ORDER BY max(s) DESC, node_id LIMIT 20""")
def c19_pattern_prefetch(spark, sf):
    h = T.vectors(spark, sf).select(F.col("id").alias("query"), vectors.dot(F.col("embedding"), vectors.literal(first_vector(spark, sf))).alias("similarity"), (F.lit(T.AS_OF) - F.col("id") * 600).alias("ts"), F.array(F.col("id"), F.col("id") + 1, F.floor(F.col("id") / 2)).alias("node_ids"))
    return K.prefetch(h, T.AS_OF, threshold=0.2).withColumn("score", r6(F.col("score")))


@query("WITH v AS (SELECT source, lang, max(doc_id) AS t FROM documents GROUP BY 1, 2), l AS (SELECT source, arg_max(lang, t) AS lang FROM v GROUP BY 1) SELECT d.doc_id FROM documents d JOIN l ON d.source = l.source WHERE d.lang <> l.lang")
def e5_stale_versions(spark, sf):
    return K.stale_versions(T.table(spark, sf, "documents"), "source", "lang", "doc_id", "doc_id")


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM o) SELECT user_id AS node_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, g""")
def i14_sessions(spark, sf):
    return access.sessions(T.table(spark, sf, "events"), "6 hours").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"WITH {PAIRS} SELECT a, b, md5(least(a::varchar, b::varchar) || greatest(a::varchar, b::varchar)) AS pair_key FROM pairs WHERE s >= {LOW}")
def h15_pair_keys(spark, sf):
    a, b = F.col("a").cast("string"), F.col("b").cast("string")
    return S.pairs(T.vectors(spark, sf), LOW).select("a", "b", F.md5(F.concat(F.least(a, b), F.greatest(a, b)).cast("binary")).alias("pair_key"))
