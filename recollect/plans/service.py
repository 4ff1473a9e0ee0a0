"""Registered queries of search, the write path, indexes, enrichment and text rewrites, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import phrases, text, vectors
from ..operators import consolidation as K
from ..operators import enrichment as N
from ..operators import indexes as I
from ..operators import maintenance as U
from ..operators import memory as M
from ..operators import search as Q
from ..operators import similarity as S
from ..operators import writing as W
from ..sources import tables as T
from ..sources.storage import materialize
from . import upkeep
from .queries import ENTRIES, HASH, LOW, NODES, PAIRS, index_entries, query, r6

_ID = "id::bigint"
RICH = f"""{NODES}, rich AS (SELECT * REPLACE (CASE WHEN {_ID} % 10 = 9 THEN '' ELSE source END AS source), (0.5 + ({_ID} % 5) / 10)::double AS decay_score, {_ID} % 13 AS access_count,
  (1704067200 + ({_ID} * 7919) % 2592000)::double AS last_accessed, CASE WHEN {_ID} % 11 = 0 THEN 'q' || ({_ID} % 7) END AS question_key, CASE WHEN {_ID} % 5 = 1 THEN 'h' || ({_ID} % 40) END AS chunk_hash,
  CASE WHEN {_ID} % 7 = 2 THEN 'c' || ({_ID} % 30) END AS content_hash, CASE WHEN {_ID} % 13 = 4 THEN [({_ID} % 9)::varchar, ({_ID} % 4)::varchar] END AS merged_from,
  CASE WHEN {_ID} % 17 = 6 THEN [({_ID} % 8)::varchar] END AS lineage_summary_ids, CASE WHEN {_ID} % 4 = 3 THEN 'd' || ({_ID} % 30) END AS document_hash, CASE WHEN {_ID} % 4 = 3 THEN {_ID} % 3 END AS chunk,
  CASE WHEN {_ID} % 6 = 5 THEN 'Title ' || id END AS title, CASE WHEN {_ID} % 20 = 9 THEN 'f' || id || '.md' END AS filepath FROM nodes)"""


def rich(spark, sf):
    """Nodes with access columns and typed metadata."""
    i = F.col("id").cast("bigint")
    some = lambda m, r, value: F.when(i % m == r, value)
    name = lambda prefix, m: F.concat(F.lit(prefix), (i % m).cast("string"))
    return T.nodes(spark, sf).withColumns({
        "source": F.when(i % 10 == 9, "").otherwise(F.col("source")),
        "decay_score": 0.5 + (i % 5) / 10,
        "access_count": i % 13,
        "last_accessed": (F.lit(T.EPOCH) + (i * 7919) % 2592000).cast("double"),
        "question_key": some(11, 0, name("q", 7)),
        "chunk_hash": some(5, 1, name("h", 40)),
        "content_hash": some(7, 2, name("c", 30)),
        "merged_from": some(13, 4, F.array((i % 9).cast("string"), (i % 4).cast("string"))),
        "lineage_summary_ids": some(17, 6, F.array((i % 8).cast("string"))),
        "document_hash": some(4, 3, name("d", 30)),
        "chunk": some(4, 3, i % 3),
        "title": some(6, 5, F.concat(F.lit("Title "), "id")),
        "filepath": some(20, 9, F.concat(F.lit("f"), "id", F.lit(".md"))),
    })


_TIER = "CASE tier WHEN 'working' THEN 5 WHEN 'semantic' THEN 4 WHEN 'procedural' THEN 3 WHEN 'episodic' THEN 2 WHEN 'archived' THEN 1 ELSE 0 END"
_BEST = f"score DESC, {_TIER} DESC, importance DESC, last_accessed DESC, id"
_KEY = f"coalesce('question:' || question_key, 'chunk:' || chunk_hash, 'content:' || content_hash, 'merged:' || array_to_string(list_sort(merged_from), ','), 'lineage:' || array_to_string(list_sort(lineage_summary_ids), ','), 'content:' || {HASH.format('content')})"
SEMANTIC = f"""{RICH}, q AS (SELECT vec_id AS query, embedding::double[] AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query, vec_id, list_dot_product(embedding::double[], q) AS score FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rn FROM s), hits AS (SELECT r.query, r.score, n.* FROM r JOIN rich n ON n.id = vec_id::varchar WHERE rn <= 10 AND score >= 0),
sem AS (SELECT * EXCLUDE (dn) FROM (SELECT *, row_number() OVER (PARTITION BY query, {_KEY} ORDER BY {_BEST}) AS dn FROM hits) WHERE dn = 1)"""


def asked(spark, sf):
    """The query set: vectors whose ids are divisible by 50."""
    return T.vectors(spark, sf).where("id % 50 = 0").select(F.col("id").alias("query"), F.col("embedding").alias("query_vector"))


def found(spark, sf):
    return Q.semantic(T.vectors(spark, sf), asked(spark, sf), rich(spark, sf), 10)


@query(f"WITH {RICH}, h AS (SELECT 1 AS query, (length(content) % 7)::double AS score, * FROM rich) SELECT id, score FROM (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY {_BEST}) AS rn FROM h) WHERE rn = 1")
def e1_e2_result_dedupe(spark, sf):
    h = rich(spark, sf).withColumn("query", F.lit(1)).withColumn("score", (F.length("content") % 7).cast("double"))
    return Q.dedupe(h).select("id", "score")


@query(f"WITH {SEMANTIC} SELECT query, id, round(score, 6) AS score FROM sem")
def c1_f5_semantic_search(spark, sf):
    return found(spark, sf).select("query", "id", r6(F.col("score")).alias("score"))


NODE_ENTRIES = "entries AS (SELECT l_orderkey::varchar AS summary_id, l_partkey::varchar AS node_id, l_linenumber AS rank, (l_discount * 10)::double AS weight FROM lineitem)"
NODE_EDGES = """nedges AS (SELECT DISTINCT l_orderkey::varchar AS source_id, l_suppkey::varchar AS target_id, CASE l_returnflag WHEN 'A' THEN 'explains' WHEN 'R' THEN 'relates_to' ELSE 'similar_to' END AS relation_type
  FROM lineitem WHERE l_orderkey::varchar IN (SELECT id FROM nodes) AND l_suppkey::varchar IN (SELECT id FROM nodes))"""


def node_entries(spark, sf):
    return T.table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("summary_id"), F.col("l_partkey").cast("string").alias("node_id"), F.col("l_linenumber").alias("rank"), (F.col("l_discount") * 10).cast("double").alias("weight"))


def node_edges(spark, sf):
    ids = T.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"))
    kind = F.when(F.col("l_returnflag") == "A", "explains").when(F.col("l_returnflag") == "R", "relates_to").otherwise("similar_to")
    e = T.table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("source_id"), F.col("l_suppkey").cast("string").alias("target_id"), kind.alias("relation_type"))
    return e.join(ids, e.source_id == ids.id, "left_semi").join(ids, F.col("target_id") == ids.id, "left_semi").distinct()


EXPANDED = f"""{SEMANTIC}, {NODE_ENTRIES}, {NODE_EDGES}, seeds AS (SELECT * FROM (SELECT query, id, score, node_type, row_number() OVER (PARTITION BY query ORDER BY {_BEST}) AS place FROM sem) WHERE place <= 4),
idx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY summary_id ORDER BY rank, weight DESC, node_id) AS nth FROM entries) WHERE nth <= 20 AND node_id <> summary_id),
via AS (SELECT s.query, s.id AS seed, e.node_id AS id, s.score * 0.9 * greatest(0.1, e.weight) / greatest(1, e.rank) AS score FROM seeds s JOIN idx e ON e.summary_id = s.id WHERE s.node_type = 'summary' AND e.node_id IN (SELECT id FROM rich)),
named AS (SELECT query, id, max(score) AS score FROM via v WHERE NOT EXISTS (SELECT 1 FROM sem x WHERE x.query = v.query AND x.id = v.id) GROUP BY 1, 2),
bare AS (SELECT *, CASE WHEN node_type = 'summary' AND id IN (SELECT summary_id FROM entries) THEN 1000 ELSE 0 END + place AS turn FROM seeds s WHERE NOT EXISTS (SELECT 1 FROM via v WHERE v.query = s.query AND v.seed = s.id)),
step AS (SELECT source_id AS f, target_id AS t FROM nedges UNION SELECT target_id, source_id FROM nedges), one AS (SELECT DISTINCT b.id AS start, t AS id FROM bare b JOIN step ON f = b.id),
around AS (SELECT DISTINCT start, id FROM (SELECT start, id FROM one UNION SELECT start, t FROM one JOIN step ON f = one.id) WHERE id <> start),
walked AS (SELECT b.query, a.id, arg_min(b.score, b.turn) * 0.6 AS score FROM bare b JOIN around a ON a.start = b.id WHERE NOT EXISTS (SELECT 1 FROM sem x WHERE x.query = b.query AND x.id = a.id) AND NOT EXISTS (SELECT 1 FROM named x WHERE x.query = b.query AND x.id = a.id) GROUP BY 1, 2),
every AS (SELECT * FROM sem UNION ALL SELECT m.query, m.score, n.* FROM (SELECT * FROM named UNION ALL SELECT * FROM walked) m JOIN rich n ON n.id = m.id),
expanded AS (SELECT * EXCLUDE (dn) FROM (SELECT *, row_number() OVER (PARTITION BY query, {_KEY} ORDER BY {_BEST}) AS dn FROM every) WHERE dn = 1)"""


@query(f"WITH {EXPANDED} SELECT query, id, round(score, 6) AS score FROM expanded")
def c5_f18_expanded_search(spark, sf):
    e = Q.expand(found(spark, sf), node_entries(spark, sf), node_edges(spark, sf), rich(spark, sf), 10, 2)
    return e.select("query", "id", r6(F.col("score")).alias("score"))


_HEAT = "0.35 * least(1.0, access_count / 10) + 0.30 * pow(2.0, -greatest(0.0, (1706659200 - last_accessed) / 3600) / 12) + 0.20 * decay_score + 0.10 * importance + 0.05 * CASE tier WHEN 'working' THEN 1.0 WHEN 'episodic' THEN 0.75 WHEN 'semantic' THEN 0.55 WHEN 'procedural' THEN 0.5 WHEN 'archived' THEN 0.2 ELSE 0.4 END"


@query(f"WITH {RICH}, h AS (SELECT *, ({_HEAT})::double AS heat FROM rich) SELECT id, round(heat, 6) AS heat_score, CASE WHEN heat >= 0.75 THEN 'hot' WHEN heat >= 0.45 THEN 'warm' ELSE 'cold' END AS temperature, round(greatest(0.0, (1706659200 - last_accessed) / 3600), 3) AS age_hours FROM h")
def h13_heatmap(spark, sf):
    heat = Q.heatmap(T.AS_OF)
    return rich(spark, sf).select("id", *[heat[c].alias(c) for c in ("heat_score", "temperature", "age_hours")])


_LINE = "trim(split_part(regexp_replace(content, '^\\s+|\\s+$', '', 'g'), chr(10), 1), ' ')"
SHAPED = f"""shown AS (SELECT query, id AS node_id, coalesce(title, nullif(source, ''), filepath, CASE WHEN {_LINE} = '' THEN 'Untitled memory' WHEN length({_LINE}) > 80 THEN left({_LINE}, 77) || '...' ELSE {_LINE} END) AS title,
  coalesce(nullif(source, ''), filepath, 'unknown') AS source, CASE WHEN length(content) > 200 THEN rtrim(left(content, 197), ' ') || '...' ELSE content END AS snippet, round(score, 6) AS score, round(({_HEAT})::double, 6) AS heat_score, tier, node_type, tags FROM {{0}})"""


@query(f"""WITH {EXPANDED}, {SHAPED.format('expanded')} SELECT query, node_id, title, source, snippet, score, heat_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY 0.65 * score + 0.35 * heat_score DESC, node_id) AS rank FROM shown
  WHERE tier IN ('working', 'semantic', 'episodic') AND node_type IN ('fact', 'summary') AND NOT contains(lower(source), 'src1')) WHERE rank <= 10""")
def b10_f10_f11_search(spark, sf):
    got = Q.search(T.vectors(spark, sf), asked(spark, sf), rich(spark, sf), node_entries(spark, sf), node_edges(spark, sf), T.AS_OF, 10, 2, sort="hybrid", max_chars=200, sources=["-SRC1"], types=["Fact", "summary"], tiers=["working", "semantic", "EPISODIC"])
    return got.select("query", "node_id", "title", "source", "snippet", "score", "heat_score", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {RICH}, t AS (SELECT *, 1 AS query, 0.0 AS score FROM rich), {SHAPED.format('t')} SELECT node_id, title, source FROM shown")
def b7_b8_titles_and_sources(spark, sf):
    return Q.shaped(rich(spark, sf).withColumn("query", F.lit(1)).withColumn("score", F.lit(0.0)), T.AS_OF).select("node_id", "title", "source")


@query(f"WITH {SEMANTIC}, r2 AS (SELECT *, score + CASE tier WHEN 'working' THEN 0.15 ELSE 0 END + greatest(0.0, (importance - 0.5) * 0.1) AS boosted FROM sem), a AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY boosted DESC, id) AS nth FROM r2) SELECT query, count(*) AS n, string_agg('[' || nth || '] ' || coalesce(nullif(source, ''), filepath, 'unknown') || ' (id:' || id || ')' || chr(10) || 'Excerpt: ' || content, chr(10) || chr(10) ORDER BY nth) AS prompt FROM a WHERE nth <= 4 GROUP BY query")
def f9_h30_context(spark, sf):
    return Q.context(found(spark, sf), 4)


@query(f"WITH {SEMANTIC}, c AS (SELECT *, {_ID} % 3 = 0 AS cited FROM sem) SELECT query, id, cited, row_number() OVER (PARTITION BY query ORDER BY cited DESC, score DESC, id) AS rank FROM c")
def f13_cited_first(spark, sf):
    f = found(spark, sf)
    return Q.cited_first(f, f.where("id % 3 = 0")).select("query", "id", "cited", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {SEMANTIC}, a AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY importance DESC, id) AS nth FROM sem) SELECT query, string_agg('- [' || node_type || '] ' || content, chr(10) ORDER BY nth) AS answer, string_agg(id, ',' ORDER BY nth) AS ids, 0.5::double AS confidence FROM a WHERE nth <= 5 GROUP BY query")
def f19_j6_heuristic_answer(spark, sf):
    return Q.heuristic_answer(found(spark, sf)).withColumn("ids", F.concat_ws(",", "ids"))


@query("""WITH q AS (SELECT vec_id AS query, embedding::double[] AS q, sqrt(list_dot_product(embedding::double[], embedding::double[])) AS m FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query, vec_id AS id, list_dot_product(embedding::double[], q) / m / sqrt(list_dot_product(embedding::double[], embedding::double[])) AS score FROM embeddings, q) SELECT query, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rn FROM s) WHERE rn <= 4""")
def f20_naive_vector_search(spark, sf):
    return Q.naive_top_k(T.vectors(spark, sf), asked(spark, sf), 4).select("query", "id", r6(F.col("score")).alias("score"))


@query(f"WITH {NODES} SELECT id FROM nodes WHERE contains(lower(content), 'license') ORDER BY created_at, id LIMIT 10")
def b24_substring_search(spark, sf):
    return Q.substring(T.nodes(spark, sf, rated=False), "License", 10).select("id")


_SHARE = "(CASE WHEN contains(lower(content), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(content), 'license') THEN 1 ELSE 0 END + CASE WHEN contains(lower(content), 'mit') THEN 1 ELSE 0 END) / 3.0"


@query(f"WITH {NODES}, s AS (SELECT id, ({_SHARE})::double AS score FROM nodes WHERE id NOT IN (SELECT vec_id::varchar FROM embeddings WHERE label <> 0)) SELECT id, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY s.score DESC, id LIMIT 64")
def f4_h6_lexical_shortlist(spark, sf):
    """The index holds the vectors of all classes but one; its rows are still to be embedded."""
    v = T.vectors(spark, sf).where("label <> 0").select(F.col("id").cast("string").alias("id"), "embedding")
    return Q.shortlist(T.nodes(spark, sf, rated=False).join(v, "id", "left"), "the MIT license", 10).select("id", r6(F.col("score")).alias("score"))


@query(f"WITH {NODES}, v AS (SELECT vec_id::varchar AS id FROM embeddings), j AS (SELECT n.*, v.id IS NOT NULL AS embedded FROM nodes n LEFT JOIN v ON n.id = v.id) SELECT id, tier <> 'archived' AND NOT (node_type = 'summary' AND source IN ('agent-reflection', 'agent-maintenance')) AS active, embedded AND NOT pinned AS mergeable, embedded AND node_type <> 'summary' AS synthesisable, node_type = 'concept' OR (node_type = 'fact' AND pinned) AS bridge FROM j")
def b11_b16_predicates(spark, sf):
    v = T.vectors(spark, sf).select(F.col("id").cast("string").alias("id"), "embedding")
    return T.nodes(spark, sf, rated=False).join(v, "id", "left").select("id", M.active().alias("active"), M.mergeable().alias("mergeable"), M.synthesisable().alias("synthesisable"), N.bridge_candidate().alias("bridge"))


_EMPTY = "(" + " OR ".join(f"contains({{0}}, '{p}')".replace("don't", "don''t").replace("couldn't", "couldn''t") for p in phrases.EMPTY_PHRASES) + ")"
ANSWERS = "answers AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'agent-maintenance' ELSE source END AS source, CASE doc_id % 5 WHEN 0 THEN ' {\"a\": 1} ' || text WHEN 1 THEN 'I could not find it. ' || text WHEN 2 THEN 'Label' || chr(10) || chr(10) || '[1] ' || text ELSE text END AS content FROM documents)"


def answers(spark, sf):
    i = F.col("doc_id")
    content = F.when(i % 5 == 0, F.concat(F.lit(' {"a": 1} '), "text")).when(i % 5 == 1, F.concat(F.lit("I could not find it. "), "text")).when(i % 5 == 2, F.concat(F.lit("Label\n\n[1] "), "text")).otherwise(F.col("text"))
    return T.table(spark, sf, "documents").select("doc_id", F.when(i % 3 == 0, "agent-maintenance").otherwise(F.col("source")).alias("source"), content.alias("content"))


@query(f"""WITH {ANSWERS}, t AS (SELECT *, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS b FROM answers), u AS (SELECT *, CASE WHEN contains(b, chr(10) || chr(10)) THEN substring(b, instr(b, chr(10) || chr(10)) + 2) ELSE b END AS body FROM t)
SELECT doc_id, length(content) >= 30 AND NOT starts_with(b, '{{') AND NOT starts_with(b, '[') AND NOT {_EMPTY.format('lower(b)')} AS useful,
  source = 'agent-maintenance' AND (length(b) < 30 OR starts_with(body, '{{') OR starts_with(body, '[') OR starts_with(b, '{{') OR starts_with(b, '[') OR {_EMPTY.format('lower(b)')}) AS garbage FROM u""")
def b14_b15_answers(spark, sf):
    return answers(spark, sf).select("doc_id", phrases.useful_answer(F.col("content")).alias("useful"), phrases.garbage(F.col("source"), F.col("content")).alias("garbage"))


@query("WITH n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'tmp' || p_size || '.txt' WHEN 1 THEN ' ' WHEN 2 THEN 'Upload' ELSE p_brand END AS name FROM part) SELECT p_partkey, regexp_matches(lower(trim(name)), '^tmp[a-z0-9_.-]+$') OR trim(name) = '' OR lower(trim(name)) = 'upload' AS ignored FROM n")
def b18_ignored_sources(spark, sf):
    i = F.col("p_partkey")
    name = F.when(i % 4 == 0, F.concat(F.lit("tmp"), F.col("p_size").cast("string"), F.lit(".txt"))).when(i % 4 == 1, " ").when(i % 4 == 2, "Upload").otherwise(F.col("p_brand"))
    return T.table(spark, sf, "part").select("p_partkey", phrases.ignored_source(name, ("upload",)).alias("ignored"))


LISTS = """statuses AS (SELECT o_custkey::varchar AS summary_id, o_orderkey::varchar AS node_id, o_orderstatus AS st, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS place FROM orders),
legacy AS (SELECT summary_id, node_id, CASE st WHEN 'O' THEN 'summarizes' WHEN 'F' THEN 'references' ELSE 'derived_from' END AS relation, CASE st WHEN 'O' THEN 'support' WHEN 'F' THEN 'focus' ELSE 'source' END AS role, 'out' AS direction, place AS rank, CASE st WHEN 'F' THEN 0.8 ELSE 1.0 END::double AS weight FROM statuses)"""


def summaries_with_lists(spark, sf):
    ids = lambda st: F.transform(F.array_sort(F.collect_list(F.when(F.col("o_orderstatus") == st, F.col("o_orderkey")))), lambda x: x.cast("string"))
    return T.table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("summary_id")).agg(ids("O").alias("supporting_node_ids"), ids("F").alias("focus_node_ids"), ids("P").alias("merged_from"))


@query(f"WITH {LISTS} SELECT * FROM legacy")
def g3_legacy_entries(spark, sf):
    return I.from_lists(summaries_with_lists(spark, sf)).withColumn("rank", F.col("rank").cast("bigint"))


@query("SELECT o_custkey::varchar AS summary_id, sha1('summary:' || o_custkey || '|kind:manual|source:agent|content:|' || string_agg(DISTINCT 'node:' || o_orderkey, '|' ORDER BY 'node:' || o_orderkey)) AS snapshot FROM orders GROUP BY o_custkey")
def h27_snapshots(spark, sf):
    s = summaries_with_lists(spark, sf)
    ids = F.concat("supporting_node_ids", "focus_node_ids", "merged_from")
    return s.select("summary_id", I.snapshot(F.col("summary_id"), F.lit("manual"), F.lit("agent"), F.lit(None), ids).alias("snapshot"))


@query(f"WITH idx AS (WITH {ENTRIES}), f AS (SELECT summary_id, node_id, min(pos) AS pos FROM idx WHERE node_id <> summary_id::varchar GROUP BY 1, 2) SELECT summary_id, node_id, row_number() OVER (PARTITION BY summary_id ORDER BY pos) AS at FROM f")
def b22_c24_related_ids(spark, sf):
    return I.related_ids(index_entries(spark, sf)).withColumn("at", F.col("at").cast("bigint"))


_SEMANTIC_SET = "(" + ", ".join(f"'{r}'" for r in N.SEMANTIC) + ")"


@query(f"WITH {NODES}, {NODE_EDGES}, {PAIRS}, p AS (SELECT a::varchar AS source_id, b::varchar AS target_id FROM pairs WHERE s >= 0.35), k AS (SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b FROM nedges WHERE relation_type IN {_SEMANTIC_SET}) SELECT source_id, target_id FROM p WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.a = least(source_id, target_id) AND k.b = greatest(source_id, target_id))")
def c10_unenriched_pairs(spark, sf):
    p = S.pairs(T.vectors(spark, sf), 0.35).select(F.col("a").cast("string").alias("source_id"), F.col("b").cast("string").alias("target_id"))
    return N.unenriched(p, node_edges(spark, sf))


TYPED = f"typed AS (SELECT id, pinned, (['code_file', 'function', 'concept', 'decision', 'fact', 'summary', 'class'])[{_ID} % 7 + 1] AS node_type, {_ID} % 50 = 0 AS new FROM nodes), kinds AS (SELECT *, node_type IN ('code_file', 'function', 'class') AS code, node_type IN ('concept', 'decision') OR (node_type = 'fact' AND pinned) AS bridge FROM typed)"


@query(f"WITH {NODES}, {TYPED} SELECT a.id AS source_id, b.id AS target_id FROM kinds a, kinds b WHERE a.new AND ((NOT b.new AND ((a.code AND b.bridge) OR (a.bridge AND b.code))) OR (b.new AND a.bridge AND b.bridge AND a.id < b.id))")
def c12_cross_type_pairs(spark, sf):
    i = F.col("id").cast("bigint")
    names = F.array(*map(F.lit, ("code_file", "function", "concept", "decision", "fact", "summary", "class")))
    n = T.nodes(spark, sf, rated=False).withColumn("node_type", F.element_at(names, (i % 7 + 1).cast("int")))
    return N.cross_type_pairs(n.where(i % 50 == 0), n.where(i % 50 != 0))


JUDGED_PAIRS = "judged AS (SELECT l_orderkey AS source_id, l_partkey AS target_id, lower(trim(CASE l_linenumber % 5 WHEN 0 THEN 'Explains ' WHEN 1 THEN 'none' WHEN 2 THEN 'unknown' WHEN 3 THEN 'about' ELSE 'decides' END)) AS relation_type, (l_discount * 10)::double AS confidence FROM lineitem), good AS (SELECT *, relation_type IN ('explains', 'about', 'decides') AND confidence <> 0 AS made FROM judged)"


def judged_pairs(spark, sf):
    i = F.col("l_linenumber") % 5
    relation = F.when(i == 0, "Explains ").when(i == 1, "none").when(i == 2, "unknown").when(i == 3, "about").otherwise("decides")
    return N.judged_edges(T.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id"), relation.alias("relation"), (F.col("l_discount") * 10).cast("double").alias("confidence")))


@query(f"WITH {JUDGED_PAIRS} SELECT source_id, target_id, relation_type, round(confidence, 6) AS weight, CASE WHEN confidence < 0.5 THEN 'ambiguous' ELSE 'inferred' END AS provenance FROM good WHERE made")
def h28_h32_judged_edges(spark, sf):
    return judged_pairs(spark, sf)[0].withColumn("weight", r6(F.col("weight")))


@query(f"WITH {JUDGED_PAIRS} SELECT count(*) AS asked, count(*) FILTER (NOT made) AS no_relation, count(*) FILTER (made AND confidence < 0.5) AS ambiguous, count(*) FILTER (made) AS created FROM good")
def d26_enrichment_report(spark, sf):
    return judged_pairs(spark, sf)[1]


@query(f"WITH {PAIRS} SELECT a AS source_id, b AS target_id, 'relates_to' AS relation_type, round(s, 6) AS weight, CASE WHEN s >= 0.8 THEN 0.95 WHEN s >= 0.7 THEN 0.9 WHEN s >= 0.6 THEN 0.87 ELSE 0.82 END::double AS confidence, md5(least(a::varchar, b::varchar) || greatest(a::varchar, b::varchar)) AS pair_key FROM pairs WHERE s >= 0.3 AND s < 0.88 ORDER BY s DESC, a, b LIMIT 20")
def i10_woven_edges(spark, sf):
    none = T.vectors(spark, sf).select(F.col("id").alias("source_id"), F.col("id").alias("target_id")).where("false")
    return N.woven_edges(T.vectors(spark, sf), none, 0.3).withColumn("weight", r6(F.col("weight")))


@query(f"WITH {NODES} SELECT id, source, content FROM nodes WHERE source <> 'src1' UNION ALL SELECT 'n' || id, source, upper(source) FROM nodes WHERE source = 'src1'")
def c17_replaced_source(spark, sf):
    n = T.nodes(spark, sf, rated=False).select("id", "source", "content")
    return W.replace_source(n, n.where("source = 'src1'").select(F.concat(F.lit("n"), "id").alias("id"), "source", F.upper("source").alias("content")))


@query(f"WITH {RICH}, have AS (SELECT question_key, min(id) AS id FROM rich WHERE question_key IS NOT NULL GROUP BY 1) SELECT 'q' || n_nationkey AS question_key, coalesce(h.id, sha256('q' || n_nationkey)) AS id, n_name AS content, CASE WHEN h.id IS NULL THEN 'insert' ELSE 'update' END AS action FROM nation LEFT JOIN have h ON h.question_key = 'q' || n_nationkey")
def c22_upsert_by_key(spark, sf):
    new = T.table(spark, sf, "nation").select(F.concat(F.lit("q"), F.col("n_nationkey").cast("string")).alias("question_key"), F.col("n_name").alias("content"))
    return W.upsert_by_key(rich(spark, sf), new, "question_key")


@query("""WITH old AS (SELECT c_custkey AS id, 'c:' || c_custkey AS source_id, 'n:' || c_nationkey AS target_id, 1.0::double AS weight FROM customer),
new AS (SELECT c_custkey AS id, 'c:' || c_custkey AS source_id, 'n:' || (c_nationkey + 5) AS target_id, least(1.0, greatest(0.0, c_acctbal / 5000))::double AS weight FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey + 5 IN (SELECT n_nationkey FROM nation))
SELECT id, source_id, target_id, round(weight, 6) AS weight FROM (SELECT * FROM new UNION ALL SELECT * FROM old WHERE id NOT IN (SELECT id FROM new))""")
def a6_edge_upsert(spark, sf):
    c = T.table(spark, sf, "customer")
    key = lambda p, k: F.concat(F.lit(p), k.cast("string"))
    edge = lambda d, to, w: d.select(F.col("c_custkey").alias("id"), key("c:", F.col("c_custkey")).alias("source_id"), key("n:", to).alias("target_id"), w.cast("double").alias("weight"), F.lit(1.0).alias("confidence"), F.lit(0).alias("created_at"))
    ids = c.select(key("c:", F.col("c_custkey")).alias("id")).unionByName(T.table(spark, sf, "nation").select(key("n:", F.col("n_nationkey")).alias("id")))
    got = W.upsert_edges(edge(c, F.col("c_nationkey"), F.lit(1.0)), edge(c.where("c_mktsegment = 'BUILDING'"), F.col("c_nationkey") + 5, F.col("c_acctbal") / 5000), ids)
    return got.select("id", "source_id", "target_id", r6(F.col("weight")).alias("weight"))


@query("SELECT sha256('fact' || chr(31) || p_name) AS id, 'fact' AS node_type, 'episodic' AS tier, round(coalesce(CASE WHEN p_size > 25 THEN p_size / 50 END, 0.5), 6)::double AS importance, 1706659200.0::double AS created_at FROM part")
def a25_h17_store(spark, sf):
    new = T.table(spark, sf, "part").select(F.col("p_name").alias("content"), F.when(F.col("p_size") > 25, F.col("p_size") / 50).alias("importance"))
    return W.store(new, T.AS_OF).select("id", "node_type", "tier", r6(F.col("importance")).alias("importance"), "created_at")


@query(f"WITH {RICH}, seen AS (SELECT user_id::varchar AS id, count(*) AS k, max(epoch_us(ts) / 1e6) AS t FROM events GROUP BY 1) SELECT r.id, access_count + coalesce(k, 0) AS access_count, greatest(last_accessed, t) AS last_accessed, round(CASE WHEN k > 0 THEN least(1.0, pow(1.2, k) * (decay_score + 0.5) - 0.5) ELSE decay_score END, 6) AS decay_score FROM rich r LEFT JOIN seen s ON r.id = s.id")
def a33_h10_touch(spark, sf):
    log = T.access_log(spark, sf).select(F.col("node_id").cast("string").alias("id"), "ts")
    return W.touch(rich(spark, sf), log).select("id", "access_count", "last_accessed", r6(F.col("decay_score")).alias("decay_score"))


@query("SELECT 'nodes' AS kind, count(*) FILTER (c_mktsegment = 'BUILDING') AS deleted FROM customer UNION ALL SELECT 'edges', count(*) FILTER (o_orderpriority = 'BUILDING') FROM orders UNION ALL SELECT 'clusters', count(*) FILTER (r_name = 'BUILDING') FROM region")
def a11_drop_collection(spark, sf):
    own = lambda t, c: T.table(spark, sf, t).select(F.col(c).alias("collection"))
    return W.drop_collection(own("customer", "c_mktsegment"), own("orders", "o_orderpriority"), own("region", "r_name"), "BUILDING")[3]


@query("""WITH m AS (SELECT c_nationkey AS id, 'c' || c_custkey AS node FROM customer WHERE c_mktsegment <> 'BUILDING' UNION SELECT s_nationkey, 's' || s_suppkey FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer))
SELECT n.id, count(m.node) AS size, md5(coalesce(string_agg(m.node, ',' ORDER BY m.node), '')) AS members FROM (SELECT DISTINCT c_nationkey AS id FROM customer) n LEFT JOIN m ON n.id = m.id GROUP BY n.id""")
def a12_a13_cluster_members(spark, sf):
    c = T.table(spark, sf, "customer").select(F.col("c_nationkey").alias("id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node_id"), "c_mktsegment")
    s = T.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node_id"), F.lit("add").alias("action"))
    old = c.groupBy("id").agg(F.collect_list("node_id").alias("node_ids")).withColumn("updated_at", F.lit(0.0))
    got = W.change_members(old, s.unionByName(c.where("c_mktsegment = 'BUILDING'").select("id", "node_id", F.lit("remove").alias("action"))), T.AS_OF)
    return got.select("id", F.col("size").cast("bigint").alias("size"), F.md5(F.concat_ws(",", F.array_sort("node_ids")).cast("binary")).alias("members"))


@query(f"WITH {NODES} SELECT tier, count(*) AS n FROM nodes JOIN embeddings ON id = vec_id::varchar WHERE tier = 'working' GROUP BY tier UNION ALL SELECT 'all', count(*) FROM nodes JOIN embeddings ON id = vec_id::varchar")
def a14_a15_index_rows(spark, sf):
    v = T.vectors(spark, sf).select(F.col("id").cast("string").alias("id"), "embedding")
    n = T.nodes(spark, sf, rated=False).join(v, "id", "left")
    return W.index_rows(n, hot_only=True).select(F.lit("working").alias("tier")).unionByName(W.index_rows(n).select(F.lit("all").alias("tier"))).groupBy("tier").agg(F.count("*").alias("n"))


@query("SELECT event_id AS trace_id, user_id FROM events WHERE event_type = (SELECT min(event_type) FROM events) ORDER BY ts DESC, event_id DESC LIMIT 20")
def a29_newest_traces(spark, sf):
    e = T.table(spark, sf, "events").select(F.col("event_id").alias("trace_id"), "user_id", "event_type", F.col("ts").alias("timestamp"))
    return W.newest_traces(e, event_type=e.agg(F.min("event_type")).first()[0], limit=20).select("trace_id", "user_id")


@query("SELECT user_id AS collection, count(*) AS events, first(event_type ORDER BY ts DESC, event_id DESC) AS last_event FROM events GROUP BY 1")
def d30_status(spark, sf):
    e = T.table(spark, sf, "events").select(F.col("event_id").alias("trace_id"), F.col("user_id").alias("collection"), "event_type", F.col("ts").alias("timestamp"))
    return W.status(e).drop("last")


@query(f"WITH {NODES} SELECT 'type' AS kind, node_type AS name FROM nodes GROUP BY 2 UNION ALL SELECT 'source', source FROM nodes GROUP BY 2")
def d4_distinct_values(spark, sf):
    n = T.nodes(spark, sf, rated=False)
    return n.select(F.explode(F.array(F.struct(F.lit("type").alias("kind"), F.col("node_type").alias("name")), F.struct(F.lit("source").alias("kind"), F.col("source").alias("name")))).alias("x")).select("x.*").distinct()


DUPES = f"""per AS (SELECT source, document_hash, max(last_accessed) AS t FROM rich WHERE source <> '' AND document_hash IS NOT NULL GROUP BY 1, 2), l AS (SELECT source, document_hash AS keep FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY t DESC, document_hash DESC) AS rn FROM per) WHERE rn = 1),
stale AS (SELECT id FROM rich JOIN l ON rich.source = l.source WHERE document_hash <> keep), same AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY coalesce(content_hash, {HASH.format('content')}) ORDER BY importance DESC, created_at, id) AS rn FROM rich WHERE id NOT IN (SELECT id FROM stale)) WHERE rn > 1)"""


@query(f"WITH {RICH}, {DUPES} SELECT id, 'source_version' AS cause FROM stale UNION ALL SELECT id, 'content_hash' FROM same")
def e5_e6_duplicates(spark, sf):
    return W.dedupe_report(rich(spark, sf), time="last_accessed")[0]


@query(f"WITH {RICH}, {DUPES}, c AS (SELECT (SELECT count(*) FROM rich) AS scanned, (SELECT count(*) FROM stale) AS source_version_dupes, (SELECT count(*) FROM same) AS content_hash_dupes) SELECT *, source_version_dupes + content_hash_dupes AS total_duplicates, scanned - source_version_dupes - content_hash_dupes AS remaining FROM c")
def d25_dedupe_report(spark, sf):
    return W.dedupe_report(rich(spark, sf), time="last_accessed")[1]


@query(f"WITH {RICH} SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY coalesce('question:' || question_key, 'document:' || document_hash || ':' || chunk, 'content:' || node_type || ':' || coalesce(content_hash, {HASH.format('content')})) ORDER BY {_TIER} DESC, importance DESC, access_count DESC, last_accessed DESC, id) AS rn FROM rich) WHERE rn > 1")
def e4_full_keys(spark, sf):
    return M.exact_duplicates(rich(spark, sf), pinned=True)


BAND = f"""{NODES}, {PAIRS}, e AS (SELECT a, b FROM pairs WHERE s >= {LOW} UNION SELECT b, a FROM pairs WHERE s >= {LOW}), walk AS (SELECT a AS node, a AS other FROM e UNION SELECT w.node, e.b FROM walk w JOIN e ON e.a = w.other),
c AS (SELECT node, min(other) AS root FROM walk GROUP BY node), sizes AS (SELECT root, count(*) AS size, md5(string_agg(node::varchar, ',' ORDER BY node::varchar)) AS key FROM c GROUP BY root),
sums AS (SELECT x.root, count(*) AS k, sum(p.s) AS s FROM pairs p JOIN c x ON x.node = p.a WHERE p.s >= {LOW} GROUP BY 1), sim AS (SELECT z.root, size, key, (s + (size * (size - 1) / 2 - k) * {LOW}) / (size * (size - 1) / 2) AS similarity FROM sizes z JOIN sums USING (root)),
held AS (SELECT n.*, c.root, row_number() OVER (PARTITION BY root ORDER BY id) AS rank FROM nodes n JOIN c ON n.id = c.node::varchar)"""


def band(spark, sf):
    """(pairs, clusters of them)."""
    p = materialize(S.pairs(T.vectors(spark, sf), LOW), "band")
    return p, S.clusters(p)


@query(f"WITH RECURSIVE {BAND} SELECT root, size, round(similarity, 6) AS similarity FROM sim")
def d9_synthesis_similarity(spark, sf):
    p, labels = band(spark, sf)
    return K.synthesis_similarity(labels, p, LOW).withColumn("similarity", r6(F.col("similarity")))


@query(f"WITH RECURSIVE {BAND}, best AS (SELECT root FROM held GROUP BY root ORDER BY avg(importance) DESC, root LIMIT 5) SELECT node, root FROM c WHERE root IN (SELECT root FROM best)")
def f16_chosen_clusters(spark, sf):
    n = T.nodes(spark, sf).withColumn("id", F.col("id").cast("bigint"))
    return K.chosen_clusters(band(spark, sf)[1], n, 5)


def synthesised(spark, sf):
    p, labels = band(spark, sf)
    return K.synthesise(T.nodes(spark, sf), labels, K.synthesis_similarity(labels, p, LOW), spark.createDataFrame([], "summary_id string, key string"))


@query(f"WITH RECURSIVE {BAND} SELECT 's:' || key AS summary_id, key, size, round(least(0.9, (SELECT max(importance) FROM held h WHERE h.root = sim.root) + 0.05), 6) AS importance, round(similarity, 6) AS similarity, 'insert' AS action FROM sim WHERE root IN (SELECT root FROM held)")
def i7_synthesis_summaries(spark, sf):
    return synthesised(spark, sf)[0].select("summary_id", "key", "size", r6(F.col("importance")).alias("importance"), r6(F.col("similarity")).alias("similarity"), "action")


@query(f"WITH RECURSIVE {BAND} SELECT 's:' || key AS source_id, id AS target_id, round(greatest(0.5, similarity - (rank - 1) * 0.02), 6) AS weight, rank FROM held JOIN sim USING (root)")
def i7_synthesis_edges(spark, sf):
    return synthesised(spark, sf)[1].select("source_id", "target_id", r6(F.col("weight")).alias("weight"), F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {NODES}, k AS (SELECT 'nation ' || c_nationkey AS cluster, 'c' || c_custkey AS node_id FROM customer) SELECT * FROM k UNION ALL SELECT 'working_memory', id FROM nodes WHERE tier = 'working'")
def i8_working_cluster(spark, sf):
    k = T.table(spark, sf, "customer").select(F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("cluster"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node_id"))
    return W.working_cluster(T.nodes(spark, sf, rated=False), k.unionByName(spark.createDataFrame([("working_memory", "stale")], "cluster string, node_id string")))


@query(f"""WITH {RICH}, {NODE_ENTRIES}, {NODE_EDGES}, top AS (SELECT id, node_type, access_count, row_number() OVER (ORDER BY access_count DESC, id) AS place FROM rich WHERE tier = 'working' ORDER BY access_count DESC, id LIMIT 10),
idx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY summary_id ORDER BY rank, weight DESC, node_id) AS nth FROM entries) WHERE nth <= 20 AND node_id NOT IN (SELECT id FROM rich WHERE tier = 'working')),
via AS (SELECT t.id AS seed, n.id, n.pinned, n.importance, (1 + least(0.5, t.access_count / 50)) * greatest(0.1, weight) / greatest(1, rank) AS score FROM top t JOIN idx e ON e.summary_id = t.id JOIN rich n ON n.id = e.node_id WHERE t.node_type = 'summary'),
named AS (SELECT id, max(score) AS score, max(importance) AS importance, 0 AS kind, 0 AS place FROM via WHERE NOT pinned GROUP BY id), two AS (SELECT source_id AS f, target_id AS t FROM nedges UNION SELECT target_id, source_id FROM nedges),
near AS (SELECT t.t AS id, min(place) AS place FROM top JOIN two t ON t.f = top.id WHERE top.id NOT IN (SELECT seed FROM via) GROUP BY 1),
both_ AS (SELECT * FROM named UNION ALL SELECT n.id, NULL, n.importance, 1, place FROM near JOIN rich n ON n.id = near.id WHERE NOT n.pinned AND n.tier <> 'working' AND n.id NOT IN (SELECT id FROM named))
SELECT id, round(score, 6) AS score, round(least(1.0, importance + 0.03), 6) AS importance FROM both_ ORDER BY kind, both_.score DESC NULLS LAST, place, id LIMIT 20""")
def c20_i11_fan_out(spark, sf):
    n = rich(spark, sf)
    got = N.fan_out(n.where("tier = 'working'"), node_entries(spark, sf), node_edges(spark, sf), n)
    return got.select("id", r6(F.col("score")).alias("score"), r6(F.col("importance")).alias("importance"))


@query(f"WITH {NODES}, f AS (SELECT l_orderkey AS key, l_partkey::varchar AS id, min(l_linenumber) AS rank FROM lineitem GROUP BY 1, 2), a AS (SELECT f.key, f.id, row_number() OVER (PARTITION BY f.key ORDER BY f.rank, f.id) AS nth FROM f JOIN nodes n ON n.id = f.id WHERE tier <> 'archived' AND NOT (node_type = 'summary' AND n.source = 'agent-maintenance')) SELECT key, id, nth AS at FROM a WHERE nth <= 4")
def f17_support_nodes(spark, sf):
    c = T.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_partkey").cast("string").alias("id"), F.col("l_linenumber").alias("rank"))
    return N.support_nodes(c, T.nodes(spark, sf, rated=False)).withColumn("at", F.col("at").cast("bigint"))


_STEM = "regexp_replace(trim({0}), '\\?+$', '')"
_REST = "regexp_replace(substring({0}, instr({0}, ' ') + 1), '\\?+$', '')"


def _follow(q: str) -> str:
    low = f"lower(trim({q}))"
    return f"""CASE WHEN starts_with({low}, 'what ') OR starts_with({low}, 'which ') THEN 'How is ' || {_REST.format(q)} || ' configured and what are the available options?'
WHEN starts_with({low}, 'how ') THEN 'What are the exact steps and code needed to ' || regexp_replace(substring({q}, 5), '\\?+$', '') || '?' WHEN starts_with({low}, 'where ') OR starts_with({low}, 'when ') THEN 'Why does ' || {_REST.format(q)} || ' work this way, and are there edge cases to know about?'
WHEN length({q}) > 20 THEN 'What are the implementation details and configuration options for: ' || regexp_replace({q}, '\\?+$', '') || '?' ELSE '' END"""


_PREFIX = "(['What ', 'how ', 'Where ', 'which ', '', 'Summarize '])[turn % 6 + 1]"
QUESTIONS = f"questions AS (SELECT conv_id, turn, {_PREFIX} || text || '?' AS question FROM conversations)"


def questions(spark, sf):
    prefix = F.element_at(F.array(*map(F.lit, ("What ", "how ", "Where ", "which ", "", "Summarize "))), (F.col("turn") % 6 + 1).cast("int"))
    return T.table(spark, sf, "conversations").select("conv_id", "turn", F.concat(prefix, "text", F.lit("?")).alias("question"))


@query(f"WITH {QUESTIONS} SELECT conv_id, turn, {_follow('question')} AS follow_up, sha1(lower(regexp_replace(question, '^\\s+|\\s+$', '', 'g'))) AS question_key FROM questions")
def h20_h26_follow_ups(spark, sf):
    return questions(spark, sf).select("conv_id", "turn", phrases.follow_up(F.col("question")).alias("follow_up"), phrases.question_key(F.col("question")).alias("question_key"))


_GENERATED = "(" + " OR ".join(f"contains(low, '{p}')" for p in phrases.GENERATED_PHRASES) + ")"


@query(f"""WITH {QUESTIONS}, p AS (SELECT conv_id || ':' || turn AS id, conv_id * 1000 + turn AS created_at, (0.1 * (turn % 10))::double AS importance, regexp_replace(question, '^\\s+|\\s+$', '', 'g') AS q FROM questions WHERE length(question) >= 10), l AS (SELECT *, lower(q) AS low FROM p),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY low ORDER BY created_at, id) AS rn FROM l WHERE NOT {_GENERATED}) WHERE rn = 1 ORDER BY created_at, id LIMIT 4), w AS (SELECT *, regexp_replace(q, '\\?+$', '') AS words FROM f)
SELECT {_follow('words')} AS question, 'Follow-up: ' || left(words, 60) AS label, round(0.85 + least(0.2, importance * 0.2), 6) AS priority, id FROM w""")
def d29_follow_up_questions(spark, sf):
    n = questions(spark, sf).select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("created_at"), (0.1 * (F.col("turn") % 10)).alias("importance"), "question")
    return U.follow_ups(n).withColumn("priority", r6(F.col("priority")))


_CLEAN = "regexp_replace(regexp_replace(x, '\\s+', ' ', 'g'), '^[ \\-:\\t]+|[ \\-:\\t]+$', '', 'g')"


@query(f"WITH t AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|[\\n\\r]'), lambda x: {_CLEAN}), lambda y: length(y) >= 8 AND length(y) <= 120 AND NOT starts_with(lower(y), 'tmp') AND NOT regexp_full_match(y, '[0-9]+')) AS l FROM documents WHERE text IS NOT NULL) SELECT doc_id, coalesce(l[1], '') AS title FROM t")
def h21_inferred_titles(spark, sf):
    return T.table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", phrases.inferred_title(F.col("text")).alias("title"))


def _user_sql(c: str) -> str:
    for old, new in phrases.USER_WORDS:
        c = f"replace(replace({c}, '{old}', '{new}'), '{old.capitalize()}', '{new.capitalize()}')"
    return c


def _thought_sql(c: str) -> str:
    for pattern, new in phrases.THOUGHT_OPENINGS:
        c = f"regexp_replace({c}, '{pattern}', '{new}', 'i')"
    return c


THOUGHTS = "thoughts AS (SELECT conv_id, turn, (['I need to find ', 'i should ', 'I have to ', 'The collection says ', 'According to the collection, chunk ', ''])[turn % 6 + 1] || text AS thought FROM conversations)"


@query(f"WITH {THOUGHTS}, s AS (SELECT *, trim(regexp_replace(thought, '\\s+', ' ', 'g'), ' ') AS t FROM thoughts), u AS (SELECT *, {_user_sql(_thought_sql('t'))} AS soft FROM s) SELECT conv_id, turn, CASE WHEN t = '' THEN 'Let me think through it a bit more.' WHEN length(soft) > 180 THEN rtrim(left(soft, 177), ' ') || '...' ELSE soft END AS thought FROM u")
def h23_h24_thoughts(spark, sf):
    prefix = F.element_at(F.array(*map(F.lit, ("I need to find ", "i should ", "I have to ", "The collection says ", "According to the collection, chunk ", ""))), (F.col("turn") % 6 + 1).cast("int"))
    return T.table(spark, sf, "conversations").select("conv_id", "turn", phrases.hop_thought(F.concat(prefix, "text"), F.lit("it")).alias("thought"))


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'A' || doc_id WHEN 1 THEN 'cut "' || doc_id || '"' WHEN 2 THEN 'tagged ' || doc_id WHEN 3 THEN 'plain ' || doc_id WHEN 4 THEN 'The reasoning model returned an empty response.' ELSE '' END AS answer,
CASE doc_id % 6 WHEN 0 THEN 0.9 WHEN 1 THEN 0.5 WHEN 2 THEN 0.25 WHEN 3 THEN 0.4 WHEN 4 THEN 0.0 ELSE 0.7 END::double AS confidence, doc_id % 6 NOT IN (2, 5) AS complete, CASE WHEN doc_id % 6 = 2 THEN 'more' END AS next_query FROM documents""")
def h25_replies(spark, sf):
    i = F.col("doc_id")
    s = i.cast("string")
    raw = (
        F.when(i % 6 == 0, F.concat(F.lit('{"answer": "A'), s, F.lit('", "confidence": 0.9}')))
        .when(i % 6 == 1, F.concat(F.lit('{"answer": "cut \\"'), s, F.lit('\\"", "reasoning": "it was cut o')))
        .when(i % 6 == 2, F.concat(F.lit("<reasoning>r</reasoning><answer> tagged "), s, F.lit(" </answer><status>More</status><confidence>0.25</confidence><next_query>more</next_query>")))
        .when(i % 6 == 3, F.concat(F.lit("plain "), s))
        .when(i % 6 == 4, F.lit("  "))
        .otherwise(F.lit('{"status": "continue", "answer": ""}'))
    )
    return T.table(spark, sf, "documents").select("doc_id", phrases.reply(raw).alias("r")).select("doc_id", "r.answer", "r.confidence", "r.complete", "r.next_query")


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-zA-Z0-9_]+')) AS w FROM documents), p AS (SELECT doc_id, ('0x' || left(sha1(w), 2))::int % 32 AS pos, count(*) AS n FROM w GROUP BY 1, 2),
m AS (SELECT doc_id, sqrt(sum(n * n)) AS m FROM p GROUP BY 1) SELECT p.doc_id, pos, round(n / m, 6) AS x FROM p JOIN m ON p.doc_id = m.doc_id""")
def j7_hashed_embedding(spark, sf):
    e = T.table(spark, sf, "documents").select("doc_id", F.posexplode(vectors.hashed(F.col("text"))).alias("pos", "x"))
    return e.where("x > 0").withColumn("x", r6(F.col("x")))


PLAN = f"plan AS (SELECT kind, label FROM sources UNION ALL SELECT kind, label FROM tagged UNION ALL SELECT kind, label FROM gaps UNION ALL SELECT kind, label FROM related UNION ALL SELECT kind, label FROM overview)"
_TERMS = upkeep._SET.format("content")


@query(f"""WITH {upkeep.MARKED}, {upkeep.SOURCES}, {upkeep.TAGS}, {upkeep.GAPS}, {upkeep.RELATED}, {upkeep.OVERVIEW}, {PLAN},
met AS (SELECT 'source_summary' AS kind, source AS label, id, open, importance, created_at FROM marked UNION ALL SELECT DISTINCT 'tag_summary', lower(t), id, open, importance, created_at FROM (SELECT unnest(tags) AS t, * FROM marked)
  UNION ALL SELECT 'topic_gap', unnest({_TERMS}), id, open, importance, created_at FROM marked WHERE open UNION ALL SELECT 'relationship', label, id, open, importance, created_at FROM marked, related WHERE list_has_any({_TERMS}, string_split(label, ' + ')) UNION ALL SELECT 'collection_overview', 'overview', id, open, importance, created_at FROM marked),
own AS (SELECT m.*, bool_or(open) OVER (PARTITION BY kind, label) AS found FROM met m JOIN plan USING (kind, label)),
r AS (SELECT *, row_number() OVER (PARTITION BY kind, label ORDER BY importance DESC, created_at DESC, id) AS nth FROM own WHERE open OR NOT found OR kind = 'relationship')
SELECT kind, label, nth AS at, id FROM r WHERE nth <= CASE kind WHEN 'source_summary' THEN 8 WHEN 'tag_summary' THEN 6 WHEN 'topic_gap' THEN 6 WHEN 'relationship' THEN 8 ELSE 10 END""")
def d16_d27_focus_nodes(spark, sf):
    from functools import reduce

    n = upkeep.marked(spark, sf)
    parts = [U.source_questions(n), U.tag_questions(n), U.gap_questions(n), U.relationship_question(n), U.overview_question(n)]
    return U.focus_nodes(reduce(lambda a, b: a.unionByName(b), [p.select("kind", "label") for p in parts]), n).withColumn("at", F.col("at").cast("bigint"))


@query()
def i9_consolidation_cycle(spark, sf):
    """Nodes after a cycle of merging, synthesis, exact duplicates and pruning; held against its invariants in the tests."""
    return K.cycle(T.nodes(spark, sf), T.vectors(spark, sf), T.AS_OF, merge_at=LOW, lower=0.30)["nodes"].select("id", "tier", "importance", "pinned")


@query()
def f2_f3_approximate_search(spark, sf):
    """The ten nearest of each query vector among the rows of common signatures; recall is measured in the tests."""
    return S.approximate_top_k(T.vectors(spark, sf), asked(spark, sf), 10).select("query", "id", r6(F.col("score")).alias("score"))
