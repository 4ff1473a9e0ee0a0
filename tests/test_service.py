"""Operators beside SQL: sources, streams, the write path, approximate search, absorbing and a whole cycle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.operators import consolidation, enrichment, evaluation, indexes, search, similarity, writing
from recollect.operators import memory as M
from recollect.sources import files
from recollect.sources import tables as T
from recollect.streaming import access


def test_folder_reads_text_and_reports(spark, tmp_path):
    root = tmp_path / "a.b"
    for name, data in {
        "notes.md": b"# Title\nbody",
        "bad.txt": b"ok \xff\x41 end",
        "README": b"no suffix",
        "src/code.PY": b"x = 1",
        "src/logo.png": b"\x89PNG",
        "node_modules/skip.js": b"skip",
        "out.log": b"ignored by pattern",
        "doc.pdf": b"%PDF",
        ".gitignore": b"*.log\n",
        "empty.txt": b"",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    got = {r.path: r for r in files.folder(spark, str(root)).collect()}
    assert set(got) == {"notes.md", "bad.txt", "README", "src/code.PY", "src/logo.png", "doc.pdf"}
    assert got["bad.txt"].content == "ok A end" and got["README"].suffix == ""
    assert (got["src/code.PY"].kind, got["notes.md"].kind, got["doc.pdf"].kind, got["src/logo.png"].kind) == ("code", "text", "pdf", "other")
    assert got["doc.pdf"].supported and not got["src/logo.png"].supported and got["src/logo.png"].content is None
    import hashlib

    assert got["notes.md"].file_hash == hashlib.sha1(b"# Title\nbody").hexdigest()
    f = files.folder(spark, str(root))
    made = files.chunks(f.where("content IS NOT NULL"), "path", "content")
    assert files.report(f, made).first().asDict() == {"processed": 4, "skipped": 2, "chunks": 3}
    assert files.folder(spark, str(root), recursive=False).where("path LIKE 'src/%'").isEmpty()


def test_pdf_pages_and_segments(spark):
    d = spark.createDataFrame([("a", bytearray(b"one|two")), ("b", None), ("c", bytearray(b""))], "path string, content binary")
    got = files.pdf_pages(d, lambda data: [x for x in data.decode().split("|") if x])
    assert sorted(map(tuple, got.collect())) == [("a", 1, "one"), ("a", 2, "two")]
    s = spark.createDataFrame([(1, "page", None), (2, None, "text"), (3, "  \n", None), (4, None, None)], "id int, page_content string, text string")
    assert sorted(map(tuple, files.segments(s).collect())) == [(1, "page"), (2, "text")]


def test_recursive_split_keeps_the_text_within_the_size(spark):
    rng = np.random.default_rng(0)
    texts = ["", "short", "x" * 95] + ["".join(rng.choice(["word ", "\n", "\n\n", "longer-word ", "y" * 40], 30)) for _ in range(30)]
    d = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "id int, t string")
    for i, parts in d.select("id", files.split_recursive(F.col("t"), 40)).collect():
        if i == 99:
            assert parts is None
        else:
            assert "".join(parts) == texts[i] and all(len(p) <= 40 for p in parts)
    (one,) = spark.createDataFrame([("one two.\n\nthree four",)], "t string").select(files.split_recursive(F.col("t"), 12)).first()
    assert one == ["one two.\n\n", "three four"]


def test_streams_give_what_batches_give(spark, sf, tmp_path):
    events = T.table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    for name, f in (("counts", lambda e: access.windowed_counts(e, late="3650 days")), ("gaps", lambda e: access.sessions(e, "6 hours"))):
        q = f(stream).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        try:
            q.awaitTermination(120)
        finally:
            q.stop()
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, f(events).collect()))


def test_approximate_search_finds_nine_of_ten(spark):
    v = T.vectors(spark, "/root/testdata/sf0.01")
    q = v.where("id % 50 = 0").select(F.col("id").alias("query"), F.col("embedding").alias("query_vector"))
    exact = {(r.query, r.id) for r in similarity.top_k_each(v, q, 10).collect()}
    near = {(r.query, r.id) for r in similarity.approximate_top_k(v, q, 10).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_distribution_of_nothing(spark):
    none = spark.createDataFrame([], "id bigint, embedding array<float>")
    assert similarity.distribution(none, (0.5,), 0.3).first().asDict() == {"lo": None, "hi": None, "mean": None, "p50": None, "n": 0}


def test_absorbing_is_a_fold(spark):
    rng = np.random.default_rng(1)
    vec = lambda: [float(x) for x in rng.normal(size=4)]
    s = [("s1", "summary one ", vec()), ("s2", "alone", vec())]
    o = [("s1", f"n{i}", t, vec(), 0.9) for i, t in enumerate([" first ", "summary", "third"])] + [("gone", "n9", "x", vec(), 0.9)]
    schema = "id string, content string, embedding array<double>"
    got = {r.id: r for r in consolidation.absorb(spark.createDataFrame(s, schema), spark.createDataFrame(o, "summary_id string, id string, content string, embedding array<double>, similarity double")).collect()}
    assert got["s1"].content == "summary one | first | third" and got["s2"].content == "alone"
    e = np.array(s[0][2])
    for row in o[:3]:
        e = (e + np.array(row[3])) / 2
        e /= np.linalg.norm(e)
    assert np.allclose(got["s1"].embedding, e) and np.allclose(got["s2"].embedding, s[1][2])


def test_a_touch_is_what_single_accesses_make(spark):
    n = spark.createDataFrame([("a", 1, 5.0, 0.2), ("b", 0, 1.0, 0.9), ("c", 0, 1.0, 0.3)], "id string, access_count int, last_accessed double, decay_score double")
    log = spark.createDataFrame([("a", 7.0), ("a", 6.0), ("a", 9.0), ("b", 0.5), ("x", 1.0)], "id string, ts double")
    got = {r.id: r for r in writing.touch(n, log).collect()}
    d = 0.2
    for _ in range(3):
        d = min(1.0, d * 1.2 + 0.1)
    assert (got["a"].access_count, got["a"].last_accessed) == (4, 9.0) and abs(got["a"].decay_score - d) < 1e-12
    assert got["b"].decay_score == 1.0 and got["b"].last_accessed == 1.0 and got["c"].decay_score == 0.3


def test_upsert_takes_the_last_of_repeated_keys(spark):
    old = spark.createDataFrame([("a", "old", 1), ("b", "old", 1)], "id string, content string, created_at int")
    new = spark.createDataFrame([("a", "x", 5, 1), ("a", "y", 6, 2), ("c", "p", 7, 1), ("c", "q", 8, 1)], "id string, content string, created_at int, v int")
    for _ in range(3):
        got = T.upsert(old, new.orderBy(F.rand()), order="v", keep=("created_at",))
        assert sorted(map(tuple, got.collect())) == [("a", "y", 1), ("b", "old", 1), ("c", "q", 8)]


def test_stored_rows_are_checked(spark):
    good = spark.createDataFrame([("x", None)], "content string, importance double")
    assert writing.store(good, 1.0).first().importance == 0.5
    bad = spark.createDataFrame([("x", 1.5)], "content string, importance double")
    with pytest.raises(Exception, match="out of bounds"):
        writing.store(bad, 1.0).collect()


def test_requests_out_of_bounds():
    search.check_request(["q"], ["c"])
    for bad in ({"queries": []}, {"queries": ["a"] * 6}, {"collections": []}, {"sources": ["s"] * 21}, {"mode": "x"}, {"sort": "x"}, {"k": 0}, {"depth": 9}, {"threshold": 2}):
        with pytest.raises(ValueError):
            search.check_request(**({"queries": ["q"], "collections": ["c"]} | bad))
    assert search.vector_only("semantic", 0, False, "relevance") and not search.vector_only("hybrid", 0, False, "relevance")


def test_summaries_lead_to_their_index_and_others_to_neighbours(spark):
    columns = "query int, id string, score double, content string, node_type string, tier string, importance double, last_accessed double"
    node = lambda i, kind="fact": (i, f"text {i}", kind, "working", 0.5, 1.0)
    n = spark.createDataFrame([node("s", "summary"), node("u", "summary"), node("f"), *map(node, "abcd")], columns.partition(", ")[2].replace("score double, ", ""))
    hits = n.where("id IN ('s', 'u', 'f')").withColumn("query", F.lit(1)).withColumn("score", F.when(F.col("id") == "s", 0.9).when(F.col("id") == "u", 0.8).otherwise(0.7))
    entries = spark.createDataFrame([("s", "a", 1, 1.0), ("s", "b", 2, 0.5), ("s", "gone", 3, 1.0), ("u", "gone", 1, 1.0)], "summary_id string, node_id string, rank int, weight double")
    edges = spark.createDataFrame([("u", "c"), ("f", "c"), ("d", "f"), ("f", "a"), ("s", "d")], "source_id string, target_id string")
    cols = [c.split()[0] for c in columns.split(", ")]
    got = {r.id: round(r.score, 6) for r in search.expand(hits.select(*cols), entries, edges, n, 10, 1).collect()}
    assert got == {"s": 0.9, "u": 0.8, "f": 0.7, "a": 0.81, "b": 0.2025, "c": 0.42, "d": 0.42}


def test_indexes_drop_blank_ids_and_clamp(spark):
    rows = [("s", " a ", "r", "o", "out", -3, -1.0), ("s", "", "r", "o", "out", 1, 1.0), ("s", None, "r", "o", "out", 1, 1.0), ("s", "b", "r", "o", "out", None, None), ("s", "s", "r", "o", "out", 1, 2.0)]
    e = spark.createDataFrame(rows, "summary_id string, node_id string, relation string, role string, direction string, rank int, weight double")
    assert sorted((r.node_id, r["rank"], r.weight, r.pos) for r in evaluation.connection_index(e).collect()) == [("a", 1, 0.0, 3), ("b", 1, 1.0, 2), ("s", 1, 2.0, 1)]
    assert [r.node_id for r in indexes.related_ids(e).orderBy("at").collect()] == ["b", "a"]
    lineage = spark.createDataFrame([("s", ["x"], [("y", 0.5), ("z", None)]), ("t", None, None)], "summary_id string, merged_from array<string>, source_lineage array<struct<node_id string, weight double>>")
    assert sorted((r.node_id, r.role, r["rank"], r.weight) for r in indexes.from_lists(lineage).collect()) == [("x", "source", 1, 1.0), ("y", "lineage", 1, 0.5), ("z", "lineage", 2, 1.0)]


def test_neighbours_keep_their_plan(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (70, 2))]
    edges = spark.createDataFrame([(f"{a}", f"{b}", "x" if a % 2 else "y") for a, b in pairs], "source_id string, target_id string, relation_type string")
    starts = spark.createDataFrame([(f"{i}",) for i in (0, 1, 2)], "id string")
    for relations in ((), ("x",)):
        near = {}
        for a, b in pairs:
            if not relations or a % 2:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
        want = set()
        for s in (0, 1, 2):
            seen, frontier = {s}, {s}
            for hop in range(1, 5):
                frontier = set().union(*(near.get(x, set()) for x in frontier)) - seen
                seen |= frontier
                want |= {(f"{s}", f"{x}", hop) for x in frontier}
        got = M.neighbours(edges, starts, 4, relations=list(relations))
        assert set(map(tuple, got.collect())) == want
        assert got._jdf.queryExecution().analyzed().toString().count("Join") <= 8


def test_a_cycle_loses_no_row_without_saying_so(spark, sf):
    n, v = T.nodes(spark, sf), T.vectors(spark, sf)
    out = consolidation.cycle(n, v, T.AS_OF, merge_at=0.42, lower=0.30)
    after, gone = {r.id for r in out["nodes"].collect()}, [r.id for r in out["deleted"].collect()]
    assert len(gone) == len(set(gone)) and after | set(gone) == {r.id for r in n.select("id").collect()} and not after & set(gone)
    kinds = {r.kind for r in out["summaries"].collect()}
    assert kinds == {"merge", "synthesis"}
    assert out["edges"].join(out["summaries"], out["edges"].source_id == out["summaries"].summary_id, "left_anti").isEmpty()
    assert {r.id for r in out["working"].collect()} == {r.id for r in out["nodes"].where("tier = 'working'").collect()}


def test_compaction_keeps_the_rows(spark, sf, tmp_path):
    d = T.table(spark, sf, "nation").repartition(7)
    got = writing.compact(d, f"{tmp_path}/t")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, d.collect())) and len(list((tmp_path / "t").glob("*.parquet"))) == 1


def test_cross_pairs_are_all_pairs(spark, sf):
    none = spark.createDataFrame([], "id string, node_type string, pinned boolean")
    some = spark.createDataFrame([("a", "function", False), ("b", "fact", True), ("c", "fact", False)], none.schema)
    assert enrichment.cross_type_pairs(none, some).isEmpty()
    assert sorted(map(tuple, enrichment.cross_type_pairs(some, some).collect())) == [("a", "b"), ("b", "a")]
