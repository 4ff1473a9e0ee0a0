"""Near copies against all pairs of shingle sets."""

import itertools

import numpy as np
import pytest

pytest.importorskip("recollect.llm")

from recollect.llm import near_copies, runtime  # noqa: E402

SCHEMA = "doc_id bigint, text string, node string, root bigint, fp string"  # names that clash with the operator's own


def sets_of(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    both = len(a & b)
    return a == b or (min(len(a), len(b)) > 0 and both >= 0.8 * (len(a) + len(b) - both))


def brute_links(texts):
    sets = [sets_of(t) for t in texts]
    return {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if alike(sets[i], sets[j])}


def family(rng, vocabulary, words, copies, edits):
    """A text and copies of it with some words replaced."""
    base = rng.choice(vocabulary, words)
    out = [" ".join(base)]
    for _ in range(copies):
        copy = base.copy()
        copy[rng.integers(0, words, edits)] = rng.choice(vocabulary, edits)
        out.append(" ".join(copy))
    return out


def groups(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("bucket", [64, 4])
def test_links_against_all_pairs(spark, bucket):
    rng = np.random.default_rng(5)
    vocabulary = np.array([f"w{i}" for i in range(5000)])
    texts = [t for _ in range(40) for t in family(rng, vocabulary, int(rng.integers(40, 400)), 5, int(rng.integers(1, 8)))]
    texts += family(rng, vocabulary, 300, 150, 3)  # a crowd around one original
    texts += [" ".join(rng.choice(vocabulary, rng.integers(1, 200))) for _ in range(100)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    p = near_copies.plan(len(texts))
    made = runtime.materialize(near_copies.sketches(docs, p, "doc_id", "text"), "made")
    nodes = runtime.materialize(near_copies.distinct(made), "nodes")
    first = {r.node: r.first for r in nodes.collect()}
    edges, roots = near_copies.links(nodes, made, p, bucket=bucket)
    got = {tuple(sorted((first[r.a], first[r.b]))) for r in edges.collect()}
    firsts = set(first.values())
    want = {(i, j) for i, j in brute_links(texts) if i in firsts and j in firsts}
    assert got <= want
    met = groups(len(texts), got)  # links connect what all pairs connect; they needn't be all pairs
    parts = {}
    for r in roots.collect():
        parts.setdefault(r.root, set()).add(first[r.node])
    assert sorted(map(sorted, parts.values())) == sorted(sorted(i for i in firsts if met[i] == m) for m in {met[i] for pair in got for i in pair})
    assert sum(met[a] == met[b] for a, b in want) >= 0.97 * len(want)
    kept = {r.doc_id for r in near_copies.keep_first(docs, bucket=bucket).collect()}
    root = groups(len(texts), brute_links(texts))
    assert set(root) <= kept  # the smallest of a group always stays
    assert len(kept - set(root)) <= 0.05 * (len(texts) - len(set(root)))


def test_kept_rows(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    sentence = "one two three four five six seven eight nine ten"
    rows = [
        (1, None),
        (2, ""),
        (3, " \n"),
        (4, "Short text"),
        (5, "short  TEXT"),
        (6, "other short"),
        (7, sentence),
        (7, sentence),  # a repeated row
        (7, "another text under the same id that has words of its own"),
        (None, "a text without an id that nobody else has written"),
        (None, sentence),
        (None, "a second text without an id and with other words"),
        (8, long),
        (9, long + " more"),
    ]
    docs = spark.createDataFrame([(i, t, "clash", 1, "clash") for i, t in rows], SCHEMA).repartition(2)
    kept = near_copies.keep_first(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, (r.text or "")[:12]) for r in kept.collect()), key=repr)
    want = [(1, ""), (4, "Short text"), (6, "other short"), (7, sentence[:12]), (7, "another text"), (8, long[:12]), (None, "a text witho"), (None, "a second tex")]
    assert got == sorted(want, key=repr)
    assert near_copies.keep_first(docs.limit(0)).count() == 0
    assert near_copies.keep_first(docs.where("doc_id = 6")).count() == 1


def test_plan_grows_with_the_table():
    plans = [near_copies.plan(n) for n in (0, 1, 1000, 10**6, 10**9)]
    assert [p.bits for p in plans] == sorted(p.bits for p in plans) and [p.tables for p in plans] == sorted(p.tables for p in plans)
    assert near_copies.plan(1000, recall=0.5).tables < near_copies.plan(1000, recall=0.99).tables


def test_a_quoted_passage_makes_no_pairs(spark, monkeypatch):
    """Texts with a long common passage and much of their own are no near copies; their pairs would grow with the square of their number."""
    monkeypatch.setattr(near_copies, "SAMPLE", 2)  # a sample of one size misses the passage
    rng = np.random.default_rng(7)
    passage = " ".join(f"p{i}" for i in range(600))
    texts = [f"{passage} " + " ".join(f"w{x}" for x in rng.integers(0, 10**6, 900)) for _ in range(100)]
    texts += [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 900)) for _ in range(50)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    met, near = [], near_copies._near
    monkeypatch.setattr(near_copies, "_near", lambda pairs, *more: met.append(pairs.count()) or near(pairs, *more))
    assert near_copies.keep_first(docs).count() == 150
    assert sum(met) < 500


def test_rows_by_bitmaps(spark):
    wanted = [0, 7, 8, 32767, 32768, (5 << 33) + 3, (5 << 33) + 40_000]
    rows = [*wanted, 1, 6, 9, 32769, 65535, 3, (5 << 33) + 2, (6 << 33) + 3]
    made = spark.createDataFrame([(r, str(r)) for r in rows], "row bigint, name string")
    nodes = spark.createDataFrame([(r,) for r in wanted * 2], "node bigint")
    got = near_copies._of(made, near_copies.bitmaps(nodes), "name")
    assert sorted((r.node, r.name) for r in got.collect()) == [(r, str(r)) for r in sorted(wanted)]
    assert near_copies._of(made, near_copies.bitmaps(nodes.limit(0)), "name").count() == 0
