"""Code graphs of small sources."""

from recollect.operators.code_graph import code_graph, graph_of

SOURCE = '"""Doc."""\nimport a as b\nfrom x import y, z\n\nclass K(Base, m.Other):\n    """A class."""\n    async def run(self):\n        return step(self.load())\n    def load(self):\n        return 1\n\ndef step(v):\n    return step(v)\n'


def test_nodes_and_edges():
    rows = graph_of("d/k.py", SOURCE)
    nodes = {r["id"]: r for r in rows if r["row"] == "node"}
    names = {(n["kind"], n["name"]) for n in nodes.values()}
    assert names == {("code_file", "k.py"), ("module", "k"), ("module", "a"), ("module", "x"), ("class", "K"), ("class", "Base"), ("class", "m.Other"), ("function", "K.run"), ("function", "K.load"), ("function", "step")}
    edges = {(r["kind"], nodes[r["source_id"]]["name"], nodes[r["target_id"]]["name"]) for r in rows if r["row"] == "edge"}
    assert edges == {
        ("defines", "k.py", "k"), ("imports", "k", "a"), ("imports", "k", "x"), ("defines", "k", "K"), ("inherits", "K", "Base"), ("inherits", "K", "m.Other"),
        ("defines", "K", "K.run"), ("defines", "K", "K.load"), ("defines", "k", "step"), ("calls", "K.run", "step"), ("calls", "K.run", "K.load"),
    }
    run = next(n for n in nodes.values() if n["name"] == "K.run")
    assert run["is_async"] and run["parent"] == "K" and run["content"] == "Method: K.run"


def test_errors_and_nulls_are_rows(spark):
    got = code_graph(spark.createDataFrame([("bad.py", "def ("), ("none.py", None), ("k.py", SOURCE)], "path string, source string")).toPandas()
    assert list(got[got.path == "bad.py"].row) == ["error"]
    assert sorted(got[got.path == "none.py"].kind) == ["code_file", "defines", "module"]
    assert len(got[got.path == "k.py"]) == len(graph_of("k.py", SOURCE))
    assert code_graph(spark.createDataFrame([], "path string, source string")).count() == 0
