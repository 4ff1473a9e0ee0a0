"""Code graphs: files, modules, classes, functions and their relations from Python sources.

Each source is parsed by itself in an Arrow-batched stage.  Ids are hashes of
path, type and name, so a graph is the same on every run and a task that runs
again changes nothing.  A source that doesn't parse gives one ``error`` row; a
null source counts as empty.
"""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = (
    "path string, row string, id string, kind string, content string, importance double, name string, lineno int, end_lineno int, "
    "is_async boolean, docstring string, parent string, external boolean, source_id string, target_id string, weight double"
)
_ARROW = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_()}
_SCHEMA = pa.schema([(n, _ARROW[t]) for n, t in map(str.split, SCHEMA.split(", "))])
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


class _Graph:
    """Rows of one file: nodes by id, edges without repeats."""

    def __init__(self, path: str):
        self.path, self.nodes, self.edges = path, {}, {}

    def node(self, kind: str, name: str, content: str, importance: float = 0.7, **more) -> str:
        scope = "external" if more.get("external") else self.path
        key = hashlib.sha1(f"{scope}\n{kind}\n{name}".encode()).hexdigest()
        self.nodes[key] = {"row": "node", "id": key, "kind": kind, "name": name, "content": content, "importance": importance, "external": False} | more
        return key

    def edge(self, kind: str, source: str, target: str, weight: float = 1.0) -> None:
        self.edges.setdefault((kind, source, target), {"row": "edge", "kind": kind, "source_id": source, "target_id": target, "weight": weight})


def _definition(graph: _Graph, d: ast.AST, owner: str, inside: str | None = None) -> str:
    doc = ast.get_docstring(d) or ""
    is_class = isinstance(d, ast.ClassDef)
    label = f"Class: {d.name}" if is_class else f"Method: {inside}.{d.name}" if inside else f"Function: {d.name}"
    more = {} if is_class else {"is_async": isinstance(d, ast.AsyncFunctionDef), "parent": inside}
    key = graph.node("class" if is_class else "function", f"{inside}.{d.name}" if inside else d.name, doc or label, lineno=d.lineno, end_lineno=d.end_lineno, docstring=doc, **more)
    graph.edge("defines", owner, key)
    return key


def _called(f: ast.AST) -> set[str]:
    heads = (c.func for c in ast.walk(f) if isinstance(c, ast.Call))
    return {h.id if isinstance(h, ast.Name) else h.attr for h in heads if isinstance(h, (ast.Name, ast.Attribute))}


def graph_of(path: str, source: str) -> list[dict]:
    """Node and edge rows of one source."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [{"row": "error", "kind": type(e).__name__, "content": str(e)}]
    g, file = _Graph(path), PurePosixPath(path)
    module = g.node("module", file.stem, f"Module: {file.stem}", 0.3, docstring=ast.get_docstring(tree) or "")
    g.edge("defines", g.node("code_file", file.name, f"Code file: {file.name}", 0.3), module)
    wanted = [n for i in ast.walk(tree) if isinstance(i, ast.Import) for n in (a.name for a in i.names)]
    wanted += [i.module or "" for i in ast.walk(tree) if isinstance(i, ast.ImportFrom)]
    for name in wanted:
        g.edge("imports", module, g.node("module", name, f"Module: {name}", external=True))
    known: dict[str, str] = {}
    for d in tree.body:
        if isinstance(d, _FUNCTIONS):
            known[d.name] = _definition(g, d, module)
        elif isinstance(d, ast.ClassDef):
            known[d.name] = own = _definition(g, d, module)
            for base in map(ast.unparse, d.bases):
                g.edge("inherits", own, g.node("class", base, f"Class: {base}", external=True))
            for m in (m for m in d.body if isinstance(m, _FUNCTIONS)):
                known[m.name] = known[f"{d.name}.{m.name}"] = _definition(g, m, own, d.name)
    for f in (f for f in ast.walk(tree) if isinstance(f, _FUNCTIONS) and f.name in known):
        for target in sorted({known[c] for c in _called(f) if c in known} - {known[f.name]}):
            g.edge("calls", known[f.name], target, 0.9)
    return [*g.nodes.values(), *g.edges.values()]


def code_graph(files: DataFrame, path_col: str = "path", source_col: str = "source") -> DataFrame:
    """Node, edge and error rows of all files (path, source)."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [{"path": p} | r for p, s in zip(*(c.to_pylist() for c in batch.columns)) for r in graph_of(p or "", s or "")]
            yield pa.RecordBatch.from_pylist(made, schema=_SCHEMA)

    return files.select(path_col, source_col).mapInArrow(stage, SCHEMA)
