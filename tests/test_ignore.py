"""Ignore patterns on relative paths."""

from pyspark.sql import functions as F

from recollect.sources.ignore import ignored

PATTERNS = ["# note", "", "*.log", "!keep.log", "/top.txt", "tmp/", "docs/**/x.md", "a?c.py", "[ab].c", "src/gen"]
SKIP = ["x.log", "d/y.log", "top.txt", "tmp/a", "d/tmp/b", "docs/x.md", "docs/p/q/x.md", "abc.py", "d/b.c", "src/gen", "src/gen/k.py", "node_modules/m.js", "d/.git/config", "p.egg-info/PKG"]
STAY = ["keep.log", "d/top.txt", "tmp", "x.md", "abbc.py", "c.c", "d/src/gen", "log", "x.logs", "outer/a.py"]


def test_ignored(spark):
    d = spark.createDataFrame([(p,) for p in SKIP + STAY + [None]], "path string")
    got = {r.path: r.skip for r in d.select("path", ignored(F.col("path"), PATTERNS).alias("skip")).collect()}
    assert {p for p, s in got.items() if s} == set(SKIP)
