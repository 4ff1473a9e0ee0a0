"""Memory of the pipeline's Python workers, and of the JVM's side of their pipes, is bounded."""

import os
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("recollect.llm")

import corpus_pipeline  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from recollect.llm import packing, runtime  # noqa: E402

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Texts of 24 MB, most of whose words are new; prints the MB that encoding them adds to the worker's highest use.
_WORKER = """
import random, resource, sys
sys.path.insert(0, sys.argv[1])
import public_tokenizers, pyarrow as pa
from recollect.llm import blocks, packing
high = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
tok = packing.Tokenizer(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
pick = random.Random(1)
make = lambda: [" ".join("%x%x-%x" % (pick.getrandbits(28), i, j) if j % 4 == 0 else "".join(pick.choices("etaoinsr", k=9)) for j in range(200)) for i in range(500)]
tok.encode_block(pa.array(make()[:9])); before = high()
for _ in range(3):
    col = pa.array([t for _ in range(8) for t in make()])
    for lo, hi, _, _ in blocks.blocks(col, packing.BLOCK_BYTES):
        tok.encode_block(col.slice(lo, hi - lo))
print(high() - before)
"""


def test_a_packing_worker_stays_small():
    got = subprocess.run([sys.executable, "-c", _WORKER, ROOT], capture_output=True, text=True, timeout=300, check=True).stdout
    assert float(got) < 200


def test_library_gets_runs_of_bounded_size():
    chunks = ["a" * n for n in (3, 3, 9, 1, 1, 1, 1)]
    runs = list(packing._runs(chunks, 4))
    assert sum(runs, []) == chunks and runs == [["aaa"], ["aaa"], ["a" * 9], ["a"] * 4]
    assert list(packing._runs([], 4)) == []


def _largest(d):
    return runtime.map_text(d, lambda col: [pa.array([col.nbytes] * len(col), pa.int64())], [("b", "bigint")]).agg(F.max("b")).first()[0]


def test_batches_are_bounded_in_bytes(spark):
    own = spark.conf.get(runtime.BATCH_KEY)
    d = spark.range(0, 9000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab"), 1000).alias("text"), F.lit("en").alias("lang"))
    assert _largest(d) > 10 << 20
    try:
        with runtime.small_batches(spark):
            assert _largest(d) < 5 << 20
        assert spark.conf.get(runtime.BATCH_KEY) == own
        corpus_pipeline.keep_identified(spark, d.limit(3), "")
        assert _largest(d) < 5 << 20
    finally:
        spark.conf.set(runtime.BATCH_KEY, own)


def test_what_a_block_knows_outlives_a_full_memo(monkeypatch):
    """A memo that starts anew keeps the ids of the block's known chunks; none is merged twice in a row."""
    import public_tokenizers
    from tokenizers import Tokenizer as Library

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = packing.Tokenizer(open(path, encoding="utf-8").read(), memo=40)
    learned, learn = [], tok._learn
    monkeypatch.setattr(tok, "_learn", lambda chunks: learned.append(list(chunks)) or learn(chunks))
    often = "The same Words, again: and naïve 42 日本"
    texts = [f"{often} " + " ".join(f"rare{chr(97 + k)}{chr(97 + i)}" for i in range(20)) for k in range(6)]
    library = Library.from_file(path)
    assert [np.frombuffer(x, np.uint32).tolist() for t in texts for x in tok.encode([t])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(tok.memo) <= 80
    assert not {c for chunks in learned[1:] for c in chunks} & set(often.split())
