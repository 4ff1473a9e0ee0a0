"""Shared plumbing: Arrow stages over a text column, shared folders, bounded samples."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Text and results of one Arrow batch of a stage: the text column (no nulls) in, columns out.
Kernel = Callable[[pa.Array], list]


#: Memos that a worker keeps for the tasks of its latest job.
MEMOS: list[dict] = []


def release() -> None:
    """Give back what a reused worker still holds of the jobs before: memos, and memory that is free but kept."""
    for memo in MEMOS:
        memo.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


#: Bytes of an Arrow batch (a longer row is one by itself); small ones take less memory in JVM and worker.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of ``BATCH_BYTES`` in the actions inside."""
    own = spark.conf.get(BATCH_KEY, None)
    spark.conf.set(BATCH_KEY, BATCH_BYTES)
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(BATCH_KEY)
        else:
            spark.conf.set(BATCH_KEY, own)


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package even if the driver found it by ``sys.path`` alone."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known and os.path.isdir(ROOT):
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, known)])
    if ROOT not in sys.path:
        sys.path.append(ROOT)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a fresh one only where none is set (tests).

    With a remote master and no setting there is no folder that all executors
    see, so that is an error rather than a silent machine-local path.
    """
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found:
        known = spark.sparkContext.getCheckpointDir()
        if known:
            found = known
        elif spark.sparkContext.master.startswith("local"):
            import tempfile

            found = "file://" + tempfile.mkdtemp(prefix="recollect-")
            spark.sparkContext.setCheckpointDir(found)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found.rstrip("/")


def materialize(df: DataFrame, name: str = "t", level: int = 3) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage with files that outlive any executor, so a lost
    executor costs the tasks that were running on it and no more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/recollect/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_text(
    df: DataFrame,
    kernel: Kernel,
    fields: list[tuple[str, str]],
    text_col: str = "text",
    keep: tuple[str, ...] | list[str] = ("doc_id",),
    condition: Callable[[list], pa.Array] | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Run ``kernel`` over ``text_col`` in Arrow batches; the result has ``keep`` plus ``fields``.

    Only ``keep`` and the text are read.  Columns travel by position, so input
    columns whose names clash with result columns do no harm.  Null text comes
    to the kernel as the empty string.  ``condition`` may turn the kernel's
    columns into a mask of the rows that stay.  ``rows`` bounds a kernel's rows
    where its results are larger than the text.
    """
    keep = list(keep)
    share_package(df.sparkSession)
    out = T.StructType()
    for i, c in enumerate(keep):
        out.add(f"k{i}", df.schema[c].dataType)
    for i, (_, kind) in enumerate(fields):
        out.add(f"r{i}", T.DataType.fromDDL(kind))
    arrow_types = _arrow_types(out)
    inner = df.select(*[F.col(_q(c)).alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(_q(text_col)).cast("string"), F.lit("")).alias("t"))
    names = [f.name for f in out]
    n = len(keep)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in (b if rows is None else b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows or max(1, b.num_rows))):
            made = kernel(batch.column(n))
            cols = [*(batch.column(i) for i in range(n)), *(x if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in zip(made, arrow_types[n:]))]
            cols = [c if c.type == t else c.cast(t) for c, t in zip(cols, arrow_types)]
            result = pa.RecordBatch.from_arrays(cols, names=names)
            yield result.filter(condition(made)) if condition else result

    return inner.mapInArrow(stage, out).toDF(*keep, *[name for name, _ in fields])


def map_batch(df: DataFrame, kernel: Callable[[list], list], fields: list[tuple[str, str]], keep: list[str]) -> DataFrame:
    """Run ``kernel`` over the columns of Arrow batches; the result has ``keep``, which come first in ``df``, plus ``fields``."""
    share_package(df.sparkSession)
    out = T.StructType([df.schema[c] for c in keep])
    for name, kind in fields:
        out.add(name, T.DataType.fromDDL(kind))
    kinds = _arrow_types(out)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cols = [*batch.columns[: len(keep)], *kernel(batch.columns)]
                yield pa.RecordBatch.from_arrays([c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, kinds)], names=out.names)

    return df.mapInArrow(stage, out)


def _arrow_types(schema: T.StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema]


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def crc_of_id(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(_q(id_col)).cast("string"), F.lit("")).cast("binary"))


def bounded_labels(labels: DataFrame, label: str, train: Column, bound: int, id_col: str = "doc_id", docs: DataFrame | None = None) -> DataFrame:
    """At most ``bound`` labelled ids for which ``train`` holds, by a hash of the id.

    Rows with a null id or label don't count, nor, if ``docs`` is given, ids
    that aren't among its; an id with several labels takes the largest.  The
    bound makes the result small enough to broadcast.
    """
    rows = labels.select(F.col(_q(id_col)).alias("id"), F.col(_q(label)).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull())
    rows = rows.withColumnRenamed("id", id_col).where(train)
    rows = rows.groupBy(id_col).agg(F.max("y").alias("y"))
    if docs is not None:  # ids alone are shuffled
        rows = rows.join(docs.select(F.col(_q(id_col)).alias("_there")).where("_there IS NOT NULL").distinct(), F.col(id_col) == F.col("_there"), "left_semi")
    return rows.orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(bound)


def labelled_texts(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(y, text) of the sampled ids; the sample is bounded, so it is broadcast to the scan."""
    d = docs.select(F.col(_q(id_col)).alias("i"), F.col(_q(text_col)).cast("string").alias("text"))
    s = sample.select(F.col(_q(id_col)).alias("j"), "y")
    return d.join(F.broadcast(s), d.i == s.j).select("y", "text")
