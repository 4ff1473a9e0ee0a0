"""Text files and folders as rows; chunks with running numbers."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from . import ignore

#: File types that are read as text, and those of code.
TEXT_SUFFIXES = ("txt", "md", "markdown", "rst", "log", "csv", "tsv", "json", "jsonl", "yaml", "yml", "xml", "html", "htm", "py", "js", "ts", "tsx", "jsx", "java", "c", "cc", "cpp", "h", "hpp", "cs", "go", "rs", "sh", "sql", "toml", "ini", "cfg", "conf")
CODE_SUFFIXES = ("py", "js", "ts", "tsx", "jsx", "java", "c", "cc", "cpp", "h", "hpp", "cs", "go", "rs", "sh", "sql")


def suffix(path: Column) -> Column:
    """The lower-case suffix of a path's last part; empty if it has none."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"[^.]\.([^.]+)$", 1))


def supported(path: Column) -> Column:
    return suffix(path).isin(*TEXT_SUFFIXES, "pdf")


def decoded(content: Column) -> Column:
    """Bytes as text; bytes that aren't UTF-8 are dropped."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("\ufffd"), F.lit(""))


def relative(path: Column, root: str) -> Column:
    """A file's path below ``root``."""
    base = root.split("://", 1)[-1].rstrip("/")
    return F.regexp_replace(path, "^(?:[a-z0-9]+:)?/*" + re.escape(base.lstrip("/")) + "/", "")


def ignore_rules(spark: SparkSession, path: str, name: str = ".gitignore") -> list[str]:
    """The lines of a folder's ignore file, through the file system that Spark reads with; none if there is no such file."""
    jvm = spark.sparkContext._jvm
    file = jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/" + name)
    fs = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(file):
        return []
    stream = fs.open(file)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8", "ignore").splitlines()
    finally:
        stream.close()


def folder(spark: SparkSession, path: str, recursive: bool = True, patterns: list[str] = ()) -> DataFrame:
    """(path, suffix, kind, supported, file_hash, content): all files below ``path`` that aren't ignored.

    ``path`` is relative to the folder; ``kind`` is code, text, pdf or other;
    ``content`` is null for files that aren't read as text.  Folders that are
    always skipped, ``patterns``, and those of the ignore file in the folder
    itself decide what is left out.  Spark lists neither hidden nor empty files.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    below = raw.withColumn("path", relative(F.col("path"), path))
    rules = [*patterns, *ignore_rules(spark, path)]
    kept = below.where(~ignore.ignored(F.col("path"), rules)).withColumn("suffix", suffix(F.col("path")))
    is_text = F.col("suffix").isin(*TEXT_SUFFIXES)
    kind = F.when(F.col("suffix").isin(*CODE_SUFFIXES), "code").when(is_text, "text").when(F.col("suffix") == "pdf", "pdf").otherwise("other")
    return kept.select("path", "suffix", kind.alias("kind"), supported(F.col("path")).alias("supported"), F.sha1("content").alias("file_hash"), F.when(is_text, decoded(F.col("content"))).alias("content"))


def report(files: DataFrame, made: DataFrame) -> DataFrame:
    """(processed, skipped, chunks) of a folder's files and the chunks (path) made of them."""
    counts = files.agg(F.count_if("supported").alias("processed"), F.count_if(~F.col("supported")).alias("skipped"))
    return counts.join(made.agg(F.count("*").alias("chunks")))


def pdf_pages(files: DataFrame, reader=None) -> DataFrame:
    """(path, page_number, content): the text of each page of binary PDF files (path, content).

    ``reader`` turns bytes into a list of page texts; by default a PDF library
    is used if one is installed, else this raises on the first file.
    """

    def pages(data: bytes) -> list[str]:
        from io import BytesIO

        from pypdf import PdfReader

        return [p.extract_text() or "" for p in PdfReader(BytesIO(data)).pages]

    read = reader or pages

    def stage(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts = read(data)
                if texts:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(texts)), pa.array(range(1, len(texts) + 1), pa.int32()), pa.array(texts, pa.string())], names=["path", "page_number", "content"])

    return files.select("path", "content").where("content IS NOT NULL").mapInArrow(stage, "path string, page_number int, content string")


def segments(docs: DataFrame) -> DataFrame:
    """Objects with a ``page_content`` or ``text`` column as segments (…, content); blank ones are dropped."""
    have = [c for c in ("page_content", "text") if c in docs.columns]
    return docs.withColumn("content", F.coalesce(*have)).where(F.trim(F.regexp_replace("content", r"(?U)\s+", " ")) != "").drop(*have)


def split_recursive(text_: Column, size: int = 1000) -> Column:
    """Pieces of at most ``size`` characters, cut at the coarsest of paragraph, line, word and character that fits.

    Without overlap; joined again the pieces are the text.
    """

    def cut(parts: Column, separator: str) -> Column:
        small = lambda p: F.length(p) <= size
        broken = F.flatten(F.transform(parts, lambda p: F.when(small(p), F.array(p)).otherwise(F.regexp_extract_all(p, F.lit(separator), F.lit(0)))))
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("last"))
        step = lambda acc, p: F.when(F.length(acc.last) + F.length(p) <= size, F.struct(acc.done.alias("done"), F.concat(acc.last, p).alias("last"))).otherwise(F.struct(F.when(acc.last == "", acc.done).otherwise(F.array_append(acc.done, acc.last)).alias("done"), p.alias("last")))
        return F.aggregate(broken, start, step, lambda acc: F.when(acc.last == "", acc.done).otherwise(F.array_append(acc.done, acc.last)))

    parts = F.array(text_)
    for separator in (r"(?s).*?\n\n|.+$", r"(?s).*?\n|.+$", r"(?s).*? |.+$", r"(?s).{1,%d}" % size):
        parts = cut(parts, separator)
    return F.when(text_.isNotNull(), parts)


def chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(id, chunk, char_start, char_end, content, chunk_hash); blank chunks are skipped and numbers run on without them."""
    made = F.filter(F.transform(text.chunk_starts(F.col(text_col), size, overlap), lambda s: F.struct(s.alias("char_start"), F.substring(F.col(text_col), (s + 1).cast("int"), F.lit(size)).alias("content"))), lambda c: F.trim(F.regexp_replace(c.content, r"\s+", " ")) != "")
    out = docs.select(id_col, F.posexplode(made).alias("chunk", "c")).select(id_col, "chunk", F.col("c.char_start"), (F.col("c.char_start") + F.length("c.content")).alias("char_end"), F.col("c.content").alias("content"))
    return out.withColumn("chunk_hash", text.content_hash(F.col("content")))
