"""A corpus pipeline: toxicity, language, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and reread as the next stage's documents.  All but the last return
the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from recollect.llm import language_id, near_copies, packing, runtime, toxicity
from recollect.llm.runtime import crc_of_id
from pyspark.sql import functions as F


def _session(spark: SparkSession) -> None:
    """Arrow batches stay small for the rest of the session: a stage's result is computed after it has returned."""
    spark.conf.set(runtime.BATCH_KEY, runtime.BATCH_BYTES)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go.

    It learns from the labels of ``sf_dir`` whose documents are among ``docs``.
    """
    _session(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, F.pmod(crc_of_id(), F.lit(5)) != 0)
    return toxicity.keep_clean(docs, model)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that are in no language, or in none with a probability of one half."""
    _session(spark)
    model = language_id.model_of(language_id.count(docs, F.pmod(crc_of_id(), F.lit(4)) != 2))
    return language_id.keep_identified(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id stays.

    SimHash with multi-index hashing as in ``simhash``, with fingerprints wide
    enough for five-word shingles at a similarity of 0.8.
    """
    _session(spark)
    return near_copies.keep_first(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of the remaining documents in training sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("language_id", keep_identified), ("simhash_dedup", drop_near_duplicates), ("packing", pack)]

#: The stages learn, hash and search, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is a written table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = runtime.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
