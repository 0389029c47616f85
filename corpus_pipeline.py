"""A training-corpus pipeline over ``documents``: each stage works on all that the one before has kept.

``STAGES`` are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of ``documents``. ``run`` writes each stage's rows to the shared folder, reads them again, and deletes those of the stage before.
SQL cannot express fingerprints, edit neighbourhoods and token ids together, so ``ORACLE_SQL`` is None and the
tests compare the stages with brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tracewell
from tracewell.llm import decontaminate, langid, linededup, packing, queries, simhash
from tracewell.llm.common import discard, in_fold, materialize, read_table

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``lang`` becomes the language found; documents without one (no text, or no letter in it) go. The model learns from three of four folds."""
    return langid.keep_identified(docs, langid.train(docs.where(~in_fold(F.col("doc_id"), 4, 2))), lang_col="lang" if "lang" in docs.columns else None)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line equals, or comes within an edit of, go; n_chars follows. Every document stays."""
    done = linededup.dedup_lines(docs)
    return done.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))) if "n_chars" in docs.columns else done


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of fingerprints within three bits, the document with the least id stays."""
    return simhash.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which an 8-word window of any benchmark item occurs go."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"), min_items=1)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of what is left, in sequences of at most 2048 tokens."""
    return packing.pack(docs, queries.vocabulary())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole of ``documents``."""
    tracewell.ship(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)
    return docs
