"""Exact deduplication [native] by a tree-merge of sorted digest runs.

Every row belongs to a leaf, dealt row by row and not by its text, so a text that a third of the rows share
is spread over all leaves. A leaf's run is sorted by digest and has one entry per digest. In each round the runs of
``fan_in`` neighbours (two: binomial rounds, as many as the number of leaves has doublings) meet at their parent, run r
at run r div fan_in, and are merged in their order by a sort aggregate: counts add up, and of the identifiers the one
to retain is taken. A run is sharded by its digests, so even the root's run is never in one task. An entry's key is
the whole proof of equality (SHA-256, a second, independent 64-bit hash of the text, and its length), so entries merge
at any level only if all three agree. Then the root's decisions go to the leaves that hold the digest, at most one
entry a leaf, and each row finds its own there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import any_leaf, fresh, leaves, materialize

KEY = ["digest", "check", "bytes"]


def digest_key(content: Column) -> list[Column]:
    """The key columns of a run entry for a binary column."""
    return [F.unhex(F.sha2(content, 256)).alias("digest"), F.xxhash64(content).alias("check"), F.octet_length(content).alias("bytes")]


def merged(runs: DataFrame, n: Column) -> DataFrame:
    """Sorted runs (leaf, *KEY, top, n), merged where leaf and key agree.

    The retained identifier is a structure, which Spark aggregates by sorting and merging, never by hashing: what a
    task hands on is a sorted run, and what it receives are runs to merge.
    """
    return runs.groupBy("leaf", *KEY).agg(F.max("top").alias("top"), F.sum(n).alias("n"))


def tree_merge(rows: DataFrame, n_leaves: int, fan_in: int = 2) -> DataFrame:
    """rows(id, leaf, digest, check, bytes) -> the same rows with keep_id (largest id) and group_size."""
    run = merged(rows.select("leaf", *KEY, F.struct("id").alias("top")), F.lit(1))
    held, width = run.select("leaf", *KEY), n_leaves
    while width > 1:
        width = -(-width // fan_in)
        run = merged(run.withColumn("leaf", F.floor(F.col("leaf") / fan_in)), F.col("n"))
    root = run.select(*KEY, F.col("top.id").alias("keep_id"), F.col("n").alias("group_size"))
    return rows.join(held.join(root, KEY), ["leaf", *KEY])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 2) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty; the row with the largest id stays. A null id is
    below all others; where all ids of a group are null, keep_id is null. Rows repeated with both id and text
    are one document: each is marked kept if that id stays, and each counts in group_size.
    Other columns of ``docs`` are not read. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    content = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), *digest_key(content))
    rows = materialize(rows.withColumn("leaf", any_leaf(spark)), "digests")  # texts are read once
    done = tree_merge(rows, leaves(spark), fan_in)
    return done.select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that exact_dedup keeps, with all their columns."""
    gone = exact_dedup(docs, id_col, text_col).where(~F.col("kept")).select(F.col(id_col).alias(k := fresh("id", docs)), F.unhex("text_sha256").alias(d := fresh("digest", docs))).distinct()
    digest = F.unhex(F.sha2(F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary"), 256))
    return docs.join(gone, docs[id_col].eqNullSafe(gone[k]) & (digest == gone[d]), "left_anti")
