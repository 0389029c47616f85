"""Evaluation of rankings, for many queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.cascade import budget_prefix
from ..schemas import MAX_SET


def temporal_split(commits: DataFrame, holdout: int) -> tuple[DataFrame, DataFrame]:
    """(queries, evidence) of commits(id, ts, seq, merge): the last ``holdout`` that are no merges, and all before the first of them."""
    half = commits.count() // 2
    last = commits.where("not merge").orderBy(F.desc("seq")).limit(max(1, min(holdout, half)))
    first = last.agg(F.min("seq").alias("first"))  # one row
    return last, commits.join(F.broadcast(first), F.col("seq") < F.col("first")).drop("first")


def gold_filter(gold: DataFrame, max_gold: int = MAX_SET, code_only: bool = False) -> DataFrame:
    """gold(qid, unit, path) of queries with at most ``max_gold`` units; ``code_only`` leaves prose out first."""
    rows = gold.where(~F.col("path").rlike("\\.(md|rst|txt)$")) if code_only else gold
    sized = rows.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= max_gold)
    return rows.join(sized.select("qid"), "qid", "left_semi")


def score(hits: DataFrame, gold: DataFrame, closure: DataFrame, cost: DataFrame) -> DataFrame:
    """(qid, gold, found, recall, returned, tokens) of hits(qid, doc), gold(qid, unit), closure and cost(unit, tokens) of leaves.

    A gold unit is found if it or a unit around it is a hit. Tokens are those of all leaves below each hit,
    once for each hit.
    """
    below = closure.select(F.col("ancestor").alias("doc"), F.col("descendant").alias("unit"))
    spread = hits.select("qid", "doc").join(below, "doc")
    found = gold.select("qid", "unit").distinct().join(spread.select("qid", "unit").distinct(), ["qid", "unit"], "left_semi").groupBy("qid").agg(F.count(F.lit(1)).alias("found"))
    tokens = spread.join(cost, "unit").groupBy("qid").agg(F.sum("tokens").alias("tokens"))
    returned = hits.groupBy("qid").agg(F.count(F.lit(1)).alias("returned"))
    n = gold.select("qid", "unit").distinct().groupBy("qid").agg(F.count(F.lit(1)).alias("gold"))
    out = n.join(found, "qid", "left").join(returned, "qid", "left").join(tokens, "qid", "left").fillna(0, ["found", "returned", "tokens"])
    return out.select("qid", "gold", "found", (F.col("found") / F.col("gold")).alias("recall"), "returned", "tokens")


def grep_read(terms: DataFrame, postings: DataFrame, cost: DataFrame, files: int) -> DataFrame:
    """(qid, doc, rank, n_terms, n_hits, tokens): files by how many of a query's terms they hold, then by occurrences, then by name.

    terms(qid, term), postings(term, doc, tf), cost(doc, tokens); the first ``files`` are read whole.
    """
    met = terms.select("qid", "term").distinct().join(postings, "term").groupBy("qid", "doc").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("n_hits"))
    return read_most(met, cost, files)


def read_most(met: DataFrame, cost: DataFrame, files: int) -> DataFrame:
    """The same of met(qid, doc, n_terms, n_hits)."""
    w = Window.partitionBy("qid").orderBy(F.desc("n_terms"), F.desc("n_hits"), "doc")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= files).join(cost, "doc").select("qid", "doc", "rank", "n_terms", "n_hits", "tokens")


def anchor_file(gold: DataFrame, units: DataFrame) -> DataFrame:
    """(qid, gold, found): gold that lies in the file of the query's first gold unit (by id)."""
    first = gold.groupBy("qid").agg(F.min("unit").alias("unit")).join(units.select(F.col("id").alias("unit"), F.col("path").alias("file")), "unit").select("qid", "file")
    placed = gold.join(units.select(F.col("id").alias("unit"), "path"), "unit").join(first, "qid")
    return placed.groupBy("qid").agg(F.count(F.lit(1)).alias("gold"), F.sum((F.col("path") == F.col("file")).cast("long")).alias("found"))


def summary(scored: DataFrame, by: str = "method") -> DataFrame:
    """(method, n, recall, hit_rate, returned, tokens): means over queries."""
    return scored.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg("recall").alias("recall"), F.avg((F.col("found") > 0).cast("double")).alias("hit_rate"), F.avg("returned").alias("returned"), F.avg("tokens").alias("tokens"))


def within_budget(hits: DataFrame, cost: DataFrame, budget: int) -> DataFrame:
    """The head of each list that a reader can afford: hits(qid, doc, rank), cost(doc, tokens)."""
    return budget_prefix(hits.join(cost, "doc"), budget, "tokens")


def find_then_near(found: DataFrame, near: DataFrame) -> DataFrame:
    """(qid, doc): the union of what a text finds, and what lies near its best hit."""
    return found.select("qid", "doc").union(near.select("qid", "doc")).distinct()


def file_texts(units: DataFrame) -> DataFrame:
    """(path, text): each file from its leaves, in order; a file's leaves are its own text, bounded by the largest file that is admitted."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return units.where("is_leaf").groupBy("path").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))
