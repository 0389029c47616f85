"""Evaluation of tasks: each against the tree and the history as they were before it."""

from __future__ import annotations

import shutil
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import token_cost
from ..operators import ranking
from ..schemas import HISTORY_DEPTH, K_MAX, K_MIN, MAX_SET, TABLES
from ..sources import gitlog
from . import evaluate
from .build import Builder, touched_units
from .search import Index, Plan, query_rows, search
from .tables import Store

RESULT = "id string, method string, gold long, found long, recall double, returned long, tokens long"


def before(log: dict[str, DataFrame], created: int) -> dict[str, DataFrame]:
    """The part of a log that was committed before a time: a task's own commits may lie behind its base."""
    kept = log["commits"].where(F.col("ts") < created)
    ids = kept.select(F.col("id").alias("commit_id"))
    return {"commits": kept, **{t: log[t].join(ids, "commit_id", "left_semi") for t in ("hunks", "commit_blobs")}}


def gold_of(spark: SparkSession, repo: str, store: Store, base: str, head: str) -> DataFrame:
    """(unit, path): the units at ``base`` that the change to ``head`` touches."""
    change = gitlog.diff(spark, repo, base, head)
    units = store.table("units")
    touched = touched_units(repo, change["hunks"], change["commit_blobs"], units, store.table("files"))
    return touched.select("unit").distinct().join(units.select(F.col("id").alias("unit"), "path"), "unit")


def run_tasks(spark: SparkSession, repo: str, tasks: DataFrame, work: str, plan: Plan | None = None, k: int = K_MAX, k_min: int | None = K_MIN, max_gold: int = MAX_SET, code_only: bool = False, grep_files: tuple[int, ...] = (3,), n: int = HISTORY_DEPTH) -> tuple[DataFrame, dict[str, int]]:
    """(id, method, gold, found, recall, returned, tokens) of tasks(id, created, base, head, text), and how many were left out.

    ``work`` is a directory that driver and executors share. Tasks come one after another, each in its own tree: one index
    is refreshed from base to base, so what they have in common is read once. A task whose change touches no indexed
    unit, or more than ``max_gold``, is left out. Methods: find, and grep-k, which reads the k files with most of the words.
    """
    store = Store(spark, f"{work}/index-{uuid.uuid4().hex}")
    tree = Path(work, f"tree-{uuid.uuid4().hex}")
    builder = Builder(spark, store, str(tree), repo)
    rows, left_out = [], {"empty": 0, "bulk": 0}
    for task in tasks.collect():  # a file of tasks, each a checkout
        shutil.rmtree(tree, ignore_errors=True)
        tree.mkdir(parents=True)
        base = gitlog.rev_parse(repo, task.base)
        gitlog.export_tree(repo, base, str(tree))
        builder.index()
        builder.record(before(gitlog.history(spark, repo, base, n), task.created))
        store.commit(git_head=base)
        gold = gold_of(spark, repo, store, base, task.head)
        wanted = [tuple(r) for r in (gold.where(~F.col("path").rlike("\\.(md|rst|txt)$")) if code_only else gold).collect()]
        if not wanted or len(wanted) > max_gold:
            left_out["bulk" if wanted else "empty"] += 1
            continue
        gold = spark.createDataFrame([(task.id, *x) for x in wanted], "qid string, unit string, path string")
        index = Index({name: store.table(name) for name in TABLES})
        hits, tests = search(index, query_rows(spark, (task.id, task.text, None, None)), k, k_min, plan)
        leaves = index["units"].where("is_leaf")
        cost = leaves.select(F.col("id").alias("unit"), token_cost(F.col("text")).alias("tokens"))
        scored = {"find": evaluate.score(hits.select("qid", "doc").unionByName(tests.select("qid", "doc")), gold, index["closure"], cost)}
        texts = evaluate.file_texts(index["units"]).select(F.col("path").alias("doc"), "text")
        terms = ranking.term_counts(spark.createDataFrame([(task.id, task.text)], "qid string, text string"), ["qid"], "text", stems=False)
        postings = ranking.term_counts(texts, ["doc"], "text", stems=False)
        read = texts.select("doc", token_cost(F.col("text")).alias("tokens"))
        for files in grep_files:
            scored[f"grep-{files}"] = evaluate.score(evaluate.grep_read(terms, postings, read, files).select("qid", "doc"), gold, index["closure"], cost)
        for method, one in scored.items():
            rows += [(r.qid, method, r.gold, r.found, r.recall, r.returned, int(r.tokens)) for r in one.collect()]
    shutil.rmtree(tree, ignore_errors=True)
    return spark.createDataFrame(rows, RESULT), left_out
