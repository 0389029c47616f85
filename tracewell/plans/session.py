"""The user's interface: find, near, refs, open, index, status."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import path_and_line
from ..operators import lookups
from ..schemas import AMBIGUOUS_SHOWN, K_MAX, K_MIN, TABLES
from ..sources import gitlog
from . import render
from .build import Builder, Report
from .search import Index, Plan, query_rows, search
from .tables import Store


class Ambiguous(ValueError):
    """A reference that several units answer to."""


#: The directory of an index inside the tree it is of.
INDEX_DIR = ".tracewell"


def locate(start: str) -> tuple[str, str]:
    """(root, index) for a directory: the nearest index upward, or where a new one belongs, at the top of the repository."""
    here = os.path.abspath(start)
    up = here
    while True:
        if os.path.isfile(os.path.join(up, INDEX_DIR, "manifest.json")):
            return up, os.path.join(up, INDEX_DIR)
        if os.path.dirname(up) == up:
            break
        up = os.path.dirname(up)
    root = gitlog.toplevel(here) if gitlog.is_repo(here) else here
    return root, os.path.join(root, INDEX_DIR)


class Session:
    """An index of a directory and the questions to it.

    ``path`` is where the tables are; executors and driver share it. With ``refresh`` the index is brought up to
    date before each question, as far as files and commits have changed.
    """

    def __init__(self, spark: SparkSession, root: str, path: str, refresh: bool = True, git: bool = True):
        self.spark, self.root, self.auto, self.git = spark, os.path.abspath(root), refresh, git
        self.store = Store(spark, path)
        self.builder = Builder(spark, self.store, self.root)
        if not self.store.meta["tables"]:
            self.index()

    @classmethod
    def at(cls, spark: SparkSession, start: str = ".", refresh: bool = True) -> Session:
        """The session of the nearest index from a directory upward; without one, the repository is indexed.

        For a local master, or a tree on storage that executors share.
        """
        root, index = locate(start)
        return cls(spark, root, index, refresh=refresh, git=gitlog.is_repo(root))

    def answer(self, text: str = "", anchor: str | None = None, scope: str | None = None, k: int = K_MAX, as_json: bool = False) -> str:
        """What find() gives, as text or JSON."""
        hits, tests = self.find(text, anchor, scope, k)
        return render.answer_json(hits, tests) if as_json else render.hits_text(hits, tests)

    def index(self, exact: bool = True) -> Report:
        """Index what changed. Exactly: history is derived anew also where only files changed."""
        report = self.builder.index()
        if self.git:
            self.builder.history(exact=exact)
        return report

    def refresh(self) -> Report:
        """What every question does first: files always, history only if the commit moved."""
        return self.index(exact=False)

    def index_paths(self, paths: list[str]) -> Report:
        """Index these paths, and all below those that are directories, whatever their times say."""
        return self.builder.index(only=[os.path.relpath(os.path.join(self.root, p), self.root) for p in paths])

    def tables(self) -> Index:
        if self.auto:
            self.refresh()
        return Index({name: self.store.table(name) for name in TABLES})

    def resolve(self, ref: str, index: Index | None = None) -> str:
        """The unit that a reference means: path:line, an id, a label, or the end of an id."""
        index = index or self.tables()
        refs = self.spark.createDataFrame([(ref,)], "ref string")
        at = refs.select(path_and_line(F.col("ref")).alias("at")).first().at
        if at:
            tried = [at.path, os.path.relpath(os.path.abspath(at.path), self.root), os.path.relpath(os.path.realpath(at.path), os.path.realpath(self.root))]
            points = self.spark.createDataFrame([(p, at.line) for p in dict.fromkeys(tried)], "path string, line int")
            found = {r.path: r.id for r in lookups.units_at(index["units"], points).collect()}
            for p in tried:
                if p in found:
                    return found[p]
        ids = [r.id for r in lookups.find_units(index["units"], refs).orderBy("rank").collect()]
        if not ids:
            raise KeyError(f"no unit matches {ref!r}")
        if len(ids) > 1:
            raise Ambiguous(f"{ref!r} may mean " + ", ".join(ids[:AMBIGUOUS_SHOWN]) + (f" and {len(ids) - AMBIGUOUS_SHOWN} more" if len(ids) > AMBIGUOUS_SHOWN else ""))
        return ids[0]

    def find(self, text: str = "", anchor: str | None = None, scope: str | None = None, k: int = K_MAX, k_min: int | None = K_MIN, plan: Plan | None = None) -> tuple[DataFrame, DataFrame]:
        """(hits, tests) for a text, an anchor or both."""
        if not text.strip() and anchor is None:
            raise ValueError("a text or an anchor is needed")
        index = self.tables()
        unit = self.resolve(anchor, index) if anchor is not None else None
        return search(index, query_rows(self.spark, ("q", text, unit, scope)), k, k_min, plan)

    def near(self, unit: str, k: int = K_MAX) -> tuple[DataFrame, DataFrame]:
        """What belongs with a unit."""
        return self.find("", unit, k=k)

    def find_many(self, queries: DataFrame, k: int = K_MAX, k_min: int | None = K_MIN, plan: Plan | None = None) -> tuple[DataFrame, DataFrame]:
        """A batch of queries(qid, text, anchor, scope); anchors are ids."""
        return search(self.tables(), queries, k, k_min, plan)

    def refs(self, ref: str) -> DataFrame:
        """All edges into a unit or what is below it."""
        index = self.tables()
        below = index["closure"].where(F.col("ancestor") == self.resolve(ref, index)).select(F.col("descendant").alias("dst"))
        return index["edges"].join(below, "dst", "left_semi").orderBy(F.desc("weight"), "src")

    def open(self, ref: str, outer: bool = False) -> tuple[DataFrame, DataFrame]:
        """A unit (``outer``: its parent) and its children."""
        index = self.tables()
        unit = self.resolve(ref, index)
        if outer:
            row = lookups.unit(index["units"], unit).first()
            unit = row.parent or unit
        return lookups.unit(index["units"], unit), lookups.children(index["units"], unit)

    def status(self) -> DataFrame:
        """Counts of the tables and the mean length of leaves, without a refresh."""
        return lookups.index_stats({name: self.store.table(name) for name in TABLES})

    def sql(self, query: str) -> DataFrame:
        """Any SQL over the index's tables, by their names."""
        for name in TABLES:
            if re.search(rf"\b{name}\b", query):
                self.store.table(name).createOrReplaceTempView(name)
        return self.spark.sql(query)
