"""Building and refreshing an index: scan, changes, extraction, derived tables, history."""

from __future__ import annotations

import hashlib
import time
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import name_text, path_text
from ..operators import ranking, relations
from ..schemas import DERIVATION, HISTORY_DEPTH, MAX_SET
from ..sources import extract, gitlog, scan
from .tables import Store

EVIDENCE = ("files", "units", "postings", "definitions", "mentions")


@dataclass
class Report:
    scanned: int = 0
    added: int = 0
    updated: int = 0
    unchanged: int = 0
    removed: int = 0
    skipped: int = 0

    def changed(self) -> bool:
        return bool(self.added or self.updated or self.removed)

    def as_dict(self) -> dict:
        return asdict(self)


def evidence_of(files: DataFrame) -> dict[str, DataFrame]:
    """files(path, content) -> units, postings, definitions, mentions, and the path and name fields of leaves."""
    tables = extract.tables_of(relations.cut(extract.extract_files(files)))
    units = tables["units"]
    leaves = units.where("is_leaf")
    said = leaves.select(F.col("id").alias("unit_id"), "path", F.concat_ws("\n", "label", "text").alias("said"))
    postings = ranking.term_counts(said, ["unit_id", "path"], "said")
    sizes = postings.groupBy(F.col("unit_id").alias("id")).agg(F.sum("tf").alias("len"))
    tables["units"] = units.join(sizes, "id", "left").withColumn("len", F.coalesce("len", F.lit(0.0)))
    tables["postings"] = postings.select("term", "unit_id", "tf", "path")
    both = leaves.select(F.col("id").alias("doc"), "path", F.explode(F.array(F.struct(F.lit("path").alias("field"), path_text(F.col("path")).alias("words")), F.struct(F.lit("name").alias("field"), name_text(F.col("id"), F.col("path")).alias("words")))).alias("f")).select("doc", "path", "f.field", "f.words")
    counts = ranking.term_counts(both, ["field", "doc", "path"], "words")
    tables["fpostings"] = counts.select("field", "term", "doc", "tf", "path")
    tables["fdocs"] = ranking.lengths(counts, both, ["field", "doc", "path"]).select("field", "doc", "len", "path")
    return tables


class Builder:
    """Keeps the index of a directory, in a store; ``repo`` is where its history is, if not there."""

    def __init__(self, spark: SparkSession, store: Store, root: str, repo: str | None = None):
        self.spark, self.store, self.root, self.repo = spark, store, root, repo or root

    def index(self, only: list[str] | None = None) -> Report:
        """Bring the index up to what the directory holds; ``only`` restricts it to these paths and all below them.

        Files are compared by size and time, then by content. One that is no longer admitted is removed.
        """
        store = self.store
        checked = time.time_ns()
        listed = relations.cut(scan.walk(self.spark, self.root))
        known = store.table("files")
        within = None
        if only is not None:
            at = F.lit(False)
            for p in only:
                at = at | (F.col("path") == p.rstrip("/")) | F.col("path").startswith(p.rstrip("/") + "/")
            within = at
            listed, looked = listed.where(within), known.where(within)
        else:
            looked = known
        still = scan.unchanged(store.table("stat_cache"), listed) if only is None else known.where(F.lit(False)).select("path")
        still = relations.cut(still.join(known.select("path"), "path", "left_semi"))
        candidates = listed.join(still, "path", "left_anti").where(scan.admissible(F.col("path"), F.col("length")))
        admitted = relations.cut(scan.admit(scan.read_contents(candidates, self.root)).withColumn("hash", scan.content_hash(F.col("content"))))
        now = admitted.select("path", "hash").unionByName(looked.join(still, "path", "left_semi").select("path", "hash"))
        change = relations.cut(scan.changes(looked.select("path", "hash"), now))
        n = {r.change: r.n for r in change.groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}
        scanned = listed.count()
        report = Report(scanned, n.get("added", 0), n.get("updated", 0), n.get("unchanged", 0), n.get("removed", 0), scanned - sum(n.get(k, 0) for k in ("added", "updated", "unchanged")))
        if report.changed():
            gone = change.where("change <> 'unchanged'").select("path")
            fresh = admitted.join(change.where("change in ('added', 'updated')").select("path"), "path", "left_semi")
            tables = evidence_of(fresh.select("path", "content")) | {"files": fresh.select("path", "hash", F.col("length").alias("size"))}
            for name in EVIDENCE:
                store.replace_paths(name, gone, tables[name])
            keep = lambda t: store.table(t).where("field <> 'tests'").join(gone, "path", "left_anti")
            fields = {t: keep(t).unionByName(tables[t].select(*keep(t).columns)) for t in ("fpostings", "fdocs")}
            self.derive(fields)
        stat = listed.select("path", F.col("length").alias("size"), "mtime_ns", F.lit(checked).alias("checked_ns"))
        if within is not None:
            stat = store.table("stat_cache").where(~within).unionByName(stat.withColumn("checked_ns", F.lit(0).cast("long")))
        store.put("stat_cache", stat)
        store.commit(root=self.root)
        return report

    def derive(self, fields: dict[str, DataFrame]) -> None:
        """Edges, the closure and the tests field, from the evidence that was just written."""
        s = self.store
        definitions, mentions, units, files = (s.current(t) for t in ("definitions", "mentions", "units", "files"))
        s.put("edges", relations.resolve(definitions, mentions))
        s.put("closure", relations.closure(units))
        postings, docs = relations.tests_field(definitions, mentions, units, files)
        s.put("fpostings", fields["fpostings"].unionByName(postings.select(*fields["fpostings"].columns)))
        s.put("fdocs", fields["fdocs"].unionByName(docs.select(*fields["fdocs"].columns)))

    def basis(self, head: str) -> str:
        """What history's tables depend on: the derivation, the commit and the files."""
        files = self.store.table("files").select(F.sha2(F.concat_ws("\0", "path", "hash"), 256).alias("h"))
        rows = files.agg(F.count(F.lit(1)), F.expr("bit_xor(conv(substring(h, 1, 15), 16, 10)::bigint)"), F.expr("bit_xor(conv(substring(h, 16, 15), 16, 10)::bigint)")).first()
        return f"{DERIVATION}:{head}:{hashlib.sha256(repr(tuple(rows)).encode()).hexdigest()}"

    def history(self, exact: bool = False, n: int = HISTORY_DEPTH) -> bool:
        """Derive the tables of history if the commit moved (``exact``: or the files did); whether it was done."""
        if not gitlog.is_repo(self.root):
            return False
        head = gitlog.rev_parse(self.root)
        basis = self.basis(head)
        if self.store.get("git_head") == head and (not exact or self.store.get("git_basis") == basis):
            return False
        self.record(gitlog.history(self.spark, self.root, head, n))
        self.store.commit(git_head=head, git_basis=basis)
        return True

    def record(self, log: dict[str, DataFrame]) -> None:
        """Write commits, and derive unit changes, the history field and co-change from what was written."""
        s = self.store
        commits, hunks, blobs = (s.put(t, log[t]) for t in ("commits", "hunks", "commit_blobs"))
        units = s.table("units")
        touched = relations.cut(touched_units(self.repo, hunks, blobs, units, s.table("files")))
        messages = commits.select(F.col("id").alias("commit"), F.concat_ws("\n", "subject", "body").alias("message"))
        changes, postings, docs = relations.history_field(touched, messages)
        s.put("unit_changes", changes)
        s.put("hist_postings", postings)
        s.put("hist_docs", docs)
        last = commits.agg(F.max_by("ts", "seq")).first()[0]  # the time of the last commit, which need not be the latest
        timed = touched.join(commits.select(F.col("id").alias("commit"), "ts"), "commit")
        s.put("cochange", relations.cochange(timed, now=last or 0, max_set=MAX_SET))


def touched_units(repo: str, hunks: DataFrame, blobs: DataFrame, units: DataFrame, files: DataFrame) -> DataFrame:
    """(commit, unit): the current units that each commit's hunks touch.

    A hunk meets the leaves of the file as it was after the commit, which then are mapped to current units. Each
    (path, blob) is read and parsed once.
    """
    indexed = blobs.join(files.select("path"), "path", "left_semi")
    old = relations.cut(gitlog.read_blobs(indexed, repo).mapInArrow(_leaf_rows, LEAF))
    met = relations.hunk_touch(hunks.join(indexed, ["commit_id", "path"]).withColumnRenamed("commit_id", "commit"), old, ["path", "blob"])
    pairs = met.select("commit", "path", "blob", F.col("id").alias("old_id"))
    leaves = met.select("blob", "id", "path", "kind", "label", "text").distinct()
    # ids of several versions of a file, told apart by the version
    mapped = relations.map_leaves(leaves.select(F.concat_ws("\0", "blob", "id").alias("id"), F.col("id").alias("name"), "path", "kind", "label", "text"), units, name="name")
    mapped = mapped.select(F.substring_index("old_id", "\0", 1).alias("blob"), F.substring_index("old_id", "\0", -1).alias("old_id"), "path", F.col("id").alias("unit"))
    return pairs.join(mapped, ["path", "blob", "old_id"]).select("commit", "unit").distinct()


LEAF = "path string, blob string, id string, kind string, label string, text string, start_line int, end_line int"


def _leaf_rows(batches):
    for batch in batches:
        rows = [(p, b, u.id, u.kind, u.label, u.text, u.start, u.end) for p, b, c in zip(*(batch.column(k).to_pylist() for k in ("path", "blob", "content"))) for u in extract.extract(p, c.removeprefix("﻿")).units if u.is_leaf]
        names = ("path", "blob", "id", "kind", "label", "text", "start_line", "end_line")
        kinds = [pa.string()] * 6 + [pa.int32()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 8, kinds)], names)
