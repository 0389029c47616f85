"""Lookups in the stored tables, for one key or a batch of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import FIND_LIMIT


def ascii_lower(col):
    """Lower case of A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unit(units: DataFrame, unit_id: str) -> DataFrame:
    return units.where(F.col("id") == unit_id)


def children(units: DataFrame, unit_id: str) -> DataFrame:
    return units.where(F.col("parent") == unit_id).orderBy("ord")


def units_in_file(units: DataFrame, path: str) -> DataFrame:
    return units.where(F.col("path") == path).orderBy("ord")


def subtree(units: DataFrame, closure: DataFrame, unit_id: str) -> DataFrame:
    """A unit and all below it, in document order."""
    below = closure.where(F.col("ancestor") == unit_id).select(F.col("descendant").alias("id"))
    return units.join(below, "id", "left_semi").orderBy("path", "ord")


def ancestors(units: DataFrame, closure: DataFrame, unit_id: str) -> DataFrame:
    """The chain of parents, the nearest first."""
    above = closure.where((F.col("descendant") == unit_id) & (F.col("depth") > 0)).select(F.col("ancestor").alias("id"), "depth")
    return units.join(above, "id").orderBy("depth")


def find_units(units: DataFrame, refs: DataFrame, limit: int = FIND_LIMIT) -> DataFrame:
    """(ref, id, rank) of refs(ref) among units(id, label).

    An id that equals the reference is the only answer. Else those count whose label equals it, or whose id ends with
    ``::`` and the reference (case of A-Z aside); the shortest ids come first. All by equi-joins: an id is keyed
    by each of its endings after ``::``.
    """
    wanted = refs.select("ref").distinct()
    exact = wanted.join(units.select(F.col("id").alias("ref")), "ref", "left_semi").select("ref", F.col("ref").alias("id"))
    rest = wanted.join(exact.select("ref"), "ref", "left_anti")
    labelled = rest.join(units.select("id", F.col("label").alias("ref")), "ref")
    parts = F.split("id", "::")
    ends = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: ascii_lower(F.array_join(F.slice(parts, i, F.size(parts)), "::")))
    keyed = units.where(F.col("id").contains("::")).select("id", F.explode(ends).alias("end"))
    ended = rest.withColumn("end", ascii_lower(F.col("ref"))).join(keyed, "end").select("ref", "id")
    w = Window.partitionBy("ref").orderBy(F.char_length("id"), "id")
    found = exact.unionByName(labelled.unionByName(ended).distinct())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def units_at(units: DataFrame, points: DataFrame) -> DataFrame:
    """(path, line, id) of points(path, line): the smallest unit around each; ties to leaves, then in document order."""
    met = points.select("path", "line").distinct().join(units, "path").where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    order = F.struct((F.col("end_line") - F.col("start_line")).alias("span"), (~F.col("is_leaf")).alias("inner"), "ord", "id")
    return met.groupBy("path", "line").agg(F.min_by("id", order).alias("id"))


def edges_from(edges: DataFrame, src: str) -> DataFrame:
    return edges.where(F.col("src") == src).orderBy(F.desc("weight"), "src", "dst")


def edges_to(edges: DataFrame, dst: str) -> DataFrame:
    return edges.where(F.col("dst") == dst).orderBy(F.desc("weight"), "src", "dst")


def cochange_from(cochange: DataFrame, src: str) -> DataFrame:
    """What changes together with a unit, by its id."""
    return cochange.where(F.col("src") == src).orderBy("dst")


def file_hash(files: DataFrame, path: str) -> DataFrame:
    """(hash) of one file; no row where it is not indexed."""
    return files.where(F.col("path") == path).select("hash")


def file_hashes(files: DataFrame) -> DataFrame:
    """(path, hash) of all files, in order of path."""
    return files.select("path", "hash").orderBy("path")


def file_paths(files: DataFrame, below: str = "") -> DataFrame:
    """(path) of all files, or of those below a directory."""
    return files.where(F.col("path").startswith(below)).select("path").orderBy("path")


def stat_rows(stat: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """What is remembered of files' sizes and times; of paths(path) only, where given."""
    rows = stat.select("path", "size", "mtime_ns", "checked_ns")
    return rows if paths is None else rows.join(paths.select("path"), "path", "left_semi")


def hist_postings(postings: DataFrame, docs: DataFrame, units: DataFrame) -> DataFrame:
    """History postings with their lengths; units that are gone drop out."""
    return postings.join(docs, "unit_id").join(units.select(F.col("id").alias("unit_id")), "unit_id", "left_semi").select("term", "unit_id", "tf", "len")


def symbol_definitions(definitions: DataFrame, names: DataFrame) -> DataFrame:
    """(asked, unit_id): the units that define a symbol of this name, case of A-Z aside."""
    asked = names.select(F.col("name").alias("asked"), ascii_lower(F.col("name")).alias("_key")).distinct()
    return definitions.where("kind = 'symbol'").select("unit_id", ascii_lower(F.col("name")).alias("_key")).join(asked, "_key").select("asked", "unit_id").distinct()


def commits_nested(commits: DataFrame, hunks: DataFrame, blobs: DataFrame) -> DataFrame:
    """Commits with their hunks and blobs as arrays, oldest first by ``seq``."""
    h = hunks.groupBy(F.col("commit_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("path", "start_line", "len"))).alias("hunks"))
    b = blobs.groupBy(F.col("commit_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("path", "blob"))).alias("blobs"))
    return commits.join(h, "id", "left").join(b, "id", "left").orderBy("seq")


def index_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: rows of the main tables, and the mean length of leaves."""
    counts = [tables[name].agg(F.count(F.lit(1)).alias(name)) for name in ("files", "units", "definitions", "mentions", "edges", "commits") if name in tables]
    leaves = tables["units"].where("is_leaf").agg(F.count(F.lit(1)).alias("leaves"), F.avg("len").alias("avg_len"))
    out = leaves
    for c in counts:
        out = out.join(F.broadcast(c))  # one row each
    return out
