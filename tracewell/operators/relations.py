"""Derived relations: reference edges, the tests field, co-change, the history field, and the tree's closure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.counting import shared_terms
from ..functions.shared import written
from ..functions.text import is_test, jaccard, lines, tokenize_raw
from ..functions.stemmer import stem_vocabulary
from ..schemas import BRIDGE_CAP, JACCARD_LEAST, MAX_SET, ORDINAL_KINDS, SUPPORT, TAU_DAYS

#: Origins of edges, in the order of their names.
ORIGINS = ("bridge", "explicit", "global", "same_file")
#: Edges are dealt by their source to so many partitions that each has about so many, however many there are.
EDGES = 1 << 19


def resolve(definitions: DataFrame, mentions: DataFrame, bridge_cap: int = BRIDGE_CAP) -> DataFrame:
    """(src, dst, kind, origin, weight, line): mentions joined with definitions by name, ambiguity split as mass.

    Links reach anchors; other kinds reach symbols. Bridges reach symbols of other files, at most ``bridge_cap`` of
    them; a mention of code reaches the symbols of its own file if there are any, else all. How many targets a
    mention has is counted per (name, file) before anything is joined, so a name that is defined and mentioned
    very often costs its result and no more.
    """
    defs = written(definitions.select("name", F.col("unit_id").alias("dst"), (F.col("kind") == "anchor").alias("anchor"), F.col("path").alias("dpath")).distinct(), "defs")
    per_file = defs.groupBy("name", "anchor", "dpath").agg(F.countDistinct("dst").alias("here"))
    everywhere = defs.groupBy("name", "anchor").agg(F.countDistinct("dst").alias("all"))
    m = mentions.select(F.col("unit_id").alias("src"), "name", "kind", "line", "path", (F.col("kind") == "link").alias("anchor"))
    m = m.join(everywhere, ["name", "anchor"]).join(per_file.withColumnRenamed("dpath", "path"), ["name", "anchor", "path"], "left").fillna(0, ["here"])
    own, bridge = (F.col("here") > 0) & ~F.col("kind").isin("link", "bridge"), F.col("kind") == "bridge"
    mass = F.when(bridge, F.col("all") - F.col("here")).when(own, F.col("here")).otherwise(F.col("all"))
    origin = F.when(F.col("kind") == "link", "explicit").when(bridge, "bridge").when(own, "same_file").otherwise("global")
    m = written(m.withColumn("m", mass).withColumn("origin", origin).where((F.col("m") > 0) & (~bridge | (F.col("m") <= bridge_cap))), "mentions")
    rows = m.agg(F.sum("m")).first()[0] or 0
    same = m.where("origin = 'same_file'").join(defs.withColumnRenamed("dpath", "path"), ["name", "anchor", "path"])
    other = m.where("origin <> 'same_file'").join(defs, ["name", "anchor"]).where(~bridge | (F.col("dpath") != F.col("path"))).drop("dpath")
    edges = same.select(sorted(same.columns)).unionByName(other).where("dst <> src")
    weight = 1.0 / (F.col("m") + F.when(F.col("kind") == "method", 1).otherwise(0))
    first = F.coalesce(F.col("line").cast("long"), F.lit(-(1 << 31))) * len(ORIGINS) + F.array_position(F.array(*map(F.lit, ORIGINS)), F.col("origin")) - 1  # a number, so that sums are hashed and not sorted
    parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // EDGES))
    grouped = edges.withColumn("first", first).withColumn("w", weight).repartition(parts, "src").groupBy("src", "dst", "kind").agg(F.min("first").alias("first"), F.sum("w").alias("weight"), F.min("line").alias("line"))
    return grouped.select("src", "dst", "kind", F.get(F.array(*map(F.lit, ORIGINS)), F.pmod("first", F.lit(len(ORIGINS))).cast("int")).alias("origin"), "weight", "line")


def tests_field(definitions: DataFrame, mentions: DataFrame, units: DataFrame, files: DataFrame, stems: bool = True) -> tuple[DataFrame, DataFrame]:
    """What tests say of a file: (field, term, doc, tf, path) postings and (field, doc, len, path), a row for every file.

    A name that a test unit's line uses hands the line's and the test label's terms to the files that define it,
    split over the definers (two or more symbols of a name share it).
    """
    simple = definitions.where(F.col("kind") == "symbol").where(~F.col("name").contains("::") & (F.char_length("name") >= 3) & ~(F.col("name").startswith("__") & F.col("name").endswith("__")))
    definers = simple.select("name", F.col("unit_id").alias("definer"), F.col("path").alias("file")).distinct()
    shares = definers.groupBy("name").agg(F.countDistinct("definer").alias("m"))
    used = mentions.where(F.col("kind").isin("call", "method", "import", "type") & is_test(F.col("unit_id"), F.col("path")))
    used = used.select("unit_id", "line", F.substring_index("name", "::", -1).alias("name")).distinct()
    leaf = units.where("is_leaf").select(F.col("id").alias("unit_id"), "label", "text", "start_line")
    met = used.join(definers.join(shares, "name"), "name").where("definer <> unit_id")
    pooled = met.groupBy("unit_id", "line", "file").agg(F.sum(1.0 / F.col("m")).alias("w"))
    pooled = pooled.groupBy("unit_id", "line").agg(F.collect_list(F.struct("file", "w")).alias("shares"))  # at most the files that define a line's names
    text = F.coalesce(F.get(lines(F.col("text")), F.col("line") - F.col("start_line")), F.lit(""))
    said = pooled.join(leaf, "unit_id").select(F.concat_ws("\n", text, "label").alias("words"), "shares")  # words travel once a line, and are cut once
    tf = shared_terms(said).groupBy("file", "term").agg(F.sum("tf").alias("tf"))
    if stems:
        extra = tf.join(stem_vocabulary(tf), "term").select("file", F.col("stem").alias("term"), "tf")
        tf = tf.select("file", "term", "tf").unionByName(extra.select("file", "term", "tf")).groupBy("file", "term").agg(F.sum("tf").alias("tf"))
    postings = tf.select(F.lit("tests").alias("field"), "term", F.col("file").alias("doc"), "tf", F.col("file").alias("path"))
    sizes = tf.groupBy("file").agg(F.sum("tf").alias("len"))
    docs = files.select(F.col("path").alias("file")).join(sizes, "file", "left").select(F.lit("tests").alias("field"), F.col("file").alias("doc"), F.coalesce("len", F.lit(0.0)).alias("len"), F.col("file").alias("path"))
    return postings, docs


def cochange(touched: DataFrame, now: int | None = None, tau_days: float = TAU_DAYS, support: int = SUPPORT, max_set: int = MAX_SET) -> DataFrame:
    """(src, dst, weight), both directions, of touched(commit, ts, unit): units that change together, recent ones more.

    ``now`` defaults to the time of the last commit, by ``seq`` where touched has it, else by its id. The size filter comes before the self-join, so a commit costs at
    most max_set squared rows.
    """
    sets = touched.select("commit", "ts", "unit").distinct()
    sized = sets.join(sets.groupBy("commit").agg(F.count(F.lit(1)).alias("size")).where(F.col("size").between(2, max_set)), "commit")
    at = F.lit(now) if now is not None else F.col("now")
    if now is None:
        sized = sized.crossJoin(F.broadcast(touched.agg(F.max_by("ts", "seq" if "seq" in touched.columns else "commit").alias("now"))))  # one row
    weighed = sized.select("commit", "unit", (F.exp(-F.greatest(at - F.col("ts"), F.lit(0)) / F.lit(tau_days * 86400.0)) / (F.col("size") - 1)).alias("w"))
    a, b = weighed.select("commit", F.col("unit").alias("a"), "w"), weighed.select("commit", F.col("unit").alias("b"))
    pairs = a.join(b, "commit").where("a < b").groupBy("a", "b").agg(F.sum("w").alias("weight"), F.count(F.lit(1)).alias("n")).where((F.col("n") >= support) & (F.col("weight") > 0))
    return pairs.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e"), "weight").select("e.src", "e.dst", "weight")


def history_field(touched: DataFrame, messages: DataFrame, max_set: int = MAX_SET, stems: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words of commit messages at the units they touch: unit_changes, hist_postings and hist_docs.

    touched(commit, unit), messages(commit, message). Commits that touch more than ``max_set`` units say nothing.
    """
    from .ranking import term_counts

    sets = touched.select("commit", "unit").distinct()
    small = sets.join(sets.groupBy("commit").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") <= max_set), "commit").select("commit", "unit")
    counts = term_counts(messages, ["commit"], "message", stems)
    tf = small.join(counts, "commit").groupBy("term", F.col("unit").alias("unit_id")).agg(F.sum("tf").alias("tf"))
    docs = tf.groupBy("unit_id").agg(F.sum("tf").alias("len"))
    return small.select(F.col("unit").alias("unit_id"), F.col("commit").alias("commit_id")), tf, docs


def hunk_touch(hunks: DataFrame, leaves: DataFrame, keys: list[str]) -> DataFrame:
    """Interval join: leaves(*keys, unit, start_line, end_line) that hunks(commit, *keys, start_line, len) overlap."""
    h = hunks.select("commit", *keys, F.col("start_line").alias("_a"), (F.col("start_line") + F.col("len") - 1).alias("_b"))
    return h.join(leaves, keys).where("start_line <= _b and _a <= end_line").select("commit", *leaves.columns).distinct()


def map_leaves(old: DataFrame, units: DataFrame, least: float = JACCARD_LEAST, name: str = "id") -> DataFrame:
    """(old_id, path, id): historical leaves to current units.

    Named kinds by their id (a container may stand there now); ordinal kinds by the most similar words within the
    file, ties to the smaller id. old(id, path, kind, label, text), units(id, path, kind, is_leaf, label, text); ``name``
    is the column with the id that a named leaf had, where id tells versions apart.
    """
    named = old.where(~F.col("kind").isin(*ORDINAL_KINDS)).select(F.col("id").alias("old_id"), "path", F.col(name).alias("_name")).join(units.select(F.col("id").alias("_name")), "_name", "left_semi").select("old_id", "path", F.col("_name").alias("id"))
    words = lambda d: F.array_distinct(tokenize_raw(F.concat_ws("\n", d["label"], d["text"])))
    a = old.where(F.col("kind").isin(*ORDINAL_KINDS)).select(F.col("id").alias("old_id"), "path", "label", "text")
    a = a.select("old_id", "path", words(a).alias("x"), F.xxhash64(F.array_sort(words(a))).alias("finger"))
    b = units.where(F.col("kind").isin(*ORDINAL_KINDS) & F.col("is_leaf"))
    b = b.select("id", "path", words(b).alias("y"))
    distinct = a.dropDuplicates(["path", "finger"])
    scored = distinct.join(b, "path").select("path", "finger", "id", jaccard(F.col("x"), F.col("y")).alias("j")).where(F.col("j") >= least)
    best = scored.groupBy("path", "finger").agg(F.min_by("id", F.struct(-F.col("j"), F.col("id"))).alias("id"))
    return named.select("old_id", "path", "id").unionByName(a.join(best, ["path", "finger"]).select("old_id", "path", "id"))


def closure(nodes: DataFrame, node: str = "id", parent: str = "parent", max_depth: int = 64) -> DataFrame:
    """(ancestor, descendant, depth) of a forest, each node with itself at depth 0.

    One equi-join a level; trees of units are a handful of levels deep. A parent that is no node ends the chain.
    """
    tree = nodes.select(F.col(node).alias("n"), F.col(parent).alias("p"))
    found = tree.select(F.col("n").alias("ancestor"), F.col("n").alias("descendant"), F.lit(0).alias("depth"))
    edge = tree.where("p is not null").join(tree.select(F.col("n").alias("p")), "p", "left_semi")
    edge = cut(edge.select(F.col("n").alias("child"), F.col("p").alias("ancestor")))
    level = edge.select("ancestor", F.col("child").alias("descendant"))
    for depth in range(1, max_depth + 1):
        if level.isEmpty():
            return found
        found = found.unionByName(level.withColumn("depth", F.lit(depth)))
        level = cut(level.select(F.col("ancestor").alias("child"), "descendant").join(edge, "child").select("ancestor", "descendant"))
    raise ValueError(f"deeper than {max_depth}, or a cycle")


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder where the session names one, else ``df`` itself."""
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return df.checkpoint()
    return df


def neighbours(edges: DataFrame, anchors: DataFrame, outward: bool = True) -> DataFrame:
    """(anchor, doc, score): edge weight from (or to) an anchor's set of units to others. anchors(anchor, unit)."""
    here, there = ("src", "dst") if outward else ("dst", "src")
    met = edges.join(anchors, edges[here] == anchors["unit"]).select("anchor", F.col(there).alias("doc"), "weight")
    inside = anchors.select(F.col("anchor"), F.col("unit").alias("doc"))
    return met.groupBy("anchor", "doc").agg(F.sum("weight").alias("score")).join(inside, ["anchor", "doc"], "left_anti")  # sums first: there are fewer


def near_in_order(units: DataFrame, centres: DataFrame, inside: DataFrame, by: str, scale: float = 1.0) -> DataFrame:
    """(anchor, doc, score): 1 / (1 + |distance in order| / scale) of units that share ``by`` with an anchor's centre.

    units(id, ord, <by>), centres(anchor, ord, <by>); inside(anchor, unit) is left out.
    """
    centre = centres.select("anchor", F.col(by).alias("_by"), F.col("ord").alias("_ord"))
    met = centre.join(units, F.col("_by") == F.col(by)).select("anchor", F.col("id").alias("doc"), (1.0 / (1.0 + F.abs(F.col("ord") - F.col("_ord")) / scale)).alias("score"))
    return met.join(inside.select("anchor", F.col("unit").alias("doc")), ["anchor", "doc"], "left_anti")


def islands(rows: DataFrame, by: list[str], order: str, blank: str, size: int) -> DataFrame:
    """Runs of rows that are not blank, cut at ``size`` rows: (*by, start, end, n)."""
    w = Window.partitionBy(*by).orderBy(order)
    run = rows.withColumn("_run", F.sum(F.col(blank).cast("int")).over(w)).where(~F.col(blank))
    k = Window.partitionBy(*by, "_run").orderBy(order)
    piece = run.withColumn("_piece", F.floor((F.row_number().over(k) - 1) / size))
    return piece.groupBy(*by, "_run", "_piece").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count(F.lit(1)).alias("n")).drop("_run", "_piece")
