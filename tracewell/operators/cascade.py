"""The cascade after the scorers, for a batch of queries at once: union, rank, collapse, lift and cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import GAP_TIE, K_MAX, K_MIN, LIFT_LINES, LIFT_SIBLINGS, MASS, RANK_CAP, RANK_DIGITS, VIA_LEAST


#: Bytes of hits, as Catalyst sizes them, that are sorted in one task.
SORTED = 4 << 20
#: Partitions at most: sizes of joins are bounds, and may be far above what is there.
MOST = 4096


def dealt(rows: DataFrame, like: DataFrame, key: str) -> DataFrame:
    """The rows by their key, in as many partitions as the size of ``like`` asks for, so that a task sorts no more of a larger table."""
    size = int(str(like._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // SORTED), MOST))
    return rows.repartition(parts, key)


def scaled_union(parts: DataFrame, weights: DataFrame, raw_ops: tuple[str, ...] = ("text",), qid: str = "qid", details: DataFrame | None = None) -> DataFrame:
    """(qid, doc, score, via) of parts(qid, op, doc, score) and the plan's weights(qid, op, weight).

    An operator that is a query's only one and gives bits counts as it is; any other is scaled by its largest
    score, and left out where that is not above 0. via lists contributions of 0.005 or more, to nine decimals; those of an operator with
    ``details`` (qid, op, part, doc, score) are listed by part.
    """
    alone = weights.withColumn("alone", (F.count(F.lit(1)).over(Window.partitionBy(qid)) == 1) & F.col("op").isin(*raw_ops))
    top = parts.groupBy(qid, "op").agg(F.max("score").alias("top"))
    scale = alone.join(top, [qid, "op"]).select(qid, "op", F.when(F.col("alone"), F.col("weight")).when(F.col("top") > 0, F.col("weight") / F.col("top")).alias("scale")).where("scale is not null")
    given = parts.select(qid, "op", "doc", "score", F.lit(None).cast("string").alias("part"))
    if details is not None:
        given = given.unionByName(details.select(qid, "op", "doc", "score", "part"))
    c = given.join(scale, [qid, "op"]).withColumn("c", F.col("score") * F.col("scale"))
    detailed = F.lit(False) if details is None else F.col("op").isin(*[r.op for r in details.select("op").distinct().collect()])  # operators: a handful
    listed = (F.round("c", RANK_DIGITS) >= VIA_LEAST) & (F.col("part").isNotNull() | ~detailed)
    via = F.array_sort(F.collect_list(F.when(listed, F.struct(F.coalesce("part", "op").alias("op"), F.col("c").alias("contribution")))))
    out = c.groupBy(qid, "doc").agg(F.sum(F.when(F.col("part").isNull(), F.col("c"))).alias("score"), via.alias("via"))
    return out.where("score is not null")


def ranked(scores: DataFrame, cap: int = RANK_CAP, qid: str = "qid") -> DataFrame:
    """The best ``cap`` of each query, ties by id, with their rank from 1."""
    w = Window.partitionBy(qid).orderBy(F.round("score", RANK_DIGITS).desc(), "doc")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)


def collapse_ancestors(hits: DataFrame, closure: DataFrame, qid: str = "qid") -> DataFrame:
    """Hits without those that have a descendant among the query's hits."""
    pairs = hits.select(qid, F.col("doc").alias("descendant")).join(closure.where("depth > 0").select("ancestor", "descendant"), "descendant")
    above = pairs.select(qid, F.col("ancestor").alias("doc")).distinct()
    return hits.join(above, [qid, "doc"], "left_anti")


def lift_siblings(hits: DataFrame, parents: DataFrame, k_max: int = K_MAX, siblings: int = LIFT_SIBLINGS, max_lines: int = LIFT_LINES, qid: str = "qid") -> DataFrame:
    """(qid, doc, score, pos, lifted): within the first 2 k_max hits, a parent takes the place of four or more.

    hits(qid, doc, score, rank); parents(doc, parent, span): span is the parent's number of lines.
    """
    w = Window.partitionBy(qid).orderBy("rank")
    placed = dealt(hits.withColumn("pos", F.row_number().over(w)).join(parents, "doc", "left"), hits, qid)
    inside = F.col("pos") <= 2 * k_max
    group = Window.partitionBy(qid, "parent", inside)
    fits = F.col("parent").isNotNull() & inside & (F.col("span") <= max_lines)
    marked = placed.withColumn("n", F.when(fits, F.count(F.lit(1)).over(group))).withColumn("first", F.when(fits, F.min("pos").over(group)))
    up = F.coalesce(F.col("n") >= siblings, F.lit(False))
    kept = marked.where(~up | (F.col("pos") == F.col("first")))
    return kept.select(qid, F.when(up, F.col("parent")).otherwise(F.col("doc")).alias("doc"), "score", "pos", F.when(up, F.col("n")).otherwise(F.lit(0)).cast("int").alias("lifted"))


def adaptive_cut(hits: DataFrame, k_min: Column | int = K_MIN, k_max: Column | int = K_MAX, order: str = "pos", qid: str = "qid") -> DataFrame:
    """(qid, k): where each query's list is cut: at the widest gap after half of the mass, ties to the longer list."""
    k_min, k_max = (F.lit(x) if isinstance(x, int) else x for x in (k_min, k_max))
    w = Window.partitionBy(qid)
    rows = hits.select(qid, F.greatest(F.col("score"), F.lit(0.0)).alias("s"), F.row_number().over(w.orderBy(order)).alias("k"), F.count(F.lit(1)).over(w).alias("n"), k_min.alias("_min"), k_max.alias("_max"))
    rows = rows.withColumn("hi", F.least("_max", "n")).withColumn("lo", F.least(F.greatest("_min", F.lit(1)), "hi"))
    rows = rows.withColumn("next", F.coalesce(F.lead("s").over(w.orderBy("k")), F.lit(0.0))).withColumn("cum", F.sum("s").over(w.orderBy("k")))
    rows = rows.withColumn("mass", F.sum(F.when(F.col("k") <= F.col("hi"), F.col("s"))).over(w))
    fits = F.col("k").between(F.col("lo"), F.col("hi")) & (F.col("mass") > 0) & (F.col("cum") / F.col("mass") >= MASS)
    best = F.max(F.when(fits, F.struct(F.round((F.col("s") - F.col("next")) / GAP_TIE).alias("gap"), "k")))
    return rows.groupBy(qid).agg(best.alias("best"), F.first("hi").alias("hi")).select(qid, F.coalesce("best.k", "hi").cast("int").alias("k"))


def cut_list(scores: list[float], k_min: int | None = K_MIN, k_max: int = K_MAX) -> int:
    """The same cut of one list; without a minimum it is at ``k_max``."""
    s = [max(0.0, x) for x in scores]
    hi = min(k_max, len(s))
    if not hi or k_min is None:
        return hi
    mass, run, best, at = sum(s[:hi]), 0.0, None, hi
    for k in range(1, hi + 1):
        run += s[k - 1]
        gap = s[k - 1] - (s[k] if k < len(s) else 0.0)
        if k >= min(max(k_min, 1), hi) and mass > 0 and run / mass >= MASS and (best is None or gap >= best - GAP_TIE):
            best, at = max(gap, best or gap), k
    return at


def budget_prefix(hits: DataFrame, budget: int, cost: str = "cost", order: str = "rank", qid: str = "qid") -> DataFrame:
    """The longest head of each list whose cost stays within the budget, one hit at least; it ends at the first overflow."""
    w = Window.partitionBy(qid).orderBy(order)
    run = hits.withColumn("spent", F.sum(cost).over(w)).withColumn("at", F.row_number().over(w))
    return run.withColumn("over", F.max(F.col("spent") > budget).over(w)).where((F.col("at") == 1) | ~F.col("over")).drop("at", "over")
