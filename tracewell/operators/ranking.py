"""Postings, collection statistics and DPH ranking, for one query or a batch of any size.

Everything is relational (``scoring`` does the same for batches that executors can hold): postings(field, term, doc, tf) and lengths(field, doc, len) on one side, weighted query
terms(qid, term, qw) on the other. Statistics of a term (cf) and a field (n, average length) are those
of the whole collection; a scope filters documents only after they are computed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.counting import term_rows
from ..functions.shared import written
from ..functions.stemmer import add_stems
from ..functions.text import dph, first_line
from ..schemas import RANK_DIGITS, TITLE_BOOST


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt to all cores where the table is too small for its scan to fill them: costly expressions follow.

    A table with a split of the scan's size for each core, or more, stays where it is read.
    """
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return rows.repartition(cores) if size < cores * split else rows


def term_counts(texts: DataFrame, key: list[str], text: str, stems: bool = True) -> DataFrame:
    """(*key, term, tf) of the tokens of a text column; ``stems`` counts each for its stem too."""
    raw = term_rows(spread(texts.select(*key, text)), key, text).groupBy(*key, "term").agg(F.sum("tf").alias("tf"))
    return add_stems(raw) if stems else raw


def lengths(postings: DataFrame, docs: DataFrame, key: list[str]) -> DataFrame:
    """(*key, len): tokens of every document, 0 for those without postings."""
    sizes = postings.groupBy(*key).agg(F.sum("tf").alias("len"))
    return docs.select(*key).join(sizes, key, "left").select(*key, F.coalesce("len", F.lit(0.0)).alias("len"))


def field_totals(docs: DataFrame) -> DataFrame:
    """(field, n, total) of docs(field, len)."""
    return docs.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0.0)).alias("total"))


def weighted_terms(queries: DataFrame, qid: str = "qid", text: str = "text", stems: bool = True) -> DataFrame:
    """(qid, term, qw): 1 + ln(count), more for terms of the first line of a text that has several lines."""
    several = F.regexp_replace(text, "\\s+$", "").contains("\n")
    counts = term_counts(queries, [qid], text, stems)
    title = term_counts(queries.where(several).select(qid, first_line(F.col(text)).alias("_title")), [qid], "_title", stems).select(qid, "term", F.lit(True).alias("titled"))
    boost = F.when(F.col("titled"), F.lit(TITLE_BOOST)).otherwise(F.lit(1.0))
    return counts.join(title, [qid, "term"], "left").select(qid, "term", ((1 + F.log("tf")) * boost).alias("qw"))


#: What is scored by document is dealt to so many partitions that each has at most about so many scores.
SCORES = 1 << 21


def matched(texts: DataFrame, terms: DataFrame, key: str, text: str, field: str = "code") -> DataFrame:
    """(field, doc, copies, len, term, tf) of the terms(term) that the texts hold, and a row without a term for each text.

    Texts are cut once, and what is matched is written. len counts all tokens of a document, and copies the texts that have
    its key; without a key a text has neither length nor terms.
    """
    wanted = written(terms.select("term").distinct(), "terms").withColumn("wanted", F.lit(True))
    rows = term_rows(spread(texts.select(F.col(key).alias("doc"), text)), ["doc"], text, sizes=True).join(wanted, "term", "left")
    rows = rows.where((F.col("wanted") & F.col("doc").isNotNull()) | F.col("term").isNull())
    size = F.when(F.col("doc").isNull(), 0.0).otherwise(F.col("len")).alias("len")
    rows = written(rows.select(F.lit(field).alias("field"), "doc", F.lit(1).cast("long").alias("copies"), size, "term", "tf"), "matched")
    docs = rows.where("term is null and doc is not null").groupBy("field", "doc").agg(F.sum("copies").alias("copies"), F.sum("len").alias("len"))
    if docs.where("copies > 1").isEmpty():
        return rows
    once = rows.where("term is not null").groupBy("field", "doc", "term").agg(F.sum("tf").alias("tf")).join(docs, ["field", "doc"])
    each = docs.withColumn("term", F.lit(None).cast("string")).withColumn("tf", F.lit(0.0)).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return written(once.select(rows.columns).unionByName(each.select(rows.columns)).unionByName(rows.where("doc is null")), "matched")


def dealt(met: DataFrame, terms: DataFrame, qid: str = "qid") -> DataFrame:
    """The rows of ``matched`` that have a term, dealt by document: what is grouped by query and document then stays where it is."""
    scores = met.where("term is null").count() * terms.select(qid).distinct().count()
    parts = max(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-scores // SCORES))
    return met.where("term is not null").repartition(parts, "doc")


def matched_bits(terms: DataFrame, met: DataFrame, qid: str = "qid", scope: DataFrame | None = None) -> DataFrame:
    """``field_bits`` of the rows of ``matched``. A scope(doc) leaves out documents, and no statistics."""
    totals = field_totals(met.where("term is null")).where("n > 0 and total > 0")
    stats = met.where("term is not null").groupBy("field", "term").agg(F.sum(F.col("tf") * F.col("copies")).alias("cf"))
    rated = written(terms.join(stats, "term").select(qid, "field", "term", "qw", "cf"), "rated")
    rows = dealt(met, terms, qid)
    rows = rows if scope is None else rows.join(scope, "doc", "left_semi")
    scored = rows.join(rated, ["field", "term"]).join(F.broadcast(written(totals, "totals")), "field")  # a row per field: a handful
    bits = dph(F.col("tf"), F.col("len"), F.col("total") / F.col("n"), F.col("n"), F.col("cf"))
    return scored.groupBy(qid, "field", "doc").agg(F.sum(F.col("qw") * bits * F.col("copies")).alias("bits"))


def field_bits(terms: DataFrame, postings: DataFrame, docs: DataFrame, totals: DataFrame, qid: str = "qid") -> DataFrame:
    """(qid, field, doc, bits): the sum over a query's terms of weight times DPH.

    ``postings`` have (field, term, doc, tf) and ``docs`` (field, doc, len). A posting whose document is not in
    ``docs`` does not count, not even in cf. Fields without documents or length give nothing.
    """
    wanted = terms.select("term").distinct()
    met = postings.join(wanted, "term", "left_semi").join(docs, ["field", "doc"])
    stats = met.groupBy("field", "term").agg(F.sum("tf").alias("cf"))
    usable = totals.where("n > 0 and total > 0")
    scored = met.join(stats, ["field", "term"]).join(F.broadcast(usable), "field")  # a row per field: a handful
    bits = dph(F.col("tf"), F.col("len"), F.col("total") / F.col("n"), F.col("n"), F.col("cf"))
    return scored.select("field", "term", "doc", bits.alias("b")).join(terms, "term").groupBy(qid, "field", "doc").agg(F.sum(F.col("qw") * F.col("b")).alias("bits"))


def top_k(scores: DataFrame, k: int, score: str = "score", key: str = "doc", by: list[str] | None = None, positive: bool = True) -> DataFrame:
    """The best ``k`` per ``by`` (or in all), ties by key; only scores above 0 unless told otherwise."""
    rows = scores.where(F.col(score) > 0) if positive else scores
    if not by:
        return rows.orderBy(F.round(score, RANK_DIGITS).desc(), key).limit(k)
    w = Window.partitionBy(*by).orderBy(F.round(score, RANK_DIGITS).desc(), key)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
