"""Queries of postings, statistics and DPH ranking: benchmark items against documents."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.counting import text_sizes
from ..functions.shared import written
from ..operators import ranking, scoring
from ..plans.search import Index, text_scores
from ..schemas import LIMITS, RANK_CAP, RANK_DIGITS, TABLES, TEST_FILES
from .common import Book, near, rounded, sql_dph, sql_terms, table

BOOK = Book()


def code_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, term, doc, tf) of the documents' texts."""
    counts = ranking.term_counts(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"), ["doc"], "text", stems=False)
    return counts.select(F.lit("code").alias("field"), "term", "doc", "tf")


def all_docs(spark: SparkSession, sf_dir: str, field: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.lit(field).alias("field"), F.col("doc_id").alias("doc"))


def item_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, term, qw) of the benchmark's items."""
    return written(ranking.weighted_terms(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text"), stems=False), "items")


def code_matched(spark: SparkSession, sf_dir: str, terms: DataFrame) -> DataFrame:
    """What the documents' texts hold of the items' terms."""
    return ranking.matched(table(spark, sf_dir, "documents"), terms, "doc_id", "text")


class Search:
    """The items against the documents, in the code field and, if asked, the path field: by a held batch, or by joins where it is too large."""

    def __init__(self, spark: SparkSession, sf_dir: str, paths: bool = False) -> None:
        self.terms = item_terms(spark, sf_dir)
        self.qid = self.terms.schema["qid"].dataType
        docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws(" ", "source", "lang").alias("path_words"))
        batch = scoring.batch(self.terms)
        self.held = batch and scoring.cut_texts(docs, "doc_id", ["text", "path_words"] if paths else ["text"], batch)
        if not self.held:
            self.met = code_matched(spark, sf_dir, self.terms)
            if paths:
                self.met = self.met.unionByName(ranking.matched(docs, self.terms, "doc_id", "path_words", "path"))

    def scores(self, best: int | None = None, scope: DataFrame | None = None) -> DataFrame:
        """(qid, doc, score, n_fields) of every item and every document that shares a term with it; with ``best`` at least of that many of each item."""
        if self.held:
            at = self.held if scope is None else replace(self.held, rows=self.held.rows.join(scope, "doc", "left_semi"))
            return scoring.scores(at, self.qid, best)
        return ranking.matched_bits(self.terms, self.met, scope=scope).groupBy("qid", "doc").agg(F.sum("bits").alias("score"), F.count(F.lit(1)).alias("n_fields"))

    def hits(self, best: int | None = None, whole: bool = False) -> DataFrame:
        """(qid, doc, n_hits, n_terms) by the code field; ``whole`` asks for documents that have all terms of an item."""
        if self.held:
            return scoring.hits(self.held, self.qid, best, whole)
        asked = written(self.terms.join(self.terms.groupBy("qid").agg(F.count(F.lit(1)).alias("n")), "qid").select("qid", "term", "n"), "asked")
        met = ranking.dealt(self.met.where("field = 'code'"), self.terms).select("term", "doc", "tf").join(asked, "term")
        rows = met.groupBy("qid", "n", "doc").agg(F.sum("tf").alias("n_hits"), F.count(F.lit(1)).alias("n_terms"))
        return (rows.where("n_terms = n") if whole else rows).select("qid", "doc", "n_hits", "n_terms")


def code_bits(spark: SparkSession, sf_dir: str, best: int | None = None, scope: DataFrame | None = None) -> DataFrame:
    """(qid, doc, score) of every item and every document that shares a term with it."""
    return Search(spark, sf_dir).scores(best, scope).select("qid", "doc", "score")


#: Common tables in SQL: postings p, lengths d, totals s, query weights q, bits b.
SQL_POSTINGS = f"""t AS (SELECT doc_id AS doc, unnest({sql_terms('text')}) AS term FROM documents),
p AS (SELECT 'code' AS field, term, doc, count(*)::DOUBLE AS tf FROM t GROUP BY term, doc),
d AS (SELECT 'code' AS field, doc_id AS doc, coalesce(len, 0.0) AS len FROM documents LEFT JOIN (SELECT doc, sum(tf) AS len FROM p GROUP BY doc) x ON doc_id = doc),
s AS (SELECT field, count(*) AS n, sum(len) AS total FROM d GROUP BY field)"""
SQL_TERMS = f"""qt AS (SELECT item_id AS qid, unnest({sql_terms('text')}) AS term FROM benchmark),
qh AS (SELECT DISTINCT item_id AS qid, unnest({sql_terms("string_split(text, chr(10))[1]")}) AS term FROM benchmark WHERE contains(rtrim(text, ' ' || chr(9) || chr(10) || chr(13)), chr(10))),
q AS (SELECT qid, term, (1 + ln(n)) * CASE WHEN qh.term IS NULL THEN 1.0 ELSE 1.5 END AS qw FROM (SELECT qid, term, count(*) AS n FROM qt GROUP BY qid, term) c LEFT JOIN qh USING (qid, term))"""
SQL_BITS = f"""m AS (SELECT p.field, p.term, p.doc, p.tf, d.len FROM p JOIN d ON p.field = d.field AND p.doc = d.doc),
f AS (SELECT field, term, sum(tf) AS cf FROM m GROUP BY field, term),
b AS (SELECT qid, m.field, m.doc, sum(qw * ({sql_dph('m.tf', 'm.len', 's.total / s.n', 's.n', 'f.cf')})) AS bits
  FROM q JOIN m ON q.term = m.term JOIN f ON f.field = m.field AND f.term = m.term JOIN s ON s.field = m.field WHERE s.n > 0 AND s.total > 0 GROUP BY qid, m.field, m.doc)"""
SQL_CODE = f"WITH {SQL_POSTINGS}, {SQL_TERMS}, {SQL_BITS}"


@BOOK.add(f"WITH {SQL_POSTINGS} SELECT term, doc, tf FROM p")
def postings(spark, sf_dir):
    """The code field's postings."""
    return code_postings(spark, sf_dir).select("term", "doc", "tf")


@BOOK.add(f"WITH {SQL_POSTINGS} SELECT * FROM d")
def field_docs(spark, sf_dir):
    """Lengths of all documents in the code field, 0 for those without terms."""
    sizes = text_sizes(ranking.spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")), ["doc"], "text")
    return ranking.lengths(sizes.select(F.lit("code").alias("field"), "doc", F.col("len").alias("tf")), all_docs(spark, sf_dir, "code"), ["field", "doc"])


@BOOK.add(f"WITH {SQL_POSTINGS} SELECT field, n, total FROM s")
def field_totals(spark, sf_dir):
    """Documents and total length of the code field."""
    return ranking.field_totals(field_docs(spark, sf_dir))


@BOOK.add(f"{SQL_CODE} SELECT qid, doc, {near('bits')} AS score FROM b")
def dph_rank(spark, sf_dir):
    """Bits of every item for every document."""
    return rounded(code_bits(spark, sf_dir), 6, "score")


def sql_top(source: str, k: int, by: str = "qid") -> str:
    return f"""(SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round(score, {RANK_DIGITS}) DESC, doc) AS rank FROM {source} WHERE score > 0) x WHERE rank <= {k}"""


@BOOK.add(f"{SQL_CODE} SELECT qid, doc, {near('score')} AS score, rank FROM {sql_top('(SELECT qid, doc, bits AS score FROM b) z', 10)}")
def dph_topk(spark, sf_dir):
    """The ten best documents of every item."""
    return rounded(ranking.top_k(code_bits(spark, sf_dir, 10), 10, by=["qid"]), 6, "score")


SQL_FIELDS = f"""WITH t AS (SELECT 'code' AS field, doc_id AS doc, unnest({sql_terms('text')}) AS term FROM documents UNION ALL SELECT 'path', doc_id, unnest({sql_terms("concat_ws(' ', source, lang)")}) FROM documents),
p AS (SELECT field, term, doc, count(*)::DOUBLE AS tf FROM t GROUP BY field, term, doc),
d AS (SELECT a.field, a.doc, coalesce(len, 0.0) AS len FROM (SELECT field, doc_id AS doc FROM documents, (VALUES ('code'), ('path')) AS f(field)) a LEFT JOIN (SELECT field, doc, sum(tf) AS len FROM p GROUP BY field, doc) x USING (field, doc)),
s AS (SELECT field, count(*) AS n, sum(len) AS total FROM d GROUP BY field), {SQL_TERMS}, {SQL_BITS}"""


@BOOK.add(f"{SQL_FIELDS} SELECT qid, doc, {near('sum(bits)')} AS score, count(*) AS n_fields FROM b GROUP BY qid, doc")
def dph_field_sum(spark, sf_dir):
    """Bits summed over the code and path fields, each with its own statistics."""
    return rounded(Search(spark, sf_dir, paths=True).scores(), 6, "score")


@BOOK.add(f"{SQL_CODE} SELECT qid, doc, {near('score')} AS score, rank FROM {sql_top("(SELECT qid, doc, bits AS score FROM b JOIN documents ON doc = doc_id WHERE starts_with(source, 'src1')) z", 5)}")
def dph_scoped(spark, sf_dir):
    """The five best documents of every item in a scope; statistics are still those of the whole collection."""
    scope = table(spark, sf_dir, "documents").where(F.col("source").startswith("src1")).select(F.col("doc_id").alias("doc"))
    return rounded(ranking.top_k(code_bits(spark, sf_dir, 5, scope), 5, by=["qid"]), 6, "score")


@BOOK.add(f"""{SQL_CODE}, ranked AS (SELECT z.*, coalesce(quality = 0, false) AS is_test FROM (SELECT qid, doc, bits AS score FROM b) z LEFT JOIN labels ON doc = doc_id),
capped AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, {RANK_DIGITS}) DESC, doc) AS r FROM ranked QUALIFY r <= 200)
SELECT qid, doc, {near('score')} AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY r) AS rank FROM capped WHERE is_test AND score > 0) WHERE rank <= 3""")
def test_partition_top3(spark, sf_dir):
    """Of every item's 200 best, the first three on the test side (here: labelled with quality 0)."""
    from pyspark.sql import Window

    from ..operators.cascade import ranked

    low = table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("doc"))
    best = ranked(code_bits(spark, sf_dir, RANK_CAP))
    tests = best.join(low, "doc", "left_semi").where("score > 0").withColumn("at", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    return rounded(tests.where("at <= 3").select("qid", "doc", "score", F.col("at").alias("rank")), 6, "score")


@BOOK.add(f"WITH {SQL_POSTINGS} SELECT p.term, p.doc, p.tf, d.len FROM p JOIN d ON p.doc = d.doc JOIN (SELECT DISTINCT unnest({sql_terms('text')}) AS term FROM benchmark) b ON b.term = p.term")
def term_postings(spark, sf_dir):
    """Postings of all benchmark terms, with the documents' lengths."""
    met = code_matched(spark, sf_dir, item_terms(spark, sf_dir)).where("term is not null")
    return met.select("term", "doc", "tf", "len", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("col")


# Conversations are files, their turns leaves, and the words of a file's first turn are its tests field.

SQL_TURNS = f"""u AS (SELECT 'c' || conv_id || '/' || turn AS doc, 'c' || conv_id AS file, turn, text FROM conversations),
t AS (SELECT doc, file, turn, unnest({sql_terms('text')}) AS term FROM u),
p AS (SELECT 'code' AS field, term, doc, count(*)::DOUBLE AS tf FROM t GROUP BY term, doc UNION ALL SELECT 'tests', term, file, count(*)::DOUBLE FROM t WHERE turn = 0 GROUP BY term, file),
d AS (SELECT 'code' AS field, u.doc, coalesce(len, 0.0) AS len FROM u LEFT JOIN (SELECT doc, sum(tf) AS len FROM p WHERE field = 'code' GROUP BY doc) x ON x.doc = u.doc UNION ALL SELECT 'tests', doc, sum(tf) FROM p WHERE field = 'tests' GROUP BY doc),
s AS (SELECT field, count(*) AS n, sum(len) AS total FROM d GROUP BY field)"""


@BOOK.add(f"""WITH {SQL_TURNS}, {SQL_TERMS}, {SQL_BITS},
tb AS (SELECT qid, doc AS file, bits FROM b WHERE field = 'tests' AND bits <> 0),
best AS (SELECT qid, file FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(bits, {RANK_DIGITS}) DESC, file) AS r FROM tb WHERE bits > 0) WHERE r <= {TEST_FILES}),
c AS (SELECT qid, doc, sum(bits) AS own FROM (SELECT qid, doc, bits FROM b WHERE field = 'code' UNION ALL SELECT qid, doc, 0.0 FROM best JOIN u USING (file)) GROUP BY qid, doc),
total AS (SELECT c.qid, c.doc, own + coalesce(tb.bits, 0.0) AS score FROM c JOIN u ON u.doc = c.doc LEFT JOIN tb ON tb.qid = c.qid AND tb.file = u.file)
SELECT qid, doc, {near('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, {RANK_DIGITS}) DESC, doc) AS r FROM total WHERE score > 0) WHERE r <= {LIMITS['text']}""")
def text_operator(spark, sf_dir):
    """The text operator in full: turns by their words and their file's tests, with the leaves of the best files."""
    turns = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("/"), "turn").alias("id"), F.concat(F.lit("c"), "conv_id").alias("path"), "turn", "text")
    code = ranking.term_counts(turns.withColumnRenamed("id", "unit_id"), ["unit_id"], "text", stems=False)
    sizes = code.groupBy(F.col("unit_id").alias("id")).agg(F.sum("tf").alias("len"))
    units = turns.join(sizes, "id", "left").select("id", "path", F.lit(True).alias("is_leaf"), F.coalesce("len", F.lit(0.0)).alias("len"))
    tests = ranking.term_counts(turns.where("turn = 0").select(F.col("path").alias("doc"), "text"), ["doc"], "text", stems=False).select(F.lit("tests").alias("field"), "term", "doc", "tf")
    none = {name: spark.createDataFrame([], TABLES[name]) for name in ("hist_postings", "hist_docs")}
    index = Index({"units": units, "postings": code, "fpostings": tests, "fdocs": tests.groupBy("field", "doc").agg(F.sum("tf").alias("len")), **none})
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text", F.lit(None).cast("string").alias("anchor"), F.lit(None).cast("string").alias("scope"))
    return rounded(text_scores(index, asked, stems=False)[0], 6, "score")
