"""Ranked search over an index: one plan for a batch of queries of any size."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import is_test, signature
from ..operators import cascade, ranking, relations
from ..schemas import K_MAX, K_MIN, LIMITS, TEST_FILES, TESTS_SHOWN, TEXT_WEIGHT_WITH_ANCHOR, UNIT_FIELDS, WEIGHTS

QUERIES = "qid string, text string, anchor string, scope string"


@dataclass
class Index:
    """The tables that searches read: units, postings, fpostings, fdocs, hist_postings, hist_docs, edges, cochange, closure."""

    tables: dict[str, DataFrame]

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


@dataclass
class Field:
    """A field of text: from an index to its postings(term, doc, tf) and docs(doc, len), of units."""

    name: str
    postings: Callable[[Index], DataFrame]
    docs: Callable[[Index], DataFrame]


#: Fields beside those that an index stores; register_field() adds to them.
FIELDS: dict[str, Field] = {}


def register_field(rule: Field) -> None:
    """Let searches count the bits of one more field of units."""
    if rule.name in (*UNIT_FIELDS, "tests"):
        raise ValueError(f"{rule.name} is a stored field")
    FIELDS[rule.name] = rule


def unit_fields() -> list[str]:
    return [*UNIT_FIELDS, *FIELDS]


def field_tables(index: Index) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All fields' postings(field, term, doc, tf), docs(field, doc, len) and totals(field, n, total)."""
    units, leaf = index["units"], index["units"].where("is_leaf")
    code = index["postings"].select(F.lit("code").alias("field"), "term", F.col("unit_id").alias("doc"), "tf")
    history = index["hist_postings"].select(F.lit("history").alias("field"), "term", F.col("unit_id").alias("doc"), "tf")
    derived = index["fpostings"].select("field", "term", "doc", "tf")
    code_docs = leaf.select(F.lit("code").alias("field"), F.col("id").alias("doc"), "len")
    hist_docs = index["hist_docs"].join(units.select(F.col("id").alias("unit_id")), "unit_id", "left_semi").select(F.lit("history").alias("field"), F.col("unit_id").alias("doc"), "len")
    derived_docs = index["fdocs"].select("field", "doc", "len")
    docs = code_docs.unionByName(hist_docs).unionByName(derived_docs)
    for rule in FIELDS.values():
        derived = derived.unionByName(rule.postings(index).select(F.lit(rule.name).alias("field"), "term", "doc", "tf"))
        docs = docs.unionByName(rule.docs(index).select(F.lit(rule.name).alias("field"), "doc", "len"))
    n = leaf.agg(F.count(F.lit(1)).alias("leaves"))  # history counts leaves, though containers may have history
    totals = ranking.field_totals(docs).join(F.broadcast(n)).select("field", F.when(F.col("field") == "history", F.col("leaves")).otherwise(F.col("n")).alias("n"), "total")
    return code.unionByName(history).unionByName(derived), docs, totals


def text_scores(index: Index, queries: DataFrame, stems: bool = True) -> tuple[DataFrame, DataFrame]:
    """Bits of units for each query's text: (qid, doc, score), and (qid, part, doc, score) by field.

    A file's bits in the tests field count for each of its candidates; the leaves of the best files by them are
    candidates too. A scope leaves out candidates and no statistics.
    """
    postings, docs, totals = field_tables(index)
    asked = queries.where(F.length(F.trim("text")) > 0)
    bits = ranking.field_bits(ranking.weighted_terms(asked, stems=stems), postings, docs, totals)
    places = index["units"].select(F.col("id").alias("doc"), F.col("path").alias("file"), "is_leaf")
    scopes = asked.select("qid", F.coalesce("scope", F.lit("")).alias("scope"))
    unit_bits = bits.where(F.col("field").isin(*unit_fields())).join(places, "doc").join(scopes, "qid").where(F.col("file").startswith(F.col("scope")))
    file_bits = bits.where("field = 'tests'").select("qid", F.col("doc").alias("file"), F.col("bits").alias("test_bits")).where("test_bits <> 0")
    best = ranking.top_k(file_bits.join(scopes, "qid").where(F.col("file").startswith(F.col("scope"))), TEST_FILES, score="test_bits", key="file", by=["qid"]).select("qid", "file")
    extra = best.join(places.where("is_leaf"), "file").select("qid", "doc", "file", F.lit("code").alias("field"), F.lit(0.0).alias("bits"), F.lit(True).alias("only_candidate"))
    parts = unit_bits.select("qid", "doc", "file", "field", "bits", F.lit(False).alias("only_candidate")).unionByName(extra)
    own = parts.groupBy("qid", "doc", "file").agg(F.sum("bits").alias("own"))
    total = own.join(file_bits, ["qid", "file"], "left").select("qid", "doc", (F.col("own") + F.coalesce("test_bits", F.lit(0.0))).alias("score"), "test_bits")
    top = ranking.top_k(total, LIMITS["text"], by=["qid"]).select("qid", "doc", "score", "test_bits")
    by_field = parts.where("not only_candidate").select("qid", F.col("field").alias("part"), "doc", F.col("bits").alias("score"))
    tests = top.where("test_bits is not null").select("qid", F.lit("tests").alias("part"), "doc", F.col("test_bits").alias("score"))
    details = by_field.join(top.select("qid", "doc"), ["qid", "doc"], "left_semi").select("qid", "part", "doc", "score").unionByName(tests)
    return top.select("qid", "doc", "score"), details


@dataclass
class Context:
    """What an anchored query starts from: centres(anchor, id, parent, path, ord) and inside(anchor, unit)."""

    index: Index
    centres: DataFrame
    inside: DataFrame


def _tree_near(c: Context) -> DataFrame:
    return relations.near_in_order(c.index["units"].where("parent is not null"), c.centres, c.inside, "parent")


def _same_file(c: Context) -> DataFrame:
    return relations.near_in_order(c.index["units"].where("is_leaf"), c.centres, c.inside, "path", scale=4.0)


@dataclass
class Scorer:
    """An operator of the first stage: from an anchor's context to (anchor, doc, score)."""

    name: str
    weight: float
    limit: int
    score: Callable[[Context], DataFrame]
    positive: bool = True


#: Scorers of anchored queries; register() adds to them.
SCORERS: dict[str, Scorer] = {
    "refs_out": Scorer("refs_out", WEIGHTS["refs_out"], LIMITS["refs_out"], lambda c: relations.neighbours(c.index["edges"], c.inside)),
    "refs_in": Scorer("refs_in", WEIGHTS["refs_in"], LIMITS["refs_in"], lambda c: relations.neighbours(c.index["edges"], c.inside, outward=False)),
    "tree_near": Scorer("tree_near", WEIGHTS["tree_near"], LIMITS["tree_near"], _tree_near),
    "same_file": Scorer("same_file", WEIGHTS["same_file"], LIMITS["same_file"], _same_file),
    "cochange": Scorer("cochange", WEIGHTS["cochange"], LIMITS["cochange"], lambda c: relations.neighbours(c.index["cochange"], c.inside), positive=False),
}


def register(scorer: Scorer) -> None:
    SCORERS[scorer.name] = scorer


@dataclass
class Plan:
    """Which operators a search uses, and their weights."""

    off: set[str] = field(default_factory=set)
    weights: dict[str, float] = field(default_factory=dict)

    def use(self, name: str) -> bool:
        return name not in self.off

    def weight(self, name: str, default: float) -> float:
        return self.weights.get(name, default)


def anchor_context(index: Index, queries: DataFrame) -> Context:
    """Anchors are ids of units; their sets are their subtrees."""
    asked = queries.where("anchor is not null").select(F.col("qid").alias("anchor"), F.col("anchor").alias("id"))
    centres = asked.join(index["units"].select("id", "parent", "path", "ord"), "id")
    below = index["closure"].select(F.col("ancestor").alias("id"), F.col("descendant").alias("unit"))
    return Context(index, centres, asked.join(below, "id").select("anchor", "unit"))


def candidates(index: Index, queries: DataFrame, plan: Plan) -> DataFrame:
    """(qid, doc, score, via): the union of all operators' scaled scores."""
    spark = queries.sparkSession
    anchored = not queries.where("anchor is not null").isEmpty()
    parts, weights, details = [], [], None
    worded = F.length(F.trim("text")) > 0
    if plan.use("text"):
        scores, by_field = text_scores(index, queries)
        parts.append(scores.select("qid", F.lit("text").alias("op"), "doc", "score"))
        details = by_field.select("qid", F.lit("text").alias("op"), "part", "doc", "score")
        w = F.when(F.col("anchor").isNull(), plan.weight("text", 1.0)).otherwise(plan.weight("text", TEXT_WEIGHT_WITH_ANCHOR))
        weights.append(queries.where(worded).select("qid", F.lit("text").alias("op"), w.alias("weight")))
    if anchored:
        context = anchor_context(index, queries)
        for s in SCORERS.values():
            if plan.use(s.name):
                top = ranking.top_k(s.score(context), s.limit, by=["anchor"], positive=s.positive)
                parts.append(top.select(F.col("anchor").alias("qid"), F.lit(s.name).alias("op"), "doc", "score"))
                weights.append(queries.where("anchor is not null").select("qid", F.lit(s.name).alias("op"), F.lit(plan.weight(s.name, s.weight)).alias("weight")))
    if not parts:
        return spark.createDataFrame([], "qid string, doc string, score double, via array<struct<op: string, contribution: double>>")
    union = lambda frames: frames[0] if len(frames) == 1 else union([frames[0].unionByName(frames[1]), *frames[2:]])
    return cascade.scaled_union(union(parts), union(weights), details=details)


def search(index: Index, queries: DataFrame, k_max: int = K_MAX, k_min: int | None = K_MIN, plan: Plan | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, tests) of queries(qid, text, anchor, scope), both ordered by rank within their query.

    Columns: qid, rank, doc, score, via, lifted and the unit's path, kind, label, start_line, end_line, signature.
    """
    plan = plan or Plan()
    units = index["units"].select(F.col("id").alias("doc"), "path", "parent", "kind", "label", "start_line", "end_line", "text")
    found = candidates(index, queries, plan).join(units.select("doc", "path"), "doc").join(queries.select("qid", "scope"), "qid")
    found = found.where(F.col("scope").isNull() | F.col("path").startswith(F.col("scope"))).select("qid", "doc", "score", "via", "path")
    best = cascade.ranked(found).withColumn("test", is_test(F.col("doc"), F.col("path")))
    best = relations.cut(best)
    closure = index["closure"]
    sources = cascade.collapse_ancestors(best.where("not test"), closure)
    tests = cascade.collapse_ancestors(best.where("test"), closure).where("score > 0")
    spans = units.select(F.col("doc").alias("parent"), (F.col("end_line") - F.col("start_line") + 1).alias("span"))
    parents = units.select("doc", "parent").join(spans, "parent")
    lifted = cascade.lift_siblings(sources.select("qid", "doc", "score", "rank"), parents, k_max)
    cut = cascade.adaptive_cut(lifted, k_min if k_min is not None else k_max, k_max)
    w = Window.partitionBy("qid").orderBy("pos")
    hits = lifted.withColumn("rank", F.row_number().over(w)).join(cut, "qid").where(F.col("rank") <= F.col("k"))
    said = sources.select("qid", "doc", F.explode("via").alias("v")).select("qid", "doc", "v.op", "v.contribution")
    above = said.join(parents.select("doc", "parent"), "doc").select("qid", F.col("parent").alias("doc"), "op", "contribution", F.lit(True).alias("up"))
    named = hits.select("qid", "doc", (F.col("lifted") > 0).alias("up"))
    all_said = said.withColumn("up", F.lit(False)).unionByName(above).join(named, ["qid", "doc", "up"]).groupBy("qid", "doc", "op").agg(F.max("contribution").alias("contribution"))
    via = all_said.groupBy("qid", "doc").agg(F.array_sort(F.collect_list(F.struct("op", "contribution"))).alias("via"))  # a row per operator
    shown = tests.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where(F.col("rank") <= TESTS_SHOWN)
    none = F.array().cast("array<struct<op: string, contribution: double>>")

    def final(rows: DataFrame) -> DataFrame:
        return rows.join(units, "doc").select("qid", "rank", "doc", "score", F.coalesce("via", none).alias("via"), "lifted", "path", "kind", "label", "start_line", "end_line", signature(F.col("text")).alias("signature"))

    hits = final(hits.select("qid", "doc", "score", "rank", "lifted").join(via, ["qid", "doc"], "left"))
    return hits, final(shown.select("qid", "doc", "score", "rank", F.lit(0).alias("lifted"), "via"))


def query_rows(spark: SparkSession, *rows: tuple) -> DataFrame:
    """Queries (qid, text, anchor, scope)."""
    return spark.createDataFrame(list(rows), QUERIES)
