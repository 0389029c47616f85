"""DPH scores of many texts for a batch of queries that all executors can hold: what ``ranking`` does by joins, without moving scores.

A batch is held if its table of terms by queries has at most ``CELLS`` cells; a larger one is for the joins of ``ranking``. Each text is cut once and
kept as the numbers of the terms it has (``Texts.rows``); scores of a text are made where it is read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from ..functions.counting import CODECS, ROWS, latin_counts, outside
from ..functions.shared import written
from ..functions.text import tokenize_raw
from .ranking import spread

#: Terms times queries of a batch that goes to all executors (64 MB of weights).
CELLS = 1 << 23
#: Scores that rank alike to RANK_DIGITS decimals are nearer to each other than this.
SLACK = 1e-8


@dataclass
class Batch:
    """Queries: their ids (Arrow), terms, and the weights qw of (term, query) as (term's number, query's number, qw)."""

    qids: pa.Array
    terms: list[str]
    at: np.ndarray
    of: np.ndarray
    qw: np.ndarray

    def table(self) -> np.ndarray:
        out = np.zeros((len(self.terms), len(self.qids)))
        out[self.at, self.of] = self.qw
        return out


def batch(terms: DataFrame, qid: str = "qid") -> Batch | None:
    """The batch of terms(qid, term, qw); None if it is too large to be held."""
    n = terms.agg(F.count_distinct("term").alias("t"), (F.count_distinct(qid) + F.max(F.col(qid).isNull().cast("int"))).alias("q")).first()
    if (n["t"] or 0) * (n["q"] or 0) > CELLS:
        return None
    rows = terms.select(qid, "term", "qw").toArrow().combine_chunks()
    if not rows.num_rows:
        return Batch(pa.array([], rows.schema.field(qid).type), [], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    q, t = (rows.column(c).combine_chunks().dictionary_encode("encode") for c in (qid, "term"))
    return Batch(q.dictionary, t.dictionary.to_pylist(), t.indices.to_numpy(), q.indices.to_numpy(), rows.column("qw").to_numpy())


@dataclass
class Texts:
    """Texts cut for a batch: rows(doc, copies, and of each field len, ids, tf), with each field's number of texts, their length, and its terms' occurrences."""

    batch: Batch
    rows: DataFrame
    fields: int
    n: np.ndarray
    total: np.ndarray
    cf: np.ndarray


def _lists(values: list, kind: pa.DataType, dtype) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.fromiter((x for v in values for x in v), dtype, int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def _cutter(terms: list[str], fields: int, schema: pa.Schema):
    def cut(batches):
        number: dict[str, dict[bytes, int]] = {"utf-8": {t.encode(): i for i, t in enumerate(terms)}}
        for codec in CODECS:
            number[codec] = {t.encode(codec): i for i, t in enumerate(terms) if t.encode(codec, "ignore").decode(codec) == t}

        def count(value):
            """(tokens, numbers, occurrences) of a text, or of its terms."""
            if not value:
                return 0.0, (), ()
            if isinstance(value, str):
                codec, counts = latin_counts(value)
                known, n = number[codec], sum(c for t, c in counts.items() if len(t) > 1)
            else:
                counts: dict[bytes, int] = {}
                for t in value:
                    t = t.encode()
                    counts[t] = counts.get(t, 0) + 1
                known, n = number["utf-8"], len(value)
            met = [(known[t], c) for t, c in counts.items() if t in known]
            return float(n), [i for i, _ in met], [c for _, c in met]

        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                part = whole.slice(at, ROWS)
                docs, columns = part.column(0), [part.column(1 + f).to_pylist() for f in range(fields)]
                empty = docs.is_null().to_pylist()
                cut_here = [i for i in range(part.num_rows) if not any(isinstance(c[i], str) and outside(c[i]) for c in columns)]
                out = [docs.take(pa.array(cut_here, pa.int64())), pa.array(np.ones(len(cut_here), np.int64))]
                for c in columns:
                    found = [count(None if empty[i] else c[i]) for i in cut_here]
                    out += [pa.array([x[0] for x in found], pa.float64()), _lists([x[1] for x in found], pa.int32(), np.int32), _lists([x[2] for x in found], pa.float64(), np.float64)]
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return cut


def _others(fields: int):
    """The rows with a text that is not counted here."""

    def pick(batches):
        for part in batches:
            columns = [part.column(1 + f).to_pylist() for f in range(fields)]
            yield part.filter(pa.array([any(t and outside(t) for t in row) for row in zip(*columns)], pa.bool_()))

    return pick


def _flat(part: pa.RecordBatch, f: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(len of each row, its end in what follows, ids, tf) of a field."""
    size, ids, tf = (part.column(2 + 3 * f + k) for k in range(3))
    ends = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())]).astype(np.int64)
    return size.to_numpy(), ends, ids.flatten().to_numpy(), tf.flatten().to_numpy()


def _summer(n_terms: int, fields: int):
    """Per field and term the occurrences, and at -1 the length and number of texts."""

    def add(batches):
        cf, n, total = np.zeros((fields, n_terms)), np.zeros(fields), np.zeros(fields)
        for part in batches:
            copies = part.column(1).to_numpy().astype(np.float64)
            for f in range(fields):
                size, ends, ids, tf = _flat(part, f)
                cf[f] += np.bincount(ids, tf * np.repeat(copies, np.diff(ends)), n_terms)
                n[f] += copies.sum()
                total[f] += (copies * size).sum()
        for f in range(fields):
            at = np.concatenate([[-1], np.flatnonzero(cf[f])])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), f)), pa.array(at), pa.array(np.concatenate([[total[f]], cf[f][at[1:]]])), pa.array(np.concatenate([[n[f]], np.zeros(len(at) - 1)]))], names=["f", "at", "x", "n"])

    return add


def cut_texts(texts: DataFrame, key: str, fields: list[str], asked: Batch) -> Texts:
    """The texts in ``fields`` of each row, cut once and written. Rows of one key are one document, that counts as often as it has rows."""
    rows = spread(texts.select(F.col(key).alias("doc"), *[F.col(c).alias(f"_t{i}") for i, c in enumerate(fields)]))
    columns = [StructField(f"{name}{i}", kind) for i in range(len(fields)) for name, kind in (("len", DoubleType()), ("ids", ArrayType(IntegerType())), ("tf", ArrayType(DoubleType())))]
    schema = StructType([StructField("doc", rows.schema["doc"].dataType), StructField("copies", LongType()), *columns])
    names = pa.schema([(c, pa.null()) for c in schema.names])
    fast = rows.mapInArrow(_cutter(asked.terms, len(fields), names), schema)
    terms = rows.mapInArrow(_others(len(fields)), rows.schema).select("doc", *[F.coalesce(tokenize_raw(F.col(f"_t{i}")), F.array().cast("array<string>")).alias(f"_t{i}") for i in range(len(fields))])
    cut = written(fast.unionByName(terms.mapInArrow(_cutter(asked.terms, len(fields), names), schema)), "cut")
    if not cut.where("doc is not null").groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        cut = written(_merged(cut, len(fields)), "cut")
    sums = cut.mapInArrow(_summer(len(asked.terms), len(fields)), "f long, at long, x double, n double").groupBy("f", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).toArrow()
    f, at, x, n = (sums.column(c).to_numpy() for c in ("f", "at", "x", "n"))
    cf, of, total = np.zeros((len(fields), len(asked.terms))), np.zeros(len(fields)), np.zeros(len(fields))
    cf[f[at >= 0], at[at >= 0]] = x[at >= 0]
    of[f[at < 0]], total[f[at < 0]] = n[at < 0], x[at < 0]
    return Texts(asked, cut, len(fields), of, total, cf)


def _merged(cut: DataFrame, fields: int) -> DataFrame:
    """One row for each key, and for each text without a key."""
    parts = [x for i in range(fields) for x in (F.sum(f"len{i}").alias(f"len{i}"), F.collect_list(F.arrays_zip(F.col(f"ids{i}").alias("i"), F.col(f"tf{i}").alias("n"))).alias(f"_z{i}"))]
    one = cut.where("doc is not null").groupBy("doc").agg(F.sum("copies").alias("copies"), *parts)
    for i in range(fields):
        flat = F.flatten(f"_z{i}")
        ids = F.array_distinct(F.transform(flat, lambda x: x["i"]))
        tf = F.transform(ids, lambda k: F.aggregate(F.filter(flat, lambda x: x["i"] == k), F.lit(0.0), lambda a, x: a + x["n"]))  # noqa: B023
        one = one.withColumn(f"ids{i}", ids).withColumn(f"tf{i}", tf)
    return one.select(cut.columns).unionByName(cut.where("doc is null"))


def _bits(size: np.ndarray, tf: np.ndarray, avg: float, n: float, cf: np.ndarray) -> np.ndarray:
    """``dph`` over arrays."""
    with np.errstate(divide="ignore", invalid="ignore"):
        f = tf / size
        gain = tf * np.log2((tf * avg / size) * (n / cf)) + 0.5 * np.log2(2 * 3.141592653589793 * tf * np.maximum(1 - f, 1e-12))
        return np.where((tf <= 0) | (size <= 0) | (cf <= 0), 0.0, (1 - f) ** 2 / (tf + 1) * gain)


def _scorer(asked: Batch, n: np.ndarray, total: np.ndarray, cf: np.ndarray, pick, hits: bool, names: list[str]):
    fields = len(n)

    def score(batches):
        weights = asked.table()
        has = (weights > 0).astype(np.float64 if hits else np.bool_)
        q = len(asked.qids)
        choose = pick(q) if pick else None
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                part = whole.slice(at, ROWS)
                first, second, count = np.zeros((part.num_rows, q)), np.zeros((part.num_rows, q)), np.zeros((part.num_rows, q), np.int64)
                copies = part.column(1).to_numpy()
                for f in range(fields):
                    size, ends, ids, tf = _flat(part, f)
                    if hits:  # how many terms a text has, and how often
                        for i in np.flatnonzero(np.diff(ends)):
                            a, b = ends[i], ends[i + 1]
                            mine = has[ids[a:b]]
                            count[i] += mine.sum(axis=0).astype(np.int64)
                            first[i] += tf[a:b] @ mine
                    elif n[f] > 0 and total[f] > 0:
                        each = np.diff(ends)
                        bits = _bits(np.repeat(size, each), tf, total[f] / n[f], n[f], cf[f][ids]) * np.repeat(copies, each)
                        for i in np.flatnonzero(each):
                            a, b = ends[i], ends[i + 1]
                            first[i] += bits[a:b] @ weights[ids[a:b]]
                            count[i] += has[ids[a:b]].any(axis=0)
                keep = count > 0 if choose is None else choose(first, count)
                doc, of = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([asked.qids.take(pa.array(of)), part.column(0).take(pa.array(doc)), pa.array(first[doc, of]), pa.array(count[doc, of])], names=names)

    return score


def _best(k: int, hits: bool):
    """What may be among the best ``k`` of a query: of each batch the scores not below the k-th best so far."""

    def start(q: int):
        top = np.full((k, q), -np.inf)

        def choose(first: np.ndarray, count: np.ndarray) -> np.ndarray:
            nonlocal top
            order = np.where(count > 0, count * 1e9 + first if hits else first, -np.inf)
            top = np.partition(np.concatenate([top, order]), -k, axis=0)[-k:]
            return (count > 0) & (order >= top.min(axis=0) - SLACK)

        return choose

    return start


def _whole(n: np.ndarray):
    return lambda q: lambda first, count: (count > 0) & (count == n)


def _run(texts: Texts, pick, hits: bool, columns: tuple[str, str], qid) -> DataFrame:
    schema = StructType([StructField("qid", qid), texts.rows.schema["doc"], StructField(columns[0], DoubleType()), StructField(columns[1], LongType())])
    return texts.rows.where("doc is not null").mapInArrow(_scorer(texts.batch, texts.n, texts.total, texts.cf, pick, hits, schema.names), schema)


def scores(texts: Texts, qid, best: int | None = None) -> DataFrame:
    """(qid, doc, score, n_fields) of all documents that share a term with a query, or of those that may be among its ``best``."""
    return _run(texts, best and _best(best, False), False, ("score", "n_fields"), qid)


def hits(texts: Texts, qid, best: int | None = None, whole: bool = False) -> DataFrame:
    """(qid, doc, n_hits, n_terms): how many of a query's terms a document has, and how often; of all, of those that may be the ``best`` by both, or of those that have all terms."""
    n = np.bincount(texts.batch.of, minlength=len(texts.batch.qids))
    return _run(texts, _whole(n) if whole else best and _best(best, True), True, ("n_hits", "n_terms"), qid)
