"""Toxicity by multiple-instance learning.

A document is a bag of sentences; only documents have labels. A sentence's probability is the sigmoid of a bias
and the weights of its distinct words, each that of the word itself and of its beginnings; a document's is the noisy-or of its sentences: 1 - prod(1 - p). The
gradient of the documents' likelihood reaches the sentences through the noisy-or, so those that explain a label
take it on, and after training a sentence's own probability locates what offends.

Every feature has a weight: features are hashed to ``1 << BITS`` places, so a model has one size whatever it has seen.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, slices

SENTENCE = re.compile(rb"[^.!?\n]+")
WORD = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Lengths, in bytes, of the beginnings of words that are features beside the words.
BEGINNINGS = (4, 5, 6, 7, 8, 9)
#: Words whose weights a model remembers at most before it forgets them all.
REMEMBERED = 200_000
#: Labelled documents that training takes at most, about (chosen by a hash of the id); places of features.
SAMPLE, BITS = 20_000, 20
#: What keeps steps of rare features small, whose gradients are.
EVEN = 1e-2


def sentences(text: str | None) -> list[tuple[int, int, set[bytes]]]:
    """Byte offsets and distinct words of each sentence with words."""
    data = text.encode("utf-8", "surrogatepass") if text else b""
    return [(m.start(), m.end(), words) for m in SENTENCE.finditer(data) if (words := set(m[0].translate(WORD).split()))]


def features(word: bytes) -> list[int]:
    """The places of the word, and of its beginnings (marked by a leading space, which no word has)."""
    mask = (1 << BITS) - 1
    return [zlib.crc32(word) & mask, *(zlib.crc32(b" " + word[:k]) & mask for k in BEGINNINGS if len(word) >= k)]


class Weights(dict):
    """word -> its weight, computed when first asked for."""

    def __init__(self, of: np.ndarray):
        super().__init__()
        self.of = of

    def __missing__(self, word: bytes) -> float:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = total = float(self.of[features(word)].sum())
        return total


@dataclass
class Model:
    bias: float
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.float32))  # of places

    def scorer(self):
        """text -> the document's probability, and the sentences (byte offsets, probability) that offend.

        A text without words has no sentence that could offend: 0.
        """
        weight, bias = Weights(self.weights).__getitem__, self.bias
        of_plain = math.log1p(math.exp(bias))

        def score(text: str | None, at_least: float = 0.5) -> tuple[float, list[tuple[int, int, float]]]:
            total, found = 0.0, []
            for a, b, words in sentences(text):
                if extra := sum(map(weight, words)):
                    z = bias + extra
                    total += max(z, 0.0) + math.log1p(math.exp(-abs(z)))
                    if z > -700 and (p := 1 / (1 + math.exp(-z))) >= at_least:
                        found.append((a, b, p))
                else:
                    total += of_plain
            return -math.expm1(-total), found

        return score


@dataclass
class Bags:
    """Documents as bags of sentences, sentences as sets of words, words as places of features."""

    y: np.ndarray
    doc: np.ndarray  # of each sentence
    sent: np.ndarray  # of each word in a sentence
    word: np.ndarray
    owner: np.ndarray  # the word of each feature
    place: np.ndarray

    @classmethod
    def of(cls, rows) -> Bags:
        """rows: (label, text)."""
        known: dict[bytes, int] = {}
        y, per_doc, size, word = [], [], array("q"), array("i")
        for label, text in rows:
            found = sentences(text)
            y.append(label)
            per_doc.append(len(found))
            for _, _, words in found:
                size.append(len(words))
                word.extend([known.setdefault(w, len(known)) for w in words])
        places = [features(w) for w in known]
        n = np.array(size, np.int64)
        return cls(
            np.array(y, np.int64), np.repeat(np.arange(len(y)), per_doc), np.repeat(np.arange(len(n)), n), np.array(word, np.int32),
            np.repeat(np.arange(len(places)), [len(x) for x in places]), np.fromiter((p for x in places for p in x), np.int64),
        )

    def start(self) -> np.ndarray:
        """Log odds of each place between labels, where documents that have it say so clearly."""
        v = 1 << BITS
        n = [np.zeros(v), np.zeros(v)]
        seen = np.unique(self.doc[self.sent].astype(np.int64) << 32 | self.word)  # words of documents
        doc, word = seen >> 32, seen & 0xFFFFFFFF
        for label in (0, 1):
            per_word = np.bincount(word[self.y[doc] == label], minlength=self.owner[-1] + 1 if len(self.owner) else 0)
            n[label] = np.bincount(self.place, per_word[self.owner], v)
        total = np.maximum(np.bincount(self.y, minlength=2), [n[0].max(), n[1].max()])  # a place may count a document for several words
        odds = np.log((n[1] + 0.5) / (total[1] - n[1] + 0.5)) - np.log((n[0] + 0.5) / (total[0] - n[0] + 0.5))
        z = np.abs(odds) / np.sqrt(1 / (n[1] + 0.5) + 1 / (n[0] + 0.5))
        return np.where(z > 4, np.clip(odds, -2, 4), 0.0)


def loss(x: np.ndarray, bags: Bags) -> tuple[float, np.ndarray]:
    """Minus the mean log likelihood of the documents' labels, and its gradient; x: the bias, then the weights of the places."""
    of_word = np.bincount(bags.owner, x[1:][bags.place])
    z = x[0] + np.bincount(bags.sent, of_word[bags.word], len(bags.doc))
    soft, p = np.logaddexp(0, z), 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    total = np.clip(np.bincount(bags.doc, soft, len(bags.y)), 1e-9, 500)
    toxic = bags.y == 1
    value = np.where(toxic, -np.log(-np.expm1(-total)), total).mean()
    pull = np.where(toxic, -1 / np.expm1(total), 1.0)  # dL/dsoft of each document
    dz = pull[bags.doc] * p
    per_word = np.bincount(bags.word, dz[bags.sent], len(of_word))
    g = np.concatenate([[dz.sum()], np.bincount(bags.place, per_word[bags.owner], len(x) - 1)]) / len(bags.y)
    return float(value), g


def fit(bags: Bags, rounds: int = 200, rate: float = 0.05, ridge: float = 2e-5) -> tuple[float, np.ndarray]:
    """Bias and weights, by Adam on the documents' likelihood. Only places that occur have a weight."""
    used, at = np.unique(bags.place, return_inverse=True)
    small = replace(bags, place=at.reshape(-1))
    x = np.concatenate([[-4.0], bags.start()[used]])
    m, s2 = np.zeros(len(x)), np.zeros(len(x))
    for t in range(1, rounds + 1):
        _, g = loss(x, small)
        g[1:] += ridge * x[1:]
        m, s2 = 0.9 * m + 0.1 * g, 0.999 * s2 + 0.001 * g * g
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s2 / (1 - 0.999**t)) + EVEN)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = x[1:]
    return float(x[0]), weights


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from labelled documents; rows without label, id or text are left out.

    About ``sample`` labelled rows at most are taken, by a hash of their id; texts are read whole. One task fits them, batch
    by batch turned to arrays. Without documents of both labels every score is 0.
    """
    spark = docs.sparkSession
    marked = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    n = marked.count()
    share = min(1.0, sample / max(1, n))
    marked = marked.where((F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(share * (1 << 20))))  # about ``sample`` rows of 12 bytes
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")
    taken = materialize(texts.join(F.broadcast(marked), "id").select("y", "text"), "labelled")

    def one(batches):
        bags = Bags.of((y, text) for batch in slices(batches) for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist()))
        if len(np.unique(bags.y)) > 1 and len(bags.place):
            bias, w = fit(bags)
            yield pa.RecordBatch.from_arrays([pa.array([bias]), pa.array([w.tobytes()], pa.binary())], ["bias", "weights"])

    done = taken.coalesce(1).mapInArrow(one, "bias double, weights binary").collect()
    discard(taken)
    return Model(done[0].bias, np.frombuffer(bytes(done[0].weights), np.float32)) if done else Model(-50.0)


def _score(shared):
    def score(batches):
        of = shared.value.scorer()
        for batch in slices(batches):
            got = [of(t) for t in batch.column("text").to_pylist()]
            spans = pa.array([[{"start": a, "end": b, "score": p} for a, b, p in x] for _, x in got], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([p for p, _ in got], pa.float64()), spans], ["id", "score", "offending"])

    return score


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score, offending (byte spans of the sentences with a probability of 0.5 or more).

    A null text, or one without words, scores 0. Only the two columns are read; ids may be null or repeated.
    """
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    done = src.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), "id long, score double, offending array<struct<start: long, end: long, score: double>>")
    return done.withColumnRenamed("id", id_col)
