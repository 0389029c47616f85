"""Language ID with language-bitmask n-gram filters.

Training counts byte n-grams by language over all training documents, all of them. An n-gram belongs to a language if its share
of that language's n-grams is at least ``min_ratio`` of its largest share in any language: what a language has only in
passing, as every one has everything once the corpus is large, is not its own. They go into one bit-sliced Bloom filter, with as
many slots as there are n-grams, and more: each slot is a bitmask of languages, and the AND of an n-gram's slots is the mask of
all languages that contain it. A text's score for a language is its number of n-grams with that bit, corrected for the
filter's false positives; the largest decides.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, slices

LETTER = re.compile(r"[^\W\d_]")
N, HASHES = 4, 2
#: Slots of the filter: so many an n-gram, from the least to the most (16 MB for 64 languages). In a fuller filter
#: more is taken back as false positives.
SLOTS_EACH, SLOTS_LEAST, SLOTS_MOST = 8, 1 << 16, 1 << 21
#: Distinct words of a language that a training task holds before it passes their counts on.
HELD = 100_000
#: Bytes of a document that are not letters become spaces.
FOLD = bytes((b | 0x20) if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def has_letter(text: str) -> bool:
    """Whether a character is a letter; numbers of any script are none."""
    return any(m[0].isalpha() for m in LETTER.finditer(text))


def grams(data: bytes) -> np.ndarray:
    """The n-grams of folded bytes that lie within a word with its bounding spaces, as integers."""
    x = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(x) < N:
        return np.zeros(0, np.uint32)
    g = (x[:-3] << np.uint32(24)) | (x[1:-2] << np.uint32(16)) | (x[2:-1] << np.uint32(8)) | x[3:]
    inner = (x[1:-2] != 32) & (x[2:-1] != 32)
    return g[inner]


def folded(text: str) -> bytes:
    return b" " + b" ".join(text.encode("utf-8", "surrogatepass").translate(FOLD).split()) + b" "


def slots(g: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two of ``n`` slots (a power of two) of an n-gram."""
    with np.errstate(over="ignore"):
        h = g.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(40)).astype(np.int64) & (n - 1), (h >> np.uint64(16)).astype(np.int64) & (n - 1)


def _slot_masks(n: int):
    """(slot, word, mask) of n-grams and the numbers of their languages, merged within a batch."""

    def masks(batches):
        for batch in batches:
            langs = batch.column("langs")
            g = batch.column("gram").to_numpy().astype(np.uint32)
            k = langs.values.to_numpy().astype(np.int64)[: langs.offsets[-1].as_py()][langs.offsets[0].as_py() :]
            g = np.repeat(g, np.diff(langs.offsets.to_numpy()))
            word, bit = np.tile(k // 64, 2), np.tile(np.uint64(1) << (k % 64).astype(np.uint64), 2)
            at, back = np.unique(np.concatenate(slots(g, n)) << 20 | word, return_inverse=True)
            mask = np.zeros(len(at), np.uint64)
            np.bitwise_or.at(mask, back.reshape(-1), bit)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 20), pa.array(at & 0xFFFFF), pa.array(mask.view(np.int64))], ["slot", "word", "mask"])

    return masks


def _gram_counts(batches):
    """(lang, gram, n), pre-aggregated: words are counted first, and each distinct word is cut once."""

    def passed(held):
        for lang, words in held.items():
            line = b" ".join(words)
            x = b" " + line + b" "
            n = np.fromiter(words.values(), np.int64, len(words))
            size = np.fromiter(map(len, words), np.int64, len(words))
            weight = np.repeat(n, size + 1)  # of each byte, with the space before it, its word's count
            g = np.frombuffer(x, np.uint8).astype(np.uint32)
            if len(g) < N:
                continue
            code = (g[:-3] << np.uint32(24)) | (g[1:-2] << np.uint32(16)) | (g[2:-1] << np.uint32(8)) | g[3:]
            inner = (g[1:-2] != 32) & (g[2:-1] != 32)
            code, back = np.unique(code[inner], return_inverse=True)
            total = np.bincount(back, weights=weight[: len(inner)][inner]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(total)], ["lang", "gram", "n"])

    held: dict[str, Counter] = {}
    for batch in slices(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            held.setdefault(lang, Counter()).update(text.encode("utf-8", "surrogatepass").translate(FOLD).split())
            if len(held[lang]) > HELD:
                yield from passed({lang: held.pop(lang)})
    yield from passed(held)


@dataclass
class Model:
    langs: list[str]
    masks: np.ndarray  # [slot, 64 languages each] uint64
    false: np.ndarray  # false positive rate of each language's filter

    def hits(self, g: np.ndarray) -> np.ndarray:
        """[gram, language] of 0 and 1."""
        a, b = slots(g, len(self.masks))
        both = self.masks[a] & self.masks[b]
        return np.unpackbits(both.view(np.uint8).reshape(len(g), -1), axis=1, bitorder="little")[:, : len(self.langs)]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and a score from 0 to 1: the share of the corrected counts that is the winner's."""
        if not text or not has_letter(text) or not self.langs:
            return "und", 0.0
        g, counts = np.unique(grams(folded(text)), return_counts=True)
        if not len(g):
            return self.langs[0], 0.0
        found, n = np.zeros(len(self.langs)), counts.sum()
        for at in range(0, len(g), 1 << 16):
            found += counts[at : at + (1 << 16)] @ self.hits(g[at : at + (1 << 16)])
        found = np.maximum(0.0, (found - n * self.false) / np.maximum(1e-9, 1 - self.false))
        best = int(found.argmax())  # ties: the first in order of name
        return self.langs[best], float(found[best] / found.sum()) if found.sum() > 0 else 0.0


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_ratio: float = 0.1) -> Model:
    """A model from all rows with a language and a text. To the driver comes the filter only, a row per slot and 64 languages."""
    src = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).where("lang is not null and text is not null")
    counts = materialize(src.mapInArrow(_gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    langs = sorted(r.lang for r in totals.select("lang").collect())
    number = F.create_map(*[F.lit(x) for k, lang in enumerate(langs) for x in (lang, k)])[F.col("lang")] if langs else F.lit(0)
    share = counts.join(totals, "lang").select("gram", number.alias("k"), (F.col("n") / F.col("total")).alias("share"))
    top = share.groupBy("gram").agg(F.collect_list(F.struct("k", "share")).alias("all"), F.max("share").alias("top"))  # a row per language at most
    kept = top.select("gram", F.expr(f"transform(filter(all, x -> x.share >= {min_ratio} * top), x -> x.k)").alias("langs"))
    n = counts.select("gram").distinct().count()
    n_slots = min(SLOTS_MOST, max(SLOTS_LEAST, 1 << (SLOTS_EACH * max(1, n) - 1).bit_length()))
    got = kept.mapInArrow(_slot_masks(n_slots), "slot long, word long, mask long").groupBy("slot", "word").agg(F.expr("bit_or(mask)").alias("mask")).toArrow()
    discard(counts)
    masks = np.zeros((n_slots, max(1, -(-len(langs) // 64))), np.uint64)
    masks[got["slot"].to_numpy(), got["word"].to_numpy()] = got["mask"].to_numpy().view(np.uint64)
    fill = np.array([((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(langs))])
    return Model(langs, masks, fill**HASHES)


def _predict(shared):
    def predict(batches):
        for batch in slices(batches):
            got = [shared.value.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], ["id", "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score.

    A null text, or one without a letter, is ``und`` with score 0, as is every text under a model without
    languages. A text with letters of which no n-gram is known gets the first language, with score 0. Only the
    two columns are read; ids may be null or repeated.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return src.mapInArrow(_predict(spark.sparkContext.broadcast(model)), "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str | None = None, rejected: str = "und") -> DataFrame:
    """The rows of ``docs`` whose text has a language, with all their columns: those that ``identify`` calls ``und`` go.

    ``lang_col``: this column gets the language found.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        for batch in slices(batches):
            found = [shared.value.predict(t)[0] for t in batch.column(text_col).to_pylist()]
            if lang_col:
                at = batch.schema.get_field_index(lang_col)
                batch = batch.set_column(at, batch.schema.field(at), pa.array(found, batch.schema.field(at).type))
            yield batch.filter(pa.array([x != rejected for x in found], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
