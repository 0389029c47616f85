"""Terms counted text by text, in Python workers: the same terms as ``tokenize_raw``, an order of magnitude cheaper.

Texts of Latin letters only are counted here; any other text is cut by ``tokenize_raw`` itself.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .text import tokenize_raw

#: What is outside: anything but Latin letters to U+017F (without U+0130, which grows when lower-cased), punctuation and currency signs.
OUTSIDE = re.compile("[^\u0000-\u012F\u0131-\u017F\u2000-\u206F\u20A0-\u20BF]")
_LATIN = [chr(c) for c in range(0x180) if c != 0x130]
_LOWER, _UPPER = "".join(c for c in _LATIN if c.islower()), "".join(c for c in _LATIN if c.isupper())
#: A text without such a place has words of one part each.
_ODD = re.compile(f"_|[{_LOWER}0-9][{_UPPER}]|[{_UPPER}][{_UPPER}][{_LOWER}]")
_HUMPS = re.compile(f"(?<=[{_LOWER}0-9])(?=[{_UPPER}])|(?<=[{_UPPER}])(?=[{_UPPER}][{_LOWER}])|_+")
_RUN = re.compile(r"\w+")
#: Texts of a batch, and terms that a worker keeps numbers of.
ROWS, KEPT = 256, 1 << 19


def _tables(codec: str) -> tuple[bytes, bytes]:
    """Of a codec of single bytes: the kind of each byte (lower case or digit, upper case, underscore, other letter, none), and each in lower case or as a space."""
    kinds, lows = bytearray(b" " * 256), bytearray(b" " * 256)
    for b in range(256):
        c = bytes([b]).decode(codec, "replace")
        if c.isalnum() or c == "_":
            kinds[b] = ord("_" if c == "_" else "A" if c.isupper() else "a" if c.islower() or c in "0123456789" else "x")
            lows[b] = c.lower().encode(codec)[0]
    return bytes(kinds), bytes(lows)


CODECS = {codec: _tables(codec) for codec in ("latin-1", "cp1252")}


def latin_terms(word: str) -> list[str]:
    """``word_terms`` of a word of Latin letters."""
    bare = word.strip("_") if "_" in word else word
    whole = bare.lower()
    if len(whole) < 2:
        return []
    parts = [p.lower() for p in _HUMPS.split(bare) if p]
    return [whole, *(p for p in parts if len(p) >= 2 and p != whole)] if len(parts) > 1 else [whole]


def outside(text: str) -> bool:
    """Whether a text has other letters than Latin ones."""
    return not text.isascii() and OUTSIDE.search(text) is not None


def latin_counts(text: str) -> tuple[str, dict]:
    """(codec, counts): the terms of a text of Latin letters with their occurrences, in bytes of the codec. Single letters may be among them."""
    for codec, (kinds, lows) in CODECS.items():
        try:
            raw = text.encode(codec)
        except UnicodeEncodeError:
            continue
        kind = raw.translate(kinds)
        if not (b"aA" in kind or b"_" in kind or b"AAa" in kind):
            return codec, Counter(raw.translate(lows).split())
        break
    counts: dict[bytes, int] = {}
    for word, n in Counter(_RUN.findall(text)).items():
        for term in latin_terms(word):
            t = term.encode()
            counts[t] = counts.get(t, 0) + n
    return "utf-8", counts


class _Numbers(dict):
    """Numbers of terms (bytes of one codec), given as they are met; None of single letters."""

    def __init__(self, codec: str, names: list[str]) -> None:
        self.codec, self.names = codec, names

    def __missing__(self, term: bytes) -> int:
        name = term.decode(self.codec)
        if len(name) < 2 and self.codec in CODECS:
            self[term] = -1
            return -1
        n = self[term] = len(self.names)
        self.names.append(name)
        return n


class _Places(dict):
    """Numbers of values, given as they are met."""

    def __missing__(self, value) -> int:
        n = self[value] = len(self)
        return n


def _counter(key: list[str], text: str, sizes: bool, terms: bool, schema: pa.Schema):
    def count(batches):
        names: list[str] = []
        known, number = pa.array([], pa.string()), {}
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                if not number or len(names) > KEPT:
                    names, known = [], pa.array([], pa.string())
                    number = {codec: _Numbers(codec, names).__getitem__ for codec in (*CODECS, "utf-8")}
                texts = batch.column(text).to_pylist()
                found = [latin_counts(t) if t and not outside(t) else ("utf-8", {}) for t in texts]
                ids = np.fromiter(chain.from_iterable(map(number[codec], c) for codec, c in found), np.int64)
                tf = np.fromiter(chain.from_iterable(c.values() for _, c in found), np.float64, len(ids))
                row = np.repeat(np.arange(len(found)), [len(c) for _, c in found])
                good = ids >= 0
                if not good.all():  # single letters
                    ids, tf, row = ids[good], tf[good], row[good]
                if sizes:
                    total = np.bincount(row, tf, len(found))
                if not terms:
                    ids, tf, row = ids[:0], tf[:0], row[:0]
                elif len(names) > len(known):
                    known = pa.concat_arrays([known, pa.array(names[len(known):], pa.string())])
                out = [known.take(pa.array(ids)), pa.array(tf)]
                if sizes:  # one row more for each text, without a term
                    mine = np.array([i for i, t in enumerate(texts) if not t or not outside(t)], np.int64)
                    out = [pa.concat_arrays([out[0], pa.nulls(len(mine), pa.string())]), pa.array(np.concatenate([tf, np.zeros(len(mine))]))]
                    row = np.concatenate([row, mine])
                    out.append(pa.array(total[row]))
                index = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(index) for k in key), *out], schema=pa.schema([*(batch.schema.field(k) for k in key), *schema]))

    return count


def _others(text: str):
    """The rows whose texts are not counted here."""

    def pick(batches):
        for batch in batches:
            yield batch.filter(pa.array([bool(t) and outside(t) for t in batch.column(text).to_pylist()], pa.bool_()))

    return pick


def text_sizes(texts: DataFrame, key: list[str], text: str) -> DataFrame:
    """(*key, len): the tokens of each text."""
    return _rows(texts, key, text, sizes=True, terms=False).select(*key, "len")


def term_rows(texts: DataFrame, key: list[str], text: str, sizes: bool = False) -> DataFrame:
    """(*key, term, tf): the terms of each text by itself, so a key of several texts has a term several times.

    With ``sizes`` also len, the tokens of the row's text, and for each text a row more whose term is null and tf 0.
    """
    return _rows(texts, key, text, sizes, terms=True)


def _rows(texts: DataFrame, key: list[str], text: str, sizes: bool, terms: bool) -> DataFrame:
    rows = texts.select(*key, text)
    more = [StructField("term", StringType()), StructField("tf", DoubleType())] + ([StructField("len", DoubleType())] if sizes else [])
    types = [("term", pa.string()), ("tf", pa.float64())] + ([("len", pa.float64())] if sizes else [])
    fast = rows.mapInArrow(_counter(key, text, sizes, terms, pa.schema(types)), StructType([*(rows.schema[k] for k in key), *more]))
    slow = rows.mapInArrow(_others(text), rows.schema).select(*key, tokenize_raw(F.col(text)).alias("_terms"), F.monotonically_increasing_id().alias("_text"))
    cut = F.array().cast("array<string>") if not terms else F.col("_terms")
    each = F.concat(F.array(F.lit(None).cast("string")), cut) if sizes else cut
    slow = slow.select(*key, "_text", F.size("_terms").cast("double").alias("len"), F.explode(each).alias("term"))
    slow = slow.groupBy(*key, "_text", "len", "term").agg(F.sum(F.col("term").isNotNull().cast("double")).alias("tf"))
    return fast.unionByName(slow.select(fast.columns))


#: Products of a worker that are summed at once, and sums that it holds.
PRODUCTS, SUMS = 1 << 22, 1 << 20


def _sharer(batches):
    names: list[str] = []
    number = {codec: _Numbers(codec, names).__getitem__ for codec in (*CODECS, "utf-8")}
    files = _Places()
    keys, values, n = [], [], 0

    def summed():
        at, where = np.unique(np.concatenate(keys), return_inverse=True)
        return at, np.bincount(where, np.concatenate(values), len(at))

    def rows(at, total):
        file, term = pa.array(list(files), pa.string()), pa.array(names, pa.string())
        return pa.RecordBatch.from_arrays([file.take(pa.array(at >> 32)), term.take(pa.array(at & 0xFFFFFFFF)), pa.array(total)], names=["file", "term", "tf"])

    for part in batches:
        for words, shares in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            if isinstance(words, str):
                if outside(words):
                    continue
                codec, counts = latin_counts(words)
            else:
                codec, counts = "utf-8", Counter(w.encode() for w in words)
            ids = np.fromiter(map(number[codec], counts), np.int64, len(counts))
            tf = np.fromiter(counts.values(), np.float64, len(counts))
            if codec != "utf-8":
                ids, tf = ids[ids >= 0], tf[ids >= 0]
            to = np.fromiter((files[x["file"]] for x in shares), np.int64, len(shares))
            w = np.fromiter((x["w"] for x in shares), np.float64, len(shares))
            keys.append(((to << 32)[:, None] | ids[None, :]).ravel())
            values.append((w[:, None] * tf[None, :]).ravel())
            n += len(keys[-1])
            if n >= PRODUCTS:
                at, total = summed()
                keys, values, n = [at], [total], 0
                if len(at) > SUMS:
                    yield rows(at, total)
                    keys, values, names, files = [], [], [], _Places()
                    number = {codec: _Numbers(codec, names).__getitem__ for codec in (*CODECS, "utf-8")}
    if keys:
        yield rows(*summed())


def _other_lines(batches):
    for part in batches:
        yield part.filter(pa.array([bool(w) and outside(w) for w in part.column(0).to_pylist()], pa.bool_()))


def shared_terms(lines: DataFrame) -> DataFrame:
    """(file, term, tf) of lines(words, shares): each file's share of a line, times the line's terms; in parts that add up to tf."""
    rows = lines.where("words is not null").select("words", "shares")
    schema = "file string, term string, tf double"
    others = rows.mapInArrow(_other_lines, rows.schema).select(tokenize_raw(F.col("words")).alias("words"), "shares")
    return rows.mapInArrow(_sharer, schema).unionByName(others.mapInArrow(_sharer, schema))
