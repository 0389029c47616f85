"""Sum-of-squares packing of token sequences.

Documents become token ids with an end id; a document longer than a sequence is cut, and only then. The
pieces are dealt at random to groups of a bounded size, and each group is packed on its own: a piece goes
into the open bin, or a new one, for which the sum of the squared counts of open bins per residual gap
becomes smallest (ties: the closest fit). That keeps the gaps even, so later pieces find one they fill. When a
group ends, the pieces of its bins with a gap left are placed once more, largest first, in the closest-fitting
bin. A group wastes a bin or two at most beyond its share, whatever the size of the table.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HELD, materialize, slices

#: Pieces in a group, about.
GROUP = 100_000
#: Words whose ids a worker remembers, about, before it forgets them all.
REMEMBERED = 1_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: The settings of a vocabulary for which words may be encoded apart: white space is dropped, letters and signs never share a pre-token.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PRE_TOKENS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Letters and the ASCII signs after them are then apart, if the letters stay letters once they are normalised.
LETTERS_THEN_SIGNS = re.compile(rb"([A-Za-z\x80-\xff]+)([!-&(-/:-;=?-@\[-`{-~]*)")


#: A comma or full stop between a letter and white space; a space before it changes no id.
CLOSING = re.compile(rb"[,.](?<=[a-z][,.])(?=[ \n])")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, lower-cased and apart from their commas and full stops where the ids stay the same.

    That makes for far fewer distinct words. Where a special token may be spelt, all stays as it is.
    """
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    return (data if b"<|" in data else CLOSING.sub(rb" \g<0>", data.lower())).split()


class WordIds:
    """ids: word (UTF-8) -> its ids as little-endian uint32 bytes; ``apart`` says whether the vocabulary allows it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        normal, cut = told["normalizer"] or {}, told["pre_tokenizer"] or {}
        first = (cut.get("pretokenizers") or [{}])[0]
        self.apart = (
            [x["type"] for x in normal.get("normalizers", [])] == NORMALIZERS
            and normal["normalizers"][1]["pattern"] == {"Regex": "\\s+"}
            and first.get("pattern") == {"Regex": PRE_TOKENS}
            and all(x["special"] and x["content"].startswith("<|") for x in told["added_tokens"])
        )
        self.ids: dict[bytes, bytes] = {}
        self.signs: dict[bytes, bytes] = {}
        self.latin = None
        latin = [c for c in map(chr, range(0xC0, 0x250)) if self.apart and self.letters(f"a{c}{c}b".encode())]
        #: Words of these letters stay letters: precomposed ones, which no letter after them changes.
        self.latin = re.compile(f"[a-z{''.join(latin)}]+")

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, words: list[bytes]) -> list[bytes]:
        return self.encode_texts([w.decode("utf-8", "replace") for w in words])

    def letters(self, core: bytes) -> bool:
        """Whether a word of no ASCII sign is one pre-token, and stays one with a sign after it: by the library itself."""
        if core.isascii():
            return True
        text = core.decode("utf-8", "replace")
        if self.latin and self.latin.fullmatch(text):
            return True
        if text.isalpha():
            normal = self.tokenizer.normalizer.normalize_str(text)
            return [a for _, a in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal + "?")] == [(0, len(normal)), (len(normal), len(normal) + 1)]
        return False

    def encode_cores(self, words: list[bytes]) -> list[bytes]:
        """The same for words that are one pre-token each: many at once, told apart by the library's word numbers."""
        out: list[bytes] = []
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            e = self.tokenizer.encode(b" ".join(some).decode("utf-8", "replace"), add_special_tokens=False)
            ids, number = np.array(e.ids, "<u4"), np.array(e.word_ids, np.int64)
            if len(number) and number[-1] == len(some) - 1 and len(cut := np.flatnonzero(np.diff(number)) + 1) == len(some) - 1:
                data, ends = ids.tobytes(), [0, *(4 * cut).tolist(), 4 * len(ids)]
                out += [data[a:b] for a, b in zip(ends, ends[1:])]
            else:  # a word that is none or several after all
                out += self.encode(some)
        return out

    def learn(self, words: set[bytes]) -> None:
        """All of the words are then at hand."""
        ids, signs = self.ids, self.signs
        if len(ids) > REMEMBERED:
            ids.clear()
        apart, rest, whole = [], [], []
        for w in words.difference(ids):
            if (w.isalpha() and w.islower()) or not w.isascii() and self.latin.fullmatch(w.decode("utf-8", "replace")):
                whole.append(w)
                continue
            m = LETTERS_THEN_SIGNS.fullmatch(w)
            if m and self.letters(core := m[1].lower()):
                if (tail := m[2]) and tail not in signs:
                    if len(signs) > 10_000:
                        signs.clear()
                    signs[tail] = self.encode([tail])[0]
                apart.append((w, core, signs[tail] if tail else b""))
            else:
                rest.append(w)
        if rest:
            ids.update(zip(rest, self.encode(rest)))
        cores = list({core for _, core, _ in apart if core not in ids}.union(whole))
        ids.update(zip(cores, self.encode_cores(cores)))
        ids.update([(w, ids[core] + tail) for w, core, tail in apart])

    def ids_of(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as the library gives them for the whole text."""
        if not self.apart:
            return self.encode_texts([t or "" for t in texts])
        words = [words_of(t) for t in texts]
        self.learn(set().union(*words))
        return [b"".join(map(self.ids.__getitem__, ws)) for ws in words]


def word_ids(path: str) -> WordIds:
    """The worker's own, kept until a task of another operator runs there."""
    held = HELD.setdefault("packing", {})
    if path not in held:
        held[path] = WordIds(path)
    return held[path]


def _pieces(path: str, size: int, end: int):
    def pieces(batches):
        known, tail = word_ids(path), np.array([end], "<u4").tobytes()
        for batch in slices(batches, keep="packing"):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            rows = []
            for at in range(0, len(ids), 128):
                for doc, data in zip(ids[at : at + 128], known.ids_of(texts[at : at + 128])):
                    data += tail
                    n = len(data) // 4
                    rows += [(doc, k, s, min(size, n - s), zlib.crc32(data[4 * s : 4 * (s + size)])) for k, s in enumerate(range(0, n, size))]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return pieces


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each length (1 to ``size``), in the order given."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    fill: list[int] = []
    inside: list[list[int]] = []
    count = np.zeros(size + 1, np.int64)  # open bins per gap
    open_: list[list[int]] = [[] for _ in range(size + 1)]

    def put(i: int, s: int, b: int, gap: int) -> None:
        if b < 0:
            b = len(fill)
            fill.append(0)
            inside.append([])
        bins[i], offsets[i] = b, fill[b]
        fill[b] += s
        inside[b].append(i)
        if gap > s:
            count[gap - s] += 1
            open_[gap - s].append(b)

    for i, s in enumerate(lengths.tolist()):
        if s < size:
            gaps = np.flatnonzero(count[s:size]) + s
            if len(gaps):
                left = gaps - s
                cost = 2 * (np.where(left > 0, count[left], 0) - count[gaps]) + 1 + (left > 0)
                k = int(cost.argmin())
                if cost[k] <= 2 * count[size - s] + 1:
                    gap = int(gaps[k])
                    count[gap] -= 1
                    put(i, s, open_[gap].pop(), gap)
                    continue
        put(i, s, -1, size)
    # the pieces of bins with a gap, once more
    again = [i for b, f in enumerate(fill) if f < size for i in inside[b]]
    free = [b for b, f in enumerate(fill) if f < size]
    for b in free:
        fill[b] = 0
    kept = (fill.copy(), bins.copy(), offsets.copy())
    count[:] = 0
    open_ = [[] for _ in range(size + 1)]
    unused = free[::-1]
    for i in sorted(again, key=lambda i: (-lengths[i], i)):
        s = int(lengths[i])
        gaps = np.flatnonzero(count[s:size])
        if len(gaps):
            gap = int(gaps[0]) + s
            b = open_[gap].pop()
            count[gap] -= 1
        elif unused:
            gap, b = size, unused.pop()
        else:  # no better than before
            return kept[1], kept[2]
        bins[i], offsets[i] = b, fill[b]
        fill[b] += s
        if gap > s:
            count[gap - s] += 1
            open_[gap - s].append(b)
    return bins, offsets


def _packer(size: int):
    def pack(key, rows):
        rows = rows.sort_values(["order", "doc_id", "piece"], kind="stable").reset_index(drop=True)
        bins, offsets = sum_of_squares(rows["length"].to_numpy(), size)
        return rows[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    return pack


def pack(docs: DataFrame, vocabulary: str, size: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``vocabulary`` is the path of a tokenizer file on every executor; where its settings do not allow to encode words
    apart, whole texts are encoded. A null or empty text is the end id alone.
    Ids may be null or repeated: rows are packed, not ids. Only the two columns are read. An empty table
    gives an empty one.
    """
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    pieces = src.mapInArrow(_pieces(vocabulary, size, end), PIECES).withColumn("order", F.xxhash64(F.monotonically_increasing_id()))
    pieces = materialize(pieces, "pieces")  # texts are read once
    groups = max(1, round(pieces.count() / group))
    out = pieces.withColumn("g", F.pmod("order", F.lit(groups))).groupBy("g").applyInPandas(_packer(size), PIECES + ", sequence_id long, offset long")
    return out.withColumnRenamed("doc_id", id_col)
