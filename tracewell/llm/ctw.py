"""LM scoring by context-tree weighting.

A text is its tokens: words, A-Z lower-cased, then one end. It is coded byte by byte: each word with a space that
closes it, and one more space for the end. A byte's context is up to ``depth`` bytes before it, across tokens,
back to the text's start. A byte is eight binary decisions, each in the tree node of the bits before it. A
node's estimate is Krichevsky-Trofimov; a context's weighted probability is half its own estimate and half the
product over its longer contexts, so all depths are mixed, by what the training corpus says of each. A context that
training has not seen has nothing to say: its weight stays with the longest one that training has seen.

The tree is whole: every context of the corpus is in it, and it grows with the corpus. Its rows are events, a byte after
``depth`` others, each with its count in training (none, where only other texts have it). They are counted with map-side
combining and dealt by the nearest ``TOP`` bytes; a task holds the subtrees of some of these. Upwards each subtree hands on
what its root says; the crown above, of contexts of fewer than ``TOP`` bytes, is bounded by their number and is
computed on the driver; downwards each event gets the probability that all depths on its path give it. The texts then look up
their events in tables of at most ``PART`` events, which go to all executors one after another: a larger tree takes more of
them, and a text's score is the sum of what it finds in each.

The unigram base needs the counts of all tokens. Those of the most frequent tokens, at most ``HOT``, go to all
executors; a document's other tokens meet their counts in a join, where none of them can be hot.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, in_fold, lower_words, materialize, release, slices

#: Bytes of context; bytes by which subtrees are dealt; events in a table; events that a task takes at once, about.
DEPTH, TOP, PART, TAKEN = 5, 3, 1 << 22, 1 << 18
#: Distinct words that a task holds before it passes their counts on; words whose counts go to all executors.
HELD, HOT = 300_000, 1 << 18
#: Bytes that are coded at once, and distinct events that a task holds before it passes their counts on, about.
CHUNK, EVENTS = 1 << 21, 1 << 22


def _token_counts(batches):
    """(word, c, o): occurrences in training and other texts; the end token is the empty word."""
    held: tuple[Counter, Counter] = Counter(), Counter()

    def passed():
        c, o = held
        words = list(c.keys() | o.keys())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([c[w] for w in words], pa.int64()), pa.array([o[w] for w in words], pa.int64())], ["word", "c", "o"])
        c.clear(), o.clear()

    for batch in slices(batches):
        for out, text in zip(batch.column("out").to_pylist(), batch.column("text").to_pylist()):
            to = held[out]
            to.update(lower_words(text))
            to[b""] += 1
            if len(to) > HELD:
                yield from passed()
    yield from passed()


def _chunks(texts: list):
    """Texts (lists of words) in runs of about CHUNK bytes: padded bytes, the places to code, texts in the run."""
    at = 0
    while at < len(texts):
        parts, n = [], 0
        while at + len(parts) < len(texts) and n < CHUNK:
            parts.append(b" ".join([*texts[at + len(parts)], b"", b""]))
            n += len(parts[-1])
        yield parts
        at += len(parts)


def _layout(parts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the parts, each after ``depth`` zeros; the places to code; how many of each part."""
    pad = bytes(depth)
    x = np.frombuffer(pad + pad.join(parts), np.uint8)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    own = np.arange(size.sum()) + depth * (1 + np.repeat(np.arange(len(parts)), size))
    return x, own, size


def event_codes(parts: list[bytes], depth: int) -> np.ndarray:
    """Of each coded byte, its context (the oldest byte highest) and itself in the lowest eight bits; ``depth`` is 6 at most."""
    x, own, _ = _layout(parts, depth)
    code = np.zeros(len(x), np.int64)
    for d in range(depth + 1):
        code[d:] |= x[: len(x) - d].astype(np.int64) << (8 * d)
    return code[own]


def _event_counts(depth: int):
    """(code, n): distinct events with their count in training texts; those of other texts only, with none."""

    def counts(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            code, n = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(code, kind="stable")
            code, n = code[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            return code[first], np.add.reduceat(n, first)

        for batch in slices(batches):
            texts, outs = batch.column("text").to_pylist(), batch.column("out").to_pylist()
            for out in (False, True):
                for parts in _chunks([lower_words(t) for t, o in zip(texts, outs) if o == out]):
                    code, n = np.unique(event_codes(parts, depth), return_counts=True)
                    held.append((code, np.zeros_like(n) if out else n))
            if sum(len(c) for c, _ in held) > EVENTS:
                code, n = merged()
                held = [(code, n)]
                if len(code) > EVENTS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])
                    held = []
        if held:
            code, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])

    return counts


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 1/2: the recurrence up to x + 6, then Stirling's series."""
    shift = np.ones_like(x)
    for k in range(6):
        shift *= x + k
    y = x + 6
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def _kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1.0) - np.log(np.pi)


@dataclass
class Level:
    """The nodes of one depth that training or other texts pass: key (context and bits before), counts of 0 and 1."""

    key: np.ndarray
    zero: np.ndarray
    one: np.ndarray
    up: np.ndarray | None = None  # of each node of the depth below, its node here
    split: np.ndarray | None = None  # log of the product over longer contexts; none at the greatest depth

    def __post_init__(self) -> None:
        own = _kt(self.zero, self.one)
        self.log = own if self.split is None else np.logaddexp(own, self.split) - np.log(2)  # weighted probability
        self.stop = np.ones(len(own)) if self.split is None else np.exp(np.minimum(0.0, own - np.log(2) - self.log))

    def shorter(self, d: int) -> Level:
        """The level of depth d - 1, by what this level of depth d hands on."""
        key, up = np.unique(shorter_key(self.key, d), return_inverse=True)
        zero, one, split = (np.bincount(up, x, len(key)) for x in (self.zero, self.one, self.log))
        return Level(key, zero, one, up, split)


def shorter_key(key: np.ndarray, d: int) -> np.ndarray:
    """Keys of depth d without the oldest byte."""
    return ((key >> 8) & ((1 << 8 * (d - 1)) - 1)) << 8 | (key & 255)


def leaves_of(code: np.ndarray, n: np.ndarray) -> tuple[Level, np.ndarray, np.ndarray]:
    """The level of the greatest depth; of each event and bit its node, and the bit."""
    byte, context = code & 255, code >> 8
    prefix = np.stack([np.full_like(byte, 1 << k) | byte >> (8 - k) for k in range(8)])
    bit = np.stack([byte >> (7 - k) & 1 for k in range(8)])
    key, node = np.unique((context << 8 | prefix).ravel(), return_inverse=True)
    node = node.reshape(-1)
    total = np.bincount(node, np.tile(n, 8), len(key))
    one = np.bincount(node, np.tile(n, 8) * bit.ravel(), len(key))
    return Level(key, total - one, one), node.reshape(8, -1), bit


def descend(levels: list[Level], state: np.ndarray | None) -> np.ndarray:
    """The probability of a one at each node of the deepest level; levels from the shortest context down.

    A state is, of each node: what shorter contexts have added, the weight that is left, and the probability if the path
    ended there. ``state`` is that of the parents of the first level's nodes.
    """
    for k, level in enumerate(levels):
        if state is None:
            state = np.stack([np.zeros(len(level.key)), np.ones(len(level.key)), np.full(len(level.key), 0.5)])
        elif k:
            state = state[:, levels[k - 1].up]
        mix, left, before = state
        own, seen = (level.one + 0.5) / (level.zero + level.one + 1), level.zero + level.one > 0
        state = np.stack([np.where(seen, mix + left * level.stop * own, mix), np.where(seen, left * (1 - level.stop), left), np.where(seen, mix + left * own, before)])
    return state


def _subtrees(batches, top: int):
    """(code, n) of whole subtrees, about ``TAKEN`` events at once; rows come sorted by the nearest ``top`` bytes."""
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        held.append(np.stack([batch.column(c).to_numpy() for c in ("code", "n")]))
        size += batch.num_rows
        if size > TAKEN:
            rows = np.concatenate(held, axis=1)
            sub = (rows[0] >> 8) & ((1 << 8 * top) - 1)
            cut = int(np.searchsorted(sub, sub[-1]))
            if cut:
                yield rows[0, :cut], rows[1, :cut]
            held, size = [rows[:, cut:]], rows.shape[1] - cut
    if size:
        rows = np.concatenate(held, axis=1)
        yield rows[0], rows[1]


def _rise(code: np.ndarray, n: np.ndarray, depth: int, top: int):
    """The levels of depths ``top`` to ``depth``, the shortest first, and the nodes and bits of the events."""
    level, node, bit = leaves_of(code, n)
    levels = [level]
    for d in range(depth, top, -1):
        levels.append(levels[-1].shorter(d))
    return levels[::-1], node, bit


NODE = "key long, zero double, one double, split double"


def _roots(depth: int, top: int):
    """What the subtrees hand on to the nodes of depth ``top`` - 1."""

    def roots(batches):
        for code, n in _subtrees(batches, top):
            above = _rise(code, n, depth, top)[0][0].shorter(top)
            yield pa.RecordBatch.from_arrays([pa.array(above.key), pa.array(above.zero), pa.array(above.one), pa.array(above.split)], [x.split()[0] for x in NODE.split(", ")])

    return roots


@dataclass
class Crown:
    """The states of the nodes of depth ``top`` - 1."""

    key: np.ndarray
    state: np.ndarray

    @classmethod
    def of(cls, key: np.ndarray, zero: np.ndarray, one: np.ndarray, split: np.ndarray, top: int) -> Crown:
        order = np.argsort(key)
        levels = [Level(key[order], zero[order], one[order], None, split[order])]
        for d in range(top - 1, 0, -1):
            levels.append(levels[-1].shorter(d))
        return cls(key[order], descend(levels[::-1], None))


def _probabilities(shared, depth: int, top: int):
    """(code, score): log10 of the probability of each event."""

    def probabilities(batches):
        crown = shared.value
        for code, n in _subtrees(batches, top):
            levels, node, bit = _rise(code, n, depth, top)
            parents = np.searchsorted(crown.key, shorter_key(levels[0].key, top))
            p = np.clip(descend(levels, crown.state[:, parents])[2], 1e-12, 1 - 1e-12)
            score = np.log10(np.where(bit, p[node], 1 - p[node])).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(score)], ["code", "score"])

    return probabilities


def event_scores(docs: DataFrame, depth: int = DEPTH, top: int = TOP) -> DataFrame:
    """docs(text, out) -> (code, score) of all events of all texts, under the tree of those that are not ``out``."""
    spark, top = docs.sparkSession, min(top, depth)
    counted = docs.select("out", "text").mapInArrow(_event_counts(depth), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    events = materialize(counted, "events")
    sub = F.shiftright("code", 8).bitwiseAND(F.lit((1 << 8 * top) - 1))
    tasks = max(1, -(-events.count() // TAKEN))
    dealt = events.withColumn("sub", sub).repartition(tasks, "sub").sortWithinPartitions("sub").select("code", "n")
    sums = dealt.mapInArrow(_roots(depth, top), NODE).groupBy("key").agg(*[F.sum(c).alias(c) for c in ("zero", "one", "split")])
    got = sums.toArrow()  # 255 nodes at most a context of TOP - 1 bytes
    crown = spark.sparkContext.broadcast(Crown.of(*(got[c].to_numpy() for c in ("key", "zero", "one", "split")), top))
    done = materialize(dealt.mapInArrow(_probabilities(crown, depth, top), "code long, score double"), "scores")
    crown.destroy()
    discard(events)
    return done


class Table:
    """A score of each event, found by a hash of its code."""

    def __init__(self, code: np.ndarray, score: np.ndarray):
        self.bits = max(1, len(code).bit_length())
        h = self.hash(code)
        order = np.argsort(h, kind="stable")
        self.code, self.score = code[order], score[order].astype(np.float32)
        self.start = np.searchsorted(h[order], np.arange((1 << self.bits) + 1)).astype(np.int32)

    def hash(self, code: np.ndarray) -> np.ndarray:
        x = code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, code: np.ndarray) -> np.ndarray:
        """The scores; 0 for what is not here."""
        out = np.zeros(len(code), np.float32)
        h = self.hash(code)
        at, end = self.start[h], self.start[h + 1]
        open_ = np.flatnonzero(at < end)
        at, end, code = at[open_], end[open_], code[open_]
        while len(open_):
            hit = self.code[at] == code
            out[open_[hit]] = self.score[at[hit]]
            at += 1
            more = ~hit & (at < end)
            open_, at, end, code = open_[more], at[more], end[more], code[more]
        return out

    def of_texts(self, texts: list, depth: int) -> np.ndarray:
        """The sum of the scores of each text's events (a text is a list of words, in UTF-8)."""
        out = []
        for parts in _chunks(texts):
            size = np.fromiter(map(len, parts), np.int64, len(parts))
            out.append(np.add.reduceat(self.get(event_codes(parts, depth)), np.cumsum(size) - size, dtype=np.float64))
        return np.concatenate(out) if out else np.zeros(0)


def tables(scores: DataFrame, part: int = PART):
    """The events in tables of about ``part`` events, one at a time; one table, if empty, where there are none."""
    n = max(1, -(-scores.count() // part))
    for k in range(n):
        got = (scores if n == 1 else scores.where(F.pmod(F.xxhash64("code"), F.lit(n)) == k)).toArrow()
        yield Table(got["code"].to_numpy(), got["score"].to_numpy())


def _partial(shared, depth: int):
    """(doc_id, check, score): what the texts find in one table."""

    def partial(batches):
        for batch in slices(batches):
            got = shared.value.of_texts([lower_words(t) for t in batch.column("text").to_pylist()], depth)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("check"), pa.array(got)], ["doc_id", "check", "score"])

    return partial


def _score_texts(table, counts, depth: int):
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("check", pa.int64()), ("out", pa.bool_()), ("n_tokens", pa.int64()), ("word", pa.binary()), ("tf", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])

    def score(batches):
        """A row per document with its score and what its frequent tokens give, and a row for each other distinct word."""
        get = counts.value.get
        for batch in slices(batches):
            cols: list[list] = [[] for _ in schema]
            texts = [lower_words(t) for t in batch.column("text").to_pylist()]
            scores = table.value.of_texts(texts, depth).tolist()
            for row, doc, check, out, words, total in zip(*(batch.column(k).to_pylist() for k in ("row", "doc_id", "check", "out")), texts, scores):
                tfs = Counter(words)
                tfs[b""] += 1
                known, base, rare = 0, 0.0, []
                for w, tf in tfs.items():
                    if hot := get(w):
                        known += tf * hot[0]
                        base += tf * hot[1]
                    else:
                        rare.append((w, tf))
                k = len(rare)
                # no word holds a space, so a document's own row meets none in the join and is dealt by its number
                for col, own, other in zip(cols, (row, doc, check, out, len(words) + 1, b" %d" % row, 0, known, base, total), ([row] * k, [None] * k, [None] * k, [None] * k, [None] * k, [w for w, _ in rare], [n for _, n in rare], [0] * k, [0.0] * k, [0.0] * k)):
                    col.append(own)
                    col.extend(other)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return score


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, held_out: int = 0, depth: int = DEPTH, part: int = PART) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose crc32(id as text) mod ``folds`` is not ``held_out``; a null id's is 0. base_score is
    the log10 of an additive-smoothing unigram model (0.1, with one unseen token); score is that of
    context-tree weighting, over the same tokens (its code length in bits is -score * log2(10)). Null, empty and
    white-space texts are the end token alone. Without training documents the model is uniform over bits. Only
    the two columns are read; ids may be null or repeated. ``depth`` is 6 bytes at most.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), in_fold(F.col(f"`{id_col}`"), folds, held_out).alias("out"))
    counts = materialize(src.select("out", "text").mapInArrow(_token_counts, "word binary, c long, o long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("o").alias("o")), "tokens")
    n, v, all_n = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1)), F.coalesce(F.sum(F.col("c") + F.col("o")), F.lit(0))).first()
    words = counts.select("word", "c", F.log10((F.col("c") + 0.1) / F.lit(n + 0.1 * (v + 1))).alias("base"), (F.col("c") + F.col("o")).alias("all"))
    hot = words.where(F.col("all") * HOT >= all_n).select("word", (F.col("c") > 0).cast("int").alias("known"), "base").collect()  # HOT words at most
    share = spark.sparkContext.broadcast
    every = tables(event_scores(src, depth), part)
    scored = _score_texts(share(next(every)), share({bytes(r.word): (r.known, r.base) for r in hot}), depth)
    rows = src.withColumn("row", F.monotonically_increasing_id()).withColumn("check", F.xxhash64("text")).mapInArrow(scored, "row long, doc_id long, check long, out boolean, n_tokens long, word binary, tf long, known long, base double, score double")
    met = rows.alias("r").join(words.alias("w"), F.col("r.word") == F.col("w.word"), "left").select(
        "r.row", "r.doc_id", "r.check", "r.out", "r.n_tokens", "r.score",
        F.when(F.col("w.c") > 0, F.col("r.tf")).otherwise(F.col("r.known")).alias("known"),
        (F.col("r.base") + F.coalesce(F.col("r.tf") * F.col("w.base"), F.lit(0.0))).alias("base"),
    )
    done = met.groupBy("row").agg(*[F.max(c).alias(c) for c in ("doc_id", "check", "out", "n_tokens")], F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    more = None
    for k, table in enumerate(every):  # rows of one id and text find the same
        here = share(table)
        got = src.select("doc_id", F.xxhash64("text").alias("check"), "text").mapInArrow(_partial(here, depth), "doc_id long, check long, score double").groupBy("doc_id", "check").agg(F.max("score").alias("score"))
        got = materialize(got.withColumn("part", F.lit(k)), "partial")
        here.destroy()
        more = got if more is None else more.union(got)
    release(spark)
    if more is not None:
        rest = more.groupBy("doc_id", "check").agg(F.sum("score").alias("more")).select(F.col("doc_id").alias("_id"), F.col("check").alias("_check"), "more")
        done = done.join(rest, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("check") == F.col("_check"))).withColumn("score", F.col("score") + F.col("more"))
    return done.select(F.col("doc_id").alias(id_col), F.col("out").alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
