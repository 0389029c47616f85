"""Benchmark decontamination by a prefix-filtered set join.

A window is ``width`` consecutive words of a benchmark item (a shorter item is one window). Words are ordered
by rarity over the whole corpus, counted in a first pass over all documents. A text that contains a window
contains the window's rarest word, so that word is the only necessary prefix token: each window is posted
under it, with its place in the window. A document's words are looked up in those postings; a match gives the
only place where the window can lie (the positional bound), which must lie within the document (the length
bound), and there the words are compared exactly, over windows as long as the item's.

The benchmark is the stated query set. One of at most ``BLOCK`` windows goes to all executors, and documents are never
shuffled. The windows of a larger one are rows, joined to the documents' words: all words are counted in one pass, and
in a second each occurrence of a word that is some window's rarest leaves with the words around it, which is all that
comparing needs. However large the benchmark is, the corpus is read twice.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import candidate_bits, fresh, has_bits, materialize, slices

#: Bytes that are not part of a word become spaces: \x00-\x2F \x3A-\x60 \x7B-\x7F, after lower-casing A-Z.
WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Windows of a benchmark that goes to all executors: about 100 bytes each. Distinct words that a task counts before it passes them on.
BLOCK, HELD = 200_000, 300_000


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(WORD_BYTES).split() if text else []


def windows_of(words: list, width: int) -> list[tuple]:
    """The distinct windows of an item; none if it has no words."""
    return list(dict.fromkeys(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))) if words else []


def _counts(wanted: frozenset):
    def count(batches):
        total: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                total.update([w for w in words_of(text) if w in wanted])
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    return count


def post(items: list[tuple[int, tuple]], rarity: dict) -> dict:
    """word -> [(place in the window, window, item)], each window under its rarest word."""
    index: dict = {}
    for item, window in items:
        k = min(range(len(window)), key=lambda i: (rarity.get(window[i], 0), window[i], i))
        index.setdefault(window[k], []).append((k, window, item))
    return index


def find(words: list, index: dict) -> tuple[list[int], list[int], set[int]]:
    """Starts and ends (merged, in order) of the hit words, and the items that occur."""
    spans, found = [], set()
    for at in [i for i, w in enumerate(words) if w in index]:
        for k, window, item in index[words[at]]:
            a = at - k
            if a >= 0 and a + len(window) <= len(words) and tuple(words[a : a + len(window)]) == window:
                spans.append((a, a + len(window)))
                found.add(item)
    starts, ends = [], []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends, found


def _scan(shared):
    def scan(batches):
        index = shared.value
        for batch in slices(batches):
            rows = [(len(w := words_of(t)), *find(w, index)) for t in batch.column("text").to_pylist()]
            n, a, b, found = map(list, zip(*rows)) if rows else ([],) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), batch.column("check"), pa.array(n, pa.int64()), pa.array(a, pa.list_(pa.int64())), pa.array(b, pa.list_(pa.int64())), pa.array([sorted(map(str, x)) for x in found], pa.list_(pa.string()))],
                ["row", "id", "check", "n_words", "starts", "ends", "items"],
            )

    return scan


def _merged(batches):
    """Spans that several blocks have found, merged to one list a document."""
    for batch in batches:
        rows = batch.to_pylist()
        hits = []
        for r in rows:
            end = n = 0
            for a, b in sorted(zip(r["starts"], r["ends"])):
                n += max(0, b - max(a, end))
                end = max(end, b)
            hits.append(n)
        items = [sorted(set(r["items"])) for r in rows]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("check"), batch.column("n_words"), pa.array(hits, pa.int64()), pa.array(items, pa.list_(pa.string()))], ["id", "check", "n_words", "n_hit", "items"])


def _windows(width: int):
    """(item, words) of each window; its words one after another, parted by spaces."""

    def windows(batches):
        for batch in slices(batches):
            rows = [(i, b" ".join(w)) for i, t in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()) for w in windows_of(words_of(t), width)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([w for _, w in rows], pa.binary())], ["item", "window"])

    return windows


def _passing_words(shared):
    """Which of the words pass the filter, by XXH64."""
    bits = np.frombuffer(shared.value, np.uint8)

    def passing(words: list[bytes]) -> np.ndarray:
        h = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))
        return has_bits(bits, np.stack([h >> np.uint64(32), h & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))

    return passing


def _all_counts(shared):
    """(word, n) of the words that may be of the benchmark."""

    def counts(batches):
        passing, held = _passing_words(shared), Counter()

        def passed():
            words = list(held)
            keep = np.flatnonzero(passing(words)).tolist() if words else []
            yield pa.RecordBatch.from_arrays([pa.array([words[k] for k in keep], pa.binary()), pa.array([held[words[k]] for k in keep], pa.int64())], ["word", "n"])
            held.clear()

        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                held.update(words_of(text))
                if len(held) > HELD:
                    yield from passed()
        yield from passed()

    return counts


PLACE = "row long, word binary, at long, first long, around binary, n_words long"


def _places(shared, width: int):
    """The occurrences of words that may be posted, with the words around each; and for each row its number of words."""
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]

    def places(batches):
        passing = _passing_words(shared)
        for batch in slices(batches, rows=64):
            rows = []
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text)
                rows.append((row, None, None, None, None, len(words)))
                for at in np.flatnonzero(passing(words)).tolist() if words else []:
                    first = max(0, at - width + 1)
                    rows.append((row, words[at], at, first, b" ".join(words[first : at + width]), len(words)))
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [x.split()[0] for x in PLACE.split(", ")])

    return places


def _verified(batches):
    """(row, starts, ends, items, n_words): the meetings whose words are equal, and the rows' own."""
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.int64()]
    for batch in slices(batches):
        rows = []
        for row, at, first, around, n_words, k, window, item in zip(*(batch.column(c).to_pylist() for c in ("row", "at", "first", "around", "n_words", "k", "window", "item"))):
            if around is None:
                rows.append((row, [], [], [], n_words))
                continue
            want, have = window.split(), around.split()
            a = at - first - k
            if a >= 0 and have[a : a + len(want)] == want:
                rows.append((row, [a + first], [a + first + len(want)], [str(item)], n_words))
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["row", "starts", "ends", "items", "n_words"])


def joined_hits(rows: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """rows(row, text), windows(item, window) -> (row, starts, ends, items, n_words), several a row, for a benchmark of any size."""
    share = rows.sparkSession.sparkContext.broadcast
    each = windows.select("item", "window", F.posexplode(F.split(F.col("window").cast("string"), " ")).alias("k", "word")).withColumn("word", F.col("word").cast("binary"))
    vocabulary = materialize(each.select("word").distinct(), "vocabulary")
    digits = F.hex(F.xxhash64("word"))
    told = share(candidate_bits(vocabulary, digits).tobytes())
    n = rows.select("text").mapInArrow(_all_counts(told), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rarity = materialize(vocabulary.join(n, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n")), "rarity")
    told.destroy()
    rarest = each.join(rarity, "word").groupBy("item", "window").agg(F.min(F.struct("n", "word", "k")).alias("least"))
    posted = materialize(rarest.select("item", "window", "least.word", "least.k"), "posted")
    told = share(candidate_bits(posted.select("word").distinct(), digits).tobytes())
    places = materialize(rows.select("row", "text").mapInArrow(_places(told, width), PLACE), "places")
    told.destroy()
    met = places.where("word is not null").join(posted, "word").drop("word")
    own = places.where("word is null").drop("word").select("*", F.lit(None).cast("int").alias("k"), F.lit(None).cast("binary").alias("window"), F.lit(None).cast("long").alias("item"))
    found = met.select("row", "at", "first", "around", "n_words", "k", "window", "item").unionByName(own)
    return found.mapInArrow(_verified, "row long, starts array<long>, ends array<long>, items array<string>, n_words long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = 8, block: int = BLOCK) -> DataFrame:
    """One row per document: id, n_words, n_hit, items (ids of the items with occurring windows, as sorted strings), check (xxhash64 of the text).

    A document word inside any occurrence of a window is hit, once however many windows cover it. Null and
    empty texts have no words. Items without words, or with a null id, have no windows; items repeated with one
    id pool their windows. An empty benchmark hits nothing. Only the named columns are read. Documents
    repeated with one id each get a row. A benchmark of more than ``block`` windows is joined, with the same result.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("check", F.xxhash64("text"))
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item"), F.col(f"`{item_text}`").cast("string").alias("text")).where("item is not null")
    windows = materialize(items.mapInArrow(_windows(width), "item long, window binary").distinct(), "windows")
    if windows.count() <= block:
        known = [(r.item, tuple(bytes(r.window).split())) for r in windows.collect()]  # ``block`` at most
        wanted = frozenset(w for _, window in known for w in window)
        counts = src.select("text").mapInArrow(_counts(wanted), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
        rarity = {bytes(r.word): r.n for r in counts.collect()} if known else {}  # at most the words of the windows
        post_of = spark.sparkContext.broadcast(post(known, rarity))
        found = src.withColumn("row", F.lit(0).cast("long")).mapInArrow(_scan(post_of), "row long, id long, check long, n_words long, starts array<long>, ends array<long>, items array<string>")
    else:
        rows = materialize(src.withColumn("row", F.monotonically_increasing_id()), "rows")
        pool = lambda c: F.flatten(F.collect_list(c)).alias(c)  # noqa: E731  bounded by a row's words and items
        hits = joined_hits(rows, windows, width).groupBy("row").agg(F.max("n_words").alias("n_words"), pool("starts"), pool("ends"), pool("items"))
        found = rows.select("row", "id", "check").join(hits, "row")
    return found.mapInArrow(_merged, "id long, check long, n_words long, n_hit long, items array<string>").withColumnRenamed("id", id_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_items: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which fewer than ``min_items`` items occur, with all their columns.

    Rows repeated with one id and text all stay or all go.
    """
    done = decontaminate(docs, benchmark, id_col, text_col).where(F.size("items") >= min_items)
    gone = done.select(F.col(id_col).alias(k := fresh("id", docs)), F.col("check").alias(c := fresh("check", docs))).distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(gone[k]) & (F.xxhash64(docs[text_col].cast("string")) == gone[c]), "left_anti")
