"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints: 64-bit SimHash over word shingles (XXH64, seed 42). Equal fingerprints meet first, so what is
compared are distinct ones. Two that differ in at most three bits agree in one of four 16-bit blocks, and in
what is left, 48 bits, in one of four 12-bit blocks: 16 keys of 28 bits, and every link has a key that
both ends share. Within a key the fingerprints are stored as vertical bit planes, 64 to a machine word; the
distances of a query to 64 others are updated plane by plane in saturating carry-save counters, and a block
is abandoned when all 64 counters exceed the radius. A key with more fingerprints than a block list may
hold is dealt to pairs of chunks, so the comparison stays exact and bounded at any size. Links within a list
leave as a star a local component, never as all its pairs; components then join across keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import any_leaf, fresh, lower_words, materialize, salted_lookup, slices
from .components import components

#: Fingerprints in one list at most (two chunks of half of it each, for a larger key), and comparisons of a fingerprint with a block of 64 at once.
LIST, WORK = 4096, 1 << 19
ONE, ALL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, width: int = 3) -> int:
    """The SimHash of a text as an unsigned 64-bit integer; without words it is zero."""
    words = lower_words(text)
    if not words:
        return 0
    line, n = b" ".join(words), len(words)
    if n <= width:
        return xxhash.xxh64_intdigest(line, 42)
    size = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(size + 1) - 1
    start = end - size
    h = xxhash.xxh64_intdigest
    many = n - width + 1
    counts = np.zeros(64, np.int64)
    starts, ends = start[:many].tolist(), end[width - 1 :].tolist()
    for at in range(0, many, 4096):  # bounded, also for very long texts
        got = np.array([h(line[a:b], 42) for a, b in zip(starts[at : at + 4096], ends[at : at + 4096])], np.uint64)
        counts += np.unpackbits(got.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > many).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches):
    for batch in slices(batches):
        got = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("check"), pa.array(got)], ["id", "check", "fp"])


def near_in_lists(lists: list[np.ndarray], radius: int = 3) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each list of distinct uint64 fingerprints: the index pairs (i < j) at a Hamming distance within ``radius`` (3 at most)."""
    queries, planes, owner, place, first = [], [], [], [], []
    blocks = 0
    for k, fps in enumerate(lists):
        n = -(-len(fps) // 64)
        padded = np.zeros(n * 64, np.uint64)
        padded[: len(fps)] = fps
        bits = (padded.reshape(n, 64)[:, None, :] >> np.arange(64, dtype=np.uint64)[None, :, None]) & ONE
        planes.append((bits << np.arange(64, dtype=np.uint64)).sum(axis=2, dtype=np.uint64))  # [block, plane]
        i = np.repeat(np.arange(len(fps)), n)
        b = np.tile(np.arange(n), len(fps))
        use = b >= i // 64  # later blocks only: a pair is compared once
        queries.append(fps[i[use]])
        owner.append(np.full(use.sum(), k))
        place.append(i[use])
        first.append(b[use] + blocks)
        blocks += n
    base = np.cumsum([0] + [len(p) for p in planes])
    planes, queries, owner, place, first = map(np.concatenate, (planes, queries, owner, place, first))
    limit = np.array([len(x) for x in lists])
    out = [([], []) for _ in lists]
    for at in range(0, len(queries), 1 << 16):  # bounded work space
        cut = slice(at, at + (1 << 16))
        alive = np.arange(len(queries))[cut]
        c0 = np.zeros(len(alive), np.uint64)
        c1, over = c0.copy(), c0.copy()
        for bit in range(64):
            q = (queries[alive] >> np.uint64(bit)) & ONE
            x = planes[first[alive], bit] ^ (np.uint64(0) - q)
            carry = c0 & x
            c0 ^= x
            over |= c1 & carry
            c1 ^= carry
            if bit % 8 == 7:  # counters hold 0 to 3, then they are over
                live = over != ALL
                if not live.all():
                    alive, c0, c1, over = alive[live], c0[live], c1[live], over[live]
                if not len(alive):
                    break
        if radius < 3:
            over = over | (c1 & c0) if radius == 2 else over | c1 if radius == 1 else over | c1 | c0
        near = ~over
        hit = near != 0
        alive, near = alive[hit], near[hit]
        if not len(alive):
            continue
        which, lane = np.nonzero(np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        who = alive[which]
        j = (first[who] - base[owner[who]]) * 64 + lane
        ok = (j > place[who]) & (j < limit[owner[who]])
        who, j = who[ok], j[ok]
        for k in np.unique(owner[who]):
            mine = owner[who] == k
            out[k][0].append(place[who][mine])
            out[k][1].append(j[mine])
    none = np.zeros(0, np.int64)
    return [(np.concatenate(a) if a else none, np.concatenate(b) if b else none) for a, b in out]


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index that each of n nodes reaches over the pairs."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if (root == before).all():
            return root


def parts_of(sizes: list[int], work: int = WORK) -> list[tuple[int, int]]:
    """Runs (from, to) of lists that are compared at once: as many as ``work`` comparisons of a block hold, one list at least."""
    out, at, held = [], 0, 0
    for k, n in enumerate(sizes):
        own = n * -(-n // 64)
        if k > at and held + own > work:
            out.append((at, k))
            at, held = k, 0
        held += own
    return [*out, (at, len(sizes))] if len(sizes) > at else out


def _links(radius: int):
    def links(batches):
        for batch in slices(batches):
            lists = batch.column("fps")
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            for at, to in parts_of(np.diff(ends).tolist()):
                part = [values[ends[k] : ends[k + 1]] for k in range(at, to)]
                a, b = [], []
                for fps, (i, j) in zip(part, near_in_lists(part, radius)):
                    if len(i):
                        root = local_roots(len(fps), i, j)
                        k = np.nonzero(root != np.arange(len(fps)))[0]
                        a.append(fps[k])
                        b.append(fps[root[k]])
                a, b = (np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (a, b))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return links


def _keys(fp: Column) -> Column:
    """The 16 keys of a fingerprint: one of four 16-bit blocks with one of four 12-bit blocks of the rest."""
    keys = []
    for i in range(4):
        block = F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))
        low = fp.bitwiseAND(F.lit((1 << (16 * i)) - 1))
        high = F.shiftleft(F.shiftrightunsigned(fp, 16 * (i + 1)), 16 * i) if i < 3 else F.lit(0).cast("long")
        rest = high.bitwiseOR(low)
        for j in range(4):
            part = F.shiftrightunsigned(rest, 12 * j).bitwiseAND(F.lit(0xFFF))
            keys.append(F.shiftleft(F.lit(4 * i + j).cast("long"), 28).bitwiseOR(F.shiftleft(block, 12)).bitwiseOR(part))
    return F.array(*keys)


def near_links(fps: DataFrame, radius: int = 3, limit: int = LIST) -> DataFrame:
    """fps(fp), distinct -> (a, b): enough links within the radius (3 at most) to connect all that are linked."""
    rows = fps.select("fp", F.explode(_keys(F.col("fp"))).alias("key"))
    many = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chunks = F.greatest(F.lit(1), F.ceil(F.col("n") * 2 / F.lit(limit)))
    met = rows.join(many, "key").withColumn("c", F.when(F.col("n") <= limit, F.lit(1)).otherwise(chunks).cast("long"))
    met = met.withColumn("i", F.pmod(F.xxhash64("fp"), F.col("c"))).select("key", "fp", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)).alias("j"))
    lists = met.groupBy("key", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1")
    return lists.select("fps").mapInArrow(_links(radius), "a long, b long").distinct()


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """One row per input row: id, fp (the fingerprint as a signed long), component_id, check (xxhash64 of the text).

    Fingerprints link at ``radius`` or fewer differing bits; component_id is the least id of all documents
    that can be reached. A null or empty text, or one of white space, has fingerprint zero and links like any
    other. A null id is above all others: component_id is null only where all ids of a component are.
    Repeated rows share a component. Other columns of ``docs`` are not read; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = src.withColumn("check", F.xxhash64("text")).mapInArrow(_fingerprints, "id long, check long, fp long").withColumn("leaf", any_leaf(spark))
    rows = materialize(rows, "fingerprints")  # texts are read once
    classes = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    roots = components(near_links(classes, radius), "a", "b")
    whole = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    table = whole.select("fp", "root").join(best, "root").select("fp", "component_id")
    return salted_lookup(rows, ["fp"], "leaf", table).select(F.col("id").alias(id_col), "fp", "component_id", "check")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the least of their component, with all their columns.

    A component without ids keeps its rows. Rows repeated with one id and text all stay or all go.
    """
    done = simhash(docs, id_col, text_col).where(F.col(id_col).isNull() & F.col("component_id").isNotNull() | (F.col(id_col) != F.col("component_id")))
    gone = done.select(F.col(id_col).alias(k := fresh("id", docs)), F.col("check").alias(c := fresh("check", docs))).distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(gone[k]) & (F.xxhash64(docs[text_col].cast("string")) == gone[c]), "left_anti")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
