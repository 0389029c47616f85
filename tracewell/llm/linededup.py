"""Line deduplication by a deletion-neighbourhood join.

A line of the corpus goes if an earlier line (by document id, then place) is equal to it, or lies within one
edit of it (a character inserted, deleted or replaced) and both have at least ``min_chars`` characters.

Equal lines meet by a 128-bit digest. For the others, a line is cut into regions; if the edit lies in one
region, the rest of the line before and after it is equal, so the hash of that rest is a key that both lines
share. Only lines that share such a key with a different line go on, and only with that region: there each
emits all variants with one character deleted, as hashed keys (with the place, for replacements; and the line
itself, for the shorter of two). Lines with equal variants are joined, by aggregates and never as pairs
within a group, the edit distance of what is found is verified on the texts, and the earliest line stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import any_leaf, candidate_bits, discard, fresh, has_bits, materialize, release, salted_lookup, slices

REGIONS, MIN_CHARS = 3, 20
#: Lines that a task remembers, so as to give the keys of a repeated line once.
SEEN = 200_000
SEP = "\x00"
#: Lines of these alone are blank.
WHITE = " \t\n\v\f\r"


def digest(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))


def text_check(text: str) -> int:
    """What tells documents with one id apart: XXH64 (seed 42), signed, as Spark's xxhash64."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


def region_keys(line: str, regions: int = REGIONS) -> list[tuple[int, int, int]]:
    """(key, base length, region): the rests of the line as the shorter (or equal) and as the longer of two."""
    n, out = len(line), []
    for base in (n, n - 1):
        for i in range(regions):
            a, b = i * base // regions, (i + 1) * base // regions
            rest = f"{base} {i} {line[:a]}{SEP}{line[n - (base - b):]}"
            out.append((xxhash.xxh64_intdigest(rest.encode("utf-8", "surrogatepass")) >> 1, base, i))
    return out


def _occurrences(min_chars: int):
    schema = pa.schema([("doc_id", pa.int64()), ("check", pa.int64()), ("line_no", pa.int32()), ("line", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def occurrences(batches):
        seen: set[bytes] = set()
        for batch in slices(batches):
            cols: list[list] = [[] for _ in schema]
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                check = text_check(text)
                for k, line in enumerate(text.split("\n")):
                    if not line.strip(WHITE):
                        continue
                    d = digest(line)
                    keys = []
                    if len(line) >= min_chars - 1 and d not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(d)
                        keys = [key for key, base, _ in region_keys(line) if base >= min_chars]
                    for col, v in zip(cols, (doc, check, k, d, keys)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return occurrences


def _bit_places(digests: list[bytes]) -> np.ndarray:
    """The first two 32-bit numbers of each digest."""
    return np.frombuffer(b"".join(digests), ">u4").reshape(-1, 4)[:, :2].astype(np.uint32)


def _texts_of(shared):
    """(line, text) of the lines that may be candidates, once a task for most."""

    def texts(batches):
        bits, seen = np.frombuffer(shared.value, np.uint8), set()
        for batch in slices(batches):
            lines = [line for text in batch.column("text").to_pylist() for line in text.split("\n") if line.strip(WHITE)]
            got = []
            if lines:
                digests = [digest(x) for x in lines]
                for k in np.flatnonzero(has_bits(bits, _bit_places(digests))).tolist():
                    if digests[k] not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(digests[k])
                        got.append((digests[k], lines[k]))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in got], pa.binary()), pa.array([b for _, b in got], pa.string())], ["line", "text"])

    return texts


BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def variants(line: str, wanted: set[int], regions: int = REGIONS) -> list[tuple[np.ndarray, int]]:
    """Hashed variants of a line in the regions of its wanted keys, with their kind.

    0: a character replaced (deleted, with its place); 1: the line itself, as the shorter of two; 2: a character
    deleted, as the longer. Variants of kinds 1 and 2 have comparable hashes, those of kind 0 their own.
    """
    n, out, own = len(line), [], False
    c = _mix(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1))
    power = np.full(n, np.uint64(BASE))
    power[:1] = 1
    power = np.multiply.accumulate(power)
    prefix = np.concatenate([[np.uint64(0)], np.add.accumulate(c * power)])
    for key, base, i in region_keys(line, regions):
        if key not in wanted:
            continue
        a, b = i * base // regions, (i + 1) * base // regions
        p = np.arange(a, b if base == n else b + 1)
        without = prefix[p] + (prefix[n] - prefix[p + 1]) * np.uint64(INVERSE)
        if base == n:
            out.append((_mix(without + _mix(p.astype(np.uint64) + np.uint64(7))), 0))
            if not own:
                own = True
                out.append((_mix(prefix[n:]), 1))
        else:
            out.append((np.unique(_mix(without)), 2))
    return out


def _variants(batches):
    for batch in batches:
        lines, hashes, kinds = [], [], []
        for d, text, keys in zip(batch.column("line").to_pylist(), batch.column("text").to_pylist(), batch.column("keys").to_pylist()):
            for h, kind in variants(text, set(keys)):
                lines += [d] * len(h)
                hashes.append(h.view(np.int64))
                kinds.append(np.full(len(h), kind, np.int8))
            if len(lines) > 200_000:
                yield _variant_rows(lines, hashes, kinds)
                lines, hashes, kinds = [], [], []
        yield _variant_rows(lines, hashes, kinds)


def _variant_rows(lines, hashes, kinds):
    h, k = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((hashes, np.int64), (kinds, np.int8)))
    return pa.RecordBatch.from_arrays([pa.array(lines, pa.binary()), pa.array(h, pa.int64()), pa.array(k.astype(np.int32))], ["line", "variant", "kind"])


def near_lines(occurrences: DataFrame, first: DataFrame, src: DataFrame) -> DataFrame:
    """(line, keep): lines with an earlier one within an edit, and the first place of the earliest such."""
    spark = src.sparkSession
    rows = occurrences.select(F.explode("keys").alias("key"), "line")
    one = F.xxhash64("line")
    many = rows.groupBy("key").agg(F.min(one).alias("a"), F.max(one).alias("b")).where("a <> b").select("key")  # a key of many lines is combined where they are
    many = materialize(many, "keys")
    release(spark)
    wanted = materialize(rows.join(many, "key").groupBy("line").agg(F.collect_set("key").alias("keys")), "candidates")  # 2 * REGIONS keys at most
    bits = spark.sparkContext.broadcast(candidate_bits(wanted, F.substring(F.hex("line"), 1, 16)).tobytes())
    texts = src.select("text").mapInArrow(_texts_of(bits), "line binary, text string").groupBy("line").agg(F.first("text").alias("text"))
    texts = materialize(wanted.join(texts, "line").join(first.select("line", "place"), "line"), "lines")
    bits.destroy()
    emitted = materialize(texts.select("line", "text", "keys").mapInArrow(_variants, "line binary, variant long, kind int"), "variants")
    group = [F.col("variant"), (F.col("kind") == 0).alias("replaced")]
    meet = emitted.groupBy(*group).agg(F.min("line").alias("lo"), F.max("line").alias("hi")).where("lo <> hi").select("variant", "replaced")
    members = emitted.withColumn("replaced", F.col("kind") == 0).join(meet, ["variant", "replaced"]).distinct().join(texts.select("line", "place"), "line")
    entry = F.struct("place", "line")
    best = members.groupBy("variant", "replaced").agg(F.min(F.when(F.col("kind") != 2, entry)).alias("short"), F.min(F.when(F.col("kind") != 1, entry)).alias("long"))
    links = members.join(best, ["variant", "replaced"]).withColumn("to", F.when(F.col("kind") == 1, F.col("long")).otherwise(F.col("short")))
    links = links.where("to is not null and to.place < place").select("line", F.col("to.line").alias("other"), F.col("to.place").alias("keep")).distinct()
    met = links.join(texts.select("line", "text"), "line").join(texts.select(F.col("line").alias("other"), F.col("text").alias("other_text")), "other")
    sure = met.where(F.levenshtein("text", "other_text", 1).between(0, 1))  # a threshold that is passed gives -1
    near = materialize(sure.groupBy("line").agg(F.min("keep").alias("keep")), "near")
    for done in (many, wanted, texts, emitted):
        discard(done)
    release(spark)
    return near


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Lines that go: doc_id, check, line_no (from 0), keep_doc_id, keep_line_no, near.

    ``check`` is xxhash64 of the text and tells documents with one id apart. keep is the earliest equal line, or
    for near duplicates the earliest within the bound. Null ids come first. Lines of white space stay, and no line goes on
    their account; null and empty texts have no lines. Rows repeated with id and text are one document.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null and text <> ''")
    occ = src.mapInArrow(_occurrences(min_chars), "doc_id long, check long, line_no int, line binary, keys array<long>").withColumn("leaf", any_leaf(spark))
    occ = materialize(occ, "lines")
    place = F.struct("doc_id", "check", "line_no")
    first = occ.groupBy("line").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("n"))
    near = near_lines(occ, first, src)
    table = first.join(near, "line", "left").where("n > 1 or keep is not null").select("line", "place", "keep")
    met = salted_lookup(occ.select("doc_id", "check", "line_no", "line", "leaf"), ["line"], "leaf", table, "inner")
    gone = met.where(F.col("keep").isNotNull() | ~place.eqNullSafe(F.col("place")))
    kept = F.coalesce("keep", "place")
    return gone.select("doc_id", "check", "line_no", kept["doc_id"].alias("keep_doc_id"), kept["line_no"].alias("keep_line_no"), F.col("keep").isNotNull().alias("near"))


def _without(text_col: str, gone_col: str):
    def without(batches):
        for batch in slices(batches):
            gone = batch.column(gone_col).to_pylist()
            texts = batch.column(text_col)
            if any(gone):
                texts = pa.array([t if not g else "\n".join([x for k, x in enumerate(t.split("\n")) if k not in g]) for t, g in zip(texts.to_pylist(), map(set, (g or () for g in gone)))], texts.type)
            keep = [c for c in batch.schema.names if c != gone_col]
            yield pa.RecordBatch.from_arrays([texts if c == text_col else batch.column(c) for c in keep], names=keep)

    return without


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, count_col: str | None = None) -> DataFrame:
    """``docs`` without the lines that go; every row stays, with all columns. A text may become empty, null stays null.

    ``count_col``: also give the number of lines that went, under this name.
    """
    gone = removed_lines(docs, id_col, text_col, min_chars).groupBy("doc_id", "check").agg(F.collect_set("line_no").alias("gone"))
    a, b, c = fresh("id", docs), fresh("check", docs), fresh("gone", docs)
    gone = gone.select(F.col("doc_id").alias(a), F.col("check").alias(b), F.col("gone").alias(c))
    same = docs[id_col].cast("long").eqNullSafe(gone[a]) & (F.xxhash64(docs[text_col].cast("string")) == gone[b])
    met = docs.join(gone, same, "left").drop(a, b)
    if count_col:
        met = met.withColumn(count_col, F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long"))
    return met.mapInArrow(_without(text_col, c), met.drop(c).schema)
