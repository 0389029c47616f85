"""What the operators of this subpackage share: the shared folder, written intermediates, salted lookups."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words where a contract says [^\x20\x09-\x0D]+ (bytes.split() splits at the same).
SPACE = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = current.get() if current.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tracewell-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tracewell-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    release(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tracewell_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that no later plan reads."""
    path = getattr(df, "_tracewell_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that have ended: it does when the driver's JVM collects their garbage.

    That also gives the driver's memory back, which many small plans would fill up with theirs.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(base: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has (Spark's names ignore case)."""
    taken = {c.lower() for f in frames for c in f.columns}
    name = f"_tw_{base}"
    while name.lower() in taken:
        name += "_"
    return name


def leaves(spark: SparkSession) -> int:
    """How many leaves keyed work is dealt to before keys meet: a power of two, at least the shuffle partitions."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return 1 << max(4, (n - 1).bit_length())


def any_leaf(spark: SparkSession) -> Column:
    """A leaf dealt row by row, never by a key or id that may be hot. Only for columns that are materialized next."""
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(leaves(spark)))


def salted_lookup(rows: DataFrame, keys: list[str], leaf: str, table: DataFrame, how: str = "left") -> DataFrame:
    """Join ``rows`` with a table that has one row per key, where one key may hold a third of the rows.

    The table's row first goes to each (leaf, key) that occurs, at most ``leaves`` a key, and the rows meet
    it there: no task gets more of a hot key than its leaf has. Null keys match null keys.
    """
    wanted = rows.select(leaf, *keys).distinct()
    t = table.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in table.columns if c not in keys])
    on = [wanted[k].eqNullSafe(t[f"_k{i}"]) for i, k in enumerate(keys)]
    spread = wanted.join(t, on, "inner").select(F.col(leaf).alias("_kl"), *t.columns)
    cond = [rows[leaf] == spread["_kl"]] + [rows[k].eqNullSafe(spread[f"_k{i}"]) for i, k in enumerate(keys)]
    return rows.join(spread, cond, how).drop("_kl", *[f"_k{i}" for i in range(len(keys))])


#: What a Python worker keeps from task to task, by the operator that uses it.
HELD: dict = {}


def tidy() -> None:
    """Give the memory that a worker's allocators hold free back to the machine: a worker lives on after its task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # elsewhere than on glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches, rows: int = 512, keep: str | None = None):
    """The batches in parts of at most ``rows`` rows, so that what is made of a part stays small.

    What the worker still holds for other operators than ``keep`` goes first, and free memory goes back at the end.
    """
    for name in [n for n in HELD if n != keep]:
        del HELD[name]
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    tidy()


#: Bits of a filter of candidates: so many a key, from the least to the most (16 MB). It only spares rows a way: what passes
#: wrongly finds no partner in the join that follows, so the rows are the same with a full filter.
FILTER_EACH, FILTER_LEAST, FILTER_MOST = 16, 1 << 20, 1 << 27


def candidate_bits(keys: DataFrame, digits: Column) -> np.ndarray:
    """The bits (in bytes) of the places of the keys, two a key: the first 16 of at least 16 hex ``digits`` (or fewer, of a number) are two 32-bit numbers.

    Every task merges its own bits before they meet.
    """
    n = keys.count()
    n_bits = min(FILTER_MOST, max(FILTER_LEAST, 1 << (FILTER_EACH * n - 1).bit_length())) if n else FILTER_LEAST
    places = F.array(*[F.conv(F.substring(F.lpad(digits, 16, "0"), at, 8), 16, 10).cast("long").bitwiseAND(F.lit(n_bits - 1)) for at in (1, 9)])
    at = keys.select(F.explode(places).alias("at"))
    words = at.groupBy(F.shiftright("at", 5).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(at & 31 AS INT)))").alias("bits")).toArrow()  # n_bits / 32 rows at most
    out = np.zeros(n_bits // 32, "<u4")
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint8)


def has_bits(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which rows of [key, 2] 32-bit numbers pass the filter."""
    at = places & np.uint32(8 * len(bits) - 1)
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def in_fold(doc_id: Column, folds: int, out: int) -> Column:
    """crc32(doc_id as text) mod ``folds`` is ``out``. A null id counts as empty text (its crc32 is 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == out


def crc_fold(doc_id, folds: int) -> int:
    """The same in Python."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def lower_words(text: str | None) -> list[bytes]:
    """Words between white space of 0x20 and 0x09-0x0D, A-Z lower-cased, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
