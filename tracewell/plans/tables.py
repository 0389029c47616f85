"""The stored index: versioned Parquet tables and a manifest whose replacement is the commit."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SCHEMA_VERSION, TABLES

#: Commits after which a replaced version is deleted: a question may be answered while others refresh.
KEPT = 8
#: Tables that a dump leaves out: raw history, what can't matter to answers, and caches.
NOT_DUMPED = ("commits", "hunks", "commit_blobs", "unit_changes", "stat_cache", "closure")


class Store:
    """Tables below ``path``, which driver and executors share.

    A table is written to a directory of its own version and never changed; ``commit`` puts the new versions into the
    manifest at once, so a reader sees all of a refresh or nothing of it, and a lost job leaves only files that
    nothing refers to.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.pending: dict[str, str] = {}
        self.meta = self._read()
        if self.meta.get("schema") != SCHEMA_VERSION:  # another layout: all but the root is dropped
            self.meta = {"schema": SCHEMA_VERSION, "tables": {}, "keys": {k: v for k, v in self.meta.get("keys", {}).items() if k == "root"}}

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _read(self) -> dict:
        fs, p = self._fs(f"{self.path}/manifest.json")
        if not fs.exists(p):
            return {}
        return json.loads("\n".join(r.value for r in self.spark.read.text(str(p)).collect()))

    def table(self, name: str) -> DataFrame:
        """The committed table; empty where there is none yet."""
        at = self.meta["tables"].get(name)
        return self.spark.read.schema(TABLES[name]).parquet(at) if at else self.spark.createDataFrame([], TABLES[name])

    def put(self, name: str, rows: DataFrame) -> DataFrame:
        """Write a new version, and read it: what is derived from it is derived from what was stored."""
        columns = [F.col(c).cast(t).alias(c) for c, t in (x.split() for x in TABLES[name].split(", "))]
        at = f"{self.path}/{name}/{uuid.uuid4().hex}"
        rows.select(*columns).write.parquet(at)
        self.pending[name] = at
        return self.spark.read.schema(TABLES[name]).parquet(at)

    def current(self, name: str) -> DataFrame:
        """The version that is being written, or else the committed one."""
        return self.spark.read.schema(TABLES[name]).parquet(self.pending[name]) if name in self.pending else self.table(name)

    def get(self, key: str, default: str | None = None) -> str | None:
        return self.meta["keys"].get(key, default)

    def commit(self, **keys: str | None) -> None:
        """Make the pending versions, and these keys, the current ones.

        What they replace stays until it has been replaced ``KEPT`` commits ago, for readers that still hold it.
        """
        old = [at for name, at in self.meta["tables"].items() if name in self.pending]
        kept = [*self.meta.get("replaced", []), old]
        self.meta["replaced"] = kept[-KEPT:]
        self.meta["tables"].update(self.pending)
        self.meta["keys"].update(keys)
        self.pending = {}
        jvm = self.spark.sparkContext._jvm
        fs, p = self._fs(f"{self.path}/manifest.json.{uuid.uuid4().hex}")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(self.meta).encode()))
        out.close()
        _, final = self._fs(f"{self.path}/manifest.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(p, final, options)
        for at in (x for versions in kept[:-KEPT] for x in versions):
            f, q = self._fs(at)
            f.delete(q, True)

    def replace_paths(self, name: str, gone: DataFrame, new: DataFrame) -> DataFrame:
        """The table without the rows of gone(path), and with the new rows."""
        columns = [x.split()[0] for x in TABLES[name].split(", ")]
        return self.put(name, self.table(name).join(gone.select("path"), "path", "left_anti").select(*columns).unionByName(new.select(*columns)))

    def dump(self) -> DataFrame:
        """(table, row): every row of the tables that answers depend on, floats to nine decimals, for comparisons of indexes."""
        out = None
        for name in TABLES:
            if name in NOT_DUMPED:
                continue
            rows = self.table(name)
            cells = [F.coalesce(F.format_string("%.9f", F.col(f.name)) if f.dataType.typeName() == "double" else F.col(f.name).cast("string"), F.lit("")) for f in rows.schema]
            part = rows.select(F.lit(name).alias("table"), F.concat_ws("\t", *cells).alias("row"))
            out = part if out is None else out.unionByName(part)
        return out
