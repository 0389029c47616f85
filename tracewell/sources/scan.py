"""Directory scans: which files there are, which are ignored, and which are admitted as text."""

from __future__ import annotations

import re
from datetime import timezone
from fnmatch import translate

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FILE_BYTES, NUL_WINDOW, RACY_SECONDS

# Extensions that are never readable text, and directories that are never entered.
EXCLUDED = (
    "png jpg jpeg gif webp bmp ico svg tif tiff heic psd "
    "mp3 m4a aac ogg wav flac mp4 mov avi mkv webm "
    "zip tar gz bz2 xz 7z rar zst jar war "
    "bin dat exe dll so dylib o a lib wasm class pyc "
    "pdf doc docx ppt pptx xls xlsx hwp hwpx key pages numbers "
    "db sqlite sqlite3 parquet npy npz pt pth ckpt safetensors onnx "
    "ttf otf woff woff2 lock"
).split()
SKIPPED = ("target", "node_modules", ".git", "__pycache__", ".venv", "venv", "dist", "build")


class Ignore:
    """The rules of one ignore file, for paths relative to its directory."""

    def __init__(self, text: str):
        self.rules: list[tuple[re.Pattern, bool, bool]] = []
        for line in text.splitlines():
            rule = line.rstrip()
            if not rule or rule.startswith("#"):
                continue
            keep, rule = rule.startswith("!"), rule.removeprefix("!").removeprefix("\\")
            folder, rule = rule.endswith("/"), rule.rstrip("/")
            anchored = "/" in rule
            parts = [".*" if p == "**" else translate(p).removesuffix(r"\Z").removesuffix(r"\z").removeprefix("(?s:").removesuffix(")").replace(".*", "[^/]*") for p in rule.lstrip("/").split("/")]
            body = "/".join(parts).replace(".*/", "(?:.*/)?").replace("/.*", "/.*")
            self.rules.append((re.compile(("" if anchored else "(?:.*/)?") + body + "$", re.S), keep, folder))

    def verdict(self, path: str, is_dir: bool) -> bool | None:
        """True: ignored; False: kept by a later ``!`` rule; None: no rule speaks of it."""
        said = None
        for rule, keep, folder in self.rules:
            if (is_dir or not folder) and rule.match(path):
                said = not keep
        return said


def ignored(path: str, rules: dict[str, list[Ignore]]) -> bool:
    """Whether a file is hidden, in a skipped directory, or ignored by the rules of a directory above it."""
    parts = path.split("/")
    for n in range(1, len(parts) + 1):
        name, is_dir = parts[n - 1], n < len(parts)
        if name.startswith(".") or is_dir and name in SKIPPED:
            return True
        here = "/".join(parts[:n])
        for depth in range(n - 1, -1, -1):  # the nearest directory's rules speak first
            base = "/".join(parts[:depth])
            said = [v for r in rules.get(base, []) if (v := r.verdict(here[len(base) :].lstrip("/"), is_dir)) is not None]
            if said:
                if said[-1]:
                    return True
                break
    return False


def _filesystem(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pafs.LocalFileSystem(), root)


def walk(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, mtime_ns) of the files below ``root`` that are not ignored: names only, listed by the driver."""
    fs, base = _filesystem(root)
    base = base.rstrip("/")
    rules: dict[str, list[Ignore]] = {}
    found, todo = [], [""]
    exclude = fs.get_file_info(f"{base}/.git/info/exclude")
    if exclude.type == pafs.FileType.File:
        with fs.open_input_stream(exclude.path) as f:
            rules.setdefault("", []).append(Ignore(f.read().decode("utf-8", "replace")))
    while todo:
        here = todo.pop()
        infos = fs.get_file_info(pafs.FileSelector(f"{base}/{here}" if here else base))
        for info in infos:
            if info.base_name == ".gitignore" and info.type == pafs.FileType.File:
                with fs.open_input_stream(info.path) as f:
                    rules.setdefault(here, []).append(Ignore(f.read().decode("utf-8", "replace")))
        for info in infos:
            path = f"{here}/{info.base_name}" if here else info.base_name
            if info.type == pafs.FileType.Directory:
                if not ignored(f"{path}/x", rules) and not _is_link(fs, info.path):
                    todo.append(path)
            elif info.type == pafs.FileType.File and not ignored(path, rules) and not _is_link(fs, info.path):
                found.append((path, info.size, int(info.mtime.replace(tzinfo=info.mtime.tzinfo or timezone.utc).timestamp() * 1_000_000) * 1000))
    return spark.createDataFrame(sorted(found), "path string, length long, mtime_ns long")


def _is_link(fs: pafs.FileSystem, path: str) -> bool:
    import os

    return isinstance(fs, pafs.LocalFileSystem) and os.path.islink(path)


def read_contents(listed: DataFrame, root: str) -> DataFrame:
    """Add ``content`` (binary) to listed(path, ...): read by the executors; a file that is gone has null."""

    def read(batches):
        fs, base = _filesystem(root)
        for batch in batches:
            data = []
            for p in batch.column("path").to_pylist():
                try:
                    with fs.open_input_stream(f"{base.rstrip('/')}/{p}") as f:
                        data.append(f.read())
                except OSError:
                    data.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], [*batch.schema.names, "content"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listed.schema)
    return listed.mapInArrow(read, f"{columns}, content binary")


def admissible(path: Column, length: Column) -> Column:
    """What can be said before a file is read: its extension and size."""
    name = F.substring_index(path, "/", -1)
    ext = F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))
    return ~ext.isin(EXCLUDED) & (length <= FILE_BYTES)


def admit(files: DataFrame) -> DataFrame:
    """files(path, length, content binary, ...) -> those that are readable text, with it as a string (one BOM dropped)."""
    head = F.expr(f"hex(substring(content, 1, {NUL_WINDOW}))")
    fits = files.where(admissible(F.col("path"), F.col("length"))).where("content is not null")
    clean = fits.where(~head.rlike("^(?:..)*?00")).where(F.is_valid_utf8(F.col("content").cast("string")))
    return clean.withColumn("content", F.regexp_replace(F.col("content").cast("string"), "^\\uFEFF", "")).where(F.col("content").rlike("\\S"))


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def unchanged(stat: DataFrame, listed: DataFrame) -> DataFrame:
    """Paths that need no reading: same size and time, and last touched well before they were last checked."""
    same = (stat["size"] == listed["length"]) & (stat["mtime_ns"] == listed["mtime_ns"])
    settled = stat["mtime_ns"] + RACY_SECONDS * 1_000_000_000 < stat["checked_ns"]
    return listed.join(stat, (listed["path"] == stat["path"]) & same & settled, "left_semi").select("path")


def changes(known: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change): added, updated, unchanged or removed, of known(path, hash) and now(path, hash)."""
    a, b = known.select("path", F.col("hash").alias("old")), now.select("path", F.col("hash").alias("new"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "unchanged").otherwise("updated")
    return a.join(b, "path", "full").select("path", kind.alias("change"))
