"""A dictionary-compressed WARC writer, and its reader.

Pages with equal payloads are found by digest, by the tree-merge of exact deduplication, so a payload that a third
of the pages share loads no single task. The one with the largest id is archived as a response, the others as
revisits that refer to it. An archive (.warc.zst) holds up to ``archive_bytes`` of records: a Zstandard dictionary
is trained on records spread evenly over it and leads the file in a skippable frame; then each record is a
frame of its own, so a record can be read alone.

A task writes an archive under a name of its own and renames it when it is whole; the manifest of the tasks that
succeeded says which archives count. What a lost or repeated task leaves behind is never read.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import io
import struct
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import any_leaf, fresh, leaves, materialize, new_path
from .exact_dedup import KEY, tree_merge

#: Magic number of the frame with the dictionary; uncompressed bytes of an archive; of a dictionary; of what it is trained on.
MAGIC, ARCHIVE, DICTIONARY, SAMPLE = 0x184D2A5D, 48 << 20, 64 << 10, 2 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'urn:page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """A WARC/1.1 record. White space and control characters in the URL are escaped."""
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else f"urn:page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{sha1}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", *([] if refers_to is None else [f"X-Refers-To-Page-Id: {refers_to}"])]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> bytes:
    """Trained on whole records spread evenly over the archive, about ``SAMPLE`` bytes of them.

    A few records, or such that no dictionary can be trained on, are their own dictionary: its raw content is the start
    of what they are.
    """
    step = sum(map(len, records)) // SAMPLE + 1
    samples = records[::step]
    size = min(DICTIONARY, max(256, sum(map(len, samples)) // 8))
    if len(samples) > 7:
        with contextlib.suppress(zstandard.ZstdError):
            return zstandard.train_dictionary(size, samples, k=512, d=8).as_bytes()
    return b"".join(samples)[:size]


def archive(records: list[bytes], level: int = 3) -> bytes:
    """The file: the dictionary in a leading skippable frame, then a frame a record."""
    trained = dictionary(records)
    press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(trained), write_content_size=True)
    out = io.BytesIO()
    out.write(struct.pack("<II", MAGIC, len(trained)) + trained)
    for r in records:
        out.write(press.compress(r))
    return out.getvalue()


def read_archive(data: bytes):
    """(headers, block) of each record. A header's name is in lower case."""
    at, trained = 0, None
    if len(data) >= 8 and struct.unpack("<I", data[:4])[0] == MAGIC:
        size = struct.unpack("<I", data[4:8])[0]
        held = data[8 : 8 + size]
        trained = zstandard.ZstdCompressionDict(zstandard.decompress(held) if held[:4] == b"\x28\xb5\x2f\xfd" else held)
        at = 8 + size
    source = zstandard.ZstdDecompressor(dict_data=trained).stream_reader(io.BytesIO(memoryview(data)[at:]), read_across_frames=True)
    stream = io.BufferedReader(source, 1 << 16)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record where one should be: {line[:40]!r}")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "surrogatepass").rstrip("\r\n").partition(": ")
            head[name.lower()] = value
        block = stream.read(int(head["content-length"]))
        stream.read(4)
        yield head, block


def page_of(head: dict, block: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as the archive has them."""
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda k: int(head[k]) if k in head else None
    if head["warc-type"] == "revisit":
        length = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
        return number("x-page-id"), length, head["warc-payload-digest"].removeprefix("sha1:"), "revisit", number("x-refers-to-page-id")
    return number("x-page-id"), len(payload), digest(payload), "response", None


def _writer(folder: str, archive_bytes: int):
    def write(batches):
        fs, base = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
        fs.create_dir(base, recursive=True)

        def flushed(records):
            name = f"{uuid.uuid4().hex}.warc.zst"
            data = archive(records)
            with fs.open_output_stream(f"{base}/{name}.part") as out:
                out.write(data)
            fs.move(f"{base}/{name}.part", f"{base}/{name}")
            return pa.RecordBatch.from_pydict({"archive": [name], "records": [len(records)], "bytes": [len(data)]})

        held, size = [], 0
        for batch in batches:
            for page, url, html, keep, group, least in zip(*(batch.column(k).to_pylist() for k in ("page_id", "url", "html", "keep_id", "group_size", "least"))):
                payload = html.encode("utf-8", "surrogatepass") if html else b""
                revisit = group > 1 and page != keep and len(payload) >= least
                held.append(record(page, url, payload, digest(payload), keep if revisit else None, revisit))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flushed(held)
                    held, size = [], 0
        if held:
            yield flushed(held)

    return write


def _reader(batches):
    for batch in batches:
        for data in batch.column("content"):
            rows = []
            for head, block in read_archive(data.as_py()):
                rows.append(page_of(head, block))
                if len(rows) == 10_000:
                    yield _rows(rows)
                    rows = []
            yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 5
    kinds = (("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, kinds)], [k for k, _ in kinds])


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, archive_bytes: int = ARCHIVE) -> DataFrame:
    """Write the pages' records to archives in ``folder`` (shared by all executors); the manifest: archive, records, bytes.

    A null page is an empty payload; a null URL becomes urn:page:<id>. Payloads of fewer than ``min_bytes`` bytes are
    responses all. Ids may be null: a null id is below all others, and where all of a group are null its pages
    are responses all. Rows repeated with one id and payload are one page: all of them are what that page is.
    Other columns are not read. An empty table gives no archive.
    """
    spark = pages.sparkSession
    src = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    content = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    key = [F.unhex(F.sha1(content)).alias("digest"), F.xxhash64(content).alias("check"), F.octet_length(content).alias("bytes")]
    runs = materialize(src.select(F.col("page_id").alias("id"), *key).withColumn("leaf", any_leaf(spark)), "payloads")
    decided = tree_merge(runs, leaves(spark)).select("id", *KEY, "keep_id", "group_size").distinct().alias("d")
    rows = src.select("page_id", "url", "html", *key).alias("p")
    same = [F.col("p.page_id").eqNullSafe(F.col("d.id"))] + [F.col(f"p.{k}") == F.col(f"d.{k}") for k in KEY]
    met = rows.join(decided, same).select("p.page_id", "p.url", "p.html", "d.keep_id", F.when(F.col("d.keep_id").isNull(), F.lit(1)).otherwise(F.col("d.group_size")).alias("group_size"), F.lit(min_bytes).alias("least"))
    return materialize(met.mapInArrow(_writer(folder, archive_bytes), "archive string, records long, bytes long"), "manifest")


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record in the manifest's archives."""
    if manifest.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    name = fresh("archive", files)
    counted = files.withColumn(name, F.substring_index("path", "/", -1)).join(manifest.select(F.col("archive").alias(name)), name)
    return counted.select("content").mapInArrow(_reader, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write the pages and read the archives back."""
    folder = folder or new_path(pages.sparkSession, "warc")
    return read_archives(pages.sparkSession, folder, write_archives(pages, folder, **options))
