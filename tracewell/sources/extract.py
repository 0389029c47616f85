"""From files to rows: the extractor of a path, and the DataFrame of all that it finds."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import prose
from .code import JavaReader, PythonReader, RustReader
from .unit_tree import UnitTree


def python(path: str, content: str) -> UnitTree:
    """By its syntax tree; what does not parse is read as text."""
    try:
        return PythonReader(path, content).read()
    except (SyntaxError, ValueError, RecursionError):
        return prose.text(path, content, prose=False)


#: Extractors by extension; others are read as text, those of PROSE with names of code in them.
EXTRACTORS: dict[str, Callable[[str, str], UnitTree]] = {
    **dict.fromkeys(("md", "markdown", "mdx"), prose.markdown),
    **dict.fromkeys(("py", "pyi"), python),
    "rs": lambda path, content: RustReader(path, content).read(),
    "java": lambda path, content: JavaReader(path, content).read(),
}
PROSE = ("txt", "rst", "org", "tex", "")


def register(extension: str, extractor: Callable[[str, str], UnitTree]) -> None:
    """Let an extractor (path, content) -> finished UnitTree read files of an extension."""
    EXTRACTORS[extension.lower()] = extractor


def extract(path: str, content: str) -> UnitTree:
    """What a file holds. The extension is what follows the last dot of the whole path."""
    ext = path.rsplit(".", 1)[1].lower() if "." in path else ""
    of = EXTRACTORS.get(ext)
    return of(path, content) if of else prose.text(path, content, prose=ext in PROSE)


UNIT = "id string, parent string, kind string, path string, start_line int, end_line int, label string, text string, is_leaf boolean, ord long"
EXTRACTED = f"path string, units array<struct<{UNIT.replace(' ', ':').replace(',:', ',')}>>, definitions array<struct<unit_id:string,name:string,kind:string>>, mentions array<struct<unit_id:string,name:string,kind:string,line:int>>"
STRUCT = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
UNIT_TYPE = pa.struct([(name, STRUCT[kind]) for name, kind in (x.split() for x in UNIT.split(", "))])
DEFINITION_TYPE = pa.struct([("unit_id", pa.string()), ("name", pa.string()), ("kind", pa.string())])
MENTION_TYPE = pa.struct([("unit_id", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("line", pa.int32())])


def _rows(extractors: dict):
    def rows(batches):
        EXTRACTORS.update(extractors)
        for batch in batches:
            trees = [extract(p, c or "") for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist())]
            units = [[{"id": u.id, "parent": u.parent, "kind": u.kind, "path": t.path, "start_line": u.start, "end_line": u.end, "label": u.label, "text": u.text, "is_leaf": u.is_leaf, "ord": n} for n, u in enumerate(t.units)] for t in trees]
            definitions = [[dict(zip(("unit_id", "name", "kind"), d)) for d in t.definitions] for t in trees]
            mentions = [[dict(zip(("unit_id", "name", "kind", "line"), m)) for m in t.mentions] for t in trees]
            yield pa.RecordBatch.from_arrays(
                [pa.array([t.path for t in trees], pa.string()), pa.array(units, pa.list_(UNIT_TYPE)), pa.array(definitions, pa.list_(DEFINITION_TYPE)), pa.array(mentions, pa.list_(MENTION_TYPE))],
                ["path", "units", "definitions", "mentions"],
            )

    return rows


def extract_files(files: DataFrame) -> DataFrame:
    """files(path, content) -> a row per file with its units, definitions and mentions; no shuffle."""
    return files.select("path", "content").mapInArrow(_rows(dict(EXTRACTORS)), EXTRACTED)


def tables_of(extracted: DataFrame) -> dict[str, DataFrame]:
    """The evidence tables units (without len), definitions and mentions."""
    return {
        "units": extracted.select(F.inline("units")),
        "definitions": extracted.select("path", F.inline("definitions")).select("unit_id", "name", "kind", "path"),
        "mentions": extracted.select("path", F.inline("mentions")).select("unit_id", "name", "kind", "line", "path"),
    }
