"""DataFrames of cells as .xlsx files."""

from __future__ import annotations

import itertools
import os
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit
from urllib.request import url2pathname

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.refs import MAX_ROW
from ..plans.fills import numbered
from .model import Cell
from .writer import SheetInput, WorkbookInput, _by_row, write_xlsx


_COLUMNS = ["path", "sheet_index", "sheet", "row", "col", "type", "n", "s", "b", "err", "t", "formula"]
_VALUE = {"number": 6, "string": 7, "boolean": 8, "error": 9, "date": 10}


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns], strict=True)


def _cell(r: tuple) -> Cell:
    at = _VALUE.get(r[5])
    return Cell(r[3], r[4], r[5], None if at is None else r[at], r[11])


def render(cells: DataFrame) -> DataFrame:
    """(path, content): one workbook for each ``path``.

    Cells come to a task in their order and are written as they come, so that a task holds a workbook's compressed bytes only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, own in itertools.groupby(_rows(batches), key=lambda r: r[0]):
            sheets = (SheetInput(sheet, _by_row(map(_cell, some)), streamed=True) for (_, sheet), some in itertools.groupby(own, key=lambda r: r[1:3]))
            content = write_xlsx(WorkbookInput(sheets))
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([content], pa.binary())], names=["path", "content"])

    ordered = cells.select(*_COLUMNS).repartition("path").sortWithinPartitions("path", "sheet_index", "sheet", "row", "col")
    return ordered.mapInArrow(run, "path string, content binary")


def _kind(t: T.DataType) -> str:
    """What the cells of a column are: boolean, number, date or, of any other type, string."""
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.NumericType):
        return "number"
    return "date" if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "string"


_SPARK = {"boolean": "boolean", "number": "double", "date": "timestamp_ntz", "string": "string"}


def _named(path: str, part: str) -> Column:
    """``path`` with the number of the part in place of ``{part}``."""
    return F.format_string(path.replace("%", "%%").replace("{part}", "%05d"), part) if "{part}" in path else F.lit(path)


def render_table(df: DataFrame, order: list[str], path: str, sheet: str = "Sheet1", rows: int = MAX_ROW - 1) -> DataFrame:
    """(path, content): a table as workbooks of at most ``rows`` rows below a header row, numbered through by ``order``.

    As ``render`` of ``cells_of_table``, but rows go to the writing tasks whole.
    """
    kinds = [_kind(f.dataType) for f in df.schema.fields]
    body = numbered(df, order, "__row").withColumn("__part", F.floor((F.col("__row") - 1) / rows).cast("int")).withColumn("__row", ((F.col("__row") - 1) % rows + 2).cast("int"))
    values = [F.col(f"`{f.name}`").cast(_SPARK[k]).alias(f"v{i}") for i, (f, k) in enumerate(zip(df.schema.fields, kinds, strict=True))]
    wide = body.select(_named(path, "__part").alias("path"), F.col("__row").alias("row"), *values)
    header = [Cell(1, i, "string", name) for i, name in enumerate(df.columns, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, own in itertools.groupby(_rows(batches), key=lambda r: r[0]):
            lines = ((r[1], [Cell(r[1], i, "empty" if v is None else k, v) for i, (k, v) in enumerate(zip(kinds, r[2:], strict=True), 1)]) for r in own)
            content = write_xlsx(WorkbookInput(iter([SheetInput(sheet, itertools.chain([(1, header)], lines), streamed=True)])))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], names=["path", "content"])

    return wide.repartition("path").sortWithinPartitions("path", "row").mapInArrow(run, "path string, content binary")


def cells_of_table(df: DataFrame, order: list[str], path: str, sheet: str = "Sheet1", rows: int = MAX_ROW - 1) -> DataFrame:
    """A table as cells with a header row, in workbooks of at most ``rows`` rows, numbered through by ``order``.

    Row numbers come from a range partitioning and the sizes of its partitions, not from one sorted task.
    """
    body = numbered(df, order, "__row").withColumn("__part", F.floor((F.col("__row") - 1) / rows).cast("int")).withColumn("__row", ((F.col("__row") - 1) % rows + 2).cast("int"))
    none = {"n": "double", "s": "string", "b": "boolean", "err": "string", "t": "timestamp_ntz"}
    entries = []
    for i, f in enumerate(df.schema.fields, 1):
        c, kind = F.col(f"`{f.name}`"), _kind(f.dataType)
        lane = {"boolean": "b", "number": "n", "date": "t", "string": "s"}[kind]
        lanes = [(c.cast(none[k]) if k == lane else F.lit(None).cast(none[k])).alias(k) for k in none]
        entries.append(F.struct(F.lit(i).alias("col"), F.when(c.isNull(), "empty").otherwise(kind).alias("type"), *lanes))
    header = [F.struct(F.lit(i).alias("col"), F.lit("string").alias("type"), *[(F.lit(n) if k == "s" else F.lit(None).cast(none[k])).alias(k) for k in none]) for i, n in enumerate(df.columns, 1)]
    flat = body.select("__part", F.col("__row").alias("row"), F.explode(F.array(*entries)).alias("c"))
    top = body.select("__part").distinct().select("__part", F.lit(1).alias("row"), F.explode(F.array(*header)).alias("c"))
    out = flat.unionByName(top)
    return out.select(_named(path, "__part").alias("path"), F.lit(sheet).alias("sheet"), F.lit(0).alias("sheet_index"), "row", "c.*", F.lit(None).cast("string").alias("formula"))


def _write_local(path: str, content: bytes) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(part, "wb") as f:
        f.write(content)
    os.replace(part, path)  # a task that runs again leaves one whole file


def _is_file(path: str) -> bool:
    return path.startswith("file:") or not re.match("[A-Za-z][A-Za-z0-9+.-]*:", path)


def save(rendered: DataFrame, spark: SparkSession) -> None:
    """Writes (path, content).  Each task writes its own files where paths are files; other stores go through Spark's file systems, a file at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            others = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if _is_file(path):
                    _write_local(url2pathname(urlsplit(path).path) if path.startswith("file:") else path, content)
                else:
                    others.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(others, pa.string())], names=["path"])

    if not rendered.select("path", "content").mapInArrow(run, "path string").agg(F.count("path")).first()[0]:
        return
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for r in rendered.where(F.col("path").rlike("^[A-Za-z][A-Za-z0-9+.-]*:") & ~F.col("path").startswith("file:")).toLocalIterator():
        target = jvm.org.apache.hadoop.fs.Path(r.path)
        stream = target.getFileSystem(conf).create(target, True)
        stream.write(bytearray(r.content))
        stream.close()
