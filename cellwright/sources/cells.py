"""Workbooks and delimited files as DataFrames.

Files come through Spark's binary reader, so any store that Spark reads will do; each task parses whole files.
Large delimited text goes through Spark's own splitting reader and is typed by expressions (``delimited_table``).
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import WorkbookError
from ..functions.refs import format_cell
from .detect import detect, open_workbook
from .model import Cell
from .theme import resolve_color

CELLS = "path string, sheet string, sheet_index int, row int, col int, ref string, type string, n double, s string, b boolean, err string, t timestamp_ntz, formula string, style int, format string"
META = "path string, sheet string, sheet_index int, kind string, ref string, data string"
_ARROW = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.bool_(), pa.string(), pa.timestamp("us"), pa.string(), pa.int32(), pa.string()]
_LANE = {"number": 0, "string": 1, "boolean": 2, "error": 3, "date": 4}
_BATCH = 20_000


def files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def formats(files_: DataFrame) -> DataFrame:
    """(path, format) by content; null where unknown."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([detect(x) for x in b.column(1).to_pylist()], pa.string())], names=["path", "format"])

    return files_.select("path", "content").mapInArrow(run, "path string, format string")


def _lanes(c: Cell) -> list:
    out = [None] * 5
    if c.type in _LANE:
        out[_LANE[c.type]] = c.value
    return out


def cell_batches(path: str, content: bytes, sheet: str | None) -> Iterator[pa.RecordBatch]:
    """The cells of a workbook, or of one of its sheets, at most ``_BATCH`` at a time; sheets keep their places."""
    names = [f.split(" ")[0] for f in CELLS.split(", ")]
    book = open_workbook(content, sheet, metadata=False)
    for i, s in enumerate(book.sheets):
        for some in itertools.batched(s.cells, _BATCH):
            rows = []
            for c in some:
                code = book.formats[c.style] if c.style is not None and c.style < len(book.formats) else None
                rows.append((path, s.name, i, c.row, c.col, format_cell(c.col, c.row), c.type, *_lanes(c), c.formula, c.style, code))
            yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], names=names)


def read_cells(files_: DataFrame, sheet: str | None = None, strict: bool = True) -> DataFrame:
    """The cells of workbooks (path, content), at most ``_BATCH`` at a time.

    ``sheet`` picks one by name; files that can't be read fail, or are left out if not ``strict`` (from where they can't be read).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    yield from cell_batches(path, content, sheet)
                except WorkbookError:
                    if strict:
                        raise

    return files_.select("path", "content").mapInArrow(run, CELLS)


def _plain(x: object) -> object:
    return {"size": len(x)} if isinstance(x, bytes) else x


def read_images(files_: DataFrame) -> DataFrame:
    """path, sheet, ref (the anchor's first cell), name and content of each picture, a file's pictures one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for s in open_workbook(content).sheets:
                    for ref, data in s.meta.get("image", []):
                        row = [pa.array([x]) for x in (path, s.name, ref, data["name"])]
                        yield pa.RecordBatch.from_arrays([*row, pa.array([data["bytes"]], pa.binary())], names=["path", "sheet", "ref", "name", "content"])

    return files_.select("path", "content").mapInArrow(run, "path string, sheet string, ref string, name string, content binary")


def read_metadata(files_: DataFrame) -> DataFrame:
    """Everything but cells: a row per sheet, name, merge, link, comment, table, column, validation, image (``read_images`` has the bytes) and so on; ``data`` is JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                book = open_workbook(content)
                rows += [(path, None, n["sheet_index"], "name", n["name"], json.dumps(n)) for n in book.names]
                rows += [(path, None, None, k, None, json.dumps(x)) for k, xs in book.meta.items() for x in xs]
                for i, s in enumerate(book.sheets):
                    rows.append((path, s.name, i, "sheet", None, json.dumps({"state": s.state, "visible": s.state == "visible", "part": s.part})))
                    for kind, notes in s.meta.items():
                        rows += [(path, s.name, i, kind, ref, json.dumps(data, default=_plain, sort_keys=True)) for ref, data in notes]
            if rows:
                kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "sheet", "sheet_index", "kind", "ref", "data"])

    return files_.select("path", "content").mapInArrow(run, META)


def with_colors(cells: DataFrame, metadata: DataFrame) -> DataFrame:
    """``cells`` with font_color and fill_color as ARGB, by the styles and theme of their workbook; null where none is given or known."""
    style = "array<struct<style:int,font_color:string,fill_color:string>>"

    def run(styles: str | None, theme: str | None) -> list[tuple]:
        colors = (json.loads(theme) if theme else {}).get("colors")
        out = []
        for i, s in enumerate(json.loads(styles or "[]")):
            fill = s.get("fill")
            out.append((i, resolve_color(s.get("color"), colors), resolve_color(fill.get("fore") if isinstance(fill, dict) and "pattern" in fill else fill, colors)))
        return out

    # a row per workbook
    of = lambda kind: F.when(F.col("kind") == kind, F.col("data"))
    own = metadata.where("kind IN ('styles', 'theme')").groupBy("path")
    own = own.agg(F.to_json(F.collect_list(of("styles"))).alias("styles"), F.first(of("theme"), ignorenulls=True).alias("theme"))
    listed = F.udf(lambda styles, theme: run("[" + ",".join(json.loads(styles)) + "]", theme), style)
    table = own.select("path", F.explode(listed("styles", "theme")).alias("x")).select("path", "x.*")
    return cells.join(table, ["path", "style"], "left")


def names_of(metadata: DataFrame) -> DataFrame:
    """Defined names as the evaluator takes them."""
    d = F.from_json("data", "name string, refers_to string, sheet_index int")
    return metadata.where("kind = 'name'").select("path", d["name"].alias("name"), d["refers_to"].alias("refers_to"), d["sheet_index"].alias("sheet_index"))


def to_table(cells: DataFrame, header: bool = True, columns: list[str] | None = None) -> DataFrame:
    """One sheet's cells as a wide table with a column for each cell column.

    Names come from row 1, or are letters.  Columns are typed by what they hold: all numbers DOUBLE, all booleans BOOLEAN,
    all dates TIMESTAMP_NTZ, else STRING.
    """
    kinds = cells.where(F.col("row") > int(header)).groupBy("col").agg(F.collect_set(F.when(F.col("type") != "empty", F.col("type"))).alias("kinds"))
    titles = cells.where("row = 1").select("col", F.coalesce("s", F.col("n").cast("string"), F.col("b").cast("string")).alias("title")) if header else None
    found = (kinds.join(titles, "col", "full") if header else kinds.withColumn("title", F.lit(None).cast("string"))).orderBy("col").collect()
    aggregates = []
    for i, r in enumerate(found):
        name = columns[i] if columns else r.title or format_cell(r.col, 1)[:-1]
        lane = {("number",): "n", ("boolean",): "b", ("date",): "t"}.get(tuple(r.kinds or ()))
        v = F.col(lane) if lane else F.coalesce("s", F.col("n").cast("string"), F.col("b").cast("string"), F.col("t").cast("string"), "err")
        aggregates.append(F.first(F.when(F.col("col") == r.col, v), ignorenulls=True).alias(name))
    body = cells.where(F.col("row") > int(header))
    return body.groupBy("row").agg(*aggregates) if aggregates else body.select("row").distinct()


_NUMBER = r"^[+-]?((0|[1-9][0-9]*)(\.[0-9]+)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def inferred(s: Column) -> Column:
    """Type and lanes of a text field: empty, boolean, number or string; integers beyond 2^53 - 1 stay strings."""
    x = F.when(s.rlike(_NUMBER), s.try_cast("double"))
    digits = s.rlike(r"^[+-]?[0-9]+$")
    big = digits & (F.coalesce(F.abs(s.try_cast("decimal(38,0)")), F.lit("1" + "0" * 37).cast("decimal(38,0)")) > F.lit(2**53 - 1))
    number = x.isNotNull() & (F.abs(x) < float("inf")) & ~F.coalesce(big, F.lit(False))
    boolean = F.lower(s).isin("true", "false")
    kind = F.when(s.isNull() | (s == ""), "empty").when(boolean, "boolean").when(number, "number").otherwise("string")
    return F.struct(kind.alias("type"), F.when(kind == "number", x).alias("n"), F.when(kind == "string", s).alias("s"), F.when(kind == "boolean", F.lower(s) == "true").alias("b"))


def delimited_table(spark: SparkSession, path: str, delimiter: str = ",", line_breaks: bool = False) -> DataFrame:
    """Delimited text of any size: each field with its own type, by Spark's splitting reader.

    ``line_breaks``: fields may have some; then a file isn't split, but streamed by one task.
    """
    raw = spark.read.option("multiLine", line_breaks).option("sep", delimiter).option("quote", '"').option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path, header=False, inferSchema=False)
    return raw.select(*[inferred(F.col(c)).alias(format_cell(i, 1)[:-1]) for i, c in enumerate(raw.columns, 1)])
