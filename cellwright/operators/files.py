"""Queries that go through files and whole workbooks; each has the SQL of what must come out."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import FormulaError, WorkbookError
from ..functions.refs import canonical_range, column_letters, datetime_to_serial, format_cell, parse_cell, serial_to_datetime
from ..plans.scratch import new_path
from ..plans.syntax import parse
from ..sources.cells import delimited_table, files, formats, inferred, read_cells, read_images, read_metadata, to_table, with_colors
from ..sources.datasource import register
from ..sources.detect import open_workbook
from ..sources.model import Cell
from ..sources.samples import ods, package, xlsb, xlsx_of_xml
from ..sources.sink import cells_of_table, render, render_table, save
from ..sources.theme import SLOTS, resolve_color
from ..sources.writer import SheetInput, WorkbookInput, _by_row, from_workbook, write_xlsx
from ..sources.xlsx import open_xlsx
from .evaluate import evaluate_workbooks, user_function
from .uniform import uniform_columns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str) -> Callable[[Callable], Callable]:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@_query("SELECT c_custkey::DOUBLE AS c_custkey, c_name, c_nationkey::DOUBLE AS c_nationkey, c_acctbal::DOUBLE AS c_acctbal, c_mktsegment FROM customer")
def xlsx_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers to .xlsx files of 5000 rows, and back."""
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    names = df.columns
    cells = read_cells(render_table(df, ["c_custkey"], "part-{part}.xlsx", rows=5000))
    body = cells.where("row > 1").groupBy("path", "row").agg(*[F.first(F.when(F.col("col") == i, F.col("s" if n in ("c_name", "c_mktsegment") else "n")), ignorenulls=True).alias(n) for i, n in enumerate(names, 1)])
    return body.select(*names)


@_query("SELECT n_name AS a, n_regionkey::DOUBLE AS b FROM nation")
def sheet_to_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name", "n_regionkey", "n_nationkey").orderBy("n_nationkey")
    cells = read_cells(render(cells_of_table(df, ["n_nationkey"], "nation.xlsx")))
    return to_table(cells, header=True).select(F.col("n_name").alias("a"), F.col("n_regionkey").alias("b"))


@_query(
    """SELECT 'nation-' || c_nationkey AS path, 'B1' AS ref, floor(sum(c_acctbal::DOUBLE)) AS v FROM customer GROUP BY c_nationkey
    UNION ALL SELECT 'nation-' || c_nationkey, 'B2', count(*) FILTER (WHERE c_acctbal > 0)::DOUBLE FROM customer GROUP BY c_nationkey
    UNION ALL SELECT 'nation-' || c_nationkey, 'B3', floor(max(c_acctbal::DOUBLE)) + 1 FROM customer GROUP BY c_nationkey"""
)
def workbook_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook per nation: balances in column A, formulas over them, and one over another formula."""
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    values = df.select(F.concat(F.lit("nation-"), "c_nationkey").alias("path"), F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).alias("row"), F.lit(1).alias("col"), F.col("c_acctbal").cast("double").alias("n"), F.lit(None).cast("string").alias("formula"))
    formulas = [("=INT(SUM(A:A))", 1), ('=COUNTIF(A:A,">0")', 2), ("=B4+IF(B4=B4,1,1/0)", 3), ("=INT(MAX(A:A))", 4)]
    extra = values.select("path").distinct().select("path", F.explode(F.array(*[F.struct(F.lit(r).alias("row"), F.lit(2).alias("col"), F.lit(None).cast("double").alias("n"), F.lit(f).alias("formula")) for f, r in formulas])).alias("x")).select("path", "x.*")
    none = {"s": "string", "b": "boolean", "err": "string", "t": "timestamp_ntz"}
    cells = values.unionByName(extra).select("*", F.lit("Sheet1").alias("sheet"), F.lit(0).alias("sheet_index"), F.when(F.col("n").isNotNull(), "number").otherwise("empty").alias("type"), *[F.lit(None).cast(t).alias(k) for k, t in none.items()])
    out = evaluate_workbooks(cells)
    return out.where("row < 4").select("path", F.concat(F.lit("B"), "row").alias("ref"), F.col("n").alias("v"))


@_query(
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'number' WHEN 1 THEN 'string' WHEN 2 THEN 'boolean' WHEN 3 THEN 'string' ELSE 'string' END AS kind,
    CASE WHEN p_partkey % 5 = 0 THEN p_size * 1.5::DOUBLE END AS n FROM part"""
)
def csv_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of fields: numbers, text with leading zeros, booleans, words, integers that doubles can't hold."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("k", F.col("p_partkey") % 5)
    s = F.when(F.col("k") == 0, (F.col("p_size") * 1.5).cast("string")).when(F.col("k") == 1, F.concat(F.lit("00"), "p_size")).when(F.col("k") == 2, F.lit("tRuE")).when(F.col("k") == 3, F.col("p_name")).otherwise(F.lit("9007199254740993"))
    return p.select("p_partkey", inferred(s).alias("x")).select("p_partkey", F.col("x.type").alias("kind"), F.col("x.n").alias("n"))


# --- files of every format, made in the query and read back ------------------------------------------------


def _typed(df: DataFrame) -> DataFrame:
    """Customers as four cells of different types, by nation."""
    return df.select("c_nationkey", F.col("c_custkey").alias("n"), F.col("c_name").alias("s"), (F.col("c_acctbal") > 0).alias("b"))


def _made(df: DataFrame, make: Callable[[list], bytes], extension: str) -> DataFrame:
    """(path, content): a file for each nation with a row for each customer, from row 2 on."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        cells = []
        for i, (n, s, b) in enumerate(zip(pdf["n"], pdf["s"], pdf["b"], strict=True), 2):
            day = dt.datetime(2020, 1, 1) + dt.timedelta(days=int(n) % 1000, hours=12)
            cells += [Cell(i, 1, "number", float(n) / 4), Cell(i, 2, "string", s), Cell(i, 4, "boolean", bool(b)), Cell(i, 5, "date", day)]
        return pd.DataFrame({"path": [f"nation-{pdf['c_nationkey'].iloc[0]}.{extension}"], "content": [make([("Skipped", []), ("Data", cells)])]})

    return _typed(df).groupBy("c_nationkey").applyInPandas(run, "path string, content binary")


def _back(cells: DataFrame) -> DataFrame:
    lane = {1: "n", 2: "s", 4: "b", 5: "t"}
    rows = cells.where("sheet = 'Data'").groupBy("path", "row").agg(*[F.first(F.when(F.col("col") == i, F.col(v)), ignorenulls=True).alias(v) for i, v in lane.items()], F.count(F.lit(1)).alias("cells"))
    return rows.select("path", "n", "s", "b", F.date_format("t", "yyyy-MM-dd HH:mm").alias("t"), "cells")


def _expected(extension: str) -> str:
    return f"""SELECT 'nation-' || c_nationkey || '.{extension}' AS path, c_custkey / 4.0::DOUBLE AS n, c_name AS s, c_acctbal > 0 AS b,
    strftime(DATE '2020-01-01' + CAST(c_custkey % 1000 AS INT), '%Y-%m-%d') || ' 12:00' AS t, 4 AS cells FROM customer"""


@_query(_expected("ods"))
def ods_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An .ods file for each nation, read by the format's own reader: numbers, texts, booleans, dates and gaps."""
    return _back(read_cells(_made(spark.read.parquet(f"{sf_dir}/customer.parquet"), ods, "ods"), "Data"))


@_query(_expected("xlsb"))
def xlsb_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in .xlsb: shared strings, small whole numbers, doubles, booleans, dates by style."""
    return _back(read_cells(_made(spark.read.parquet(f"{sf_dir}/customer.parquet"), xlsb, "xlsb"), "Data"))


def _xlsx(sheets: list) -> bytes:
    return write_xlsx(WorkbookInput([SheetInput(name, _by_row(cells)) for name, cells in sheets]))


@_query(_expected("xlsx"))
def xlsx_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in .xlsx, written by tasks to the shared folder and read from there."""
    folder = new_path(spark, "xlsx-files")
    made = _made(spark.read.parquet(f"{sf_dir}/customer.parquet"), _xlsx, "xlsx")
    save(made.withColumn("path", F.concat(F.lit(f"{folder}/"), "path")), spark)
    return _back(read_cells(files(spark, folder), "Data").withColumn("path", F.regexp_extract("path", "[^/]+$", 0)))


@_query(_expected("xlsx"))
def workbook_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the data source, with a task for each sheet and the sheet's name pushed down."""
    register(spark)
    folder = new_path(spark, "workbook-source")
    save(_made(spark.read.parquet(f"{sf_dir}/customer.parquet"), _xlsx, "xlsx").withColumn("path", F.concat(F.lit(f"{folder}/"), "path")), spark)
    return _back(spark.read.format("workbook").load(folder).where("sheet = 'Data'").withColumn("path", F.regexp_extract("path", "[^/]+$", 0)))


@_query(
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || ', "big"' WHEN 1 THEN p_name || chr(10) || 'x' ELSE '00' || p_size END AS note, p_size::DOUBLE AS size, p_size % 2 = 0 AS even FROM part"""
)
def csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimited files with quotes, delimiters and line breaks in fields, and texts that look like numbers."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    note = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(', "big"'))).when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit("\nx"))).otherwise(F.concat(F.lit("00"), "p_size"))
    quoted = F.concat(F.lit('"'), F.replace(note, F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", "p_partkey", quoted, "p_size", F.when(F.col("p_size") % 2 == 0, "TRUE").otherwise("false"))
    made = p.select((F.col("p_partkey") % 7).alias("part"), "p_partkey", line.alias("line")).groupBy("part").agg(F.array_join(F.array_sort(F.collect_list("line")), "\r\n").alias("text"))
    cells = read_cells(made.select(F.concat(F.lit("part-"), "part", F.lit(".csv")).alias("path"), F.col("text").cast("binary").alias("content")))
    lane = {1: ("n", "p_partkey"), 2: ("s", "note"), 3: ("n", "size"), 4: ("b", "even")}
    rows = cells.groupBy("path", "row").agg(*[F.first(F.when(F.col("col") == i, F.col(v)), ignorenulls=True).alias(name) for i, (v, name) in lane.items()])
    return rows.select(F.col("p_partkey").cast("long").alias("p_partkey"), "note", "size", "even")


@_query(
    "SELECT p_partkey::DOUBLE AS k, p_name || ' line' AS a, 'line, ' || p_size AS b, false AS broken FROM part UNION ALL SELECT p_partkey::DOUBLE, p_name || chr(10) || ' line', 'line, ' || p_size, true FROM part"
)
def csv_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of delimited text by the splitting reader, and with line breaks in fields."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    out = None
    for broken in (False, True):
        folder = new_path(spark, "csv-table")
        p.select(F.concat(F.col("p_partkey"), F.lit(',"'), F.col("p_name"), F.lit("\n line" if broken else " line"), F.lit('","line, '), F.col("p_size"), F.lit('"')).alias("value")).write.text(folder)
        t = delimited_table(spark, folder, line_breaks=broken)
        rows = t.select(F.col("A.n").alias("k"), F.col("B.s").alias("a"), F.col("C.s").alias("b"), F.lit(broken).alias("broken"))
        out = rows if out is None else out.unionByName(rows)
    return out


@_query("SELECT * FROM (VALUES ('One', 'B2', '89504e47')) v(sheet, ref, content)")
def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of a workbook as binary columns."""
    return read_images(_one(spark, _full_book())).select("sheet", "ref", F.lower(F.hex("content")).alias("content"))


@_query("SELECT * FROM (VALUES ('a', 'xlsx'), ('b', 'ods'), ('c', 'xlsb'), ('d', 'csv'), ('e', NULL), ('f', NULL), ('g', 'csv'), ('h', 'ods')) v(path, format)")
def detect_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats are told by content, whatever a file is named."""
    some = [("S", [Cell(1, 1, "number", 1.0)])]
    no_mime = package({"content.xml": '<office:document-content xmlns:office="o"><office:body><office:spreadsheet/></office:body></office:document-content>'})
    found = [("a", _xlsx(some)), ("b", ods(some)), ("c", xlsb(some)), ("d", b"x,y\n1,2"), ("e", b"\0\1\2"), ("f", package({"word/document.xml": "<x/>", "[Content_Types].xml": "<Types/>"})), ("g", b"PK, but text"), ("h", no_mime)]
    return formats(spark.createDataFrame([(p, bytearray(b)) for p, b in found], "path string, content binary"))


def _full_book() -> bytes:
    cells = [Cell(1, 1, "string", "k"), Cell(1, 2, "string", "v"), Cell(2, 1, "string", "x"), Cell(2, 2, "number", 2.5, None, 0), Cell(3, 2, "number", 5.0, "SUM(B2:B2)*2", 1), Cell(5, 1, "date", dt.datetime(2024, 2, 29, 6), None, 2)]
    one = SheetInput(
        "One", _by_row(cells), merges=["A7:B8"], hyperlinks=[{"ref": "A1", "target": "http://x/?a=1&b=2"}, {"ref": "B1", "location": "Two!A1"}], comments=[{"ref": "A2", "text": "note", "author": "me"}],
        columns=[{"min": 1, "max": 2, "width": 20.5}], row_properties={3: {"height": 30.0}, 9: {"hidden": True}}, freeze={"rows": 1, "columns": 0}, tables=[{"name": "Tab", "ref": "A1:B3"}],
        validations=[{"type": "list", "sqref": "C1:C9", "formula1": '"a,b"'}], conditional=[{"ref": "A1:A9", "type": "cellIs", "formulas": ["5"], "attributes": {"operator": "greaterThan"}, "style": {"fill": "FFFF0000"}}],
        autofilter="A1:B3", protection={"objects": True}, margins={"left": 0.5, "right": 0.5, "top": 1, "bottom": 1, "header": 0.3, "footer": 0.3}, page_setup={"scale": 90}, images=[{"bytes": b"\x89PNG", "extension": "png", "from": (1, 1)}],
    )
    styles = [{"format": "0.00", "bold": True, "color": {"theme": 4, "tint": -0.25}}, {"format": "#,##0", "fill": "FF00FF00", "border": {"left": {"style": "thin"}}}, {"format": "yyyy-mm-dd"}]
    scheme = "".join(f'<a:{k}><a:srgbClr val="{v}"/></a:{k}>' for k, v in zip(SLOTS, ("FFFFFF", "000000", "EEECE1", "1F497D", "4F81BD", "C0504D", "9BBB59", "8064A2", "4BACC6", "F79646", "0000FF", "800080"), strict=True))
    theme = f'<a:theme xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:themeElements><a:clrScheme name="x">{scheme}</a:clrScheme></a:themeElements></a:theme>'
    names = [{"name": "Rate", "refers_to": "0.5"}, {"name": "Here", "refers_to": "One!$A$1", "sheet_index": 0, "hidden": True}]
    return write_xlsx(WorkbookInput([one, SheetInput("Two", [], "hidden"), SheetInput("Three", [], "veryHidden")], names, styles, {"lockStructure": True}, theme=theme))


def _one(spark: SparkSession, content: bytes, path: str = "x") -> DataFrame:
    return spark.createDataFrame([(path, bytearray(content))], "path string, content binary")


@_query(
    """SELECT * FROM (VALUES ('One', 'autofilter', 'A1:B3'), ('One', 'column', 'A:B'), ('One', 'comment', 'A2'), ('One', 'conditional', 'A1:A9'), ('One', 'dimension', 'A1:B5'), ('One', 'freeze', 'A2'),
    ('One', 'hyperlink', 'A1'), ('One', 'hyperlink', 'B1'), ('One', 'image', 'B2'), ('One', 'margins', NULL), ('One', 'merge', 'A7:B8'), ('One', 'page_setup', NULL), ('One', 'protection', NULL), ('One', 'row', '3'),
    ('One', 'row', '9'), ('One', 'sheet', NULL), ('One', 'table', 'A1:B3'), ('One', 'validation', 'C1:C9'), ('Two', 'dimension', 'A1'), ('Two', 'sheet', NULL), ('Three', 'dimension', 'A1'), ('Three', 'sheet', NULL), (NULL, 'name', 'Here'), (NULL, 'name', 'Rate'),
    (NULL, 'name', '_xlnm._FilterDatabase'), (NULL, 'protection', NULL)) v(sheet, kind, ref)"""
)
def workbook_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that a workbook has beside cells, after two rounds through reader and writer."""
    again = write_xlsx(from_workbook(open_workbook(_full_book())))
    return read_metadata(_one(spark, again)).where("kind NOT IN ('styles', 'dxfs', 'date1904', 'theme')").select("sheet", "kind", "ref")


@_query(
    """SELECT * FROM (VALUES ('A1', 'string', 'General', NULL, NULL), ('A2', 'string', 'General', NULL, NULL), ('A5', 'date', 'yyyy-mm-dd', NULL, NULL), ('B1', 'string', 'General', NULL, NULL),
    ('B2', 'number', '0.00', 'FF376193', NULL), ('B3', 'number', '#,##0', NULL, 'FF00FF00')) v(ref, type, format, color, fill)"""
)
def cell_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number formats and dates of cells, and their colours by the workbook's theme."""
    found = _one(spark, _full_book())
    meta = read_metadata(found)
    return with_colors(read_cells(found, "One"), meta).select("ref", "type", "format", F.col("font_color").alias("color"), F.col("fill_color").alias("fill"))


@_query(
    """SELECT i0::DOUBLE AS tint, c AS color FROM (VALUES (0.7999, 'FFDCE6F1'), (0.5999, 'FFB8CCE4'), (0.3999, 'FF96B4D8'), (0.0, 'FF4F81BD'), (-0.25, 'FF376193'), (-0.5, 'FF244062'), (-1.0, 'FF000000'), (1.0, 'FFFFFFFF'), (7.0, 'FFFFFFFF')) v(i0, c)"""
)
def theme_tints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shades of a theme colour."""
    shade = F.udf(lambda t: resolve_color({"theme": 4, "tint": t}, ["FFFFFF", "000000", "EEECE1", "1F497D", "4F81BD"]), "string")
    tints = spark.createDataFrame([(t,) for t in (0.7999, 0.5999, 0.3999, 0.0, -0.25, -0.5, -1.0, 1.0, 7.0)], "tint double")
    return tints.select("tint", shade("tint").alias("color"))


@_query("SELECT CAST(i AS INT) AS row, 'A' || i || '*$B$1+Sheet2!C' || (i + 1) || '+SUM(A$1:A' || i || ')' AS formula, i * 2.0::DOUBLE AS v FROM range(1, 501) t(i)")
def shared_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A master formula and the cells that share it, each with the text it would have on its own."""
    rows = "".join(f'<row r="{i}"><c r="D{i}"><f t="shared" si="0"{" ref=" + chr(34) + "D1:D500" + chr(34) if i == 1 else ""}>{"A1*$B$1+Sheet2!C2+SUM(A$1:A1)" if i == 1 else ""}</f><v>{i * 2}</v></c></row>' for i in range(1, 501))
    cells = read_cells(_one(spark, xlsx_of_xml(f"<worksheet><sheetData>{rows}</sheetData></worksheet>")))
    return cells.select("row", "formula", F.col("n").alias("v"))


@_query(
    """SELECT * FROM (VALUES ('A1', 'string', 'one & two', NULL), ('B1', 'string', 'rich text', NULL), ('A2', 'string', 'in < line & more', NULL), ('B2', 'number', NULL, 7.0), ('A3', 'string', 'after the error', NULL), ('B3', 'empty', NULL, NULL)) v(ref, type, s, n)"""
)
def malformed_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared and rich strings, and a part that goes on after what isn't XML."""
    strings = "<sst><si><t>one &amp; two</t></si><si><r><t>rich</t></r><r><t xml:space='preserve'> text</t></r><rPh><t>no</t></rPh></si></sst>"
    body = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="str"><v>in < line & more</v></c><c r=B2><v>7</v></c></row><row r="3"><c r="A3" t="str"><v>after the error</v></c><c r="B3" t="s"><v>99</v></c></row>'
    cells = read_cells(_one(spark, xlsx_of_xml(f"<worksheet><sheetData>{body}</sheetData></worksheet>", strings)))
    return cells.select("ref", "type", "s", "n")


@_query(
    """SELECT * FROM (VALUES ('C1', 60.0, NULL, NULL), ('C2', NULL, NULL, '#REF!'), ('C3', 5.0, NULL, NULL), ('C4', 1.0, NULL, NULL), ('C5', 5.0, NULL, NULL), ('C6', NULL, NULL, '#NAME?'), ('C7', 24.0, NULL, NULL), ('C8', 1.5, NULL, NULL),
    ('C9', 20.0, NULL, NULL), ('C10', 30.0, NULL, NULL), ('C11', 6.0, NULL, NULL), ('C12', NULL, 'b', NULL), ('C13', 2.0, NULL, NULL), ('C14', NULL, NULL, '#DIV/0!'), ('C15', 84.0, NULL, NULL), ('C16', 7.0, NULL, NULL), ('C17', NULL, NULL, '#REF!')) v(ref, n, s, err)"""
)
def reference_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One formula each: ranges, names, @ and user functions; spans of sheets are #REF!, unions have no value, and of an array constant the first element counts."""
    formulas = [
        "SUM(A1:A3)", "SUM(One:Two!A1:A3)", "COUNT((A1:A3,A1:B4))+COLUMNS(A1:E1)", "SUM({1,2;4,6})", "Rate*10", "Nothing+1", "TWICE(12)", "IFMISSING(Rate+1,1/0)",
        "@A2", "INDEX(A1:B4,3,1)", "Two!A1+Two!A2+Two!A3", 'HLOOKUP("k",Two!D1:E2,2,FALSE)', "MATCH(25,A1:A3,1)", "SUM(A1:A3,1/0)", "SUM(A:A)+SUM(Total)-36", "WEEKDAY(45353)", "A1+#REF!",
    ]
    rows = [("x", "One", 0, i + 1, 1, "number", 10.0 * (i + 1), None, None) for i in range(3)]
    rows += [("x", "Two", 1, i + 1, 1, "number", 1.0 * (i + 1), None, None) for i in range(3)]
    rows += [("x", "Two", 1, 1, 4, "string", None, "j", None), ("x", "Two", 1, 1, 5, "string", None, "k", None), ("x", "Two", 1, 2, 4, "string", None, "a", None), ("x", "Two", 1, 2, 5, "string", None, "b", None)]
    rows += [("x", "One", 0, i + 1, 3, "empty", None, None, "=" + f) for i, f in enumerate(formulas)]
    cells = spark.createDataFrame(rows, "path string, sheet string, sheet_index int, row int, col int, type string, n double, s string, formula string")
    cells = cells.select("*", F.lit(None).cast("boolean").alias("b"), F.lit(None).cast("string").alias("err"), F.lit(None).cast("timestamp_ntz").alias("t"))
    names = spark.createDataFrame([("x", "Rate", "0.5", None), ("x", "Total", "One!$A$1:$A$3", None)], "path string, name string, refers_to string, sheet_index int")
    functions = {"TWICE": user_function(lambda x: 2 * x, 1, 1), "IFMISSING": user_function(lambda a, b: a(), 2, 2, lazy=True)}
    out = evaluate_workbooks(cells, names, functions).where("col = 3")
    return out.select(F.concat(F.lit("C"), "row").alias("ref"), "n", "s", "err")


@_query("SELECT 'nation-' || c_nationkey || '.xlsb' AS path, count(*) * 4 AS n, sum(c_custkey) / 4.0::DOUBLE AS total FROM customer GROUP BY c_nationkey")
def streaming_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbooks that arrive in a folder, as a stream of cells, aggregated."""
    from ..streaming import stream_cells

    folder, checkpoint, out = (new_path(spark, f"stream-{x}") for x in ("in", "state", "out"))
    save(_made(spark.read.parquet(f"{sf_dir}/customer.parquet"), xlsb, "xlsb").withColumn("path", F.concat(F.lit(f"{folder}/"), "path")), spark)
    cells = stream_cells(spark, folder, files_per_batch=7)
    cells.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out).groupBy(F.regexp_extract("path", "[^/]+$", 0).alias("path"))
    return got.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("col") == 1, F.col("n"))).alias("total"))


@_query("SELECT count(*) AS n, sum(c_custkey)::DOUBLE AS keys, count(DISTINCT c_custkey) AS kinds FROM customer")
def streaming_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of rows written as workbooks, batch by batch, and all of them read again."""
    from ..streaming import write_workbooks

    rows, folder, checkpoint = (new_path(spark, f"sink-{x}") for x in ("rows", "out", "state"))
    spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name").repartition(3).write.parquet(rows)
    stream = spark.readStream.schema("c_custkey long, c_name string").option("maxFilesPerTrigger", 1).parquet(rows)
    write_workbooks(stream, ["c_custkey"], folder, checkpoint).awaitTermination()
    cells = read_cells(files(spark, f"{folder}/*.xlsx")).where("row > 1 AND col = 1")
    return cells.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("keys"), F.count_distinct("n").alias("kinds"))


def _code(run: Callable[[], object]) -> str:
    try:
        run()
    except (FormulaError, WorkbookError) as e:
        return e.code
    return "fine"


@_query(
    """SELECT * FROM (VALUES ('=(', 'parse-error'), ('=1+', 'parse-error'), ('="a', 'parse-error'), ('=A1 B1', 'parse-error'), ('=A1:', 'parse-error'), ('deep', 'depth-exceeded'), ('calls', 'depth-exceeded'), ('wide', 'too-many-args'),
    ('=Table1[x]', 'fine'), ('=[1]Sheet!A1', 'fine'), ('=''a b''!A1#', 'fine'), ('=50%%', 'fine'), ('={1,2;3,4}', 'fine')) v(formula, code)"""
)
def formula_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the grammar takes, and the codes of what it doesn't."""
    long = {"deep": "=" + "(" * 300 + "1" + ")" * 300, "calls": "=" + "ABS(" * 70 + "1" + ")" * 70, "wide": f"=SUM({','.join(['1'] * 256)})"}
    given = ["=(", "=1+", '="a', "=A1 B1", "=A1:", "deep", "calls", "wide", "=Table1[x]", "=[1]Sheet!A1", "='a b'!A1#", "=50%%", "={1,2;3,4}"]
    return spark.createDataFrame([(f, _code(lambda f=f: parse(long.get(f, f)))) for f in given], "formula string, code string")


@_query(
    """SELECT * FROM (VALUES ('empty', 'not-a-zip'), ('junk', 'not-a-zip'), ('word', 'not-xlsx'), ('no main', 'missing-part'), ('bomb', 'part-too-large'), ('entities', 'unsupported'), ('no sheet', 'no-such-sheet'), ('good', 'fine')) v(package, code)"""
)
def package_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages that aren't workbooks, or would be too large when inflated."""
    good = xlsx_of_xml("<worksheet><sheetData/></worksheet>")
    given = {
        "empty": b"", "junk": b"PK junk", "word": package({"word/document.xml": "<x/>"}), "no main": package({"[Content_Types].xml": "<Types/>"}), "bomb": xlsx_of_xml("<worksheet>" + " " * 30_000_000),
        "entities": xlsx_of_xml('<!DOCTYPE x [<!ENTITY a "b">]><worksheet><sheetData/></worksheet>'), "no sheet": good, "good": good,
    }
    return spark.createDataFrame([(k, _code(lambda k=k, v=v: open_xlsx(v, "Nope" if k == "no sheet" else None))) for k, v in given.items()], "package string, code string")


@_query(
    """SELECT what, 'invalid-input' AS code FROM (VALUES ('no sheets'), ('name'), ('long name'), ('hidden'), ('merges'), ('widths'), ('heights'), ('tables'), ('validation'), ('picture'), ('number'), ('rows'), ('text'), ('margins'), ('color'), ('border'), ('formula')) v(what)"""
)
def writer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input that the writer doesn't take."""
    sheet = lambda **x: WorkbookInput([SheetInput(**({"name": "S"} | x))])
    one = lambda *c: [(1, [Cell(1, 1, *c)])]
    given = {
        "no sheets": WorkbookInput([]), "name": sheet(name="a/b"), "long name": sheet(name="x" * 32), "hidden": sheet(state="hidden"), "merges": sheet(merges=["A1:B2", "B2:C3"]), "widths": sheet(columns=[{"min": 1, "max": 1, "width": 300}]),
        "heights": sheet(row_properties={1: {"height": 500}}), "tables": sheet(tables=[{"name": "A1", "ref": "A1:A2", "columns": ["x"]}]), "validation": sheet(validations=[{"type": "odd", "sqref": "A1"}]),
        "picture": sheet(images=[{"bytes": b"", "extension": "svg", "from": (0, 0)}]), "number": sheet(rows=one("number", float("nan"))), "rows": sheet(rows=[(2, []), (1, [])]), "text": sheet(rows=one("string", "x" * 32768)),
        "margins": sheet(margins={"left": 99}), "color": WorkbookInput([SheetInput("S")], styles=[{"color": "red"}]), "border": WorkbookInput([SheetInput("S")], styles=[{"border": "wavy"}]), "formula": sheet(rows=one("empty", None, "x" * 9000)),
    }
    return spark.createDataFrame([(k, _code(lambda v=v: write_xlsx(v))) for k, v in given.items()], "what string, code string")


@_query(
    """SELECT i AS col, CASE WHEN i <= 26 THEN chr(CAST(64 + i AS INT)) WHEN i <= 702 THEN chr(CAST(64 + (i - 1) // 26 AS INT)) || chr(CAST(65 + (i - 1) % 26 AS INT))
    ELSE chr(CAST(64 + (i - 703) // 676 + 1 AS INT)) || chr(CAST(65 + ((i - 703) // 26) % 26 AS INT)) || chr(CAST(65 + (i - 703) % 26 AS INT)) END AS letters, i AS again, true AS canonical FROM range(1, 16385) t(i)"""
)
def a1_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns to letters and back, over the whole grid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = b.column(0).to_pylist()
            letters = [column_letters(c) for c in cols]
            again = [parse_cell(f"${x}$7")[0] if parse_cell(format_cell(c, 7)) == (c, 7) else None for c, x in zip(cols, letters, strict=True)]
            canonical = [canonical_range(f"{x}1:{x}9") is not None and canonical_range(f"{x.lower()}1") is None for x in letters]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(letters), pa.array(again, pa.int64()), pa.array(canonical)], names=["col", "letters", "again", "canonical"])

    return spark.range(1, 16385).withColumnRenamed("id", "col").mapInArrow(run, "col long, letters string, again long, canonical boolean")


@_query(
    """SELECT o_orderkey, date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE))::DOUBLE AS serial, date_diff('day', DATE '1904-01-01', CAST(o_orderdate AS DATE))::DOUBLE AS serial1904, strftime(o_orderdate, '%Y-%m-%d') AS back FROM orders"""
)
def date_serials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates to serials of both epochs, and back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            when = [dt.datetime(t.year, t.month, t.day) for t in b.column(1).to_pylist()]
            serials = [[datetime_to_serial(t, e) for t in when] for e in (False, True)]
            back = [x.strftime("%Y-%m-%d") if x == serial_to_datetime(n, True) else None for x, n in zip((serial_to_datetime(m) for m in serials[0]), serials[1], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(serials[0]), pa.array(serials[1]), pa.array(back)], names=["o_orderkey", "serial", "serial1904", "back"])

    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate").mapInArrow(run, "o_orderkey long, serial double, serial1904 double, back string")


@_query(
    "SELECT CAST(c_nationkey AS VARCHAR) AS path, 3 AS first_row, CAST(count(*) + 2 AS INT) AS last_row, 'A3*2' AS formula FROM customer GROUP BY c_nationkey HAVING count(*) > 1"
)
def uniform_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled-down formulas of each workbook, told by their relative form."""
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    cells = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").cast("string").alias("path"), F.lit("S").alias("sheet"), (F.row_number().over(w) + 2).cast("int").alias("row"), F.lit(2).alias("col"))
    cells = cells.withColumn("formula", F.concat(F.lit("A"), "row", F.lit("*2")))
    return uniform_columns(cells).select("path", "first_row", "last_row", "formula")
