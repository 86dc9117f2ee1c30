import datetime as dt
import io
import random
import struct
import zipfile

import pytest

from cellwright.errors import WorkbookError
from cellwright.sources.cells import delimited_table, files, formats, names_of, read_cells, read_metadata, to_table
from cellwright.sources.delimited import fields, infer, open_delimited, sniff
from cellwright.sources.detect import detect, open_workbook
from cellwright.sources.model import Cell, is_date_format
from cellwright.sources.ods import open_ods
from cellwright.sources.package import Package, escape_text, unescape_text
from cellwright.sources.sink import cells_of_table, render, save
from cellwright.sources.writer import SheetInput, WorkbookInput, from_workbook, write_xlsx
from cellwright.sources.xlsb import open_xlsb, rk
from cellwright.sources.xlsx import open_xlsx, stream_rows

NINE = [(1, 1, "string", "Name"), (1, 2, "string", "é"), (2, 1, "number", 1.5), (2, 2, "number", -2.0), (3, 1, "boolean", True), (3, 2, "boolean", False), (4, 1, "date", dt.datetime(2024, 2, 29)), (4, 2, "string", "a b"), (5, 1, "error", "#N/A")]


def rows_of(cells):
    out = {}
    for c in cells:
        out.setdefault(c.row, []).append(c)
    return sorted(out.items())


def nine_xlsx():
    return write_xlsx(WorkbookInput([SheetInput("S", rows_of([Cell(*c) for c in NINE]))]))


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def nine_ods():
    cell = {"string": lambda v: f'<table:table-cell office:value-type="string"><text:p>{v}</text:p></table:table-cell>', "number": lambda v: f'<table:table-cell office:value-type="float" office:value="{v}"/>', "boolean": lambda v: f'<table:table-cell office:value-type="boolean" office:boolean-value="{str(v).lower()}"/>', "date": lambda v: f'<table:table-cell office:value-type="date" office:date-value="{v.isoformat()}"/>', "error": lambda v: f'<table:table-cell office:value-type="string" calcext:value-type="error"><text:p>{v}</text:p></table:table-cell>'}
    rows = "".join(f"<table:table-row>{''.join(cell[c.type](c.value) for c in cs)}</table:table-row>" for _, cs in rows_of([Cell(*c) for c in NINE]))
    ns = 'xmlns:office="o" xmlns:table="t" xmlns:text="x" xmlns:calcext="c"'
    body = f'<office:document-content {ns}><office:body><office:spreadsheet><table:table table:name="S">{rows}</table:table></office:spreadsheet></office:body></office:document-content>'
    return zipped({"mimetype": "application/vnd.oasis.opendocument.spreadsheet", "content.xml": body})


def record(number, payload):
    head = bytes([number]) if number < 128 else bytes([number & 127 | 128, number >> 7])
    size, length = len(payload), b""
    while True:
        length += bytes([size & 127 | (128 if size > 127 else 0)])
        size >>= 7
        if not size:
            return head + length + payload


def wide(s):
    raw = s.encode("utf-16-le")
    return struct.pack("<I", len(raw) // 2) + raw


def nine_xlsb():
    body, strings = b"", []
    for row, cells in rows_of([Cell(*c) for c in NINE]):
        body += record(0, struct.pack("<I", row - 1))
        for c in cells:
            at = struct.pack("<II", c.col - 1, 1 if c.type == "date" else 0)
            if c.type == "string":
                strings.append(c.value)
                body += record(7, at + struct.pack("<I", len(strings) - 1))
            elif c.type == "boolean":
                body += record(4, at + bytes([c.value]))
            elif c.type == "error":
                body += record(3, at + bytes([42]))
            else:
                body += record(5, at + struct.pack("<d", 45351.0 if c.type == "date" else c.value))
    rel = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
    one = '<Relationship Id="{}" Type="x/{}" Target="{}"/>'
    return zipped(
        {
            "[Content_Types].xml": '<Types><Override PartName="/xl/workbook.bin" ContentType="application/vnd.ms-excel.sheet.binary.macroEnabled.main"/></Types>',
            "_rels/.rels": rel.format(one.format("r1", "officeDocument", "xl/workbook.bin")),
            "xl/_rels/workbook.bin.rels": rel.format(one.format("r1", "worksheet", "worksheets/sheet1.bin") + one.format("r2", "sharedStrings", "sharedStrings.bin") + one.format("r3", "styles", "styles.bin")),
            "xl/workbook.bin": record(156, struct.pack("<II", 0, 1) + wide("r1") + wide("S")),
            "xl/sharedStrings.bin": b"".join(record(19, b"\0" + wide(s)) for s in strings),
            "xl/styles.bin": record(617, b"") + record(47, struct.pack("<HH", 0, 0)) + record(47, struct.pack("<HH", 0, 14)) + record(618, b""),
            "xl/worksheets/sheet1.bin": body,
        }
    )


@pytest.mark.parametrize("make", [nine_xlsx, nine_ods, nine_xlsb])
def test_same_cells_from_every_format(make):
    assert [tuple(c)[:4] for c in open_workbook(make()).sheets[0].cells] == NINE


def test_detection():
    assert [detect(f()) for f in (nine_xlsx, nine_ods, nine_xlsb)] == ["xlsx", "ods", "xlsb"]
    assert detect(b"a,b\n1,2") == "csv"
    assert detect(b"") is None and detect(b"\0\1\2") is None and detect(b"PK\3\4junk") is None
    assert detect(zipped({"word/document.xml": "x", "[Content_Types].xml": "<Types/>"})) is None
    assert detect(b"PK,not a zip") == "csv"


def test_delimited():
    assert list(fields('a,"b ""q"" ",c\r\n1,,\n"x\ny",007', ",")) == [["a", 'b "q" ', "c"], ["1", "", ""], ["x\ny", "007"]]
    assert list(fields('"open, to the end\n', ",")) == [["open, to the end\n"]]
    assert list(fields('a"b,c', ",")) == [['a"b', "c"]]
    assert [infer(x) for x in ("007", ".5", "1e3", "tRue", "9007199254740993", "5.", "Infinity", "")] == [("string", "007"), ("number", 0.5), ("number", 1000.0), ("boolean", True), ("string", "9007199254740993"), ("string", "5."), ("string", "Infinity"), None]
    assert sniff("a;b;c,d") == ";" and sniff('"a;b;c",d') == "," and sniff("x") == ","
    assert [c.value for c in open_delimited("﻿a\t1", "\t").sheets[0].cells] == ["a", 1.0]


def full_book():
    cells = [Cell(1, 1, "string", "a & <b>\r\n x"), Cell(1, 2, "string", "h2"), Cell(3, 1, "number", 1.5), Cell(3, 3, "date", dt.datetime(2024, 2, 29, 12, 30)), Cell(3, 5, "number", 3.0, "A3*2", 0), Cell(3, 6, "string", "x", '"x"')]
    return WorkbookInput(
        [
            SheetInput(
                "One", rows_of(cells), merges=["A5:B6"], hyperlinks=[{"ref": "A1", "target": "http://x/?a=1&b=2"}, {"ref": "B1", "location": "One!A3"}], comments=[{"ref": "A1", "text": "note", "author": "me"}], freeze={"rows": 1},
                columns=[{"min": 1, "max": 2, "width": 20.5}], tables=[{"name": "Tab_1", "ref": "A1:B3"}], validations=[{"type": "list", "sqref": "C1:C9", "formula1": '"a,b"'}],
                conditional=[{"ref": "A1:A9", "type": "cellIs", "formulas": ["5"], "attributes": {"operator": "greaterThan"}, "style": {"fill": "FFFF0000"}}], autofilter="A1:B3", protection={"objects": True}, margins={"left": 1},
                page_setup={"scale": 90}, images=[{"bytes": b"\x89PNG", "extension": "png", "from": (1, 1)}] * 2, row_properties={3: {"height": 30.0}, 9: {"hidden": True}},
            ),
            SheetInput("It's", [], "hidden"),
        ],
        [{"name": "Rate", "refers_to": "0.5"}],
        [{"bold": True, "color": "FFFF0000", "format": "0.00", "align": "center", "border": "thin"}],
    )


def test_write_read_write():
    data = write_xlsx(full_book())
    assert data == write_xlsx(full_book())
    first = open_xlsx(data)
    again = open_xlsx(write_xlsx(from_workbook(first)))
    plain = lambda b: [[c._replace(style=None) for c in s.cells] for s in b.sheets]
    assert plain(first) == plain(again)
    keep = lambda b: [{k: sorted(r or "" for r, _ in v) for k, v in s.meta.items()} for s in b.sheets]
    assert keep(first) == keep(again)
    assert [s.state for s in again.sheets] == ["visible", "hidden"]
    assert {n["name"] for n in again.names} == {"Rate", "_xlnm._FilterDatabase"}
    bold = next(c for c in first.sheets[0].cells if c.formula == "A3*2")
    assert first.meta["styles"][bold.style] == {"format": "0.00", "bold": True, "color": "FFFF0000", "font": "Calibri", "size": 11.0, "align": "center", "border": "thin"}
    assert len([n for n in Package(data).parts if n.startswith("xl/media/")]) == 1


@pytest.mark.parametrize(
    "change",
    [
        {"sheets": []},
        {"name": "a/b"},
        {"name": "x" * 32},
        {"state": "hidden"},
        {"merges": ["A1:B2", "B2:C3"]},
        {"merges": ["B2:A1"]},
        {"merges": ["A1"]},
        {"columns": [{"min": 2, "max": 1}]},
        {"columns": [{"min": 1, "max": 1, "width": 300}]},
        {"row_properties": {1: {"height": 500}}},
        {"freeze": {"rows": 0, "columns": 0}},
        {"tables": [{"name": "A1", "ref": "A1:A2", "columns": ["x"]}]},
        {"tables": [{"name": "Tab", "ref": "A1:B2", "columns": ["x", "X"]}]},
        {"comments": [{"ref": "A1", "text": "a"}, {"ref": "A1", "text": "b"}]},
        {"validations": [{"type": "odd", "sqref": "A1"}]},
        {"images": [{"bytes": b"", "extension": "svg", "from": (0, 0)}]},
        {"rows": [(1, [Cell(1, 1, "number", float("nan"))])]},
        {"rows": [(2, []), (1, [])]},
        {"rows": [(1, [Cell(1, 1, "string", "x" * 32768)])]},
        {"margins": {"left": 99}},
    ],
)
def test_writer_is_strict(change):
    sheets = [SheetInput(**({"name": "S"} | change))] if "sheets" not in change else []
    with pytest.raises(WorkbookError) as e:
        write_xlsx(WorkbookInput(sheets))
    assert e.value.code == "invalid-input"


def sheet_xml(body, extra=""):
    rel = '<Relationships>{}</Relationships>'
    return zipped(
        {
            "[Content_Types].xml": "<Types><Override ContentType='application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml'/></Types>",
            "_rels/.rels": rel.format('<Relationship Id="r" Type="x/officeDocument" Target="xl/workbook.xml"/>'),
            "xl/workbook.xml": '<workbook><sheets><sheet name="S" id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": rel.format('<Relationship Id="r1" Type="x/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="x/styles" Target="styles.xml"/><Relationship Id="r3" Type="x/sharedStrings" Target="sst.xml"/>'),
            "xl/styles.xml": '<styleSheet><numFmts><numFmt numFmtId="164" formatCode="yyyy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>',
            "xl/sst.xml": "<sst><si><t>one</t></si><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si></sst>",
            "xl/worksheets/sheet1.xml": f"<worksheet><cols><col min='3' max='3' style='1'/></cols><sheetData>{body}</sheetData>{extra}</worksheet>",
        }
    )


def test_cell_decoding():
    body = """<row><c t="s"><v>1</v></c><c t="s"><v>9</v></c><c><v>45351</v></c></row><row r="4" s="1" customFormat="1"><c><v>1</v></c><c s="0"><v>1</v></c><c t="b"><v>1</v></c><c t="e"><v>#REF!</v></c><c t="str"><v>a_x000D_b</v></c><c><v>1e999</v></c></row>
    <row><c r="B9"><f t="shared" si="0">A9+1</f><v>2</v></c></row><row r="10"><c r="B10"><f t="shared" si="0"/><v>3</v></c><c r="C10" s="0"><f t="dataTable">x</f></c></row>"""
    cells = {(c.row, c.col): (c.type, c.value, c.formula) for c in open_xlsx(sheet_xml(body)).sheets[0].cells}
    assert cells[1, 1] == ("string", "rich", None)
    assert cells[1, 2] == ("empty", None, None)
    assert cells[1, 3] == ("date", dt.datetime(2024, 2, 29), None)
    assert cells[4, 1][0] == "date" and cells[4, 2] == ("number", 1.0, None) and cells[4, 3] == ("boolean", True, None)
    assert cells[4, 4] == ("error", "#REF!", None) and cells[4, 5] == ("string", "a\rb", None) and cells[4, 6][0] == "empty"
    assert cells[9, 2][2] == "A9+1" and cells[10, 2][2] == "A10+1" and cells[10, 3][2] is None
    assert [n for n, _ in stream_rows(sheet_xml(body))] == [1, 4, 9, 10]


def test_dates_and_text():
    assert [is_date_format(x) for x in ("yyyy", "0.00", '"day" 0', "[h]:mm", "[Red]0", "0.00_m", "[$-409]d", '"[h]" 0')] == [True, False, False, True, False, False, True, False]
    assert unescape_text(escape_text("a\x01_x0041_\r")) == "a\x01_x0041_\r"
    assert rk(struct.pack("<i", 5 << 2 | 3), 0) == 0.05


def test_ods_repeats():
    ns = 'xmlns:office="o" xmlns:table="t" xmlns:text="x"'
    body = f'<d {ns}><office:spreadsheet><table:table table:name="A"><table:table-row table:number-rows-repeated="2"><table:table-cell table:number-columns-repeated="3" office:value-type="float" office:value="1"/><table:table-cell table:number-columns-repeated="16000"/></table:table-row><table:table-row table:number-rows-repeated="1000000"/><table:table-row><table:table-cell table:number-columns-spanned="2"><text:p>a<text:s text:c="2"/>b</text:p><text:p>c</text:p></table:table-cell><table:covered-table-cell/></table:table-row></table:table></office:spreadsheet></d>'
    s = open_ods(zipped({"content.xml": body})).sheets[0]
    assert len(s.cells) == 7 and s.cells[-1][:4] == (1000003, 1, "string", "a  b\nc")
    assert s.meta["merge"][0][0] == "A1000003:B1000003"


def test_guards():
    bomb = sheet_xml("<row><c><v>1</v></c></row>" + " " * 30_000_000)
    with pytest.raises(WorkbookError) as e:
        open_xlsx(bomb)
    assert e.value.code == "part-too-large"
    assert open_xlsx(bomb, most_ratio=float("inf")).sheets[0].cells
    with pytest.raises(WorkbookError) as e:
        open_xlsx(nine_xlsx(), "Other")
    assert e.value.code == "no-such-sheet"
    for data in (b"", b"nonsense", nine_xlsx()[:300]):
        with pytest.raises(WorkbookError):
            open_xlsx(data)


def test_mutations_end_in_typed_errors():
    rng = random.Random(7)
    for make in (nine_xlsx, nine_ods, nine_xlsb):
        good = make()
        for _ in range(120):
            bad = bytearray(good)
            for _ in range(rng.randint(1, 8)):
                bad[rng.randrange(len(bad))] = rng.randrange(256)
            try:
                open_workbook(bytes(bad[: rng.choice([len(bad), rng.randrange(len(bad))])]))
            except WorkbookError:
                pass
    inner = Package(nine_xlsb()).read("xl/worksheets/sheet1.bin")
    for _ in range(200):
        bad = bytearray(inner)
        bad[rng.randrange(len(bad))] = rng.randrange(256)
        from cellwright.sources.model import Sheet
        from cellwright.sources.xlsb import _cells

        _cells(bytes(bad), Sheet("x"), ["a"], [], {})


def test_spark_reading(spark, tmp_path):
    for name, make in (("a.xlsx", nine_xlsx), ("b.ods", nine_ods), ("c.xlsb", nine_xlsb)):
        (tmp_path / name).write_bytes(make())
    found = files(spark, str(tmp_path))
    assert {r.format for r in formats(found).collect()} == {"xlsx", "ods", "xlsb"}
    cells = read_cells(found)
    assert cells.count() == 27 and cells.where("type = 'date'").select("t").distinct().count() == 1
    (tmp_path / "d.bin").write_bytes(b"\0\1")
    with pytest.raises(Exception, match="unknown format"):
        read_cells(files(spark, str(tmp_path))).count()
    assert read_cells(files(spark, str(tmp_path)), strict=False).count() == 27


def test_spark_metadata_and_tables(spark, tmp_path):
    (tmp_path / "x.xlsx").write_bytes(write_xlsx(full_book()))
    meta = read_metadata(files(spark, str(tmp_path)))
    kinds = {r.kind for r in meta.collect()}
    assert {"sheet", "name", "merge", "hyperlink", "comment", "table", "validation", "conditional", "freeze", "column", "row", "image", "styles"} <= kinds
    assert [r.refers_to for r in names_of(meta).where("name = 'Rate'").collect()] == ["0.5"]
    df = spark.createDataFrame([(i, f"n{i}", i % 2 == 0) for i in range(1, 8)], "id int, name string, even boolean")
    out = render(cells_of_table(df, ["id"], str(tmp_path / "out-{part}.xlsx"), rows=3))
    save(out, spark)
    back = to_table(read_cells(files(spark, str(tmp_path / "out-00001.xlsx")))).drop("row").orderBy("id").collect()
    assert [tuple(r) for r in back] == [(4.0, "n4", True), (5.0, "n5", False), (6.0, "n6", True)]


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_numbers_over_many_ranges(spark, tmp_path, adaptive):
    from pyspark.sql import functions as F

    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        _numbers_over_many_ranges(spark, tmp_path, F)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def _numbers_over_many_ranges(spark, tmp_path, F):  # noqa: N803

    from cellwright.plans.fills import numbered

    df = spark.range(1_000_000).select((F.col("id") * 7919 % 1_000_000).alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("name"), F.md5(F.col("id").cast("string")).alias("note")).repartition(6)
    out = numbered(df, ["id"], "__row")
    assert out.columns == ["id", "name", "note", "__row"]
    assert tuple(out.agg(F.count(F.lit(1)), F.count_distinct("__row"), F.count_if(F.col("__row") == F.col("id") + 1), F.max(F.length(F.concat("name", "note")))).first()) == (1_000_000, 1_000_000, 1_000_000, 96)
    # null and very frequent keys
    odd = spark.range(50_000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("k"), "id").repartition(5)
    rows = numbered(odd, ["k", "id"], "__row").orderBy("__row").collect()
    assert [r["__row"] for r in rows] == list(range(1, 50_001))
    assert [(r.k is not None, r.k or 0, r.id) for r in rows] == sorted((r.k is not None, r.k or 0, r.id) for r in rows)
    # a column of nulls without a type
    cells = cells_of_table(df.limit(3).withColumn("none", F.lit(None)), ["id"], str(tmp_path / "x.xlsx"))
    assert cells.count() == 16 and cells.where("type = 'empty'").count() == 3


def test_delimited_table(spark, tmp_path):
    (tmp_path / "x.csv").write_text('1,007,TRUE,"a,b"\n,x,no,9007199254740993\n')
    rows = delimited_table(spark, str(tmp_path)).collect()
    assert [[c.type for c in r] for r in rows] == [["number", "string", "boolean", "string"], ["empty", "string", "string", "string"]]


def test_streaming(spark, tmp_path):
    from cellwright.streaming import stream_cells, write_workbooks

    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.xlsx").write_bytes(nine_xlsx())
    q = stream_cells(spark, str(inbox)).writeStream.format("memory").queryName("cells_in").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    (inbox / "b.ods").write_bytes(nine_ods())
    q.processAllAvailable()
    q.stop()
    assert spark.table("cells_in").count() == 18
    spark.range(5).write.parquet(str(tmp_path / "rows"))
    q = write_workbooks(spark.readStream.schema("id long").parquet(str(tmp_path / "rows")), ["id"], str(tmp_path / "out"), str(tmp_path / "c2"))
    q.awaitTermination()
    assert read_cells(files(spark, str(tmp_path / "out" / "*.xlsx"))).where("row > 1").count() == 5


@pytest.mark.parametrize("size", [1 << 16, 7, 1])
def test_malformed_sheets_are_read_on(monkeypatch, size):
    from cellwright.sources import package

    monkeypatch.setattr(package, "CHUNK", size)
    rows = "".join(f'<row r="{i}"><c r="A{i}" t="str"><v>{v}</v></c></row>' for i, v in enumerate(["a", "b &amp; é", "c & d", "e < f", "g &#233; &nope; h", "<b>x</b>", "tail"], 1))
    cells = open_xlsx(sheet_xml(rows)).sheets[0].cells
    assert [c.value for c in cells] == ["a", "b & é", "c & d", "e < f", "g é &nope; h", "x", "tail"]
    # a close that has no open, a tag without its end, attributes without quotes
    odd = '<row r="1"><c r="A1"><v>1</v></c></wrong></row><row r=2><c r=A2><v>2</v></c></row><row r="3"><c r="A3" t="b"><v>1</v>'
    assert [(c.row, c.value) for c in open_xlsx(sheet_xml(odd)).sheets[0].cells][:2] == [(1, 1.0), (2, 2.0)]
    events = list(package.scan(iter([b"<a x='1&lt;' y=2 z><!-- <b> --><![CDATA[<&]]>t<c/></a> < & <d"])))
    assert events == [("open", "a", {"x": "1<", "y": "2"}), ("text", "<&", {}), ("text", "t", {}), ("open", "c", {}), ("close", "c", {}), ("close", "a", {}), ("text", " ", {}), ("text", "<", {}), ("text", " & ", {}), ("text", "<", {}), ("text", "d", {})]


OFFICE = ["FFFFFF", "000000", "EEECE1", "1F497D", "4F81BD", "C0504D", "9BBB59", "8064A2", "4BACC6", "F79646", "0000FF", "800080"]


def theme_xml(lt1='<a:sysClr val="window"/>'):
    slots = dict(zip(("lt1", "dk1", "lt2", "dk2", *[f"accent{i}" for i in range(1, 7)], "hlink", "folHlink"), OFFICE, strict=True))
    body = "".join(f"<a:{k}>{lt1 if k == 'lt1' else f'<a:srgbClr val={chr(34)}{v}{chr(34)}/>'}</a:{k}>" for k, v in sorted(slots.items()))
    return f'<a:theme xmlns:a="x"><a:themeElements><a:clrScheme name="Office">{body}</a:clrScheme><a:fmtScheme><a:srgbClr val="123456"/></a:fmtScheme></a:themeElements></a:theme>'


def test_themes_and_tints():
    from cellwright.sources.package import tree
    from cellwright.sources.theme import from_hls, resolve_color, theme_colors, tinted, to_hls

    read = lambda x: theme_colors(tree(iter([x.encode()])))
    assert read(theme_xml()) == OFFICE
    assert read(theme_xml("<a:sysClr val='other'/>")) is None and read("<a/>") is None
    assert read(theme_xml("<a:sysClr val='other' lastClr='abcdef'/>"))[0] == "ABCDEF"
    # shades as spreadsheets show them
    assert [tinted("4F81BD", t) for t in (0.7999, 0.5999, 0.3999, -0.25, -0.5)] == ["DCE6F1", "B8CCE4", "96B4D8", "376193", "244062"]
    assert [tinted("000000", 0.5), tinted("FFFFFF", -0.5), tinted("ff0000", 0.0), tinted("FF0000", 9.0), tinted("00FF00", float("nan"))] == ["808080", "808080", "FF0000", "FFFFFF", "00FF00"]
    assert resolve_color("ff00ff", None) == "FFFF00FF" and resolve_color({"theme": 4}, OFFICE) == "FF4F81BD" and resolve_color({"theme": 4}, None) is None
    assert [resolve_color(c, OFFICE) for c in ({"auto": True}, {"indexed": 3}, {"theme": 12}, None, {"rgb": "80123456"})] == [None, None, None, None, "80123456"]
    rng = random.Random(1)
    for _ in range(2000):
        rgb = tuple(rng.randrange(256) for _ in range(3))
        assert max(abs(a - b) for a, b in zip(rgb, from_hls(*to_hls(rgb)), strict=True)) <= 6


def test_styles_and_theme_go_round():
    styles = [
        {"underline": "doubleAccounting", "strike": True, "color": {"theme": 4, "tint": -0.25}},
        {"fill": {"pattern": "lightUp", "fore": {"indexed": 10}, "back": "FF112233"}, "border": {"left": {"style": "thin", "color": "FFFF0000"}, "bottom": {"style": "double"}}},
        {"fill": {"theme": 5}, "border": "dashed", "rotation": 45, "indent": 2, "shrink": True, "wrap": True, "align": "left", "locked": False, "hidden": True},
        {"underline": True, "italic": True},
    ]
    cells = [Cell(1, i + 1, "number", 1.0, None, i) for i in range(4)]
    book = open_xlsx(write_xlsx(WorkbookInput([SheetInput("S", [(1, cells)])], styles=styles, theme=theme_xml())))
    again = open_xlsx(write_xlsx(from_workbook(book)))
    for b in (book, again):
        assert b.meta["theme"][0]["colors"] == OFFICE
        for c, want in zip(b.sheets[0].cells, styles, strict=True):
            assert {k: v for k, v in b.meta["styles"][c.style].items() if k not in ("font", "size", "format")} == want
    for bad in ({"underline": "wavy"}, {"fill": {"pattern": "x"}}, {"border": "thick!"}, {"color": {"theme": 99}}, {"color": "red"}, {"color": {"rgb": "FF000000", "theme": 1}}, {"rotation": 200}):
        with pytest.raises(WorkbookError):
            write_xlsx(WorkbookInput([SheetInput("S")], styles=[bad]))


def test_tables_as_cells_and_as_rows_alike(spark, tmp_path):
    from cellwright.sources.sink import render_table

    rows = [(i, f"n{i} & <x>" if i % 3 else None, i % 2 == 0, dt.date(2024, 1, 1 + i), float(i) / 3 if i % 4 else None) for i in range(1, 18)]
    df = spark.createDataFrame(rows, "id int, `na.me` string, even boolean, day date, part double").repartition(3)
    out = [{r.path: bytes(r.content) for r in f.collect()} for f in (render(cells_of_table(df, ["id"], "p-{part}.xlsx", rows=5)), render_table(df, ["id"], "p-{part}.xlsx", rows=5))]
    assert len(out[0]) == 4 and out[0].keys() == out[1].keys()
    for path in out[0]:
        a, b = (open_xlsx(o[path]) for o in out)
        assert [c._replace(style=None) for c in a.sheets[0].cells] == [c._replace(style=None) for c in b.sheets[0].cells] and out[0][path] == out[1][path]


def test_data_source(spark, tmp_path):
    from cellwright.sources.datasource import WorkbookReader, listed, register

    register(spark)
    two = write_xlsx(WorkbookInput([SheetInput("A", rows_of([Cell(1, 1, "number", 1.0)])), SheetInput("B", rows_of([Cell(1, 1, "string", "x"), Cell(2, 1, "date", dt.datetime(2024, 2, 29))]))]))
    (tmp_path / "b.xlsx").write_bytes(two)
    (tmp_path / "a.ods").write_bytes(nine_ods())
    (tmp_path / "c.xlsb").write_bytes(nine_xlsb())
    df = spark.read.format("workbook").load(str(tmp_path))
    assert df.count() == 3 + 9 + 9 and df.rdd.getNumPartitions() == 4
    want = {tuple(r)[1:] for r in read_cells(files(spark, str(tmp_path))).collect()}
    assert {tuple(r)[1:] for r in df.collect()} == want
    assert spark.read.format("workbook").option("sheet", "B").load(str(tmp_path / "b.*")).where("row = 2").first().t == dt.datetime(2024, 2, 29)
    assert df.where("sheet = 'A'").collect()[0].n == 1.0 and df.where("sheet = 'A'").count() == 1
    reader = WorkbookReader({"path": str(tmp_path)})
    from pyspark.sql.datasource import EqualTo

    assert list(reader.pushFilters([EqualTo(("sheet",), "B"), EqualTo(("row",), 2)])) == [EqualTo(("row",), 2)] and [p.sheet for p in reader.partitions()] == ["B"]
    assert list(reader.pushFilters([EqualTo(("sheet",), "A")])) == [] and reader.partitions() == []
    assert listed(f"file://{tmp_path}/*.xlsx") == [f"file://{tmp_path}/b.xlsx"]
    with pytest.raises(Exception, match="no file"):
        spark.read.format("workbook").load(str(tmp_path / "none")).count()
