"""Writing .xlsx: strict about its input, and the same bytes for the same input."""

from __future__ import annotations

import datetime as dt
import io
import itertools
import re
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from xml.sax.saxutils import escape, quoteattr

from ..errors import WorkbookError
from ..functions.refs import MAX_COL, MAX_ROW, canonical_range, column_letters, datetime_to_serial, format_cell, overlaps
from .model import Cell, Workbook
from .package import escape_text

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
#: Content of a part: whole, or in pieces of text.
Content = str | bytes | Iterator[str]
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
#: Enumerations of the format.
VALIDATION_TYPES = ("none", "whole", "decimal", "list", "date", "time", "textLength", "custom")
VALIDATION_OPERATORS = ("between", "notBetween", "equal", "notEqual", "lessThan", "lessThanOrEqual", "greaterThan", "greaterThanOrEqual")
UNDERLINES = ("single", "double", "singleAccounting", "doubleAccounting")
LINES = ("thin", "medium", "thick", "dashed", "dotted", "double", "hair", "mediumDashed", "dashDot", "mediumDashDot", "dashDotDot", "mediumDashDotDot", "slantDashDot")
PATTERNS = (
    *("none", "solid", "mediumGray", "darkGray", "lightGray", "darkHorizontal", "darkVertical", "darkDown", "darkUp", "darkGrid", "darkTrellis"),
    *("lightHorizontal", "lightVertical", "lightDown", "lightUp", "lightGrid", "lightTrellis", "gray125", "gray0625"),
)
MEDIA = {"png": "image/png", "jpeg": "image/jpeg", "jpg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp"}


@dataclass
class SheetInput:
    """Rows of cells and the sheet's settings.  ``rows``: (row number, cells) in order; may be a generator."""

    name: str
    rows: Iterable[tuple[int, list[Cell]]] = ()
    state: str = "visible"
    columns: list[dict] = field(default_factory=list)  # min, max, width, hidden
    row_properties: dict[int, dict] = field(default_factory=dict)  # height, hidden
    freeze: dict | None = None  # rows, columns
    merges: list[str] = field(default_factory=list)
    hyperlinks: list[dict] = field(default_factory=list)  # ref, target, location, tooltip, display
    comments: list[dict] = field(default_factory=list)  # ref, text, author
    validations: list[dict] = field(default_factory=list)
    conditional: list[dict] = field(default_factory=list)  # ref, type, priority, formulas, attributes, style
    tables: list[dict] = field(default_factory=list)  # name, ref, columns, totals
    images: list[dict] = field(default_factory=list)  # bytes, extension, from (col, row), to (col, row)
    autofilter: str | None = None
    protection: dict | None = None
    margins: dict | None = None
    page_setup: dict | None = None
    print_options: dict | None = None
    header_footer: dict | None = None
    streamed: bool = False  # write rows as they come


@dataclass
class WorkbookInput:
    sheets: Iterable[SheetInput]
    names: list[dict] = field(default_factory=list)  # name, refers_to, sheet_index, hidden
    #: Styles by number: dictionaries with format; bold, italic, strike, underline, color, font, size; fill; border; align, valign, wrap,
    #: shrink, indent, rotation; locked, hidden.
    styles: list[dict] = field(default_factory=list)
    protection: dict | None = None
    date1904: bool = False
    theme: str | None = None  # the theme part as it was read


def fail(message: str) -> None:
    raise WorkbookError("invalid-input", message)


def need(good: bool, message: str) -> None:
    if not good:
        fail(message)


def attributes(a: dict) -> str:
    return "".join(f" {k}={quoteattr(_value(v))}" for k, v in a.items() if v is not None)


def _value(v: object) -> str:
    return ("0", "1")[v] if isinstance(v, bool) else number(v) if isinstance(v, float) else str(v)


def number(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def tag(name: str, a: dict, body: str = "") -> str:
    return f"<{name}{attributes(a)}>{body}</{name}>" if body else f"<{name}{attributes(a)}/>"


def text_tag(name: str, s: str, a: dict | None = None) -> str:
    s = escape_text(s)
    keep = ' xml:space="preserve"' if s != s.strip() or "\n" in s or "\t" in s else ""
    return f"<{name}{attributes(a or {})}{keep}>{escape(s)}</{name}>"


# --- styles ---------------------------------------------------------------------------------------


def _color(name: str, c: str | dict | None) -> str:
    if not c:
        return ""
    c = {"rgb": c} if isinstance(c, str) else c
    need(len(set(c) & {"rgb", "theme", "indexed", "auto"}) == 1 and set(c) <= {"rgb", "theme", "tint", "indexed", "auto"}, f"not a colour: {c!r}")
    if "rgb" in c:
        need(bool(re.fullmatch("[0-9A-Fa-f]{6}|[0-9A-Fa-f]{8}", c["rgb"])), f"not a colour: {c!r}")
    need(c.get("theme") is None or 0 <= c["theme"] < 12, f"no colour of a theme: {c!r}")
    need(c.get("tint") is None or -1 <= c["tint"] <= 1, f"not a tint: {c!r}")
    return tag(name, c)


def _fill(f: str | dict | None) -> str:
    """A colour is a solid fill; else pattern, fore and back."""
    if not f:
        return ""
    if isinstance(f, str) or "pattern" not in f:
        f = {"pattern": "solid", "fore": f}
    need(f["pattern"] in PATTERNS, f"not a pattern: {f['pattern']!r}")
    return f"<fill>{tag('patternFill', {'patternType': f['pattern']}, _color('fgColor', f.get('fore')) + _color('bgColor', f.get('back')))}</fill>"


def _border(b: str | dict | None) -> str:
    """One line for all sides, or style and colour by side."""
    if not b:
        return ""
    sides = dict.fromkeys(("left", "right", "top", "bottom"), {"style": b}) if isinstance(b, str) else b
    need(set(sides) <= {"left", "right", "top", "bottom"} and all(e.get("style") in LINES for e in sides.values()), f"not a border: {b!r}")
    edge = lambda side: tag(side, {"style": sides[side]["style"]}, _color("color", sides[side].get("color"))) if side in sides else f"<{side}/>"
    return f"<border>{edge('left')}{edge('right')}{edge('top')}{edge('bottom')}<diagonal/></border>"


class Styles:
    """Interns fonts, fills, borders, formats, cell styles and differential styles; index 0 is the default."""

    def __init__(self, given: list[dict]) -> None:
        self.fonts: dict[str, int] = {'<font><sz val="11"/><name val="Calibri"/></font>': 0}
        self.fills: dict[str, int] = {'<fill><patternFill patternType="none"/></fill>': 0, '<fill><patternFill patternType="gray125"/></fill>': 1}
        self.borders: dict[str, int] = {"<border><left/><right/><top/><bottom/><diagonal/></border>": 0}
        self.formats: dict[str, int] = {}
        self.xfs: dict[str, int] = {'<xf numFmtId="0" fontId="0" fillId="0" borderId="0" xfId="0"/>': 0}
        self.dxfs: dict[str, int] = {}
        self.given = [self.cell(s) for s in given]
        self.date = None

    @staticmethod
    def _id(table: dict[str, int], xml: str, start: int = 0) -> int:
        return table.setdefault(xml, start + len(table))

    def _parts(self, s: dict) -> tuple[str, str, str]:
        font = "".join(f"<{t}/>" for t, k in (("b", "bold"), ("i", "italic"), ("strike", "strike")) if s.get(k))
        line = s.get("underline")
        need(line in (None, False, True, *UNDERLINES), f"not an underline: {line!r}")
        font += "" if not line else "<u/>" if line in (True, "single") else tag("u", {"val": line})
        return font + _color("color", s.get("color")), _fill(s.get("fill")), _border(s.get("border"))

    def format_id(self, code: str | None) -> int:
        from .model import BUILTIN_FORMATS

        if code is None:
            return 0
        known = next((i for i, c in BUILTIN_FORMATS.items() if c == code), None)
        return known if known is not None else self._id(self.formats, code, 164)

    def cell(self, s: dict) -> int:
        font, fill, border = self._parts(s)
        f = self._id(self.fonts, f'<font>{font}<sz val="{number(float(s.get("size", 11)))}"/><name val={quoteattr(s.get("font", "Calibri"))}/></font>') if font or "size" in s or "font" in s else 0
        xf = {"numFmtId": self.format_id(s.get("format")), "fontId": f, "fillId": self._id(self.fills, fill) if fill else 0, "borderId": self._id(self.borders, border) if border else 0, "xfId": 0}
        xf |= {k: 1 for k, v in (("applyNumberFormat", xf["numFmtId"]), ("applyFont", f), ("applyFill", xf["fillId"]), ("applyBorder", xf["borderId"])) if v}
        align = {"horizontal": s.get("align"), "vertical": s.get("valign"), "textRotation": s.get("rotation"), "wrapText": s.get("wrap"), "indent": s.get("indent"), "shrinkToFit": s.get("shrink")}
        need(0 <= (s.get("rotation") or 0) <= 180 or s.get("rotation") == 255, "a rotation is 0 to 180, or 255")
        align = {k: v for k, v in align.items() if v}
        lock = {k: s[k] for k in ("locked", "hidden") if s.get(k) is not None}
        body = (tag("alignment", align) if align else "") + (tag("protection", lock) if lock else "")
        return self._id(self.xfs, tag("xf", xf | ({"applyAlignment": 1} if align else {}) | ({"applyProtection": 1} if lock else {}), body))

    def difference(self, s: dict) -> int:
        if "xml" in s:
            return self._id(self.dxfs, s["xml"])
        font, fill, border = self._parts(s)
        fill = fill.replace("fgColor", "bgColor")
        return self._id(self.dxfs, f"<dxf>{f'<font>{font}</font>' if font else ''}{fill}{border}</dxf>")

    def of(self, c: Cell) -> int:
        if c.style is not None and 0 <= c.style < len(self.given):
            return self.given[c.style]
        return self.cell({"format": "yyyy-mm-dd hh:mm:ss"}) if c.type == "date" else 0

    def xml(self) -> str:
        group = lambda name, table: f'<{name} count="{len(table)}">{"".join(table)}</{name}>' if table else ""
        codes = "".join(tag("numFmt", {"numFmtId": i, "formatCode": c}) for c, i in self.formats.items())
        return (
            f'{HEAD}<styleSheet xmlns="{MAIN}">{f"<numFmts count={quoteattr(str(len(self.formats)))}>{codes}</numFmts>" if codes else ""}{group("fonts", self.fonts)}{group("fills", self.fills)}{group("borders", self.borders)}'
            f'<cellStyleXfs count="1"><xf numFmtId="0" fontId="0" fillId="0" borderId="0"/></cellStyleXfs>{group("cellXfs", self.xfs)}<cellStyles count="1"><cellStyle name="Normal" xfId="0" builtinId="0"/></cellStyles>{group("dxfs", self.dxfs)}</styleSheet>'
        )


# --- cells ----------------------------------------------------------------------------------------


#: What a text can't have if it is to be written as it is.
_SPECIAL = re.compile("[&<>\x00-\x1f\\ufffe\\uffff\\ud800-\\udfff]|_x|^\\s|\\s\\Z")


def _text(name: str, s: str) -> str:
    return text_tag(name, s) if _SPECIAL.search(s) else f"<{name}>{s}</{name}>"


def cell_xml(c: Cell, style: int, date1904: bool) -> str:
    ref = f"{column_letters(c.col)}{c.row}"
    head = f'<c r="{ref}" s="{style}"' if style else f'<c r="{ref}"'
    v, kind = c.value, c.type
    if kind == "date":
        need(isinstance(v, dt.datetime), f"{ref}: not a date")
        v, kind = datetime_to_serial(v, date1904), "number"
    formula = ""
    if c.formula is not None:
        body = c.formula.removeprefix("=")
        need(0 < len(body) <= 8192, f"{ref}: a formula has 1 to 8192 characters")
        formula = _text("f", body)
    if kind == "number":
        need(isinstance(v, (int, float)) and v - v == 0, f"{ref}: not a finite number")
        return f"{head}>{formula}<v>{number(float(v))}</v></c>"
    if kind == "string":
        need(isinstance(v, str), f"{ref}: not a text")
        need(len(v) <= 32767, f"{ref}: text of more than 32767 characters")
        return f'{head} t="str">{formula}{_text("v", v)}</c>' if formula else f'{head} t="inlineStr"><is>{_text("t", v)}</is></c>'
    if kind == "empty":
        return f"{head}>{formula}</c>" if formula else f"{head}/>"
    if kind == "boolean":
        return f'{head} t="b">{formula}<v>{int(bool(v))}</v></c>'
    need(kind == "error", f"{ref}: unknown type {kind!r}")
    return f'{head} t="e">{formula}{_text("v", str(v))}</c>'


def rows_xml(s: SheetInput, styles: Styles, date1904: bool, seen: dict) -> Iterator[str]:
    """Row elements; ``seen`` gets the used range, and header texts that tables need."""
    headers = {r for t in s.tables for r in [canonical_range(t["ref"])] if r}
    pending = dict(sorted(s.row_properties.items()))
    last = 0

    def properties(row: int) -> dict:
        p = pending.pop(row, {})
        need(p.get("height") is None or 0 < p["height"] <= 409.5, f"row {row}: a height is above 0 and at most 409.5")
        return {"ht": p.get("height"), "customHeight": True if p.get("height") is not None else None, "hidden": True if p.get("hidden") else None}

    for row, cells in s.rows:
        need(last < row <= MAX_ROW, f"row {row} is out of order or off the grid")
        for other in [r for r in pending if r < row]:
            yield tag("row", {"r": other} | properties(other))
        last, col, out = row, 0, []
        for c in cells:
            if not (c.row == row and col < c.col <= MAX_COL):
                fail(f"{row}: cells are out of order or off the grid")
            col = c.col
            out.append(cell_xml(c, styles.of(c), date1904))
            if headers and any(r[1] == row and r[0] <= c.col <= r[2] for r in headers):
                seen.setdefault("headers", {})[row, c.col] = c.value
        if cells:
            lo, hi = seen.get("columns", (cells[0].col, col))
            seen["columns"], seen["rows"] = (min(lo, cells[0].col), max(hi, col)), (seen.get("rows", (row, row))[0], row)
        yield tag("row", {"r": row} | properties(row), "".join(out))
    for other in list(pending):
        need(1 <= other <= MAX_ROW, f"row {other} is off the grid")
        yield tag("row", {"r": other} | properties(other))


# --- sheets ---------------------------------------------------------------------------------------


def _range(ref: object, what: str) -> tuple[int, int, int, int]:
    found = canonical_range(ref) if isinstance(ref, str) else None
    if found is None:
        fail(f"{what}: not a range on the grid: {ref!r}")
    return found


class _Parts:
    """All parts of a package, with the relationships and content types between them."""

    def __init__(self) -> None:
        self.types: dict[str, str] = {}
        self.media: dict[tuple[bytes, str], str] = {}
        self.extensions: set[str] = set()
        self.tables: set[str] = set()
        self.counts: dict[str, int] = {}

    def next(self, kind: str) -> int:
        self.counts[kind] = self.counts.get(kind, 0) + 1
        return self.counts[kind]


def _before_data(s: SheetInput) -> str:
    out = []
    if s.freeze:
        rows, cols = s.freeze.get("rows", 0), s.freeze.get("columns", 0)
        need(0 <= rows < MAX_ROW and 0 <= cols < MAX_COL and rows + cols > 0, "a freeze lies within the grid")
        side = "bottomRight" if rows and cols else "bottomLeft" if rows else "topRight"
        pane = tag("pane", {"xSplit": cols or None, "ySplit": rows or None, "topLeftCell": format_cell(cols + 1, rows + 1), "activePane": side, "state": "frozen"})
        out.append(f'<sheetViews><sheetView workbookViewId="0">{pane}<selection pane="{side}"/></sheetView></sheetViews>')
    if s.columns:
        last, cols = 0, []
        for c in s.columns:
            need(last < c["min"] <= c["max"] <= MAX_COL, "columns are in order and within the grid")
            need(c.get("width") is None or 0 < c["width"] <= 255, "a width is above 0 and at most 255")
            last = c["max"]
            cols.append(tag("col", {"min": c["min"], "max": c["max"], "width": c.get("width"), "customWidth": True if c.get("width") is not None else None, "hidden": True if c.get("hidden") else None}))
        out.append(f"<cols>{''.join(cols)}</cols>")
    return "".join(out)


def _merges(s: SheetInput) -> str:
    found = [_range(m, "merge") for m in s.merges]
    need(all((r[0], r[1]) != (r[2], r[3]) for r in found), "a merge has several cells")
    live: list[tuple[int, int, int, int]] = []
    for r in sorted(found, key=lambda r: r[1]):  # a sweep down the rows
        live = [x for x in live if x[3] >= r[1]]
        need(not any(overlaps(x, r) for x in live), "merges overlap")
        live.append(r)
    return f'<mergeCells count="{len(found)}">{"".join(tag("mergeCell", {"ref": m}) for m in s.merges)}</mergeCells>' if found else ""


def _conditional(s: SheetInput, styles: Styles) -> str:
    order = sorted(range(len(s.conditional)), key=lambda i: (s.conditional[i].get("priority", 1 << 30), i))
    rank = {i: n for n, i in enumerate(order, 1)}
    out = []
    for i, rule in enumerate(s.conditional):
        for ref in rule["ref"].split(" "):
            _range(ref, "conditional formatting")
        formulas = rule.get("formulas", [])
        need(len(formulas) <= 3, "a rule has three formulas at most")
        a = {"type": rule["type"], "dxfId": styles.difference(rule["style"]) if rule.get("style") else None, "priority": rank[i]} | rule.get("attributes", {})
        out.append(tag("conditionalFormatting", {"sqref": rule["ref"]}, tag("cfRule", a, "".join(text_tag("formula", f) for f in formulas) + rule.get("body", ""))))
    return "".join(out)


def _validations(s: SheetInput) -> str:
    out = []
    for v in s.validations:
        kind, op = v.get("type", "none"), v.get("operator")
        need(kind in VALIDATION_TYPES and op in (None, *VALIDATION_OPERATORS), "an unknown validation")
        for ref in v["sqref"].split(" "):
            _range(ref, "validation")
        for k, most in (("promptTitle", 32), ("errorTitle", 32), ("prompt", 255), ("error", 255)):
            need(len(v.get(k) or "") <= most, f"{k} is too long")
        first = v.get("formula1")
        need(not (kind == "list" and first and first.startswith('"')) or len(first) <= 257, "an inline list has 255 characters at most")
        keys = ("errorStyle", "allowBlank", "showInputMessage", "showErrorMessage", "errorTitle", "error", "promptTitle", "prompt")
        a = {"type": kind, "operator": op} | {k: v[k] for k in keys if k in v} | {"showDropDown": True if v.get("hideDropDown") else None, "sqref": v["sqref"]}
        out.append(tag("dataValidation", a, "".join(text_tag(k, v[k]) for k in ("formula1", "formula2") if v.get(k) is not None)))
    return f'<dataValidations count="{len(out)}">{"".join(out)}</dataValidations>' if out else ""


def _sheet_parts(s: SheetInput, index: int, styles: Styles, parts: _Parts, date1904: bool) -> Iterator[tuple[str, Content]]:
    """(part name, content) of a sheet and all that hangs on it.  A streamed sheet's part comes in pieces, without its dimension."""
    seen: dict = {}
    name = f"xl/worksheets/sheet{index}.xml"
    before, merges = _before_data(s), _merges(s)
    relations: list[tuple[str, str, bool]] = []
    extra: list[tuple[str, str | bytes]] = []

    def relate(kind: str, target: str, external: bool = False) -> str:
        relations.append((kind, target, external))
        return f"rId{len(relations)}"

    def after_data() -> str:
        after = [tag("sheetProtection", {"sheet": True} | s.protection) if s.protection is not None else ""]
        if s.autofilter:
            _range(s.autofilter, "autofilter")
            after.append(tag("autoFilter", {"ref": s.autofilter}))
        after += [merges, _conditional(s, styles), _validations(s)]
        links = []
        for h in s.hyperlinks:
            _range(h["ref"], "hyperlink")
            if h.get("target") or h.get("location"):
                links.append(tag("hyperlink", {"ref": h["ref"], "r:id": relate("hyperlink", h["target"], True) if h.get("target") else None, "location": h.get("location"), "tooltip": h.get("tooltip"), "display": h.get("display")}))
        after.append(f"<hyperlinks>{''.join(links)}</hyperlinks>" if links else "")
        after.append(tag("printOptions", s.print_options) if s.print_options else "")
        if s.margins:
            need(all(0 <= float(v) <= 49 for v in s.margins.values()), "a margin is 0 to 49")
            after.append(tag("pageMargins", {k: float(s.margins.get(k, 0.7)) for k in ("left", "right", "top", "bottom", "header", "footer")}))
        if s.page_setup:
            need(10 <= int(s.page_setup.get("scale", 100)) <= 400, "a scale is 10 to 400")
            after.append(tag("pageSetup", s.page_setup))
        if s.header_footer:
            after.append(f"<headerFooter>{''.join(text_tag(k, s.header_footer[k]) for k in ('oddHeader', 'oddFooter', 'evenHeader', 'evenFooter') if k in s.header_footer)}</headerFooter>")
        if s.images:
            n = parts.next("drawing")
            after.append(tag("drawing", {"r:id": relate("drawing", f"../drawings/drawing{n}.xml")}))
            extra.extend(_drawing(s, n, parts))
        if s.comments:
            n = parts.next("comments")
            relate("comments", f"../comments{n}.xml")
            after.append(tag("legacyDrawing", {"r:id": relate("vmlDrawing", f"../drawings/vmlDrawing{n}.vml")}))
            extra.extend(_comments(s, n, parts))
        tables = []
        for t in s.tables:
            n = parts.next("table")
            tables.append(tag("tablePart", {"r:id": relate("table", f"../tables/table{n}.xml")}))
            extra.append((f"xl/tables/table{n}.xml", _table(t, n, seen, parts, s)))
            parts.types[f"/xl/tables/table{n}.xml"] = "application/vnd.openxmlformats-officedocument.spreadsheetml.table+xml"
        after.append(f'<tableParts count="{len(tables)}">{"".join(tables)}</tableParts>' if tables else "")
        return "".join(after)

    parts.types["/" + name] = "application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"
    root = f'{HEAD}<worksheet xmlns="{MAIN}" xmlns:r="{REL}">'

    def pieces() -> Iterator[str]:
        yield f"{root}{before}<sheetData>"
        yield from rows_xml(s, styles, date1904, seen)
        yield f"</sheetData>{after_data()}</worksheet>"

    if s.streamed:
        yield name, pieces()
    else:
        data = "".join(rows_xml(s, styles, date1904, seen))
        size = f"{format_cell(seen['columns'][0], seen['rows'][0])}:{format_cell(seen['columns'][1], seen['rows'][1])}" if "columns" in seen else "A1"
        yield name, f'{root}<dimension ref="{size}"/>{before}<sheetData>{data}</sheetData>{after_data()}</worksheet>'
    if relations:
        yield f"xl/worksheets/_rels/sheet{index}.xml.rels", _relations([(k, t, e) for k, t, e in relations])
    yield from extra


def _relations(found: list[tuple[str, str, bool]]) -> str:
    body = "".join(tag("Relationship", {"Id": f"rId{i}", "Type": f"{REL}/{kind}", "Target": target, "TargetMode": "External" if external else None}) for i, (kind, target, external) in enumerate(found, 1))
    return f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships">{body}</Relationships>'


def _table(t: dict, n: int, seen: dict, parts: _Parts, s: SheetInput) -> str:
    r = _range(t["ref"], "table")
    need(_is_name(t["name"]) and t["name"].upper() not in parts.tables, f"a table's name is new and an identifier: {t['name']!r}")
    parts.tables.add(t["name"].upper())
    need(not any(overlaps(r, _range(o["ref"], "table")) for o in s.tables if o is not t), "tables overlap")
    need(r[3] - r[1] >= (2 if t.get("totals") else 1), "a table has a row below its header")
    width = r[2] - r[0] + 1
    columns = t.get("columns") or [seen.get("headers", {}).get((r[1], c)) for c in range(r[0], r[2] + 1)]
    need(len(columns) == width and all(isinstance(c, str) and c for c in columns) and len({c.upper() for c in columns}) == width, "a table's columns have different names, one for each")
    names = "".join(tag("tableColumn", {"id": i, "name": c}) for i, c in enumerate(columns, 1))
    a = {"xmlns": MAIN, "id": n, "name": t["name"], "displayName": t["name"], "ref": t["ref"], "totalsRowCount": 1 if t.get("totals") else None}
    body = f"{tag('autoFilter', {'ref': t['ref'] if not t.get('totals') else f'{format_cell(r[0], r[1])}:{format_cell(r[2], r[3] - 1)}'})}<tableColumns count=\"{width}\">{names}</tableColumns>{tag('tableStyleInfo', {'name': t.get('style', 'TableStyleMedium9'), 'showRowStripes': True})}"
    return HEAD + tag("table", a, body)


def _comments(s: SheetInput, n: int, parts: _Parts) -> list[tuple[str, str]]:
    authors = list(dict.fromkeys(c.get("author", "") for c in s.comments))
    items, shapes = [], []
    for c in s.comments:
        r = _range(c["ref"], "comment")
        need((r[0], r[1]) == (r[2], r[3]), "a comment is on one cell")
        items.append(tag("comment", {"ref": c["ref"], "authorId": authors.index(c.get("author", ""))}, f"<text>{text_tag('t', c['text'])}</text>"))
        shapes.append(
            f'<v:shape type="#_x0000_t202" style="position:absolute;visibility:hidden" fillcolor="#ffffe1"><v:textbox/><x:ClientData ObjectType="Note"><x:MoveWithCells/><x:SizeWithCells/><x:AutoFill>False</x:AutoFill><x:Row>{r[1] - 1}</x:Row><x:Column>{r[0] - 1}</x:Column></x:ClientData></v:shape>'
        )
    need(len({c["ref"] for c in s.comments}) == len(s.comments), "two comments on one cell")
    parts.types[f"/xl/comments{n}.xml"] = "application/vnd.openxmlformats-officedocument.spreadsheetml.comments+xml"
    parts.extensions.add("vml")
    names = "".join(text_tag("author", a) for a in authors)
    vml = f'<xml xmlns:v="urn:schemas-microsoft-com:vml" xmlns:o="urn:schemas-microsoft-com:office:office" xmlns:x="urn:schemas-microsoft-com:office:excel"><v:shapetype id="_x0000_t202" coordsize="21600,21600" o:spt="202" path="m,l,21600r21600,l21600,xe"/>{"".join(shapes)}</xml>'
    return [(f"xl/comments{n}.xml", f'{HEAD}<comments xmlns="{MAIN}"><authors>{names}</authors><commentList>{"".join(items)}</commentList></comments>'), (f"xl/drawings/vmlDrawing{n}.vml", vml)]


def _drawing(s: SheetInput, n: int, parts: _Parts) -> list[tuple[str, str | bytes]]:
    out: list[tuple[str, str | bytes]] = []
    anchors, relations = [], []
    for i, image in enumerate(s.images, 1):
        ext = image["extension"].lower()
        need(ext in MEDIA, f"an image is one of {', '.join(MEDIA)}")
        key = (image["bytes"], ext)
        if key not in parts.media:  # equal images are stored once
            parts.media[key] = f"image{len(parts.media) + 1}.{ext}"
            parts.extensions.add(ext)
            out.append((f"xl/media/{parts.media[key]}", image["bytes"]))
        relations.append(("image", f"../media/{parts.media[key]}", False))
        (c1, r1), (c2, r2) = image["from"], image.get("to", (image["from"][0] + 2, image["from"][1] + 5))
        need(0 <= c1 <= c2 < MAX_COL and 0 <= r1 <= r2 < MAX_ROW, "an image lies within the grid")
        corner = lambda name, c, r: f"<xdr:{name}><xdr:col>{c}</xdr:col><xdr:colOff>0</xdr:colOff><xdr:row>{r}</xdr:row><xdr:rowOff>0</xdr:rowOff></xdr:{name}>"
        anchors.append(
            f'<xdr:twoCellAnchor>{corner("from", c1, r1)}{corner("to", c2, r2)}<xdr:pic><xdr:nvPicPr><xdr:cNvPr id="{i}" name="Picture {i}"/><xdr:cNvPicPr/></xdr:nvPicPr><xdr:blipFill><a:blip r:embed="rId{i}"/><a:stretch><a:fillRect/></a:stretch></xdr:blipFill><xdr:spPr><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></xdr:spPr></xdr:pic><xdr:clientData/></xdr:twoCellAnchor>'
        )
    parts.types[f"/xl/drawings/drawing{n}.xml"] = "application/vnd.openxmlformats-officedocument.drawing+xml"
    body = f'{HEAD}<xdr:wsDr xmlns:xdr="http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="{REL}">{"".join(anchors)}</xdr:wsDr>'
    return [(f"xl/drawings/drawing{n}.xml", body), (f"xl/drawings/_rels/drawing{n}.xml.rels", _relations(relations)), *out]


# --- workbook -------------------------------------------------------------------------------------


def _is_name(s: object) -> bool:
    """An identifier that can't be taken for a cell, R or C."""
    if not isinstance(s, str) or not 1 <= len(s) <= 255 or not re.fullmatch(r"[A-Za-z_\\\u0080-\U0010ffff][\w.\\?]*", s):
        return False
    return not re.fullmatch(r"[A-Za-z]{1,3}[0-9]{1,7}|[RrCc]|[Rr]\d*[Cc]\d*", s)


def _check_sheet(s: SheetInput) -> None:
    need(isinstance(s.name, str) and 1 <= len(s.name) <= 31 and not re.search(r"[\\/?*\[\]:\x00-\x1f]", s.name) and not (s.name.startswith("'") or s.name.endswith("'")), f"not a sheet name: {s.name!r}")
    need(s.state in ("visible", "hidden", "veryHidden"), f"not a state: {s.state!r}")


def _check(sheets: list[SheetInput], given: list[dict]) -> None:
    need(bool(sheets), "a workbook has a sheet")
    need(any(s.state == "visible" for s in sheets), "a workbook has a visible sheet")
    need(len({s.name.upper() for s in sheets}) == len(sheets), "two sheets have one name")
    keys = [(n.get("sheet_index"), n["name"].upper()) for n in given]
    need(len(set(keys)) == len(keys), "two names are the same")
    for n in given:
        need(_is_name(n["name"]) or n["name"].startswith("_xlnm."), f"not a name: {n['name']!r}")
        need(n.get("sheet_index") is None or 0 <= n["sheet_index"] < len(sheets), "a name's sheet doesn't exist")


def workbook_parts(book: WorkbookInput) -> Iterator[tuple[str, Content]]:
    """All parts: sheets first, then what is known only after them.  Sheets may come one by one; a list is checked before any is written."""
    if isinstance(book.sheets, list):
        for s in book.sheets:
            _check_sheet(s)
        _check(book.sheets, book.names)
    styles, parts = Styles(book.styles), _Parts()
    done: list[SheetInput] = []
    for s in book.sheets:
        _check_sheet(s)
        done.append(s)
        yield from _sheet_parts(s, len(done), styles, parts, book.date1904)
    _check(done, book.names)
    book = replace(book, sheets=done)
    names = list(book.names)
    for i, s in enumerate(book.sheets):
        if s.autofilter:
            r = _range(s.autofilter, "autofilter")
            quoted = "'" + s.name.replace("'", "''") + "'"
            names.append({"name": "_xlnm._FilterDatabase", "refers_to": f"{quoted}!${column_letters(r[0])}${r[1]}:${column_letters(r[2])}${r[3]}", "sheet_index": i, "hidden": True})
    sheets = "".join(tag("sheet", {"name": s.name, "sheetId": i, "state": None if s.state == "visible" else s.state, "r:id": f"rId{i}"}) for i, s in enumerate(book.sheets, 1))
    defined = "".join(text_tag("definedName", n["refers_to"].removeprefix("="), {"name": n["name"], "localSheetId": n.get("sheet_index"), "hidden": True if n.get("hidden") else None}) for n in names)
    yield "xl/styles.xml", styles.xml()
    n = len(book.sheets)
    yield (
        "xl/workbook.xml",
        f'{HEAD}<workbook xmlns="{MAIN}" xmlns:r="{REL}">{tag("workbookPr", {"date1904": True if book.date1904 else None})}{tag("workbookProtection", book.protection) if book.protection is not None else ""}<sheets>{sheets}</sheets>{f"<definedNames>{defined}</definedNames>" if defined else ""}</workbook>',
    )
    related = [("worksheet", f"worksheets/sheet{i}.xml", False) for i in range(1, n + 1)] + [("styles", "styles.xml", False)]
    yield "xl/_rels/workbook.xml.rels", _relations(related + ([("theme", "theme/theme1.xml", False)] if book.theme else []))
    if book.theme:
        yield "xl/theme/theme1.xml", book.theme
        parts.types["/xl/theme/theme1.xml"] = "application/vnd.openxmlformats-officedocument.theme+xml"
    yield "_rels/.rels", _relations([("officeDocument", "xl/workbook.xml", False)])
    types = {"/xl/workbook.xml": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml", "/xl/styles.xml": "application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"} | parts.types
    defaults = {"rels": "application/vnd.openxmlformats-package.relationships+xml", "xml": "application/xml"}
    defaults |= {e: "application/vnd.openxmlformats-officedocument.vmlDrawing" if e == "vml" else MEDIA[e] for e in sorted(parts.extensions)}
    body = "".join(tag("Default", {"Extension": e, "ContentType": t}) for e, t in defaults.items()) + "".join(tag("Override", {"PartName": p, "ContentType": t}) for p, t in types.items())
    yield "[Content_Types].xml", f'{HEAD}<Types xmlns="{PACKAGE}/content-types">{body}</Types>'


def write_xlsx(book: WorkbookInput, out: io.IOBase | None = None) -> bytes | None:
    """The file's bytes, or written to ``out``."""
    buffer = out or io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as z:
        for name, content in workbook_parts(book):
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type, info.external_attr, info.create_system = zipfile.ZIP_DEFLATED, 0, 0
            if isinstance(content, (str, bytes)):
                z.writestr(info, content.encode("utf-8", "surrogatepass") if isinstance(content, str) else content)
                continue
            with z.open(info, "w") as f:
                for piece in content:
                    f.write(piece.encode("utf-8", "surrogatepass"))
    return None if out else buffer.getvalue()


def from_workbook(book: Workbook) -> WorkbookInput:
    """What a reader gave, as input: cells, names, merges, links, comments, tables, freezes, filters, validations, widths."""
    taken: set[str] = set()
    sheets = []
    for s in book.sheets:
        meta = lambda kind, s=s: s.meta.get(kind, [])
        cells = sorted({(c.row, c.col): c for c in s.cells}.values(), key=lambda c: (c.row, c.col))
        tables = []
        for ref, t in meta("table"):
            if t["name"].upper() not in taken:
                taken.add(t["name"].upper())
                tables.append({"name": t["name"], "ref": ref, "columns": t["columns"], "totals": t["totals"]})
        copy = SheetInput(s.name, _by_row(cells), s.state, tables=tables)
        copy.merges = [r for r, _ in meta("merge")]
        copy.hyperlinks = [{"ref": r, **d} for r, d in meta("hyperlink")]
        copy.comments = [{"ref": r, **d} for r, d in meta("comment")]
        copy.freeze = next((d for _, d in meta("freeze")), None)
        copy.autofilter = next((r for r, _ in meta("autofilter")), None)
        copy.validations = [{"sqref": r, **{k: v for k, v in d.items() if isinstance(v, str) and k != "sqref"}, **{k: d[k][0].get("text", "") for k in ("formula1", "formula2") if k in d}} for r, d in meta("validation")]
        copy.columns = [{"min": int(d["min"]), "max": int(d["max"]), **({"width": float(d["width"])} if "width" in d else {}), "hidden": d.get("hidden") in ("1", "true")} for _, d in meta("column")]
        copy.row_properties = {int(r): {"height": float(d["ht"]) if "ht" in d else None, "hidden": d.get("hidden") in ("1", "true")} for r, d in meta("row")}
        copy.images = [{"bytes": d["bytes"], "extension": d["name"].rpartition(".")[2], "from": (d["from"]["col"], d["from"]["row"])} for _, d in meta("image")]
        copy.margins = next(({k: float(v) for k, v in d.items()} for _, d in meta("margins")), None)
        copy.protection = next(({k: v for k, v in d.items() if k != "sheet"} for _, d in meta("protection")), None)
        copy.page_setup = next(({k: v for k, v in d.items() if k != "id"} for _, d in meta("page_setup")), None)
        copy.print_options = next((d for _, d in meta("print_options")), None)
        copy.header_footer = next(({k: d[k][0].get("text", "") for k in ("oddHeader", "oddFooter", "evenHeader", "evenFooter") if k in d} for _, d in meta("header_footer")), None)
        dxfs = book.meta.get("dxfs", [])
        for ref, d in meta("conditional"):
            a = dict(d["attributes"])
            kind, priority, dxf = a.pop("type", "expression"), int(a.pop("priority", "1")), a.pop("dxfId", None)
            rule = {"ref": ref, "type": kind, "priority": priority, "formulas": d["formulas"], "attributes": a, "body": d["body"]}
            copy.conditional.append(rule | ({"style": {"xml": dxfs[int(dxf)]}} if dxf is not None and int(dxf) < len(dxfs) else {}))
        sheets.append(copy)
    names = {(n["sheet_index"], n["name"].upper()): n for n in book.names if not n["name"].startswith("_xlnm._FilterDatabase")}
    styles = book.meta.get("styles") or [{"format": f} if f else {} for f in book.formats]
    protection = next(iter(book.meta.get("protection", [])), None)
    theme = next((t["xml"] for t in book.meta.get("theme", [])), None)
    return WorkbookInput(sheets, list(names.values()), styles, protection, bool(book.meta.get("date1904", [False])[0]), theme)


def _by_row(cells: Iterable[Cell]) -> Iterator[tuple[int, list[Cell]]]:
    for row, own in itertools.groupby(cells, key=lambda c: c.row):
        yield row, list(own)


def crc32(data: bytes) -> int:
    return zlib.crc32(data)
