"""Reading .xlsx and .xlsm: cells streamed from sheet parts, metadata from the small rest of each part."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

from ..errors import WorkbookError
from ..functions.refs import MAX_COL, MAX_ROW, column_letters, column_number, format_cell, parse_cell
from ..plans.syntax import translate
from .model import Cell, Sheet, Workbook, format_of, number_cell
from .package import Builder, Element, Package, local, parse_events, parse_steps, tree, unescape_text
from .theme import theme_colors

#: Parts of a sheet that are notes of one kind each: element, kind, attribute that holds the reference.
_NOTES = {
    "sheetProtection": "protection",
    "autoFilter": "autofilter",
    "pageMargins": "margins",
    "pageSetup": "page_setup",
    "printOptions": "print_options",
    "headerFooter": "header_footer",
    "sheetPr": "properties",
    "sheetFormatPr": "defaults",
}


def rich_text(e: Element) -> str:
    """Text of a string item: its runs joined, phonetic text left out."""
    return unescape_text("".join((c.text if c.name == "t" else "".join(t.text for t in c.children if t.name == "t")) for c in e.children if c.name in ("t", "r")))


class _Sheet:
    """Handlers that collect one sheet's cells row by row, and trees for what is outside sheetData."""

    def __init__(self, strings: list[str], dates: list[bool], date1904: bool) -> None:
        self.strings, self.dates, self.date1904 = strings, dates, date1904
        self.rest, self.cells = Builder(), []
        self.row, self.col, self.depth, self.row_text = 0, 0, 0, "0"
        self.inside, self.cell, self.taking, self.done = False, None, None, False
        self.column_styles: list[tuple[int, int, int]] = []
        self.row_style: int | None = None
        self.rows: list[tuple[int, dict[str, str]]] = []
        self.masters: dict[str, tuple[str, int, int]] = {}

    def open(self, name: str, a: dict[str, str]) -> None:
        if ":" in name:
            name = local(name)
        if not self.inside:
            if name == "sheetData":
                self.inside = True
                return
            if name == "col" and self.rest.stack[-1].name == "cols" and "style" in a:
                self.column_styles.append((_int(a.get("min"), 1), _int(a.get("max"), 1), _int(a["style"], 0)))
            self.rest.open(name, a)
        elif name == "c":
            self.col += 1
            ref = a.get("r")
            if ref is not None and ref != column_letters(self.col) + self.row_text:
                try:
                    self.col, self.row = parse_cell(ref)
                    self.row_text = str(self.row)
                except WorkbookError:
                    pass
            self.cell = {"t": a.get("t", "n"), "s": a.get("s"), "v": "", "f": None, "fa": a, "runs": None}
        elif name == "row":
            self.row = _int(a.get("r"), self.row + 1)
            self.col, self.row_text = 0, str(self.row)
            self.row_style = _int(a["s"], 0) if a.get("customFormat") in ("1", "true") and "s" in a else None
            extra = {k: v for k, v in a.items() if k not in ("r", "spans", "s", "customFormat") and ":" not in k}
            if extra:
                self.rows.append((self.row, extra))
        elif name == "rPh":
            self.taking = None
            self.depth += 1
        elif self.cell is not None and name in ("v", "f", "t"):
            self.taking = name
            if name == "f":
                self.cell["f"], self.cell["fa"] = "", a

    def close(self, name: str) -> None:
        if ":" in name:
            name = local(name)
        if not self.inside:
            self.rest.close(name)
        elif name == "c":
            if self.cell is not None and self.row <= MAX_ROW and self.col <= MAX_COL:
                self.cells.append(self.decode(self.cell))
            self.cell = None
        elif name in ("v", "f", "t"):
            self.taking = None
        elif name == "sheetData":
            self.inside, self.done = False, True
        elif name == "rPh":
            self.depth -= 1

    def text(self, s: str) -> None:
        if not self.inside:
            self.rest.data(s)
        elif self.cell is not None and self.taking and not self.depth:
            if self.taking == "t":
                self.cell["runs"] = (self.cell["runs"] or "") + s
            else:
                self.cell[self.taking] += s

    def style(self, own: str | None) -> int:
        """The cell's, else the row's, else the column's, else style 0."""
        if own is not None:
            return _int(own, 0)
        if self.row_style is not None:
            return self.row_style
        return next((s for a, b, s in self.column_styles if a <= self.col <= b), 0) if self.column_styles else 0

    def formula(self, c: dict) -> str | None:
        if c["f"] is None or c["fa"].get("t") == "dataTable":
            return None
        body = unescape_text(c["f"])
        if c["fa"].get("t") == "shared":
            key = c["fa"].get("si", "")
            if body:
                self.masters.setdefault(key, (body, self.row, self.col))
            elif key in self.masters:
                master, row, col = self.masters[key]
                try:
                    return translate(master, self.row - row, self.col - col) if len(master) <= 8192 else None
                except Exception as e:  # noqa: BLE001 - a master that can't be read stays as it is
                    if not hasattr(e, "code"):
                        raise
                    return None
        return body or None

    def decode(self, c: dict) -> Cell:
        kind, v, style, formula = c["t"], c["v"], self.style(c["s"]), None if c["f"] is None else self.formula(c)
        at = (self.row, self.col)
        if kind == "s":
            i = _int(v, -1)
            return Cell(*at, "string", self.strings[i], formula, style) if 0 <= i < len(self.strings) else Cell(*at, "empty", None, formula, style)
        if kind == "inlineStr":
            return Cell(*at, "string", unescape_text(c["runs"] or ""), formula, style)
        if kind == "str":
            return Cell(*at, "string", unescape_text(v), formula, style)
        if kind == "b":
            return Cell(*at, "boolean", v.strip() == "1", formula, style)
        if kind == "e":
            return Cell(*at, "error", v, formula, style)
        try:
            x = float(v)
        except ValueError:
            x = float("nan")
        if x - x != 0:
            return Cell(*at, "empty", None, formula, style)
        return number_cell(*at, x, style < len(self.dates) and self.dates[style], self.date1904, formula, style)


def _int(s: str | None, otherwise: int) -> int:
    try:
        return int(s)
    except (TypeError, ValueError):
        return otherwise


def color_data(e: Element | None) -> str | dict | None:
    """ARGB where it is given, else theme number and tint, index, or automatic."""
    if e is None:
        return None
    if re.fullmatch("[0-9A-Fa-f]{6}|[0-9A-Fa-f]{8}", e.get("rgb", "")):
        return e.get("rgb")
    if e.get("theme", "").isdigit():
        try:
            tint = float(e.get("tint", "0"))
        except ValueError:
            tint = 0.0
        return {"theme": int(e.get("theme")), **({"tint": tint} if tint else {})}
    if e.get("indexed", "").isdigit():
        return {"indexed": int(e.get("indexed"))}
    return {"auto": True} if e.get("auto") in ("1", "true") else None


def _font_data(font: Element) -> dict:
    out: dict = {}
    on = lambda e: e is not None and e.get("val") not in ("0", "false", "none")
    for t, k in (("b", "bold"), ("i", "italic"), ("strike", "strike")):
        if on(font.first(t)):
            out[k] = True
    if on(font.first("u")):
        out["underline"] = {None: True, "single": True}.get(font.first("u").get("val"), font.first("u").get("val"))
    color = color_data(font.first("color"))
    if color:
        out["color"] = color
    for t, k in (("name", "font"), ("sz", "size")):
        v = font.first(t).get("val") if font.first(t) is not None else None
        if v:
            out[k] = float(v) if k == "size" else v
    return out


def _fill_data(pattern: Element | None) -> str | dict | None:
    """A solid fill's colour, or pattern and colours."""
    kind = pattern.get("patternType", "none") if pattern is not None else "none"
    if kind == "none":
        return None
    fore, back = color_data(pattern.first("fgColor")), color_data(pattern.first("bgColor"))
    if kind == "solid" and fore and not isinstance(back, str):
        return fore
    return {k: v for k, v in (("pattern", kind), ("fore", fore), ("back", back)) if v}


def _border_data(border: Element) -> str | dict | None:
    """The one line of all four sides, or line and colour by side."""
    sides = {c.name: {k: v for k, v in (("style", c.get("style")), ("color", color_data(c.first("color")))) if v} for c in border.children if c.get("style") and c.get("style") != "none"}
    sides = {k: v for k, v in sides.items() if k in ("left", "right", "top", "bottom")}
    if not sides:
        return None
    lines = {v["style"] for v in sides.values()}
    return lines.pop() if len(sides) == 4 and len(lines) == 1 and not any("color" in v for v in sides.values()) else sides


def style_data(root: Element, formats: list[str | None]) -> list[dict]:
    """Cell styles as the writer takes them: format, font, fill, border, alignment and protection."""
    group = lambda name: next((e.children for e in root.all(name)), [])
    fonts, fills, borders = group("fonts"), group("fills"), group("borders")
    out = []
    for xf, code in zip(group("cellXfs"), formats, strict=False):
        s: dict = {"format": code} if code else {}
        pick = lambda table, key, xf=xf: table[_int(xf.get(key), 0)] if 0 <= _int(xf.get(key), 0) < len(table) else None
        font, fill, border, align, lock = pick(fonts, "fontId"), pick(fills, "fillId"), pick(borders, "borderId"), xf.first("alignment"), xf.first("protection")
        if font is not None and _int(xf.get("fontId"), 0):
            s |= _font_data(font)
        s |= {k: v for k, v in (("fill", _fill_data(fill.first("patternFill")) if fill is not None and _int(xf.get("fillId"), 0) > 1 else None), ("border", _border_data(border) if border is not None else None)) if v}
        if align is not None:
            s |= {k: align.get(a) for a, k in (("horizontal", "align"), ("vertical", "valign")) if align.get(a)}
            s |= {k: _int(align.get(a), 0) for a, k in (("textRotation", "rotation"), ("indent", "indent")) if _int(align.get(a), 0)}
            s |= {k: True for a, k in (("wrapText", "wrap"), ("shrinkToFit", "shrink")) if align.get(a) in ("1", "true")}
        if lock is not None:
            s |= {k: lock.get(k) in ("1", "true") for k in ("locked", "hidden") if lock.get(k) is not None}
        out.append(s)
    return out


def _styles(root: Element) -> tuple[list[str | None], list[bool], list[object]]:
    """Number format and date flag by style, and the tree of styles as data."""
    custom = {_int(e.get("numFmtId"), -1): e.get("formatCode", "") for e in root.all("numFmt")}
    xfs = next(iter(root.all("cellXfs")), None)
    found = [format_of(_int(x.get("numFmtId"), 0), custom) for x in (xfs.children if xfs else [])]
    plain = [f for f, _ in found]
    return plain, [d for _, d in found], style_data(root, plain)


def open_xlsx(data: bytes, only: str | None = None, metadata: bool = True, **guards: float) -> Workbook:
    package = Package(data, **guards)
    main = next((target for kind, target, _ in package.relations("").values() if kind == "officeDocument"), None)
    if main is None or main not in package:
        if "[Content_Types].xml" not in package:
            raise WorkbookError("not-xlsx", "not a spreadsheet package")
        raise WorkbookError("missing-part", "no workbook part")
    root, relations = tree(package.chunks(main)), package.relations(main)
    book = root.first("workbook")
    if book is None:
        raise WorkbookError("not-xlsx", "no workbook element")
    part = {kind: target for kind, target, _ in reversed(relations.values())}
    strings = [rich_text(e) for e in _items(package, part.get("sharedStrings"))]
    sheet_styles = tree(package.chunks(part["styles"])) if part.get("styles") in package else Element("", {})
    formats, dates, styles = _styles(sheet_styles)
    prop = book.first("workbookPr")
    date1904 = prop is not None and prop.get("date1904") in ("1", "true")
    names = [
        {"name": e.get("name", ""), "refers_to": e.text, "sheet_index": _int(e.get("localSheetId"), -1) if e.get("localSheetId") else None, "hidden": e.get("hidden") in ("1", "true")} for e in book.all("definedName")
    ]
    dxfs = [e.xml() for d in sheet_styles.all("dxfs") for e in d.children]
    protection = [e.data() for e in book.children if e.name == "workbookProtection"]
    out = Workbook("xlsx", [], names, formats, {"styles": styles, "dxfs": dxfs, "protection": protection, "date1904": [date1904]})
    if part.get("theme") in package:
        raw = package.read(part["theme"])
        out.meta["theme"] = [{"colors": theme_colors(tree(iter([raw]))), "xml": raw.decode("utf-8", "replace")}]
    for e in book.all("sheet"):
        kind, target, _ = relations.get(e.get("id", ""), ("", "", False))
        state = e.get("state", "visible")
        sheet = Sheet(e.get("name", ""), state if state in ("hidden", "veryHidden") else "visible", target)
        out.sheets.append(sheet)
        if kind == "worksheet" and target in package and only in (None, sheet.name):
            if metadata:
                _read_sheet(package, sheet, strings, dates, date1904)
            else:
                sheet.cells = _Cells(package, target, strings, dates, date1904)
    if only is not None:
        out.sheet(only)
    return out


def _items(package: Package, part: str | None) -> list[Element]:
    if part is None or part not in package:
        return []
    sst = tree(package.chunks(part)).first("sst")
    return [e for e in sst.children if e.name == "si"] if sst else []


class _Cells:
    """A sheet's cells as its part is parsed, chunk by chunk, anew with each iteration."""

    def __init__(self, package: Package, part: str, *context: object) -> None:
        self.package, self.part, self.context = package, part, context

    def __iter__(self) -> Iterator[Cell]:
        reader = _Sheet(*self.context)
        for _ in parse_steps(self.package.chunks(self.part), reader.open, reader.close, reader.text):
            yield from reader.cells
            reader.cells.clear()
            if reader.done:
                return
        yield from reader.cells


def _read_sheet(package: Package, sheet: Sheet, strings: list[str], dates: list[bool], date1904: bool) -> None:
    reader = _Sheet(strings, dates, date1904)
    parse_events(package.chunks(sheet.part), reader.open, reader.close, reader.text)
    sheet.cells = reader.cells
    root = reader.rest.root.first("worksheet") or reader.rest.root
    relations = package.relations(sheet.part)
    for row, a in reader.rows:
        sheet.note("row", str(row), a)
    for e in root.children:
        if e.name in _NOTES:
            sheet.note(_NOTES[e.name], e.get("ref"), e.data())
        elif e.name == "dimension":
            sheet.note("dimension", e.get("ref"), {})
        elif e.name == "cols":
            for c in e.children:
                sheet.note("column", f"{column_letters(max(1, _int(c.get('min'), 1)))}:{column_letters(max(1, _int(c.get('max'), 1)))}", c.data())
        elif e.name == "sheetViews":
            for pane in e.all("pane"):
                if pane.get("state") in ("frozen", "frozenSplit"):
                    sheet.note("freeze", pane.get("topLeftCell"), {"rows": _int(pane.get("ySplit"), 0), "columns": _int(pane.get("xSplit"), 0)})
        elif e.name == "mergeCells":
            for m in e.children:
                sheet.note("merge", m.get("ref"), {})
        elif e.name == "hyperlinks":
            for h in e.children:
                target = relations.get(h.get("id", ""), (None, None, False))[1]
                if target or h.get("location"):
                    sheet.note("hyperlink", h.get("ref"), {k: v for k, v in {"target": target, "location": h.get("location"), "tooltip": h.get("tooltip"), "display": h.get("display")}.items() if v is not None})
        elif e.name == "dataValidations":
            for v in e.children:
                sheet.note("validation", v.get("sqref"), v.data())
        elif e.name == "conditionalFormatting":
            for rule in e.children:
                if rule.name == "cfRule":
                    body = "".join(c.xml() for c in rule.children if c.name not in ("formula", "extLst"))
                    sheet.note("conditional", e.get("sqref"), {"attributes": rule.attributes, "formulas": [c.text for c in rule.children if c.name == "formula"], "body": body})
    for kind, target, _ in relations.values():
        if target not in package:
            continue
        if kind == "comments":
            _comments(sheet, tree(package.chunks(target)))
        elif kind == "table":
            t = tree(package.chunks(target)).first("table")
            if t is not None:
                sheet.note("table", t.get("ref"), {"name": t.get("displayName") or t.get("name"), "columns": [c.get("name") for c in t.all("tableColumn")], "header": t.get("headerRowCount") != "0", "totals": _int(t.get("totalsRowCount"), 0) > 0, "xml": t.data()})
        elif kind == "drawing":
            _images(package, sheet, target)


def _comments(sheet: Sheet, root: Element) -> None:
    authors = [a.text for a in root.all("author")]
    for c in root.all("comment"):
        body, i = c.first("text"), _int(c.get("authorId"), -1)
        sheet.note("comment", c.get("ref"), {"text": rich_text(body) if body else "", **({"author": authors[i]} if 0 <= i < len(authors) else {})})


def _images(package: Package, sheet: Sheet, drawing: str) -> None:
    relations = package.relations(drawing)
    for anchor in tree(package.chunks(drawing)).all("wsDr"):
        for a in anchor.children:
            blip = next(iter(a.all("blip")), None)
            target = relations.get(blip.get("embed", ""), ("", "", False))[1] if blip is not None else None
            start = a.first("from")
            if target in package and start is not None:
                place = {c.name: _int(c.text, 0) for c in start.children}
                sheet.note("image", format_cell(place.get("col", 0) + 1, place.get("row", 0) + 1), {"name": posixpath.basename(target), "bytes": package.read(target), "anchor": a.name, "from": place})


def stream_rows(data: bytes, sheet: str | None = None) -> Iterator[tuple[int, list[Cell]]]:
    """Sparse rows of one sheet (the first, if none is named), as its part is inflated: who stops early reads no further."""
    book = open_xlsx(data, sheet, metadata=False)
    yield from book.rows(sheet if sheet is not None else book.sheets[0].name)


__all__ = ["column_number", "open_xlsx", "rich_text", "stream_rows"]
