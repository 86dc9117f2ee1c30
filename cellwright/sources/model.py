"""What every reader gives: sheets of cells with metadata."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

from ..errors import WorkbookError
from ..functions.refs import serial_to_datetime


class Cell(NamedTuple):
    row: int
    col: int
    type: str  # empty, number, string, boolean, date or error
    value: object
    formula: str | None = None
    style: int | None = None


@dataclass
class Sheet:
    name: str
    state: str = "visible"
    part: str = ""
    cells: Iterable[Cell] = ()
    #: kind: list of (reference or None, plain data)
    meta: dict[str, list[tuple[str | None, object]]] = field(default_factory=dict)

    def note(self, kind: str, ref: str | None, data: object) -> None:
        self.meta.setdefault(kind, []).append((ref, data))


@dataclass
class Workbook:
    format: str
    sheets: list[Sheet]
    names: list[dict] = field(default_factory=list)
    formats: list[str | None] = field(default_factory=list)  # number format by style
    meta: dict[str, list[object]] = field(default_factory=dict)

    def sheet(self, name: str) -> Sheet:
        found = next((s for s in self.sheets if s.name == name), None)
        if found is None:
            raise WorkbookError("no-such-sheet", f"no sheet {name!r}")
        return found

    def rows(self, name: str) -> Iterator[tuple[int, list[Cell]]]:
        """Sparse rows of a sheet, in document order."""
        row: list[Cell] = []
        for c in self.sheet(name).cells:
            if row and c.row != row[0].row:
                yield row[0].row, row
                row = []
            row.append(c)
        if row:
            yield row[0].row, row


#: The built-in number formats.
BUILTIN_FORMATS = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??",
    14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm",
    37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@",
}
#: Built-in ids that are dates.
BUILTIN_DATES = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def is_date_format(code: str) -> bool:
    """A date letter, or elapsed time in brackets, outside literals."""
    plain = re.sub(r'"[^"]*"|\\.|[_*].', "", code)
    return bool(re.search(r"\[(h+|m+|s+)\]", plain, re.I) or re.search(r"[dmyhs]", re.sub(r"\[[^\]]*\]", "", plain), re.I))


def format_of(number_format: int, custom: dict[int, str]) -> tuple[str | None, bool]:
    """Code and whether it is a date."""
    code = custom.get(number_format)
    if code is not None:
        return code, is_date_format(code)
    return BUILTIN_FORMATS.get(number_format), number_format in BUILTIN_DATES


def number_cell(row: int, col: int, x: float, is_date: bool, date1904: bool, formula: str | None, style: int | None) -> Cell:
    if is_date:
        when = serial_to_datetime(x, date1904)
        if when is not None:
            return Cell(row, col, "date", when, formula, style)
    return Cell(row, col, "number", x, formula, style)


__all__ = ["BUILTIN_DATES", "BUILTIN_FORMATS", "Cell", "Sheet", "Workbook", "dt", "format_of", "is_date_format", "number_cell"]
