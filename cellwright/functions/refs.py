"""A1 references and date serials."""

from __future__ import annotations

import datetime as dt
import re
from functools import lru_cache

from ..errors import WorkbookError

MAX_ROW, MAX_COL = 1_048_576, 16_384
_CELL = re.compile(r"\$?([A-Za-z]{1,3})\$?([0-9]{1,7})")
EPOCH_1900 = dt.datetime(1899, 12, 30)
EPOCH_1904 = dt.datetime(1904, 1, 1)
DAY_MS = 86_400_000


@lru_cache(65536)
def column_number(letters: str) -> int:
    if not re.fullmatch("[A-Za-z]+", letters):
        raise WorkbookError("invalid-input", f"not a column: {letters!r}")
    n = 0
    for c in letters.upper():
        n = 26 * n + ord(c) - 64
    return n


@lru_cache(65536)
def column_letters(n: int) -> str:
    if n < 1:
        raise WorkbookError("invalid-input", f"not a column: {n}")
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def parse_cell(ref: str) -> tuple[int, int]:
    """(column, row) of a reference, with or without ``$``."""
    m = _CELL.fullmatch(ref)
    if not m or not int(m[2]):
        raise WorkbookError("invalid-input", f"not a cell: {ref!r}")
    return column_number(m[1]), int(m[2])


def format_cell(col: int, row: int) -> str:
    if row < 1:
        raise WorkbookError("invalid-input", f"not a row: {row}")
    return f"{column_letters(col)}{row}"


def parse_range(ref: str) -> tuple[int, int, int, int]:
    """(first column, first row, last column, last row) in the order given."""
    a, _, b = ref.partition(":")
    return (*parse_cell(a), *parse_cell(b or a))


def canonical_range(ref: str) -> tuple[int, int, int, int] | None:
    """The corners if ``ref`` is upper case, without ``$``, inside the grid and runs forward."""
    try:
        c1, r1, c2, r2 = parse_range(ref)
    except WorkbookError:
        return None
    again = format_cell(c1, r1) if ":" not in ref else f"{format_cell(c1, r1)}:{format_cell(c2, r2)}"
    return (c1, r1, c2, r2) if again == ref and c1 <= c2 <= MAX_COL and r1 <= r2 <= MAX_ROW else None


def _half_up(x: float) -> int:
    return int((x + 0.5) // 1)


def serial_to_datetime(serial: float, date1904: bool = False) -> dt.datetime | None:
    """Milliseconds are rounded; None outside the years 1 to 9999."""
    try:
        return (EPOCH_1904 if date1904 else EPOCH_1900) + dt.timedelta(milliseconds=_half_up(serial * DAY_MS))
    except (OverflowError, ValueError):
        return None


def datetime_to_serial(when: dt.datetime, date1904: bool = False) -> float:
    return ((when - (EPOCH_1904 if date1904 else EPOCH_1900)) // dt.timedelta(milliseconds=1)) / DAY_MS


def overlaps(a: tuple[int, int, int, int], b: tuple[int, int, int, int]) -> bool:
    return a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]
