"""The value domain of formulas: None (blank), float, str, bool, Err and Area; coercions and operators."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from decimal import Decimal

#: The error codes of cells, and the evaluator's own for cycles.
CODES = ("#NULL!", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A", "#GETTING_DATA")
CYCLE = "#CYCLE!"


class Err(str):
    """An error value; equal codes are equal."""

    __slots__ = ()


DIV0, VALUE, REF, NAME, NUM, NA = Err("#DIV/0!"), Err("#VALUE!"), Err("#REF!"), Err("#NAME?"), Err("#NUM!"), Err("#N/A")


def error_from(text: str) -> Err:
    return Err(text) if text in CODES else VALUE


class Area:
    """A lazy rectangle over used cells.  ``used`` lists (row, column); ``get`` takes (column, row)."""

    __slots__ = ("c1", "c2", "get", "r1", "r2", "sheet", "used")

    def __init__(self, sheet: str, c1: int, r1: int, c2: int, r2: int, used: Callable[[], list[tuple[int, int]]], get: Callable[[int, int], object]) -> None:
        self.sheet, self.c1, self.r1, self.c2, self.r2, self.used, self.get = sheet, c1, r1, c2, r2, used, get

    width = property(lambda self: self.c2 - self.c1 + 1)
    height = property(lambda self: self.r2 - self.r1 + 1)
    size = property(lambda self: self.width * self.height)
    is_single = property(lambda self: self.c1 == self.c2 and self.r1 == self.r2)

    def items(self) -> Iterator[tuple[int, int, object]]:
        """(row offset, column offset, value) of used cells, by row and column."""
        for row, col in self.used():
            yield row - self.r1, col - self.c1, self.get(col, row)

    def values(self) -> Iterator[object]:
        for row, col in self.used():
            yield self.get(col, row)

    def at(self, down: int, right: int) -> object:
        col, row = self.c1 + right, self.r1 + down
        return self.get(col, row) if self.c1 <= col <= self.c2 and self.r1 <= row <= self.r2 else None


_NUMERIC = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", re.A)
_BLANKS = " \t\n\v\f\r                 　﻿"


def numeric_text(s: str) -> float | None:
    s = s.strip(_BLANKS)
    if not _NUMERIC.fullmatch(s):
        return None
    x = float(s)
    return x if math.isfinite(x) else None


def single(v: object) -> object:
    """A scalar: the cell of a one-cell area (repeatedly), #VALUE! for a larger one."""
    for _ in range(64):
        if not isinstance(v, Area):
            return v
        if not v.is_single:
            return VALUE
        v = v.at(0, 0)
    return VALUE if isinstance(v, Area) else v


def top_left(v: object) -> object:
    """What a formula cell shows: the first cell of an area."""
    for _ in range(64):
        if not isinstance(v, Area):
            return v
        v = v.at(0, 0)
    return Err(CYCLE) if isinstance(v, Area) else v


class Stop(Exception):
    """Carries an error value out of a function."""

    def __init__(self, err: Err) -> None:
        self.err = err


def ok(v: object) -> object:
    v = single(v)
    if isinstance(v, Err):
        raise Stop(v)
    return v


def num(v: object) -> float:
    v = ok(v)
    if v is None:
        return 0.0
    if isinstance(v, str):
        x = numeric_text(v)
        if x is None:
            raise Stop(VALUE)
        return x
    return float(v)


def whole(v: object) -> float:
    """Truncated; infinities stay."""
    x = num(v)
    return float(math.trunc(x)) if math.isfinite(x) else x


def general(x: float) -> str:
    if x == 0:
        return "0"
    if x.is_integer() and abs(x) < 1e16:
        return str(int(x))
    digits = Decimal(f"{x:.14e}")
    exponent = digits.adjusted()
    if exponent < -6 or exponent >= 15:
        mantissa, e = f"{x:.14e}".split("e")
        return f"{mantissa}e{int(e):+d}"
    out = f"{digits:.{14 - exponent}f}"
    return out.rstrip("0").rstrip(".") if "." in out else out


def text(v: object) -> str:
    v = ok(v)
    if v is None:
        return ""
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    return general(v) if isinstance(v, float) else v


def truth(v: object) -> bool:
    v = ok(v)
    if isinstance(v, str):
        raise Stop(VALUE)
    return bool(v)


def _rank(v: object) -> int:
    return 2 if isinstance(v, bool) else 1 if isinstance(v, str) else 0


def utf16(s: str) -> bytes:
    """Sorts as UTF-16 code units do."""
    return s.encode("utf-16-be", "surrogatepass")


def compare(a: object, b: object) -> int:
    a, b = ok(a), ok(b)
    if a is None and b is None:
        return 0
    blank_as = {0: 0.0, 1: "", 2: False}
    a = blank_as[_rank(b)] if a is None else a
    b = blank_as[_rank(a)] if b is None else b
    if _rank(a) != _rank(b):
        return -1 if _rank(a) < _rank(b) else 1
    if isinstance(a, str):
        a, b = utf16(a.upper()), utf16(b.upper())
    return (a > b) - (a < b)


def finite(x: float) -> float:
    if not math.isfinite(x):
        raise Stop(NUM)
    return x


def power(x: float, y: float) -> float:
    if x == 0 and y < 0:
        raise Stop(DIV0)
    try:
        out = math.pow(x, y)
    except (OverflowError, ValueError):
        raise Stop(NUM) from None
    return finite(out)


def divide(x: float, y: float) -> float:
    if y == 0:
        raise Stop(DIV0)
    try:
        return finite(x / y)
    except OverflowError:
        raise Stop(NUM) from None


ARITHMETIC: dict[str, Callable[[float, float], float]] = {
    "+": lambda x, y: finite(x + y),
    "-": lambda x, y: finite(x - y),
    "*": lambda x, y: finite(x * y),
    "/": divide,
    "^": power,
}
COMPARISON: dict[str, Callable[[int], bool]] = {"=": lambda c: c == 0, "<>": lambda c: c != 0, "<": lambda c: c < 0, ">": lambda c: c > 0, "<=": lambda c: c <= 0, ">=": lambda c: c >= 0}


def binary(op: str, a: object, b: object) -> object:
    try:
        if op == "&":
            left = text(a)
            return left + text(b)
        if op in COMPARISON:
            return COMPARISON[op](compare(a, b))
        x = num(a)
        return ARITHMETIC[op](x, num(b))
    except Stop as e:
        return e.err
