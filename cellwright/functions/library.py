"""The function library, evaluated value by value: the exact form of all 97 built-ins.

A function takes its arguments' values (or, if lazy, functions that yield them) and returns a value; it
leaves with ``Stop`` to return an error.
"""

from __future__ import annotations

import datetime as dt
import math
import re
import statistics
from calendar import monthrange
from collections.abc import Callable, Iterable
from typing import NamedTuple

from .criteria import glob_matches, matches, parse_criterion
from .refs import EPOCH_1900, datetime_to_serial, serial_to_datetime
from .values import ARITHMETIC, CODES, DIV0, NA, NUM, REF, VALUE, Area, Err, Stop, compare, finite, numeric_text, ok, single, text, truth, whole
from .values import num as number

ANY = 10**9
MAX_TEXT = 32767
MAX_SERIAL = 2_958_465


class Function(NamedTuple):
    least: int
    most: int
    run: Callable
    lazy: bool = False
    volatile: bool = False


BUILTINS: dict[str, Function] = {}


def define(names: str, least: int, most: int, **kind: bool) -> Callable[[Callable], Callable]:
    def add(f: Callable) -> Callable:
        for name in names.split():
            BUILTINS[name] = Function(least, most, f, **kind)
        return f

    return add


# --- numbers from arguments -----------------------------------------------------------------------


def numbers(args: Iterable[object]) -> list[float]:
    """Numbers of areas; other arguments are coerced, blank ones skipped."""
    out: list[float] = []
    for a in args:
        if isinstance(a, Area):
            for v in a.values():
                if isinstance(v, Err):
                    raise Stop(v)
                if isinstance(v, float):
                    out.append(v)
        elif a is not None:
            out.append(number(a))
    return out


def _some(found: list, otherwise: Err) -> list:
    if not found:
        raise Stop(otherwise)
    return found


define("SUM", 1, ANY)(lambda *a: float(sum(numbers(a))))
define("AVERAGE", 1, ANY)(lambda *a: (lambda f: sum(f) / len(f))(_some(numbers(a), DIV0)))
define("MIN", 1, ANY)(lambda *a: min(numbers(a), default=0.0))
define("MAX", 1, ANY)(lambda *a: max(numbers(a), default=0.0))
define("MEDIAN", 1, ANY)(lambda *a: float(statistics.median(_some(numbers(a), NUM))))


@define("COUNT", 1, ANY)
def count(*args: object) -> float:
    total = 0
    for a in args:
        if isinstance(a, Area):
            total += sum(isinstance(v, float) for v in a.values())
        elif isinstance(a, (float, bool)) or (isinstance(a, str) and not isinstance(a, Err) and numeric_text(a) is not None):
            total += 1
    return float(total)


define("COUNTA", 1, ANY)(lambda *a: float(sum(len(x.used()) if isinstance(x, Area) else x is not None for x in a)))


def _blank(v: object) -> bool:
    return v is None or (isinstance(v, str) and v == "")


define("COUNTBLANK", 1, 1)(lambda a: float(a.size - sum(not _blank(v) for v in a.values()) if isinstance(a, Area) else _blank(a)))


def _nth(values: object, k: object, largest: bool) -> float:
    found, at = numbers([values]), whole(k)
    if not 1 <= at <= len(found):
        raise Stop(NUM)
    return sorted(found, reverse=largest)[int(at) - 1]


define("LARGE", 2, 2)(lambda v, k: _nth(v, k, True))
define("SMALL", 2, 2)(lambda v, k: _nth(v, k, False))


def _floor(x: float) -> float:
    return float(math.floor(x)) if math.isfinite(x) else x


def _ceil(x: float) -> float:
    return float(math.ceil(x)) if math.isfinite(x) else x


def rounded(x: float, digits: float, how: Callable[[float], float]) -> float:
    try:
        scale = 10.0 ** math.trunc(digits)
    except OverflowError:
        return x
    if scale == 0:
        return 0.0
    # away from zero and back: on the magnitude
    y = how(abs(x) * scale)
    return math.copysign(1, x) * (y / scale) if x else 0.0


def _numeric(names: str, f: Callable[..., float], n: int) -> None:
    define(names, n, n)(lambda *a: finite(f(*[number(x) for x in a])))


def _half(y: float) -> float:
    return _floor(y + 0.5) if y < 2**52 else y


_numeric("ROUND", lambda x, d: rounded(x, d, _half), 2)
_numeric("ROUNDUP", lambda x, d: rounded(x, d, _ceil), 2)
_numeric("ROUNDDOWN", lambda x, d: rounded(x, d, _floor), 2)
_numeric("INT", _floor, 1)
_numeric("ABS", abs, 1)
_numeric("SIGN", lambda x: float((x > 0) - (x < 0)), 1)
define("TRUNC", 1, 2)(lambda x, d=0.0: rounded(number(x), whole(d), _floor))
_numeric("POWER", lambda x, y: ARITHMETIC["^"](x, y), 2)


def _domain(good: bool) -> None:
    if not good:
        raise Stop(NUM)


@define("SQRT", 1, 1)
def square_root(v: object) -> float:
    x = number(v)
    _domain(x >= 0)
    return math.sqrt(x)


@define("EXP", 1, 1)
def exponential(v: object) -> float:
    try:
        return math.exp(number(v))
    except OverflowError:
        raise Stop(NUM) from None


@define("LN", 1, 1)
def natural_log(v: object) -> float:
    x = number(v)
    _domain(x > 0)
    return math.log(x)


@define("LOG10", 1, 1)
def decimal_log(v: object) -> float:
    x = number(v)
    _domain(x > 0)
    return math.log10(x)


@define("LOG", 1, 2)
def log(v: object, base: object = 10.0) -> float:
    x = number(v)
    _domain(x > 0)
    b = number(base)
    _domain(b > 0 and b != 1)
    return math.log(x) / math.log(b)


define("PI", 0, 0)(lambda: math.pi)


@define("MOD", 2, 2)
def modulo(a: object, b: object) -> float:
    x, y = number(a), number(b)
    if y == 0:
        raise Stop(DIV0)
    return x - y * _floor(x / y)


def _stepped(a: object, b: object, how: Callable[[float], float]) -> float:
    x, step = number(a), number(b)
    _domain(not (x > 0 and step < 0))
    return how(x / step) * step if step else 0.0


define("CEILING", 2, 2)(lambda x, s: _stepped(x, s, _ceil))
define("FLOOR", 2, 2)(lambda x, s: _stepped(x, s, _floor))


@define("SUMPRODUCT", 1, ANY)
def sumproduct(*args: object) -> float:
    def weight(v: object) -> float:
        v = ok(v)
        return v if isinstance(v, float) else 0.0

    first = args[0]
    if not isinstance(first, Area):
        return math.prod(weight(a) for a in args)
    for a in args:
        if ((a.height, a.width) if isinstance(a, Area) else (1, 1)) != (first.height, first.width):
            raise Stop(VALUE)
    for a in args:  # an error counts even where the product would be 0
        for v in a.values() if isinstance(a, Area) else [a]:
            if isinstance(v, Err):
                raise Stop(v)
    total = 0.0
    for down, right, v in first.items():
        p = weight(v)
        for a in args[1:]:
            p = p and p * weight(a.at(down, right) if isinstance(a, Area) else a)
        total += p
    return total


# --- logic ----------------------------------------------------------------------------------------


@define("IF", 2, 3, lazy=True)
def if_(test: Callable, yes: Callable, no: Callable = lambda: False) -> object:
    return yes() if truth(test()) else no()


def _replaced(v: Callable, other: Callable, bad: Callable[[object], bool]) -> object:
    x = v()
    if isinstance(x, Area) and not x.is_single:
        return x
    return other() if bad(single(x)) else x


define("IFERROR", 2, 2, lazy=True)(lambda v, other: _replaced(v, other, lambda x: isinstance(x, Err)))
define("IFNA", 2, 2, lazy=True)(lambda v, other: _replaced(v, other, lambda x: isinstance(x, Err) and x == NA))


@define("IFS", 2, ANY, lazy=True)
def ifs(*args: Callable) -> object:
    for test, v in zip(args[::2], args[1::2], strict=False):
        if truth(test()):
            return v()
    raise Stop(NA)


@define("SWITCH", 3, ANY, lazy=True)
def switch(expression: Callable, *args: Callable) -> object:
    x = ok(expression())
    for case, v in zip(args[::2], args[1::2], strict=False):
        if compare(x, case()) == 0:
            return v()
    if len(args) % 2:
        return args[-1]()
    raise Stop(NA)


@define("CHOOSE", 2, ANY, lazy=True)
def choose(which: Callable, *args: Callable) -> object:
    i = whole(which())
    if not 1 <= i <= len(args):
        raise Stop(VALUE)
    return args[int(i) - 1]()


def bools(args: Iterable[object]) -> list[bool]:
    out: list[bool] = []
    for a in args:
        if isinstance(a, Area):
            for v in a.values():
                if isinstance(v, Err):
                    raise Stop(v)
                if isinstance(v, (bool, float)):
                    out.append(bool(v))
        elif a is not None:
            out.append(truth(a))
    return _some(out, VALUE)


define("AND", 1, ANY)(lambda *a: all(bools(a)))
define("OR", 1, ANY)(lambda *a: any(bools(a)))
define("XOR", 1, ANY)(lambda *a: sum(bools(a)) % 2 == 1)
define("NOT", 1, 1)(lambda v: not truth(v))


# --- lookups --------------------------------------------------------------------------------------


def _same(cell: object, sought: object) -> bool:
    try:
        cell = ok(cell)
        if isinstance(sought, str) and isinstance(cell, str) and re.search(r"[*?]", sought):
            return glob_matches(cell, sought)
        return compare(cell, sought) == 0
    except Stop:
        return False


def _last_before(line: Iterable[tuple[int, object]], sought: object, sign: int) -> int | None:
    """Place of the last element in order before the first that is out of it."""
    best = None
    for at, v in line:
        try:
            c = compare(v, sought)
        except Stop:
            continue
        if c * sign > 0:
            break
        best = at
    return best


def _shown(v: object) -> object:
    return 0.0 if v is None else v


def _table(down: bool, sought: object, table: object, index: object, near: object = True) -> object:
    sought = ok(sought)
    if not isinstance(table, Area):
        raise Stop(NA)
    i = whole(index)
    if i < 1:
        raise Stop(VALUE)
    if i > (table.width if down else table.height):
        raise Stop(REF)
    near = truth(near)
    line = _edge(table, down)
    at = _last_before(line, sought, 1) if near else next((p for p, v in line if _same(v, sought)), None)
    if at is None:
        raise Stop(NA)
    return _shown(table.at(at, int(i) - 1) if down else table.at(int(i) - 1, at))


def _edge(table: Area, down: bool) -> list[tuple[int, object]]:
    places = sorted((row - table.r1, col - table.c1) for row, col in table.used())
    keep = [(r, c) for r, c in places if (c if down else r) == 0]
    return [((r if down else c), table.at(r, c)) for r, c in keep]


define("VLOOKUP", 3, 4)(lambda *a: _table(True, *a))
define("HLOOKUP", 3, 4)(lambda *a: _table(False, *a))


@define("MATCH", 2, 3)
def match(sought: object, area: object, kind: object = 1.0) -> float:
    sought, kind = ok(sought), whole(kind)
    if not isinstance(area, Area):
        if _same(area, sought):
            return 1.0
        raise Stop(NA)
    line = [((c if area.height == 1 else r) + 1, v) for r, c, v in area.items()]
    line.sort(key=lambda x: x[0])
    at = next((p for p, v in line if _same(v, sought)), None) if kind == 0 else _last_before(line, sought, 1 if kind >= 1 else -1)
    if at is None:
        raise Stop(NA)
    return float(at)


@define("INDEX", 2, 3)
def index(area: object, row: object, *col: object) -> object:
    r = whole(row)
    c = whole(col[0]) if col else None
    if not isinstance(area, Area):
        if r in (0, 1) and c in (None, 0, 1):
            return _shown(area)
        raise Stop(REF)
    if c is None:
        if area.height != 1 and area.width != 1:
            raise Stop(REF)
        r, c = (1.0, r) if area.height == 1 else (r, 1.0)
    if not (1 <= r <= area.height and 1 <= c <= area.width):
        raise Stop(REF)
    return _shown(area.at(int(r) - 1, int(c) - 1))


define("ROWS", 1, 1)(lambda a: float(a.height if isinstance(a, Area) else 1))
define("COLUMNS", 1, 1)(lambda a: float(a.width if isinstance(a, Area) else 1))


# --- conditional aggregates -----------------------------------------------------------------------


def _at(v: object, down: int, right: int) -> object:
    return v.at(down, right) if isinstance(v, Area) else v if (down, right) == (0, 0) else None


def _cells(v: object) -> Iterable[tuple[int, int, object]]:
    return v.items() if isinstance(v, Area) else [(0, 0, v)]


def conditional(values: object, pairs: list[tuple[object, object]], own: bool, how: str, exact: bool = False) -> float:
    """``own``: the first criteria range is summed itself.

    Positions without any cell in the driving range count only if one pair allows blanks, or ``exact``.
    """
    tests = [(area, parse_criterion(c)) for area, c in pairs]
    lead = next((i for i, (_, c) in enumerate(tests) if not matches(None, c)), 0)
    area, _ = tests[lead]
    blanks = isinstance(area, Area) and matches(None, tests[lead][1]) and (len(tests) == 1 or exact)
    total, n, seen = 0.0, 0, set()

    def add(v: object) -> None:
        nonlocal total, n
        if isinstance(v, Err):
            raise Stop(v)
        if how == "count":
            n += 1
        elif isinstance(v, float):
            total, n = total + v, n + 1

    def fits(down: int, right: int, skip: int) -> bool:
        return all(matches(_at(a, down, right), c) for i, (a, c) in enumerate(tests) if i != skip)

    for down, right, v in _cells(area):
        seen.add((down, right))
        if matches(v, tests[lead][1]) and fits(down, right, lead):
            add(0.0 if how == "count" else v if own else _at(values, down, right))
    if blanks and how == "count":
        if len(tests) == 1:
            n += area.size - len(seen)
        else:
            others = {(d, r) for a, _ in tests if isinstance(a, Area) for d, r, _ in a.items()} - seen
            inside = {p for p in others if p[0] < area.height and p[1] < area.width}
            n += sum(fits(d, r, -1) for d, r in inside) + area.size - len(seen | inside)
    elif blanks and not own and isinstance(values, Area):
        for down, right, v in values.items():
            if (down, right) not in seen and down < area.height and right < area.width and isinstance(v, float) and fits(down, right, lead):
                add(v)
    if how == "avg" and not n:
        raise Stop(DIV0)
    return total / n if how == "avg" else total if how == "sum" else float(n)


def _pairs(args: tuple) -> list[tuple[object, object]]:
    found = list(zip(args[::2], args[1::2], strict=False))
    return _some(found, VALUE)


define("COUNTIF", 2, 2)(lambda a, c: conditional(None, [(a, c)], True, "count"))
define("SUMIF", 2, 3)(lambda a, c, *v: conditional(v[0] if v else None, [(a, c)], not v, "sum"))
define("AVERAGEIF", 2, 3)(lambda a, c, *v: conditional(v[0] if v else None, [(a, c)], not v, "avg"))
define("COUNTIFS", 2, ANY)(lambda *a: conditional(None, _pairs(a), True, "count"))
define("SUMIFS", 3, ANY)(lambda v, *a: conditional(v, _pairs(a), False, "sum"))
define("AVERAGEIFS", 3, ANY)(lambda v, *a: conditional(v, _pairs(a), False, "avg"))


# --- text -----------------------------------------------------------------------------------------
# Positions and lengths count UTF-16 units, as in the file format.


def units(s: str) -> int:
    return len(s) + sum(c > "￿" for c in s)


def cut(s: str, start: float, stop: float) -> str:
    if s.isascii() or max(s) <= "￿":
        return s[int(start) : int(min(stop, len(s)))]
    raw = s.encode("utf-16-le", "surrogatepass")
    return raw[2 * int(start) : 2 * int(min(stop, len(raw)))].decode("utf-16-le", "surrogatepass")


def _limited(s: str) -> str:
    if units(s) > MAX_TEXT:
        raise Stop(VALUE)
    return s


@define("CONCAT CONCATENATE", 1, ANY)
def concat(*args: object) -> str:
    return _limited("".join(text(v) for a in args for v in (a.values() if isinstance(a, Area) else [a])))


@define("TEXTJOIN", 3, ANY)
def textjoin(between: object, skip: object, *args: object) -> str:
    between, skip = text(between), truth(skip)
    return _limited(between.join(text(v) for a in args for v in (a.values() if isinstance(a, Area) else [a]) if not (skip and _blank(v))))


define("LEN", 1, 1)(lambda s: float(units(text(s))))


def _length(n: object) -> float:
    n = whole(n)
    if n < 0:
        raise Stop(VALUE)
    return n


define("LEFT", 1, 2)(lambda s, n=1.0: (lambda t: cut(t, 0, _length(n)))(text(s)))
define("RIGHT", 1, 2)(lambda s, n=1.0: (lambda t: cut(t, max(0.0, units(t) - _length(n)), units(t)))(text(s)))


@define("MID", 3, 3)
def mid(s: object, start: object, n: object) -> str:
    t, at, n = text(s), whole(start), whole(n)
    if at < 1 or n < 0:
        raise Stop(VALUE)
    return cut(t, min(at - 1, units(t)), at - 1 + n)


@define("REPLACE", 4, 4)
def replace(s: object, start: object, n: object, new: object) -> str:
    t, at, n = text(s), whole(start), whole(n)
    new = text(new)
    if at < 1 or n < 0:
        raise Stop(VALUE)
    at = min(at - 1, units(t))
    return cut(t, 0, at) + new + cut(t, min(at + n, units(t)), units(t))


define("TRIM", 1, 1)(lambda s: " ".join(p for p in text(s).split(" ") if p))
define("UPPER", 1, 1)(lambda s: text(s).upper())
define("LOWER", 1, 1)(lambda s: text(s).lower())
define("PROPER", 1, 1)(lambda s: re.sub("[A-Za-z]+", lambda m: m[0][0].upper() + m[0][1:].lower(), text(s)))
define("EXACT", 2, 2)(lambda a, b: (lambda x: x == text(b))(text(a)))


@define("REPT", 2, 2)
def repeat(s: object, n: object) -> str:
    t, n = text(s), _length(n)
    if units(t) * n > MAX_TEXT:
        raise Stop(VALUE)
    return t * int(n) if t else ""


@define("CHAR", 1, 1)
def char(n: object) -> str:
    n = whole(n)
    if not 1 <= n <= 255:
        raise Stop(VALUE)
    return chr(int(n))


@define("CODE", 1, 1)
def code(s: object) -> float:
    t = text(s)
    if not t:
        raise Stop(VALUE)
    return float(int.from_bytes(t[0].encode("utf-16-be", "surrogatepass")[:2], "big"))


@define("VALUE", 1, 1)
def value(v: object) -> float:
    v = ok(v)
    if isinstance(v, float):
        return v
    if not isinstance(v, str):
        raise Stop(VALUE)
    t = v.strip()
    percent = t.endswith("%")
    x = numeric_text(t.removesuffix("%").strip().removeprefix("$").replace(",", ""))
    if x is None:
        raise Stop(VALUE)
    return x * 0.01 if percent else x


@define("SUBSTITUTE", 3, 4)
def substitute(s: object, old: object, new: object, *which: object) -> str:
    t, old = text(s), text(old)
    new = text(new)
    if not old:
        return t
    parts = t.split(old)
    if not which:
        return new.join(parts)
    i = whole(which[0])
    if i < 1:
        raise Stop(VALUE)
    if i >= len(parts):
        return t
    return old.join(parts[: int(i)]) + new + old.join(parts[int(i) :])


def _find(needle: str, hay: str, start: object) -> float:
    at = whole(start)
    if not 1 <= at <= units(hay) + 1:
        raise Stop(VALUE)
    before = cut(hay, 0, at - 1)
    found = hay.find(needle, len(before))
    if found < 0:
        raise Stop(VALUE)
    return float(units(hay[:found]) + 1)


define("FIND", 2, 3)(lambda n, h, s=1.0: (lambda a: _find(a, text(h), s))(text(n)))
define("SEARCH", 2, 3)(lambda n, h, s=1.0: (lambda a: _find(a.upper(), text(h).upper(), s))(text(n)))


# --- information ----------------------------------------------------------------------------------


def _is(names: str, test: Callable[[object], bool]) -> None:
    define(names, 1, 1)(lambda v: test(single(v)))


_is("ISBLANK", lambda v: v is None)
_is("ISNUMBER", lambda v: isinstance(v, float))
_is("ISTEXT", lambda v: isinstance(v, str) and not isinstance(v, Err))
_is("ISLOGICAL", lambda v: isinstance(v, bool))
_is("ISERROR", lambda v: isinstance(v, Err))
_is("ISERR", lambda v: isinstance(v, Err) and v != NA)
_is("ISNA", lambda v: isinstance(v, Err) and v == NA)
define("N", 1, 1)(lambda v: (lambda x: float(x) if isinstance(x, (bool, float)) else 0.0)(ok(v)))
define("T", 1, 1)(lambda v: (lambda x: x if isinstance(x, str) else "")(ok(v)))
define("NA", 0, 0)(lambda: NA)


@define("ERROR.TYPE", 1, 1)
def error_type(v: object) -> float:
    v = single(v)
    if isinstance(v, Err) and v in CODES:
        return float(CODES.index(v) + 1)
    raise Stop(NA)


# --- dates ----------------------------------------------------------------------------------------


def serial(v: object) -> float:
    x = number(v)
    if x < 0 or math.trunc(x) > MAX_SERIAL:
        raise Stop(NUM)
    return x


def _day(year: float, month: float, day: float) -> float:
    """Serial of a day; months and days may run over."""
    try:
        y, m = divmod(int(year) * 12 + int(month) - 1, 12)
        out = (dt.datetime(y, m + 1, 1) - EPOCH_1900).days + int(day) - 1
    except (ValueError, OverflowError):
        raise Stop(NUM) from None
    if not 0 <= out <= MAX_SERIAL:
        raise Stop(NUM)
    return float(out)


@define("DATE", 3, 3)
def date(year: object, month: object, day: object) -> float:
    y, m, d = whole(year), whole(month), whole(day)
    if not 0 <= y <= 9999:
        raise Stop(NUM)
    return _day(y + 1900 if y < 1900 else y, m, d)


def _part(name: str, take: Callable[[dt.datetime], int]) -> None:
    def run(v: object) -> float:
        when = serial_to_datetime(serial(v))
        if when is None:  # rounding past the last millisecond
            raise Stop(NUM)
        return float(take(when))

    define(name, 1, 1)(run)


_part("YEAR", lambda d: d.year)
_part("MONTH", lambda d: d.month)
_part("DAY", lambda d: d.day)
_part("HOUR", lambda d: d.hour)
_part("MINUTE", lambda d: d.minute)
_part("SECOND", lambda d: d.second)


@define("WEEKDAY", 1, 2)
def weekday(v: object, kind: object = 1.0) -> float:
    x, kind = serial(v), whole(kind)
    monday = serial_to_datetime(x).weekday()
    # day of the week that counts as the first, Monday being 0
    first = {1: 6, 2: 0, 3: 0, **{11 + i: i for i in range(7)}}.get(kind)
    if first is None:
        raise Stop(NUM)
    return float((monday - first) % 7 + (kind != 3))


@define("TIME", 3, 3)
def time(h: object, m: object, s: object) -> float:
    total = number(h) * 3600
    total += number(m) * 60
    total += number(s)
    if total < 0:
        raise Stop(NUM)
    return math.fmod(total, 86400) / 86400


define("DAYS", 2, 2)(lambda end, start: (lambda e: float(math.trunc(e) - math.trunc(serial(start))))(serial(end)))


def _shifted(v: object, months: object, end: bool) -> float:
    when, by = serial_to_datetime(serial(v)), whole(months)
    if abs(by) > 200_000:
        raise Stop(NUM)
    y, m = divmod(when.year * 12 + when.month - 1 + int(by), 12)
    if not 1 <= y <= 9999:
        raise Stop(NUM)
    last = monthrange(y, m + 1)[1]
    out = datetime_to_serial(dt.datetime(y, m + 1, last if end else min(when.day, last)))
    if not 0 <= out <= MAX_SERIAL:
        raise Stop(NUM)
    return out


define("EDATE", 2, 2)(lambda v, m: _shifted(v, m, False))
define("EOMONTH", 2, 2)(lambda v, m: _shifted(v, m, True))


# --- volatile: the evaluator passes its clock and generator ------------------------------------------

define("TODAY", 0, 0, volatile=True)(lambda ctx: _floor(ctx.now()))
define("NOW", 0, 0, volatile=True)(lambda ctx: ctx.now())
define("RAND", 0, 0, volatile=True)(lambda ctx: ctx.random())


@define("RANDBETWEEN", 2, 2, volatile=True)
def randbetween(ctx, low: object, high: object) -> float:
    lo, hi = whole(low), whole(high)
    if lo > hi:
        raise Stop(NUM)
    return lo + _floor(ctx.random() * (hi - lo + 1))
