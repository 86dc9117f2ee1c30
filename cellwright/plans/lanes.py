"""Formula values as Spark columns.

A ``Lane`` is a value of known kind (num, text, bool or blank), or a ``mixed`` one with a tag, together with
an error column.  A null value without an error is a blank cell: 0, "" or FALSE by context.  Nothing here
raises at run time: every cast and division is guarded, so that untaken branches can't fail a query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import Err

KINDS = ("num", "text", "bool")
_BLANK_AS = {"num": 0.0, "text": "", "bool": False}
_SPARK = {"num": "double", "text": "string", "bool": "boolean"}
NUMERIC = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
BIG = float(2**53)


class Lane(NamedTuple):
    kind: str
    value: Column | None  # of the kind's type; for mixed a struct (tag, num, text, bool)
    err: Column | None = None
    nullable: bool = True
    loose: bool = False  # a sum, difference or product that may have left the finite numbers and isn't checked yet


def literal(v: object) -> Lane:
    if v is None:
        return Lane("blank", None)
    if isinstance(v, Err):
        return Lane("blank", None, F.lit(str(v)))
    kind = "bool" if isinstance(v, bool) else "text" if isinstance(v, str) else "num"
    return Lane(kind, F.lit(v), None, False)


def field(column: Column, kind: T.DataType) -> Lane:
    """A DataFrame column; dates become serials."""
    if isinstance(kind, T.StringType):
        return Lane("text", column)
    if isinstance(kind, T.BooleanType):
        return Lane("bool", column)
    if isinstance(kind, T.DateType):
        return Lane("num", F.datediff(column, F.lit("1899-12-30").cast("date")).cast("double"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        millis = F.floor(F.unix_micros(column.cast("timestamp")) / 1000) if isinstance(kind, T.TimestampType) else F.floor(F.expr("0L") + F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), column) / 1000)
        return Lane("num", (millis + 2209161600000) / 86400000.0)
    if isinstance(kind, T.NumericType):
        return Lane("num", column.cast("double"))
    raise TypeError(f"no formula value of type {kind.simpleString()}")


def errors(*lanes: Lane | Column | None) -> Column | None:
    """The first error, from the left."""
    found = [x.err if isinstance(x, Lane) else x for x in lanes]
    found = [x for x in found if x is not None]
    return None if not found else found[0] if len(found) == 1 else F.coalesce(*found)


def when_error(*cases: tuple[Column, str]) -> Column:
    out = F.lit(None).cast("string")
    for test, code in reversed(cases):
        out = F.when(test, F.lit(code)).otherwise(out)
    return out


def tag(x: Lane) -> Column:
    """0 num, 1 text, 2 bool, null blank."""
    if x.kind == "blank":
        return F.lit(None).cast("int")
    if x.kind == "mixed":
        return x.value["tag"]
    rank = F.lit(KINDS.index(x.kind))
    return F.when(x.value.isNotNull(), rank) if x.nullable else rank


def part(x: Lane, kind: str) -> Column:
    """The value if it is of this kind, else null."""
    if x.kind == "mixed":
        return x.value[kind]
    return x.value if x.kind == kind else F.lit(None).cast(_SPARK[kind])


def mixed(x: Lane) -> Column:
    if x.kind == "mixed":
        return x.value
    return F.struct(tag(x).alias("tag"), *[part(x, k).alias(k) for k in KINDS])


# --- coercions ------------------------------------------------------------------------------------


def trim_blanks(s: Column) -> Column:
    return F.regexp_replace(s, r"^[\s ﻿ - 　]+|[\s ﻿ - 　]+$", "")


def numeric_text(s: Column) -> Column:
    """The number a text spells, or null."""
    t = trim_blanks(s)
    x = F.when(t.rlike(NUMERIC), t.try_cast("double"))
    return F.when(F.abs(x) < float("inf"), x)


def to_num(x: Lane) -> tuple[Column, Column | None]:
    if x.kind == "num":
        return (F.coalesce(x.value, F.lit(0.0)) if x.nullable else x.value), x.err
    if x.kind == "bool":
        return F.coalesce(x.value.cast("double"), F.lit(0.0)), x.err
    if x.kind == "blank":
        return F.lit(0.0), x.err
    if x.kind == "text":
        n = numeric_text(x.value)
        return F.when(x.value.isNull(), 0.0).otherwise(n), errors(x, F.when(x.value.isNotNull() & n.isNull(), F.lit("#VALUE!")))
    s = x.value["text"]
    n = numeric_text(s)
    v = F.coalesce(x.value["num"], x.value["bool"].cast("double"), n, F.when(s.isNull(), 0.0))
    return v, errors(x, F.when(s.isNotNull() & n.isNull(), F.lit("#VALUE!")))


def general(n: Column) -> Column:
    """Number to text: integers below 1e16 in full, else 15 significant digits."""
    digits = F.format_string("%.14e", n)
    exponent = F.regexp_extract(digits, r"e([+-][0-9]+)$", 1).try_cast("int")
    plain = F.regexp_replace(digits.try_cast("decimal(38,22)").cast("string"), r"\.?0+$", "")
    odd = F.regexp_replace(digits, r"e([+-])0", "e$1")
    return (
        F.when(n == 0, F.lit("0"))
        .when((F.abs(n) < 1e16) & (n == F.floor(n)), n.try_cast("bigint").cast("string"))
        .when((exponent < -6) | (exponent >= 15), odd)
        .otherwise(plain)
    )


def _bool_text(b: Column) -> Column:
    return F.when(b, F.lit("TRUE")).when(~b, F.lit("FALSE"))


def to_text(x: Lane) -> tuple[Column, Column | None]:
    if x.kind == "blank":
        return F.lit(""), x.err
    v = {"num": general, "bool": _bool_text, "text": lambda s: s}[x.kind](x.value) if x.kind != "mixed" else F.coalesce(x.value["text"], general(x.value["num"]), _bool_text(x.value["bool"]))
    return (F.coalesce(v, F.lit("")) if x.nullable else v), x.err


def to_bool(x: Lane) -> tuple[Column, Column | None]:
    if x.kind == "blank":
        return F.lit(False), x.err
    if x.kind == "bool":
        return (F.coalesce(x.value, F.lit(False)) if x.nullable else x.value), x.err
    if x.kind == "num":
        return F.coalesce(x.value != 0, F.lit(False)), x.err
    if x.kind == "text":
        return F.lit(False), errors(x, F.when(x.value.isNotNull(), F.lit("#VALUE!")))
    return F.coalesce(x.value["bool"], x.value["num"] != 0, F.lit(False)), errors(x, F.when(x.value["text"].isNotNull(), F.lit("#VALUE!")))


def big_safe(x: Column, how: Callable[[Column], Column]) -> Column:
    """floor and ceil give bigints that saturate; beyond 2^53 a double is whole already."""
    return F.when(F.abs(x) < BIG, how(x).cast("double")).otherwise(x)


def whole(x: Column) -> Column:
    return F.signum(x) * big_safe(F.abs(x), F.floor)


COERCE: dict[str, Callable[[Lane], tuple[Column, Column | None]]] = {"n": to_num, "s": to_text, "b": to_bool, "i": lambda x: (lambda v: (whole(v[0]), v[1]))(to_num(x))}


# --- comparison -----------------------------------------------------------------------------------


def _sign(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def compare(a: Lane, b: Lane) -> tuple[Column, Column | None]:
    """-1, 0 or 1: number < text < FALSE < TRUE; a blank takes the other's kind; text by upper case."""
    err = errors(a, b)
    fold = lambda c, k: F.upper(c) if k == "text" else c

    def same(k: str, blank_a: bool, blank_b: bool) -> Column:
        x, y = part(a, k), part(b, k)
        if blank_a:
            x = F.coalesce(x, F.lit(_BLANK_AS[k]))
        if blank_b:
            y = F.coalesce(y, F.lit(_BLANK_AS[k]))
        return _sign(fold(x, k), fold(y, k))

    if a.kind == b.kind and a.kind in KINDS:
        return same(a.kind, a.nullable, b.nullable), err
    if "blank" in (a.kind, b.kind) and a.kind in (*KINDS, "blank") and b.kind in (*KINDS, "blank"):
        k = a.kind if b.kind == "blank" else b.kind
        return (F.lit(0) if k == "blank" else same(k, True, True)), err
    ta, tb = tag(a), tag(b)
    out = _sign(F.coalesce(ta, tb, F.lit(0)), F.coalesce(tb, ta, F.lit(0)))
    for i, k in enumerate(KINDS):
        out = F.when((F.coalesce(ta, tb) == i) & (F.coalesce(tb, ta) == i), same(k, True, True)).otherwise(out)
    return F.when(ta.isNull() & tb.isNull(), 0).otherwise(out), err


_TESTS: dict[str, Callable[[Column], Column]] = {"=": lambda c: c == 0, "<>": lambda c: c != 0, "<": lambda c: c < 0, ">": lambda c: c > 0, "<=": lambda c: c <= 0, ">=": lambda c: c >= 0}
_DIRECT: dict[str, Callable[[Column, Column], Column]] = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}


def relation(op: str, a: Lane, b: Lane) -> Lane:
    if a.kind == b.kind and a.kind in KINDS and not (a.nullable and b.nullable and a.kind == "bool"):
        # a plain comparison, which can reach the scan
        fold = F.upper if a.kind == "text" else lambda c: c
        x = F.coalesce(a.value, F.lit(_BLANK_AS[a.kind])) if a.nullable else a.value
        y = F.coalesce(b.value, F.lit(_BLANK_AS[b.kind])) if b.nullable else b.value
        return Lane("bool", _DIRECT[op](fold(x), fold(y)), errors(a, b), False)
    c, err = compare(a, b)
    return Lane("bool", _TESTS[op](c), err, False)


#: The functions that put a column aside under a name and give the reference to it; the last one is in use.
BINDERS: list[Callable[[Column], Column]] = []


def bind(v: Column) -> Column:
    """``v``, or a reference to it where it is computed beforehand: what is used twice need not be written out twice."""
    return BINDERS[-1](v) if BINDERS else v


def guard(v: Column, err: Column | None) -> Lane:
    """A number, with #NUM! for what is not finite (NaN counts as above infinity)."""
    v = bind(v)
    return Lane("num", v, errors(err, F.when(F.abs(v) < float("inf"), F.lit(None).cast("string")).otherwise(F.lit("#NUM!"))), False)


def settle(x: Lane) -> Lane:
    """A lane that is checked."""
    return guard(x.value, x.err) if x.loose else x


def arithmetic(op: str, a: Lane, b: Lane) -> Lane:
    if op in "/^":
        a, b = settle(a), settle(b)
    (x, ex), (y, ey) = to_num(a), to_num(b)
    err = errors(ex, ey)
    if op == "/":
        y = bind(y)
        return guard(F.try_divide(x, y), errors(err, F.when(y == 0, F.lit("#DIV/0!"))))
    if op == "^":
        return guard(F.pow(x, y), errors(err, F.when((x == 0) & (y < 0), F.lit("#DIV/0!"))))
    # what is not finite stays so through sums, differences and products: one check at the end of a chain is enough
    return Lane("num", {"+": x + y, "-": x - y, "*": x * y}[op], err, False, True)


def join_text(a: Lane, b: Lane) -> Lane:
    (x, ex), (y, ey) = to_text(a), to_text(b)
    return Lane("text", F.concat(x, y), errors(ex, ey), False)


def choose(cases: Iterable[tuple[Column, Lane]], otherwise: Lane) -> Lane:
    """The lane of the first true case.  Values and errors of untaken lanes don't show."""
    cases = list(cases)
    every = [x for _, x in cases] + [otherwise]
    kinds = {x.kind for x in every if x.kind != "blank"}
    kind = kinds.pop() if len(kinds) == 1 else "blank" if not kinds else "mixed"
    pick = (lambda x: mixed(x)) if kind == "mixed" else (lambda x: part(x, kind))

    def fold(of: Callable[[Lane], Column]) -> Column:
        out = of(otherwise)
        for test, x in reversed(cases):
            out = F.when(test, of(x)).otherwise(out)
        return out

    has_error = any(x.err is not None for x in every)
    err = fold(lambda x: F.lit(None).cast("string") if x.err is None else x.err) if has_error else None
    return Lane(kind, None if kind == "blank" else fold(pick), err, any(x.nullable or x.kind == "blank" for x in every))


def shown(x: Lane) -> tuple[Column, Column]:
    """Value (null if there is an error) and error as columns to select."""
    err = F.lit(None).cast("string") if x.err is None else x.err
    v = F.lit(None).cast("double") if x.kind == "blank" else x.value
    return (v if x.err is None else F.when(err.isNull(), v)), err
