"""The range functions as Spark aggregates: a DataFrame column, or an expression over columns, is a range.

``Ranges`` compiles a formula whose range functions take row expressions: ``SUM([a])``, ``SUMPRODUCT([a]*[b])``,
``COUNTIFS([q],">24",[flag],"R*")``.  What stands outside range functions is computed from their results.
Everything aggregates partially before a shuffle.  LARGE and SMALL, which need an order, are left to ``columns``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import FormulaError
from ..functions.criteria import Criterion, glob_parts, matches, parse_criterion
from ..functions.library import MAX_TEXT
from ..functions.values import Err, Stop
from . import lanes as L
from .lanes import Lane
from .scalars import Compiler
from .syntax import children


def has_field(tree: tuple) -> bool:
    return tree[0] == "field" or any(map(has_field, children(tree)))


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for upper-cased text."""
    return r"\A" + "".join({"*": r"[\s\S]*", "?": r"[\s\S]"}.get(p) or re.escape(p[1:]) for p in glob_parts(pattern)) + r"\z"


def glob_like(pattern: str) -> str | None:
    """The same as a LIKE pattern: linear to match, and without a regular expression where only stars occur at the ends."""
    return "".join({"*": "%", "?": "_"}.get(p) or re.sub(r"([%_\\])", r"\\\1", p[1:]) for p in glob_parts(pattern))


_TEST = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}


def fits(x: Lane, c: Criterion) -> Column:
    """Whether each value meets the criterion; never null, never true of an error."""
    if c.kind == "number":
        v = _TEST[c.op](L.part(x, "num"), F.lit(c.operand))
    elif c.kind == "bool":
        v = _TEST[c.op](L.part(x, "bool"), F.lit(c.operand)) if c.op in ("=", "<>") else F.lit(False)
    elif c.kind == "blank":
        v = L.tag(x).isNull() | F.coalesce(L.part(x, "text") == "", F.lit(False))
    else:
        t = F.upper(L.to_text(x)[0])
        if c.kind == "glob":
            v = t.like(glob_like(c.operand)) if c.op == "=" else ~t.like(glob_like(c.operand))
        else:
            v = _TEST[c.op](t, F.lit(c.operand.upper()))
    v = F.coalesce(v, F.lit(False))
    return v if x.err is None else v & x.err.isNull()


def constant(tree: tuple) -> object:
    """The value of a tree of literals."""
    from ..operators.evaluate import Grid

    if has_field(tree):
        raise FormulaError("unsupported", "a criterion that depends on the row; use lookup")
    return Grid([""], []).run(tree, "")


class Ranges(Compiler):
    """``row`` compiles row expressions; ``order``: columns that give the document order, for CONCAT and the first error."""

    def __init__(self, row: Compiler, order: list[Column] | None = None, **options: object) -> None:
        super().__init__(lambda _: None, functions=row.functions, special=self._special, **options)
        self.row, self.order = row, order or []
        self.later: dict[tuple, Callable] = {}

    def _special(self, tree: tuple) -> Lane | None:
        if tree[0] == "field":
            raise FormulaError("unsupported", "a range outside a range function")
        if tree[0] != "call" or not any(map(has_field, tree[2])):
            return None
        run = getattr(self, "_" + tree[1].replace(".", "_").lower(), None)
        return None if run is None or tree[1] not in RANGE_FUNCTIONS else run(*tree[2])

    # -- parts

    def _first_error(self, *lanes: Lane) -> Column | None:
        """One of the errors: the first by the given order."""
        err = L.errors(*lanes)
        if err is None:
            return None
        place = F.struct(*self.order) if self.order else F.lit(0)
        return F.min_by(err, F.when(err.isNotNull(), place)) if self.order else F.min(err)

    def _split(self, args: tuple) -> tuple[list[Lane], list[Lane]]:
        """Ranges as row lanes, other arguments as lanes of this level."""
        return [self.row.lane(a) for a in args if has_field(a)], [self.lane(a) for a in args if not has_field(a)]

    def _numbers(self, args: tuple, of: Callable[[Column], Column], join: Callable[[Column, Column], Column], empty: object) -> tuple[Column, Column, Column | None]:
        """Aggregate, count and error over the numbers of ranges and coerced other arguments."""
        ranges, others = self._split(args)
        value, n = None, F.lit(0).cast("bigint")
        errs = []
        for x in ranges:
            v = L.part(x, "num")
            v = v if x.err is None else F.when(x.err.isNull(), v)
            value = of(v) if value is None else join(value, of(v))
            n = n + F.count(v)
            errs.append(self._first_error(x))
        for x in others:
            if x.kind == "blank" and x.err is None:
                continue
            v, e = L.to_num(x)
            value, n = join(value, v), n + 1
            errs.append(e)
        return value, n, L.errors(*errs)

    # -- functions

    def _sum(self, *args: tuple) -> Lane:
        v, _, err = self._numbers(args, lambda c: F.coalesce(F.sum(c), F.lit(0.0)), lambda a, b: a + b, 0.0)
        return L.guard(v, err)

    def _average(self, *args: tuple) -> Lane:
        v, n, err = self._numbers(args, lambda c: F.coalesce(F.sum(c), F.lit(0.0)), lambda a, b: a + b, 0.0)
        return L.guard(F.try_divide(v, n.cast("double")), L.errors(err, F.when(n == 0, F.lit("#DIV/0!"))))

    def _min(self, *args: tuple) -> Lane:
        v, _, err = self._numbers(args, F.min, F.least, None)
        return Lane("num", F.coalesce(v, F.lit(0.0)), err, False)

    def _max(self, *args: tuple) -> Lane:
        v, _, err = self._numbers(args, F.max, F.greatest, None)
        return Lane("num", F.coalesce(v, F.lit(0.0)), err, False)

    def _median(self, *args: tuple) -> Lane:
        if len(args) != 1:
            raise FormulaError("unsupported", "MEDIAN of one range")
        v, n, err = self._numbers(args, F.median, F.least, None)
        return Lane("num", v, L.errors(err, F.when(n == 0, F.lit("#NUM!"))), False)

    def _count(self, *args: tuple) -> Lane:
        ranges, others = self._split(args)
        n = F.lit(0).cast("bigint")
        for x in ranges:
            v = L.part(x, "num")
            n = n + F.count(v if x.err is None else F.when(x.err.isNull(), v))
        for x in others:
            good = (L.tag(x) != 1) | L.numeric_text(L.part(x, "text")).isNotNull()
            n = n + F.coalesce(F.when(good if x.err is None else good & x.err.isNull(), 1), F.lit(0))
        return Lane("num", n.cast("double"), None, False)

    def _populated(self, x: Lane) -> Column:
        here = L.tag(x).isNotNull()
        return here if x.err is None else here | x.err.isNotNull()

    def _counta(self, *args: tuple) -> Lane:
        ranges, others = self._split(args)
        n = sum((F.count_if(self._populated(x)) for x in ranges), F.lit(0).cast("bigint"))
        n = n + sum(x.kind != "blank" or x.err is not None for x in others)
        return Lane("num", n.cast("double"), None, False)

    def _countblank(self, area: tuple) -> Lane:
        x = self.row.lane(area)
        full = self._populated(x) & ~F.coalesce(L.part(x, "text") == "", F.lit(False))
        return Lane("num", (F.count(F.lit(1)) - F.count_if(full)).cast("double"), None, False)

    def _rows(self, area: tuple) -> Lane:
        return Lane("num", F.count(F.lit(1)).cast("double"), None, False)

    def _columns(self, area: tuple) -> Lane:
        return L.literal(1.0)

    def _sumproduct(self, *args: tuple) -> Lane:
        xs = [self.row.lane(a) for a in args]
        product = None
        for x in xs:
            v = F.coalesce(L.part(x, "num"), F.lit(0.0))
            product = v if product is None else product * v
        err = L.errors(*xs)
        return L.guard(F.coalesce(F.sum(product if err is None else F.when(err.isNull(), product)), F.lit(0.0)), self._first_error(*xs))

    def _logic(self, args: tuple, of: Callable[[Column], Column], join: Callable[[Column, Column], Column], finish: Callable[[Column], Column]) -> Lane:
        ranges, others = self._split(args)
        value, n, errs = None, F.lit(0).cast("bigint"), []
        for x in ranges:
            b = F.coalesce(L.part(x, "bool"), L.part(x, "num") != 0)
            b = b if x.err is None else F.when(x.err.isNull(), b)
            value = of(b) if value is None else join(value, of(b))
            n = n + F.count(b)
            errs.append(self._first_error(x))
        for x in others:
            if x.kind == "blank" and x.err is None:
                continue
            b, e = L.to_bool(x)
            value, n = join(value, self._as(b, of)), n + 1
            errs.append(e)
        return Lane("bool", finish(value), L.errors(*errs, F.when(n == 0, F.lit("#VALUE!"))), False)

    @staticmethod
    def _as(b: Column, of: Callable) -> Column:
        return b.cast("bigint") if of is _odd else b

    def _and(self, *args: tuple) -> Lane:
        return self._logic(args, lambda b: F.coalesce(F.bool_and(b), F.lit(True)), lambda a, b: a & b, lambda v: v)

    def _or(self, *args: tuple) -> Lane:
        return self._logic(args, lambda b: F.coalesce(F.bool_or(b), F.lit(False)), lambda a, b: a | b, lambda v: v)

    def _xor(self, *args: tuple) -> Lane:
        return self._logic(args, _odd, lambda a, b: a + b, lambda v: v % 2 == 1)

    def _conditional(self, values: tuple | None, pairs: list[tuple[tuple, tuple]], how: str) -> Lane:
        try:
            tests = [(self.row.lane(a), parse_criterion(constant(c))) for a, c in pairs]
        except Stop as e:
            return L.literal(e.err)
        match = F.lit(True)
        for x, c in tests:
            match = match & fits(x, c)
        if how == "count":
            return Lane("num", F.count_if(match).cast("double"), None, False)
        v = self.row.lane(values)
        n = F.when(match, L.part(v, "num"))
        wrong = None if v.err is None else F.when(match, v.err)
        err = None if wrong is None else self._first_error(Lane("blank", None, wrong))
        total = F.coalesce(F.sum(n if v.err is None else F.when(v.err.isNull(), n)), F.lit(0.0))
        if how == "sum":
            return L.guard(total, err)
        return L.guard(F.try_divide(total, F.count(n).cast("double")), L.errors(err, F.when(F.count(n) == 0, F.lit("#DIV/0!"))))

    def _countif(self, area: tuple, c: tuple) -> Lane:
        return self._conditional(None, [(area, c)], "count")

    def _sumif(self, area: tuple, c: tuple, values: tuple | None = None) -> Lane:
        return self._conditional(values or area, [(area, c)], "sum")

    def _averageif(self, area: tuple, c: tuple, values: tuple | None = None) -> Lane:
        return self._conditional(values or area, [(area, c)], "avg")

    def _countifs(self, *args: tuple) -> Lane:
        return self._conditional(None, list(zip(args[::2], args[1::2], strict=False)), "count")

    def _sumifs(self, values: tuple, *args: tuple) -> Lane:
        return self._conditional(values, list(zip(args[::2], args[1::2], strict=False)), "sum")

    def _averageifs(self, values: tuple, *args: tuple) -> Lane:
        return self._conditional(values, list(zip(args[::2], args[1::2], strict=False)), "avg")

    def _joined(self, between: Column | None, skip: bool, args: tuple) -> Lane:
        """One range, by order.  The result is at most 32767 characters, so what a group holds is cut off beyond."""
        if not self.order:
            raise FormulaError("unsupported", "joining a range needs an order")
        if len(args) != 1:
            raise FormulaError("unsupported", "joining one range")
        x = self.row.lane(args[0])
        t = L.to_text(x)[0]
        drop = ~self._populated(x)
        if skip:
            drop = drop | F.coalesce(L.part(x, "text") == "", F.lit(False))
        if x.err is not None:
            drop = drop | x.err.isNotNull()
        kept = F.when(~drop, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(self.order)], t.alias("t")))
        parts = F.transform(F.array_sort(F.collect_list(kept)), lambda s: s.t)
        joined = F.array_join(parts, "") if between is None else F.array_join(F.transform(parts, lambda s, i: F.when(i == 0, s).otherwise(F.concat(between, s))), "")
        return Lane("text", joined, L.errors(self._first_error(x), F.when(F.length(joined) > MAX_TEXT, F.lit("#VALUE!"))), False)

    def _concat(self, *args: tuple) -> Lane:
        return self._joined(None, False, args)

    _concatenate = _concat

    def _textjoin(self, between: tuple, skip: tuple, *args: tuple) -> Lane:
        d, b = constant(between), constant(skip)
        if isinstance(d, Err) or isinstance(b, (Err, str)):
            return L.literal(d if isinstance(d, Err) else b if isinstance(b, Err) else Err("#VALUE!"))
        return self._joined(L.to_text(L.literal(d))[0], bool(b), args)


def _odd(b: Column) -> Column:
    return F.count_if(b)


RANGE_FUNCTIONS = frozenset(
    "SUM AVERAGE COUNT COUNTA COUNTBLANK MIN MAX MEDIAN SUMPRODUCT AND OR XOR COUNTIF SUMIF AVERAGEIF COUNTIFS SUMIFS AVERAGEIFS CONCAT CONCATENATE TEXTJOIN ROWS COLUMNS".split()
)

__all__ = ["RANGE_FUNCTIONS", "Ranges", "constant", "fits", "glob_regex", "has_field", "matches"]
