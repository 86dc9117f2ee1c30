"""The scalar built-ins as Spark columns: from syntax trees to lanes, a row at a time."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import FormulaError
from ..functions.library import BUILTINS, MAX_SERIAL, MAX_TEXT
from ..functions.values import CODES, Err
from . import lanes as L
from .lanes import Lane

#: NAME: function of lanes.  Arity is the library's.
SCALARS: dict[str, Callable[..., Lane]] = {}


def scalar(names: str, takes: str, gives: str) -> Callable[[Callable], Callable]:
    """Registers a function of columns.  ``takes``: n, i (truncated), s or b for each argument, the last one for any beyond.
    ``gives``: num (checked for overflow), finite, text or bool.

    The function gives a column, or a column and cases (condition, error code).
    """

    def add(f: Callable) -> Callable:
        def run(*args: Lane) -> Lane:
            pairs = [L.COERCE[takes[min(i, len(takes) - 1)]](a) for i, a in enumerate(args)]
            got = f(*[p[0] for p in pairs])
            v, cases = got if isinstance(got, tuple) else (got, [])
            err = L.errors(*[p[1] for p in pairs], L.when_error(*cases) if cases else None)
            return L.guard(v, err) if gives == "num" else Lane("num" if gives == "finite" else gives, v, err, False)

        for name in names.split():
            SCALARS[name] = run
        return f

    return add


# --- numbers --------------------------------------------------------------------------------------


def _round(how: Callable[[Column], Column]) -> Callable[..., Column]:
    def run(x: Column, d: Column | None = None) -> Column:
        scale = F.pow(F.lit(10.0), L.whole(d)) if d is not None else F.lit(1.0)
        r = F.signum(x) * (how(F.abs(x) * scale) / F.when(scale != 0, scale))
        return F.when(scale == float("inf"), x).when(scale == 0, 0.0).when(x == 0, 0.0).otherwise(r)

    return run


_floor: Callable[[Column], Column] = lambda y: L.big_safe(y, F.floor)
_ceil: Callable[[Column], Column] = lambda y: L.big_safe(y, F.ceil)
scalar("ROUND", "nn", "num")(_round(lambda y: F.when(y < 2.0**52, _floor(y + 0.5)).otherwise(y)))
scalar("ROUNDUP", "nn", "num")(_round(_ceil))
scalar("ROUNDDOWN", "nn", "num")(_round(_floor))
scalar("TRUNC", "nn", "num")(_round(_floor))
scalar("INT", "n", "finite")(_floor)
scalar("ABS", "n", "finite")(F.abs)
scalar("SIGN", "n", "finite")(F.signum)
scalar("MOD", "nn", "num")(lambda a, b: (a - b * _floor(F.try_divide(a, b)), [(b == 0, "#DIV/0!")]))
scalar("POWER", "nn", "num")(lambda x, y: (F.pow(x, y), [((x == 0) & (y < 0), "#DIV/0!")]))
scalar("SQRT", "n", "finite")(lambda x: (F.sqrt(F.greatest(x, F.lit(0.0))), [(x < 0, "#NUM!")]))
scalar("EXP", "n", "num")(F.exp)
scalar("LN", "n", "finite")(lambda x: (F.log(x), [(x <= 0, "#NUM!")]))
scalar("LOG10", "n", "finite")(lambda x: (F.log10(x), [(x <= 0, "#NUM!")]))


@scalar("LOG", "nn", "num")
def _log(x: Column, base: Column | None = None) -> tuple:
    base = F.lit(10.0) if base is None else base
    return F.try_divide(F.log(x), F.log(base)), [((x <= 0) | (base <= 0) | (base == 1), "#NUM!")]


scalar("PI", "n", "finite")(lambda: F.lit(math.pi))


def _step(how: Callable[[Column], Column]) -> Callable[..., tuple]:
    return lambda x, s: (F.when(s == 0, 0.0).otherwise(how(F.try_divide(x, s)) * s), [((x > 0) & (s < 0), "#NUM!")])


scalar("CEILING", "nn", "num")(_step(_ceil))
scalar("FLOOR", "nn", "num")(_step(_floor))

# --- logic ----------------------------------------------------------------------------------------


def _if(test: Lane, yes: Lane, no: Lane | None = None) -> Lane:
    b, err = L.to_bool(test)
    return _over(err, L.choose([(b, yes)], no or L.literal(False)))


def _over(err: Column | None, x: Lane) -> Lane:
    """``x``, unless ``err`` comes before it."""
    return x if err is None else x._replace(err=err if x.err is None else F.coalesce(err, x.err))


SCALARS["IF"] = _if


def _if_error(bad: Callable[[Column], Column]) -> Callable[[Lane, Lane], Lane]:
    def run(x: Lane, other: Lane) -> Lane:
        if x.err is None:
            return x
        return L.choose([(F.coalesce(bad(x.err), F.lit(False)), other)], x)

    return run


SCALARS["IFERROR"] = _if_error(lambda e: e.isNotNull())
SCALARS["IFNA"] = _if_error(lambda e: e == "#N/A")


def _ifs(*args: Lane) -> Lane:
    cases = []
    for test, v in zip(args[::2], args[1::2], strict=False):
        b, err = L.to_bool(test)
        if err is not None:
            cases.append((err.isNotNull(), Lane("blank", None, err)))
        cases.append((b, v))
    return L.choose(cases, L.literal(Err("#N/A")))


def _switch(x: Lane, *args: Lane) -> Lane:
    cases = []
    for case, v in zip(args[::2], args[1::2], strict=False):
        c, err = L.compare(x._replace(err=None), case)
        if err is not None:
            cases.append((err.isNotNull(), Lane("blank", None, err)))
        cases.append((c == 0, v))
    return _over(x.err, L.choose(cases, args[-1] if len(args) % 2 else L.literal(Err("#N/A"))))


def _choose(which: Lane, *args: Lane) -> Lane:
    i, err = L.COERCE["i"](which)
    return _over(err, L.choose([(i == k + 1, v) for k, v in enumerate(args)], L.literal(Err("#VALUE!"))))


SCALARS["IFS"], SCALARS["SWITCH"], SCALARS["CHOOSE"] = _ifs, _switch, _choose


def _logical(join: Callable[[list[Column]], Column]) -> Callable[..., Lane]:
    """Blank arguments are left out; none left is #VALUE!."""

    def run(*args: Lane) -> Lane:
        pairs = [L.to_bool(a) for a in args]
        present = [L.tag(a) for a in args]
        nothing = F.coalesce(*present).isNull() if present else F.lit(True)
        cells = [F.when(t.isNotNull(), p[0]) if a.nullable or a.kind == "blank" else p[0] for a, t, p in zip(args, present, pairs, strict=True)]
        sure = any(not a.nullable and a.kind != "blank" for a in args)
        return Lane("bool", join(cells), L.errors(*[p[1] for p in pairs], None if sure else F.when(nothing, F.lit("#VALUE!"))), False)

    return run


def _fold(cells: list[Column], start: bool, op: Callable[[Column, Column], Column]) -> Column:
    out = F.lit(start)
    for c in cells:
        out = op(out, F.coalesce(c, F.lit(start)))
    return out


SCALARS["AND"] = _logical(lambda cs: _fold(cs, True, lambda a, b: a & b))
SCALARS["OR"] = _logical(lambda cs: _fold(cs, False, lambda a, b: a | b))
SCALARS["XOR"] = _logical(lambda cs: _fold(cs, False, lambda a, b: a != b))
scalar("NOT", "b", "bool")(lambda b: ~b)

# --- text; positions count code points, which are UTF-16 units for all but astral characters ---------


def _cut(s: Column, start: Column, n: Column) -> Column:
    """n characters from a 1-based start, both whole doubles."""
    return F.substring(s, F.least(start, F.lit(2e9)).cast("int"), F.greatest(F.least(n, F.lit(2e9)), F.lit(0.0)).cast("int"))


def _long(t: Column) -> list:
    return [(F.length(t) > MAX_TEXT, "#VALUE!")]


@scalar("CONCAT CONCATENATE", "s", "text")
def _concat(*s: Column) -> tuple:
    t = F.concat(*s)
    return t, _long(t)


def _textjoin(between: Lane, skip: Lane, *args: Lane) -> Lane:
    (d, de), (b, be) = L.to_text(between), L.to_bool(skip)
    pairs = [L.to_text(a) for a in args]
    empty = [F.coalesce(F.when(L.tag(a).isNull(), True).otherwise(L.part(a, "text") == ""), F.lit(False)) for a in args]
    kept = F.array(*[F.when(~(b & e), p[0]) for p, e in zip(pairs, empty, strict=True)])
    # array_join takes no column as delimiter: every part but the first gets it in front
    t = F.array_join(F.transform(F.filter(kept, lambda x: x.isNotNull()), lambda x, i: F.when(i == 0, x).otherwise(F.concat(d, x))), "")
    return Lane("text", t, L.errors(de, be, *[p[1] for p in pairs], L.when_error(*_long(t))), False)


SCALARS["TEXTJOIN"] = _textjoin
scalar("LEN", "s", "finite")(lambda s: F.length(s).cast("double"))


@scalar("LEFT", "si", "text")
def _left(s: Column, n: Column | None = None) -> tuple:
    n = F.lit(1.0) if n is None else n
    return _cut(s, F.lit(1.0), n), [(n < 0, "#VALUE!")]


@scalar("RIGHT", "si", "text")
def _right(s: Column, n: Column | None = None) -> tuple:
    n = F.lit(1.0) if n is None else n
    size = F.length(s).cast("double")
    return _cut(s, F.greatest(size - n, F.lit(0.0)) + 1, F.least(n, size)), [(n < 0, "#VALUE!")]


scalar("MID", "sii", "text")(lambda s, at, n: (_cut(s, F.greatest(at, F.lit(1.0)), n), [((at < 1) | (n < 0), "#VALUE!")]))


@scalar("REPLACE", "siis", "text")
def _replace(s: Column, at: Column, n: Column, new: Column) -> tuple:
    start = F.least(F.greatest(at, F.lit(1.0)), F.length(s) + F.lit(1.0))
    return F.concat(_cut(s, F.lit(1.0), start - 1), new, _cut(s, start + F.greatest(n, F.lit(0.0)), F.lit(2e9))), [((at < 1) | (n < 0), "#VALUE!")]


scalar("TRIM", "s", "text")(lambda s: F.trim(F.regexp_replace(s, " +", " ")))
scalar("UPPER", "s", "text")(F.upper)
scalar("LOWER", "s", "text")(F.lower)


@scalar("PROPER", "s", "text")
def _proper(s: Column) -> Column:
    """Runs of ASCII letters between other characters, each with its first letter raised."""
    runs = F.regexp_extract_all(s, F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0))
    ascii_ = lambda x: x.rlike("^[A-Za-z]")
    return F.array_join(F.transform(runs, lambda x: F.when(ascii_(x), F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 2**31 - 1)))).otherwise(x)), "")


scalar("EXACT", "ss", "bool")(lambda a, b: a == b)


@scalar("REPT", "si", "text")
def _rept(s: Column, n: Column) -> tuple:
    long = F.length(s) * n > MAX_TEXT
    return F.repeat(s, F.when((n >= 0) & ~long, F.least(n, F.lit(float(MAX_TEXT)))).otherwise(0.0).cast("int")), [((n < 0) | long, "#VALUE!")]


scalar("CHAR", "i", "text")(lambda n: (F.char(F.when((n >= 1) & (n <= 255), n).otherwise(1.0).cast("bigint")), [((n < 1) | (n > 255), "#VALUE!")]))
scalar("CODE", "s", "finite")(lambda s: (F.ascii(s).cast("double"), [(s == "", "#VALUE!")]))


def _value(x: Lane) -> Lane:
    s = L.trim_blanks(L.part(x, "text"))
    percent = s.endswith("%")
    body = L.trim_blanks(F.when(percent, F.substring(s, F.lit(1), F.length(s) - 1)).otherwise(s))
    n = L.numeric_text(F.replace(F.regexp_replace(body, r"^\$", ""), F.lit(","), F.lit("")))
    n = F.when(percent, n * 0.01).otherwise(n)
    v = F.coalesce(L.part(x, "num"), n)
    return Lane("num", v, L.errors(x, F.when(v.isNull(), F.lit("#VALUE!"))), False)


SCALARS["VALUE"] = _value


def _substitute(text: Lane, old: Lane, new: Lane, which: Lane | None = None) -> Lane:
    (s, es), (o, eo), (n, en) = L.to_text(text), L.to_text(old), L.to_text(new)
    if which is None:
        return Lane("text", F.when(o == "", s).otherwise(F.replace(s, o, n)), L.errors(es, eo, en), False)
    k, ek = L.COERCE["i"](which)
    nth = F.least(F.greatest(k, F.lit(1.0)), F.lit(2e9)).cast("int")
    before = F.call_function("substring_index", s, o, nth)
    # with fewer occurrences the whole text comes back
    hit = F.concat(before, n, F.substring(s, F.length(before) + F.length(o) + 1, F.lit(2**31 - 1)))
    v = F.when((o == "") | (F.length(before) == F.length(s)), s).otherwise(hit)
    return Lane("text", v, L.errors(es, eo, en, F.when(o != "", L.errors(ek, F.when(k < 1, F.lit("#VALUE!"))))), False)


SCALARS["SUBSTITUTE"] = _substitute


def _finder(fold: Callable[[Column], Column]) -> Callable[..., tuple]:
    def run(needle: Column, hay: Column, at: Column | None = None) -> tuple:
        at = F.lit(1.0) if at is None else at
        start = F.least(F.greatest(at, F.lit(1.0)), F.length(hay) + F.lit(1.0)).cast("int")
        # after cutting, so that an empty needle is found at the start
        rest = F.substring(fold(hay), start, F.lit(2**31 - 1))
        found = F.when(fold(needle) == "", F.lit(1)).otherwise(F.call_function("locate", fold(needle), rest))
        return (found + start - 1).cast("double"), [((at < 1) | (at > F.length(hay) + 1) | (found == 0), "#VALUE!")]

    return run


scalar("FIND", "ssi", "finite")(_finder(lambda s: s))
scalar("SEARCH", "ssi", "finite")(_finder(F.upper))

# --- information ----------------------------------------------------------------------------------


def _kind_is(i: int | None) -> Callable[[Lane], Lane]:
    def run(x: Lane) -> Lane:
        t = L.tag(x)
        v = t.isNull() if i is None else F.coalesce(t == i, F.lit(False))
        return Lane("bool", v if x.err is None else v & x.err.isNull(), None, False)

    return run


SCALARS |= {"ISBLANK": _kind_is(None), "ISNUMBER": _kind_is(0), "ISTEXT": _kind_is(1), "ISLOGICAL": _kind_is(2)}


def _error_is(test: Callable[[Column], Column]) -> Callable[[Lane], Lane]:
    return lambda x: Lane("bool", F.lit(False) if x.err is None else F.coalesce(test(x.err), F.lit(False)), None, False)


SCALARS |= {"ISERROR": _error_is(lambda e: e.isNotNull()), "ISERR": _error_is(lambda e: e != "#N/A"), "ISNA": _error_is(lambda e: e == "#N/A")}
SCALARS["N"] = lambda x: Lane("num", F.coalesce(L.part(x, "num"), L.part(x, "bool").cast("double"), F.lit(0.0)), x.err, False)
SCALARS["T"] = lambda x: Lane("text", F.coalesce(L.part(x, "text"), F.lit("")), x.err, False)
SCALARS["NA"] = lambda: L.literal(Err("#N/A"))


def _error_type(x: Lane) -> Lane:
    if x.err is None:
        return L.literal(Err("#N/A"))
    v = F.lit(None).cast("double")
    for i, c in enumerate(CODES):
        v = F.when(x.err == c, float(i + 1)).otherwise(v)
    return Lane("num", v, F.when(v.isNull(), F.lit("#N/A")), False)


SCALARS["ERROR.TYPE"] = _error_type

# --- dates ----------------------------------------------------------------------------------------

_EPOCH = "1899-12-30"


def _valid(x: Column) -> list:
    return [((x < 0) | (L.whole(x) > MAX_SERIAL), "#NUM!")]


def _in_range(x: Column) -> Column:
    return F.when((x >= 0) & (x < MAX_SERIAL + 1), x).otherwise(0.0)


def _day_of(x: Column) -> Column:
    """The date of a serial; the time of day is rounded to milliseconds first."""
    ms = F.floor(_in_range(x) * 86400000.0 + 0.5)
    return F.date_add(F.lit(_EPOCH).cast("date"), F.least(F.floor(ms / 86400000), F.lit(MAX_SERIAL)).cast("int"))


def _ms_of(x: Column) -> Column:
    return F.floor(_in_range(x) * 86400000.0 + 0.5) % 86400000


def _serial(d: Column) -> Column:
    return F.datediff(d, F.lit(_EPOCH).cast("date")).cast("double")


for _name, _take in {
    "YEAR": lambda x: F.year(_day_of(x)),
    "MONTH": lambda x: F.month(_day_of(x)),
    "DAY": lambda x: F.dayofmonth(_day_of(x)),
    "HOUR": lambda x: F.floor(_ms_of(x) / 3600000),
    "MINUTE": lambda x: F.floor(_ms_of(x) / 60000) % 60,
    "SECOND": lambda x: F.floor(_ms_of(x) / 1000) % 60,
}.items():
    scalar(_name, "n", "finite")(lambda x, take=_take: (take(x).cast("double"), _valid(x)))


@scalar("WEEKDAY", "ni", "finite")
def _weekday(x: Column, kind: Column | None = None) -> tuple:
    kind = F.lit(1.0) if kind is None else kind
    monday = F.weekday(_day_of(x))  # Monday is 0
    first = F.when(kind == 1, 6).when(kind.isin(2.0, 3.0), 0).when((kind >= 11) & (kind <= 17), (F.least(kind, F.lit(17.0)) - 11).cast("int"))
    v = F.pmod(monday - first, F.lit(7)) + F.when(kind == 3, 0).otherwise(1)
    return v.cast("double"), [*_valid(x), (first.isNull(), "#NUM!")]


scalar("TIME", "nnn", "num")(lambda h, m, s: (F.when(h * 3600 + m * 60 + s >= 0, (h * 3600 + m * 60 + s) % 86400.0).otherwise(0.0) / 86400.0, [(h * 3600 + m * 60 + s < 0, "#NUM!")]))
scalar("DAYS", "nn", "finite")(lambda a, b: (L.whole(a) - L.whole(b), _valid(a) + _valid(b)))


def _near(x: Column) -> Column:
    """Months or days that can't leave the years Spark knows."""
    return F.greatest(F.least(x, F.lit(3e6)), F.lit(-3e6)).cast("int")


@scalar("DATE", "iii", "finite")
def _date(y: Column, m: Column, d: Column) -> tuple:
    good = (y >= 0) & (y <= 9999) & (F.abs(m) < 2e5) & (F.abs(d) < 3e6)
    year = F.when(good, F.when(y < 1900, y + 1900).otherwise(y)).otherwise(1900.0).cast("int")
    month = F.when(good, m).otherwise(1.0)
    v = _serial(F.add_months(F.make_date(year, F.lit(1), F.lit(1)), _near(month - 1))) + F.when(good, d).otherwise(1.0) - 1
    return v, [(~good | (v < 0) | (v > MAX_SERIAL), "#NUM!")]


def _months(end: bool) -> Callable[..., tuple]:
    def run(x: Column, m: Column) -> tuple:
        far = F.abs(m) > 200000
        day = F.add_months(_day_of(x), F.when(far, 0.0).otherwise(m).cast("int"))
        v = _serial(F.last_day(day) if end else day)
        return v, [*_valid(x), (far | (v < 0) | (v > MAX_SERIAL), "#NUM!")]

    return run


scalar("EDATE", "ni", "finite")(_months(False))
scalar("EOMONTH", "ni", "finite")(_months(True))


def unary(op: str, x: Lane) -> Lane:
    if op == "@":
        return x
    n, err = L.to_num(x)
    return Lane("num", -n if op == "-" else n, err, False)


def arity(name: str, n: int, functions: dict[str, object]) -> str | None:
    """The error code of a call that can't be made."""
    f = BUILTINS.get(name)
    if name in functions:
        return None
    if f is None:
        return "#NAME?"
    return None if f.least <= n <= f.most else "#VALUE!"


#: These use each argument once.
LAZY = frozenset(("IF", "IFS", "CHOOSE", "ISERROR", "ISERR", "ISNA", "AND", "OR", "NOT", "XOR", "N", "ISBLANK", "ISNUMBER"))


class Compiler:
    """Trees to lanes.  ``resolve`` gives the lane of a ``field``, ``name`` or ``cell`` node, or None."""

    def __init__(
        self,
        resolve: Callable[[tuple], Lane | None],
        functions: dict[str, Callable[..., Lane]] | None = None,
        now: float | None = None,
        seed: int | None = None,
        special: Callable[[tuple], Lane | None] = lambda _: None,
    ) -> None:
        self.resolve, self.special = resolve, special
        self.functions = {k.upper(): f for k, f in (functions or {}).items()}
        self.now, self.seed, self.draws = now, seed, 0
        #: Intermediate columns (name, column), if ``keeps`` is set: without them a nested call would be written out many times.
        self.steps: list[tuple[str, Column]] = []
        self.keeps = False

    def put(self, v: Column) -> Column:
        """Keeps a column under a new name."""
        name = f"__v{len(self.steps)}"
        self.steps.append((name, v))
        return F.col(name)

    def kept(self, tree: tuple) -> Lane:
        """The lane of an argument, by way of an intermediate column if it is not a leaf."""
        x = self.lane(tree)
        return self.held(x) if tree[0] in ("call", "binary") else x

    def held(self, x: Lane) -> Lane:
        if not self.keeps or x.value is None:
            return x
        return x._replace(value=self.put(x.value), err=None if x.err is None else self.put(x.err))

    def lane(self, tree: tuple) -> Lane:
        """The lane of a tree, checked."""
        if self.keeps:
            L.BINDERS.append(self.put)
        try:
            return L.settle(self.raw(tree))
        finally:
            if self.keeps:
                L.BINDERS.pop()

    def raw(self, tree: tuple) -> Lane:
        found = self.special(tree)
        if found is not None:
            return found
        kind = tree[0]
        if kind == "value":
            return L.literal(tree[1])
        if kind in ("field", "name", "cell"):
            found = self.resolve(tree)
            if found is None:
                return L.literal(Err("#NAME?" if kind == "name" else "#REF!"))
            return found
        if kind == "binary":
            op = tree[1]
            if op == "&":
                return L.join_text(self.kept(tree[2]), self.kept(tree[3]))
            if op in "+-*":
                return L.arithmetic(op, self.raw(tree[2]), self.raw(tree[3]))
            a, b = self.lane(tree[2]), self.lane(tree[3])
            return L.arithmetic(op, a, b) if op in "/^" else L.relation(op, a, b)
        if kind == "prefix":
            return unary(tree[1], self.lane(tree[2]))
        if kind == "percent":
            n, err = L.to_num(self.lane(tree[1]))
            return Lane("num", n / 100.0, err, False)
        if kind == "call":
            return self.call(tree[1], tree[2])
        if kind == "array":
            return self.lane(tree[1][0][0])
        if kind == "missing":
            return L.literal(None)
        return L.literal(Err("#VALUE!" if kind == "union" else "#REF!"))

    def call(self, name: str, args: tuple) -> Lane:
        bad = arity(name, len(args), self.functions)
        if bad:
            return L.literal(Err(bad))
        if name in self.functions:
            return self.functions[name](*map(self.lane, args))
        if name in ("TODAY", "NOW"):
            if self.now is None:
                raise FormulaError("volatile-unconfigured", f"{name} needs now")
            return L.literal(float(math.floor(self.now) if name == "TODAY" else self.now))
        if name in ("RAND", "RANDBETWEEN"):
            return self.random(name, [self.lane(a) for a in args])
        if name not in SCALARS:
            raise FormulaError("unsupported", f"{name} needs a range; use aggregate, lookup or fill")
        return SCALARS[name](*map(self.lane if name in LAZY else self.kept, args))

    def random(self, name: str, args: list[Lane]) -> Lane:
        if self.seed is None:
            raise FormulaError("volatile-unconfigured", f"{name} needs seed")
        self.draws += 1
        r = F.rand(self.seed + self.draws)
        if name == "RAND":
            return Lane("num", r, None, False)
        (lo, e1), (hi, e2) = L.COERCE["i"](args[0]), L.COERCE["i"](args[1])
        return Lane("num", lo + _floor(r * (hi - lo + 1)), L.errors(e1, e2, F.when(lo > hi, F.lit("#NUM!"))), False)
