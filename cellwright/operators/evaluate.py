"""Workbook evaluation: every formula of a grid of cells, with memory, laziness and cycles.

``Grid`` evaluates one workbook in one process.  A formula is run until it needs a formula cell that has no value yet;
then it is set aside, that cell is run, and the formula starts again with the value at hand.  So no
chain of references deepens the Python stack.  A reference back to a cell that is being evaluated is ``#CYCLE!``.

``evaluate_workbooks`` does this on Spark, one task per workbook; ``operators.columns`` is for tables of any size.
"""

from __future__ import annotations

import bisect
import datetime as dt
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import FormulaError
from ..functions.library import BUILTINS, Function
from ..functions.refs import MAX_COL, MAX_ROW, column_number, datetime_to_serial, parse_cell
from ..functions.values import CYCLE, NAME, REF, VALUE, Area, Err, Stop, binary, num, ok, top_left
from ..plans.syntax import height, parse

DEPTH, FUEL = 256, 5_000_000


class Need(Exception):
    """Formula cells (sheet, column, row) that must be evaluated first, in order."""

    def __init__(self, cells: list[tuple[str, int, int]]) -> None:
        self.cells = cells


class Context(NamedTuple):
    now: Callable[[], float]
    random: Callable[[], float]


class Name(NamedTuple):
    name: str
    refers_to: str
    sheet: int | None = None  # index of the sheet it belongs to


def _volatile(now: dt.datetime | float | None, random: Callable[[], float] | None) -> Context:
    def missing(what: str) -> Callable[[], float]:
        def fail() -> float:
            raise FormulaError("volatile-unconfigured", f"{what} must be given")

        return fail

    at = datetime_to_serial(now) if isinstance(now, dt.datetime) else now
    return Context(missing("now") if at is None else lambda: at, random or missing("random"))


class Sheet:
    """Used cells by row and column; rows are kept sorted for ranges."""

    def __init__(self) -> None:
        self.values: dict[tuple[int, int], object] = {}
        self.formulas: dict[tuple[int, int], str] = {}
        self.rows: dict[int, list[int]] = {}
        self.order: list[int] = []

    def put(self, row: int, col: int, value: object, formula: str | None) -> None:
        if (row, col) not in self.values:
            self.rows.setdefault(row, []).append(col)
        self.values[row, col] = value
        if formula is not None:
            self.formulas[row, col] = formula

    def seal(self) -> None:
        self.order = sorted(self.rows)
        for cols in self.rows.values():
            cols.sort()

    def within(self, c1: int, r1: int, c2: int, r2: int) -> list[tuple[int, int]]:
        out = []
        for row in self.order[bisect.bisect_left(self.order, r1) : bisect.bisect_right(self.order, r2)]:
            cols = self.rows[row]
            out += [(row, c) for c in cols[bisect.bisect_left(cols, c1) : bisect.bisect_right(cols, c2)]]
        return out


class Grid:
    """``cells``: (sheet, row, column, value, formula or None) in the order of evaluation; ``sheets``: names in order."""

    def __init__(
        self,
        sheets: list[str],
        cells: Iterable[tuple[str, int, int, object, str | None]],
        names: Iterable[Name] = (),
        functions: dict[str, Function] | None = None,
        now: dt.datetime | float | None = None,
        random: Callable[[], float] | None = None,
        fuel: int = FUEL,
    ) -> None:
        self.sheets = {s: Sheet() for s in sheets}
        self.index = {s: i for i, s in enumerate(sheets)}
        for sheet, row, col, value, formula in cells:
            self.sheets[sheet].put(row, col, value, formula)
        for s in self.sheets.values():
            s.seal()
        self.functions = BUILTINS | {k.upper(): f for k, f in (functions or {}).items()}
        self.context, self.fuel = _volatile(now, random), fuel
        self.configured = now is not None or random is not None
        self.done: dict[tuple[str, int, int], object] = {}
        self.busy: set[tuple[str, int, int]] = set()
        self.names: dict[tuple[int | None, str], tuple] = {(n.sheet, n.name.upper()): self._name(n, sheets) for n in names}
        self.areas: dict[tuple, Area] = {}

    def _name(self, n: Name, sheets: list[str]) -> tuple:
        """("value", v), ("tree", tree, sheet) or ("bad",)."""
        try:
            tree = parse(n.refers_to)
        except FormulaError:
            return ("bad",)
        if tree[0] == "value":
            return tree
        if tree[0] == "prefix" and tree[1] in "+-" and tree[2][0] == "value" and isinstance(tree[2][1], float):
            return ("value", -tree[2][1] if tree[1] == "-" else tree[2][1])
        home = sheets[n.sheet or 0] if (n.sheet or 0) < len(sheets) else ""
        return ("tree", tree, home) if tree[0] in ("cell", "range") else ("bad",)

    # -- cells

    def get(self, sheet: str, col: int, row: int) -> object:
        """The value of a cell, or Need if its formula has not been run."""
        key = (sheet, col, row)
        if key in self.done:
            return self.done[key]
        if key in self.busy:
            return Err(CYCLE)
        s = self.sheets[sheet]
        if (row, col) in s.formulas:
            raise Need([key])
        return s.values.get((row, col))

    def value_of(self, sheet: str, col: int, row: int) -> object:
        """Runs a cell and all it needs."""
        stack = [(sheet, col, row)]
        while stack:
            key = stack[-1]
            if key in self.done:
                stack.pop()
                self.busy.discard(key)
                continue
            formula = self.sheets[key[0]].formulas.get((key[2], key[1]))
            if formula is None:
                self.done[key] = self.sheets[key[0]].values.get((key[2], key[1]))
                continue
            if key not in self.busy:
                self.fuel -= 1
                if self.fuel < 0:
                    raise FormulaError("budget-exceeded", "too many cells were visited")
                self.busy.add(key)
            try:
                tree = parse(formula)
            except FormulaError:
                self.done[key] = VALUE
                continue
            if height(tree) > DEPTH:
                raise FormulaError("depth-exceeded", "nested too deeply")
            try:
                self.done[key] = self.run(tree, key[0])
            except Need as need:
                # the first needed cell is on top; those that meanwhile get done are skipped
                stack += reversed(need.cells)
        return self.done[sheet, col, row]

    def all(self) -> Iterator[tuple[str, int, int, object]]:
        """(sheet, row, column, value) of all formula cells, in order."""
        for name, sheet in self.sheets.items():
            for row, col in list(sheet.formulas):
                yield name, row, col, self.shown(name, col, row)

    def shown(self, sheet: str, col: int, row: int) -> object:
        """A cell's value; of a range its first cell, run if need be."""
        v = self.value_of(sheet, col, row)
        while True:
            try:
                return top_left(v)
            except Need as need:
                for key in need.cells:
                    self.value_of(*key)

    def evaluate(self, sheet: str, ref: str) -> object:
        col, row = parse_cell(ref)
        return self.shown(sheet, col, row) if sheet in self.sheets else REF

    # -- trees

    def run(self, tree: tuple, home: str) -> object:
        kind = tree[0]
        if kind == "value":
            return tree[1]
        if kind == "binary":
            left = self.run(tree[2], home)
            return binary(tree[1], left, self.run(tree[3], home))
        if kind == "call":
            return self.call(tree[1], tree[2], home)
        if kind == "cell":
            sheet = self.sheet(tree[5], home)
            if sheet is None or not tree[2]:
                return REF
            return self.get(sheet, tree[1], tree[2])
        if kind == "range":
            return self.area(tree[1], tree[2], home)
        if kind == "name":
            return self.named(tree[1], tree[2], home)
        if kind in ("prefix", "percent"):
            try:
                if kind == "percent":
                    return num(self.run(tree[1], home)) / 100
                v = self.run(tree[2], home)
                return ok(v) if tree[1] == "@" else -num(v) if tree[1] == "-" else num(v)
            except Stop as e:
                return e.err
        if kind == "array":
            return self.run(tree[1][0][0], home)
        if kind == "missing":
            return None
        return VALUE if kind == "union" else REF

    def sheet(self, given: object, home: str) -> str | None:
        if given is None:
            return home
        return given if isinstance(given, str) and given in self.sheets else None

    def named(self, name: str, sheet: object, home: str) -> object:
        if isinstance(sheet, tuple):
            return REF
        found = self.names.get((None, name.upper())) if sheet is not None else self.names.get((self.index.get(home, 0), name.upper())) or self.names.get((None, name.upper()))
        if found is None or found[0] == "bad":
            return NAME
        return found[1] if found[0] == "value" else self.run(found[1], found[2])

    def area(self, left: tuple, right: tuple, home: str) -> object:
        a, b = _edge_of(left), _edge_of(right)
        if a is None or b is None or (a[0] is None) != (b[0] is None) or (a[1] is None) != (b[1] is None):
            return REF
        sheet = self.sheet(a[2] if a[2] is not None else b[2], home)
        if sheet is None:
            return REF
        c1, c2 = sorted((a[0], b[0])) if a[0] is not None else (1, MAX_COL)
        r1, r2 = sorted((a[1], b[1])) if a[1] is not None else (1, MAX_ROW)
        if c2 > MAX_COL or r2 > MAX_ROW:
            return REF
        key = (sheet, c1, r1, c2, r2)
        if key not in self.areas:
            self.areas[key] = Area(sheet, c1, r1, c2, r2, lambda: self.used(*key), lambda col, row: self.get(sheet, col, row))
        return self.areas[key]

    def used(self, sheet: str, c1: int, r1: int, c2: int, r2: int) -> list[tuple[int, int]]:
        found = self.sheets[sheet].within(c1, r1, c2, r2)
        formulas = self.sheets[sheet].formulas
        open_ = [(sheet, c, r) for r, c in found if (r, c) in formulas and (sheet, c, r) not in self.done and (sheet, c, r) not in self.busy]
        if open_:
            raise Need(open_)
        return found

    def call(self, name: str, args: tuple, home: str) -> object:
        f = self.functions.get(name)
        if f is None:
            return NAME
        if not f.least <= len(args) <= f.most:
            return VALUE
        if f.volatile and not self.configured:
            raise FormulaError("volatile-unconfigured", f"{name} needs now or random")
        given = [(lambda a=a: self.run(a, home)) for a in args] if f.lazy else [self.run(a, home) for a in args]
        try:
            return f.run(self.context, *given) if f.volatile else f.run(*given)
        except Stop as e:
            return e.err


def _edge_of(node: tuple) -> tuple[int | None, int | None, object] | None:
    """(column, row, sheet) of a range's end; one of the first two may be None."""
    if node[0] == "cell":
        return None if isinstance(node[5], tuple) or not node[2] else (node[1], node[2], node[5])
    if node[0] == "value" and isinstance(node[1], float) and node[1].is_integer() and node[1] >= 1:
        return (None, int(node[1]), None)
    if node[0] == "name" and not isinstance(node[2], tuple):
        bare = node[1].removeprefix("$")
        if bare.isdecimal() and bare.isascii() and int(bare):
            return (None, int(bare), node[2])
        if bare.isalpha() and bare.isascii() and len(bare) <= 3:
            return (column_number(bare), None, node[2])
    return None


def user_function(run: Callable, least: int = 0, most: int = 255, lazy: bool = False, volatile: bool = False) -> Function:
    """A function of the caller's: results outside the value domain become #VALUE!."""
    if least < 0 or most < least or not callable(run):
        raise FormulaError("unsupported", "a bad function")

    def checked(*args: object) -> object:
        v = run(*args)
        if isinstance(v, int) and not isinstance(v, bool):
            v = float(v)
        good = v is None or isinstance(v, (bool, str, Area)) or (isinstance(v, float) and v - v == 0)
        return v if good else VALUE

    return Function(least, most, checked, lazy, volatile)


# --- Spark ----------------------------------------------------------------------------------------

RESULT = "path string, sheet string, row int, col int, type string, n double, s string, b boolean, err string"


def lanes(v: object) -> tuple[str, float | None, str | None, bool | None, str | None]:
    """type, n, s, b and err of a value."""
    if v is None:
        return "empty", None, None, None, None
    if isinstance(v, bool):
        return "boolean", None, None, v, None
    if isinstance(v, Err):
        return "error", None, None, None, str(v)
    return ("string", None, v, None, None) if isinstance(v, str) else ("number", v, None, None, None)


def value_of_lanes(kind: str, n: float | None, s: str | None, b: bool | None, err: str | None, at: object = None) -> object:
    if kind == "date":
        return datetime_to_serial(at)
    return {"number": n, "string": s, "boolean": b, "error": Err(err) if err else VALUE}.get(kind)


def evaluate_workbooks(cells: DataFrame, names: DataFrame | None = None, functions: dict[str, Function] | None = None, now: float | None = None, fuel: int = FUEL) -> DataFrame:
    """The values of all formula cells of each workbook (``path``).

    ``cells`` is as the sources give it; a workbook must fit into one task.  ``names``: path, name, refers_to, sheet_index.
    """
    columns = ["path", "sheet", "sheet_index", "row", "col", "type", "n", "s", "b", "err", "t", "formula"]
    cells = cells.select(*columns, F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("refers_to"))
    if names is not None:
        extra = names.select("path", *[F.lit(None).cast(cells.schema[c].dataType).alias(c) if c != "sheet_index" else F.col("sheet_index") for c in columns[1:]], "name", "refers_to")
        cells = cells.unionByName(extra)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        path = pdf["path"].iloc[0]
        own = pdf[pdf["name"].notna()]
        found = [Name(n, r, None if pd.isna(i) else int(i)) for n, r, i in zip(own["name"], own["refers_to"], own["sheet_index"], strict=True)]
        pdf = pdf[pdf["name"].isna()].sort_values(["sheet_index", "row", "col"])
        none = lambda x: None if x is None or x is pd.NaT or x != x else x
        sheets = list(dict.fromkeys(pdf["sheet"]))
        rows = [
            (sheet, int(row), int(col), value_of_lanes(kind, none(n), none(s), none(b) if none(b) is None else bool(b), none(err), at.to_pydatetime() if isinstance(at, pd.Timestamp) else at), none(formula))
            for sheet, row, col, kind, n, s, b, err, at, formula in zip(*[pdf[c] for c in ("sheet", "row", "col", "type", "n", "s", "b", "err", "t", "formula")], strict=True)
        ]
        grid = Grid(sheets, rows, found, functions, now=now, fuel=fuel)
        out = [(path, sheet, row, col, *lanes(v)) for sheet, row, col, v in grid.all()]
        return pd.DataFrame(out, columns=["path", "sheet", "row", "col", "type", "n", "s", "b", "err"]).astype({"row": "int32", "col": "int32", "n": "float64"})

    return cells.groupBy("path").applyInPandas(run, RESULT)
