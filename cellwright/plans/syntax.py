"""Formula grammar: one regular expression for tokens, precedence climbing for the tree.

Nodes are tuples that begin with their kind:
  ("value", v)  ("cell", col, row, absolute_col, absolute_row, sheet)  ("range", left, right)
  ("name", text, sheet)  ("binary", op, left, right)  ("prefix", op, x)  ("percent", x)  ("spill", x)
  ("call", NAME, args)  ("array", rows)  ("union", items)  ("opaque", text)  ("missing",)  ("field", table, column)
A sheet is None, a name, or a pair of names for a span of sheets.  Trees have no parentheses left.
``("field", ...)`` is an extension: ``[column]`` and ``table[column]`` name DataFrame columns.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

from ..errors import FormulaError
from ..functions.refs import MAX_COL, MAX_ROW, column_letters, column_number
from ..functions.values import CODES, Err

MAX_DEPTH, MAX_CALLS, MAX_ARGS = 256, 64, 255

_NAME_TAIL = r"A-Za-z0-9_.\\\u0080-\U0010ffff"
_TOKEN = re.compile(
    rf"""(?P<space>[ \t\r\n]+)
    |"(?P<str>(?:[^"]|"")*)"
    |'(?P<sheet>(?:[^']|'')*)'
    |(?P<err>{"|".join(re.escape(c) for c in sorted(CODES, key=len, reverse=True))})
    |(?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
    |(?P<cell>\$?[A-Za-z]{{1,3}}\$?[0-9]{{1,7}})(?![{_NAME_TAIL}$(!\[])
    |(?P<edge>\$[A-Za-z]{{1,3}}(?![{_NAME_TAIL}$])|\$[0-9]{{1,7}}(?![0-9]))
    |(?P<name>[A-Za-z_\\\u0080-\U0010ffff][{_NAME_TAIL}]*)
    |(?P<op><=|>=|<>|[\s\S])""",
    re.X | re.A,
)
_CELL_PARTS = re.compile(r"(\$?)([A-Za-z]+)(\$?)([0-9]+)")
#: Binding strengths; all infix operators group to the left.
INFIX = {":": 100, "^": 70, "*": 60, "/": 60, "+": 50, "-": 50, "&": 40, "=": 30, "<>": 30, "<": 30, ">": 30, "<=": 30, ">=": 30}
POSTFIX = {"#": ("spill", 110), "%": ("percent", 80)}
PREFIX = 90


class Token(NamedTuple):
    kind: str
    value: str
    start: int
    end: int


def tokens(source: str) -> list[Token]:
    out, at = [], 0
    while at < len(source):
        if source[at] == "[":
            end = _bracket(source, at)
            out.append(Token("bracket", source[at:end], at, end))
            at = end
            continue
        m = _TOKEN.match(source, at)
        kind = m.lastgroup
        value = m[kind]
        if kind == "op" and value in "\"'":
            raise FormulaError("parse-error", "a quote is not closed", at)
        if kind in ("str", "sheet"):
            q = source[at]
            value = value.replace(q + q, q)
        if kind != "space":
            out.append(Token("name" if kind == "edge" else kind, value, at, m.end()))
        at = m.end()
    out.append(Token("end", "", len(source), len(source)))
    return out


def _bracket(source: str, at: int) -> int:
    depth, start = 0, at
    while at < len(source):
        c = source[at]
        if c == "'":
            at += 2
            continue
        depth += (c == "[") - (c == "]")
        at += 1
        if not depth:
            return at
    raise FormulaError("parse-error", "a bracket is not closed", start)


class _Reader:
    def __init__(self, source: str) -> None:
        self.source, self.tokens, self.at, self.depth, self.calls = source, tokens(source), 0, 0, 0

    def look(self, ahead: int = 0) -> Token:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)]

    def take(self) -> Token:
        t = self.look()
        self.at += t.kind != "end"
        return t

    def sees(self, op: str, ahead: int = 0) -> bool:
        t = self.look(ahead)
        return t.kind == "op" and t.value == op

    def need(self, op: str) -> None:
        if not self.sees(op):
            self.fail(f"expected {op!r}")
        self.take()

    def fail(self, message: str) -> None:
        raise FormulaError("parse-error", message, self.look().start)

    def expression(self, least: int = 0) -> tuple:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise FormulaError("depth-exceeded", "nested too deeply", self.look().start)
        if self.look().kind == "op" and self.look().value in ("-", "+", "@"):
            left = ("prefix", self.take().value, self.expression(PREFIX))
        else:
            left = self.operand()
        while self.look().kind == "op":
            op = self.look().value
            if op in POSTFIX and POSTFIX[op][1] >= least:
                self.take()
                left = (POSTFIX[op][0], left)
            elif op in INFIX and INFIX[op] >= least:
                self.take()
                right = self.expression(INFIX[op] + 1)
                left = ("range", left, right) if op == ":" else ("binary", op, left, right)
            else:
                break
        self.depth -= 1
        return left

    def operand(self) -> tuple:
        t = self.look()
        if t.kind == "num":
            self.take()
            return ("value", float(t.value))
        if t.kind == "str":
            self.take()
            return ("value", t.value)
        if t.kind == "err":
            self.take()
            if self.sees("!"):  # a deleted sheet
                self.take()
                return self.after_sheet(t.value, t.start, False)
            return ("value", Err(t.value))
        if t.kind == "cell":
            self.take()
            return cell_node(t.value, None)
        if t.kind == "sheet":
            return self.quoted_sheet()
        if t.kind == "bracket":
            return self.bracketed()
        if t.kind == "name":
            return self.named()
        if self.sees("("):
            self.take()
            items = [self.expression()]
            while self.sees(","):
                self.take()
                items.append(self.expression())
            self.need(")")
            return items[0] if len(items) == 1 else ("union", tuple(items))
        if self.sees("{"):
            return self.array()
        return self.fail("expected an operand")

    def array(self) -> tuple:
        rows: list[list] = [[]]
        while True:
            self.take()  # the brace or a separator
            sign = self.take().value if self.sees("-") or self.sees("+") else ""
            t = self.take()
            if t.kind == "num":
                v: object = float(t.value)
            elif t.kind == "str":
                v = t.value
            elif t.kind == "err":
                v = Err(t.value)
            elif t.kind == "name" and t.value.upper() in ("TRUE", "FALSE"):
                v = t.value.upper() == "TRUE"
            else:
                self.at -= 1
                self.fail("array constants hold literals")
            rows[-1].append(("prefix", sign, ("value", v)) if sign else ("value", v))
            if self.sees(","):
                continue
            if self.sees(";"):
                rows.append([])
                continue
            self.need("}")
            return ("array", tuple(map(tuple, rows)))

    def named(self) -> tuple:
        t = self.take()
        if self.sees("("):
            return self.call(t)
        if self.look().kind == "bracket":
            b = self.take()
            plain = re.fullmatch(r"\[([^\[\]']+)\]", b.value)
            return ("field", t.value, plain[1]) if plain and not plain[1].startswith(("#", "@")) else ("opaque", self.source[t.start : b.end])
        if self.sees("!"):
            self.take()
            return self.after_sheet(t.value, t.start, False)
        if self.sees(":") and self.look(1).kind in ("name", "sheet") and self.sees("!", 2):
            self.take()
            last = self.take().value
            self.take()
            return self.after_sheet((t.value, last), t.start, False)
        if t.value.upper() in ("TRUE", "FALSE"):
            return ("value", t.value.upper() == "TRUE")
        return ("name", t.value, None)

    def quoted_sheet(self) -> tuple:
        t = self.take()
        self.need("!")
        if re.search(r"[\[\]/\\]", t.value):
            return self.after_sheet(t.value, t.start, True)
        first, colon, last = t.value.partition(":")
        return self.after_sheet((first, last) if colon else first, t.start, False)

    def after_sheet(self, sheet: object, start: int, external: bool) -> tuple:
        t = self.look()
        if t.kind not in ("cell", "err", "name", "num"):
            self.fail("expected a reference")
        self.take()
        if external:
            return ("opaque", self.source[start : t.end])
        if t.kind == "cell":
            return cell_node(t.value, sheet)
        return ("value", Err(t.value)) if t.kind == "err" else ("name", t.value, sheet)

    def bracketed(self) -> tuple:
        t = self.take()
        after = 1 if self.look().kind in ("name", "sheet") else 0
        if self.sees("!", after):
            for _ in range(after + 1):
                self.take()
            self.after_sheet("", t.start, True)
            return ("opaque", self.source[t.start : self.tokens[self.at - 1].end])
        plain = re.fullmatch(r"\[([^\[\]]+)\]", t.value)
        if after or not plain:
            self.fail("expected a reference to another workbook")
        return ("field", None, plain[1].replace("'", ""))

    def call(self, name: Token) -> tuple:
        self.take()
        self.calls += 1
        if self.calls > MAX_CALLS:
            raise FormulaError("depth-exceeded", "function calls nested too deeply", name.start)
        args: list[tuple] = []
        if not self.sees(")"):
            while True:
                args.append(("missing",) if self.sees(",") or self.sees(")") else self.expression())
                if len(args) > MAX_ARGS:
                    raise FormulaError("too-many-args", "too many arguments", name.start)
                if not self.sees(","):
                    break
                self.take()
        self.need(")")
        self.calls -= 1
        return ("call", name.value.upper(), tuple(args))


def cell_node(ref: str, sheet: object) -> tuple:
    a, letters, b, row = _CELL_PARTS.fullmatch(ref).groups()
    return ("cell", column_number(letters), int(row), bool(a), bool(b), sheet)


@lru_cache(4096)
def parse(formula: str) -> tuple:
    """The tree of a formula, with or without its leading ``=``."""
    reader = _Reader(formula[1:] if formula.startswith("=") else formula)
    tree = reader.expression()
    if reader.look().kind != "end":
        reader.fail(f"unexpected {reader.look().value!r}")
    return tree


def children(node: tuple) -> list[tuple]:
    kind = node[0]
    if kind in ("binary",):
        return [node[2], node[3]]
    if kind == "range":
        return [node[1], node[2]]
    if kind == "prefix":
        return [node[2]]
    if kind in ("percent", "spill"):
        return [node[1]]
    if kind == "call":
        return list(node[2])
    return list(node[1]) if kind == "union" else []


def height(tree: tuple) -> int:
    """Levels of a tree, found without recursion."""
    most, stack = 0, [(tree, 1)]
    while stack:
        node, level = stack.pop()
        most = max(most, level)
        stack += [(c, level + 1) for c in children(node)]
    return most


# --- moving formulas ------------------------------------------------------------------------------


def translate(formula: str, down: int, right: int) -> str:
    """The formula as filled ``down`` and ``right``: relative references move, those off the grid become #REF!."""
    body = formula[1:] if formula.startswith("=") else formula
    found, out, at = tokens(body), [], 0

    def moved(mark: str, n: int, by: int, most: int) -> int | None:
        n = n if mark else n + by
        return n if 1 <= n <= most else None

    for i, t in enumerate(found):
        new = None
        if t.kind == "cell":
            a, letters, b, row = _CELL_PARTS.fullmatch(t.value).groups()
            c, r = moved(a, column_number(letters), right, MAX_COL), moved(b, int(row), down, MAX_ROW)
            new = "#REF!" if c is None or r is None else f"{a}{column_letters(c)}{b}{r}"
        elif t.kind in ("name", "num") and ":" in (found[i - 1].value if i else "", found[i + 1].value if i + 1 < len(found) else ""):
            # an edge of a whole-column or whole-row range
            m = re.fullmatch(r"(\$?)([A-Za-z]{1,3}|[0-9]{1,7})", t.value)
            if m and not (i + 1 < len(found) and found[i + 1].value in ("!", "(")):
                if m[2].isdigit():
                    n = moved(m[1], int(m[2]), down, MAX_ROW)
                    new = "#REF!" if n is None else f"{m[1]}{n}"
                else:
                    n = moved(m[1], column_number(m[2]), right, MAX_COL)
                    new = "#REF!" if n is None else f"{m[1]}{column_letters(n)}"
        if new is not None:
            out += [body[at : t.start], new]
            at = t.end
    return ("=" if formula.startswith("=") else "") + "".join(out) + body[at:]


def relative_form(formula: str, col: int, row: int) -> str:
    """The formula with references written as offsets from its own cell: equal for cells that were filled from one another."""
    body = formula[1:] if formula.startswith("=") else formula
    out, at = [], 0
    for t in tokens(body):
        if t.kind == "cell":
            a, letters, b, r = _CELL_PARTS.fullmatch(t.value).groups()
            c = column_number(letters)
            out += [body[at : t.start], f"R{'' if b else '+'}{int(r) - (0 if b else row)}C{'' if a else '+'}{c - (0 if a else col)}"]
            at = t.end
    return "".join(out) + body[at:]
