"""Criteria of the conditional functions: ``">5"``, ``"<>x"``, ``"a*"``, 3, TRUE, blank."""

from __future__ import annotations

import re
from typing import NamedTuple

from .values import COMPARISON, Err, Stop, general, numeric_text, ok, utf16


class Criterion(NamedTuple):
    kind: str  # number, bool, text, glob or blank
    op: str
    operand: object


_OPERATOR = re.compile(r"<=|>=|<>|<|>|=|")


def parse_criterion(v: object) -> Criterion:
    v = ok(v)
    if v is None:
        return Criterion("blank", "=", None)
    if isinstance(v, bool):
        return Criterion("bool", "=", v)
    if isinstance(v, float):
        return Criterion("number", "=", v)
    op = _OPERATOR.match(v)[0]
    rest, op = v[len(op) :], op or "="
    x = numeric_text(rest)
    if x is not None:
        return Criterion("number", op, x)
    if rest.lower() in ("true", "false"):
        return Criterion("bool", op, rest.lower() == "true")
    return Criterion("glob" if op in ("=", "<>") and re.search(r"[*?]", rest) else "text", op, rest)


def glob_parts(pattern: str) -> list[str]:
    """Pieces of the upper-cased pattern: "*", "?" or "=" and a literal character."""
    return [("=" + m[1].upper()) if m[1] else m[0] if m[0] in "*?" else "=" + m[0].upper() for m in re.finditer(r"~([*?~])|[\s\S]", pattern)]


def glob_matches(s: str, pattern: str) -> bool:
    """Linear in s times pattern: each run between stars is found at its first place."""
    s, runs = s.upper(), [[]]
    for p in glob_parts(pattern):
        if p == "*":
            runs.append([])
        else:
            runs[-1].extend([None] if p == "?" else list(p[1:]))

    def fits(run: list, at: int) -> bool:
        return at >= 0 and at + len(run) <= len(s) and all(c is None or c == s[at + i] for i, c in enumerate(run))

    first, *rest = runs
    if not fits(first, 0) or (not rest and len(first) != len(s)):
        return False
    at = len(first)
    for run in rest[:-1]:
        while at + len(run) <= len(s) and not fits(run, at):
            at += 1
        if at + len(run) > len(s):
            return False
        at += len(run)
    return not rest or (len(s) - len(rest[-1]) >= at and fits(rest[-1], len(s) - len(rest[-1])))


def matches(v: object, c: Criterion) -> bool:
    """Never true of an error; numbers and booleans match only their own type."""
    try:
        v = ok(v)
    except Stop:
        return False
    if c.kind == "number":
        return isinstance(v, float) and COMPARISON[c.op]((v > c.operand) - (v < c.operand))
    if c.kind == "bool":
        return isinstance(v, bool) and c.op in ("=", "<>") and (v == c.operand) == (c.op == "=")
    if c.kind == "blank":
        return v is None or (v == "" and not isinstance(v, bool))
    s = "" if v is None else ("FALSE", "TRUE")[v] if isinstance(v, bool) else general(v) if isinstance(v, float) else v
    if c.kind == "glob":
        return glob_matches(s, c.operand) == (c.op == "=")
    a, b = utf16(s.upper()), utf16(c.operand.upper())
    return COMPARISON[c.op]((a > b) - (a < b))


__all__ = ["Criterion", "Err", "glob_matches", "glob_parts", "matches", "parse_criterion"]
