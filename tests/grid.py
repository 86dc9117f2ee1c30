"""A small grid to try formulas on."""

from cellwright.functions.refs import parse_cell
from cellwright.operators.evaluate import Grid


def grid(cells: dict, sheet: str = "S", **options) -> Grid:
    rows = []
    for ref, v in cells.items():
        col, row = parse_cell(ref)
        if isinstance(v, str) and v.startswith("="):
            rows.append((sheet, row, col, None, v[1:]))
        else:
            rows.append((sheet, row, col, float(v) if isinstance(v, int) and not isinstance(v, bool) else v, None))
    return Grid([sheet], rows, **options)


def run(formula: str, cells: dict | None = None, **options):
    return grid({**(cells or {}), "Z99": formula}, **options).evaluate("S", "Z99")
