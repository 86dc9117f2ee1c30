import pytest

from cellwright.operators.evaluate import evaluate_workbooks
from cellwright.operators.uniform import uniform_columns

SCHEMA = "path string, sheet string, sheet_index int, row int, col int, type string, n double, s string, b boolean, err string, t timestamp_ntz, formula string"


def cell(path, sheet, row, col, v=None, formula=None, index=0):
    kind = "empty" if v is None else "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "number"
    return (path, sheet, index, row, col, kind, float(v) if kind == "number" else None, v if kind == "string" else None, v if kind == "boolean" else None, None, None, formula)


@pytest.fixture
def cells(spark):
    rows = [cell(p, "Data", r, 1, r * 10) for p in ("a", "b") for r in range(1, 6)]
    rows += [cell(p, "Data", r, 2, None, f"=A{r}*Rate") for p in ("a", "b") for r in range(1, 6)]
    rows += [cell("a", "Data", 9, 2, None, "=A9"), cell("b", "Sum up", 1, 1, None, "=SUM(Data!B1:B5)&\"!\"", 1), cell("b", "Sum up", 2, 1, None, "=1/0", 1), cell("b", "Sum up", 3, 1, None, "=(", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def test_evaluation_by_workbook(spark, cells):
    names = spark.createDataFrame([("a", "Rate", "2", None), ("b", "Rate", "=-3", None), ("b", "RATE", "5", 1)], "path string, name string, refers_to string, sheet_index int")
    got = {(r.path, r.sheet, r.row, r.col): r.err or r.s or r.n for r in evaluate_workbooks(cells, names).collect()}
    assert got["a", "Data", 3, 2] == 60.0 and got["b", "Data", 3, 2] == -90.0
    assert got["b", "Sum up", 1, 1] == "-450!" and got["b", "Sum up", 2, 1] == "#DIV/0!" and got["b", "Sum up", 3, 1] == "#VALUE!"
    assert got["a", "Data", 9, 2] is None or got["a", "Data", 9, 2] == 0.0
    assert {r.err for r in evaluate_workbooks(cells).where("sheet = 'Data' AND row < 6").collect()} == {"#NAME?"}


def test_uniform_columns(cells):
    got = {(r.path, r.col, r.first_row, r.last_row, r.formula) for r in uniform_columns(cells).collect()}
    assert got == {("a", 2, 1, 5, "=A1*Rate"), ("b", 2, 1, 5, "=A1*Rate")}


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
