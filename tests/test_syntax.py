import pytest

from cellwright.errors import FormulaError
from cellwright.functions.refs import canonical_range, column_letters, column_number, format_cell, parse_cell, serial_to_datetime
from cellwright.plans.syntax import height, parse, relative_form, tokens, translate


def test_precedence():
    assert parse("=2^3^2") == ("binary", "^", ("binary", "^", ("value", 2.0), ("value", 3.0)), ("value", 2.0))
    assert parse("-2^2") == ("binary", "^", ("prefix", "-", ("value", 2.0)), ("value", 2.0))
    assert parse("1+2*3")[1] == "+"
    assert parse("1&2=3")[1] == "="
    assert parse("5%^2")[1] == "^"
    assert parse("-A1:B2")[0] == "prefix"


@pytest.mark.parametrize(
    ("text", "kind"),
    [("A1", "cell"), ("$A$1:B2", "range"), ("A:A", "range"), ("LOG10(1)", "call"), ("Rate", "name"), ("'My Sheet'!A1", "cell"), ("[1]S!A1", "opaque"), ("T[[#Data],[x]]", "opaque"), ("{1,2;3,4}", "array"), ("(A1,B2)", "union"), ("#N/A", "value"), ("Jan:Mar!A1", "cell"), ("#REF!!A1", "cell"), ("[price]", "field"), ("dim[k]", "field")],
)
def test_kinds(text, kind):
    assert parse(text)[0] == kind


@pytest.mark.parametrize("bad", ["", "1+", "(1", "\"x", "SUM(1", "A1 B1", "{A1}", "1)", "[x", "S!"])
def test_malformed(bad):
    with pytest.raises(FormulaError) as e:
        parse(bad)
    assert e.value.code == "parse-error"


def test_limits():
    with pytest.raises(FormulaError) as e:
        parse("(" * 300 + "1" + ")" * 300)
    assert e.value.code == "depth-exceeded"
    with pytest.raises(FormulaError) as e:
        parse("ABS(" * 65 + "1" + ")" * 65)
    assert e.value.code == "depth-exceeded"
    with pytest.raises(FormulaError) as e:
        parse("SUM(" + ",".join(["1"] * 256) + ")")
    assert e.value.code == "too-many-args"
    assert height(parse("+".join(["1"] * 3000))) == 3000


def test_tokens_keep_names_apart():
    assert [t.kind for t in tokens('Sheet1!A1+"a""b"')][:-1] == ["name", "op", "cell", "op", "str"]
    assert tokens("A1B")[0].kind == "name"
    assert tokens("1E5")[0].value == "1E5"


def test_translate():
    assert translate("=A1+$B$2+C$3", 1, 1) == "=B2+$B$2+D$3"
    assert translate("A1", -1, 0) == "#REF!"
    assert translate("SUM(A:A)", 0, 1) == "SUM(B:B)"
    assert translate('"A1"&A1', 2, 0) == '"A1"&A3'
    assert relative_form("A2-A1", 2, 2) == relative_form("A3-A2", 2, 3)


def test_references():
    assert [column_number(x) for x in ("A", "Z", "AA", "XFD")] == [1, 26, 27, 16384]
    assert [column_letters(x) for x in (1, 26, 27, 16384)] == ["A", "Z", "AA", "XFD"]
    assert parse_cell("$B$3") == (2, 3)
    assert format_cell(28, 9) == "AB9"
    assert canonical_range("A1:B2") == (1, 1, 2, 2)
    assert canonical_range("B2:A1") is None
    assert canonical_range("a1") is None
    assert serial_to_datetime(45351.5).isoformat() == "2024-02-29T12:00:00"
    assert serial_to_datetime(1e9) is None
