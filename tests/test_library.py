import datetime as dt

import pytest
from tests.grid import grid, run

from cellwright.errors import FormulaError
from cellwright.functions.criteria import glob_matches
from cellwright.functions.library import BUILTINS
from cellwright.operators.evaluate import Name, user_function

DATA = {"A1": 1, "A2": 2, "A3": "x", "A4": True, "B1": 10, "B2": 20, "B3": 30, "B4": "7"}


def test_inventory():
    assert len(BUILTINS) == 97


@pytest.mark.parametrize(
    ("formula", "value"),
    [
        ("=SUM(A1:A4)", 3.0),
        ("=SUM(B4)", 7.0),
        ("=SUM(B1:B4)", 60.0),
        ("=SUM(1,,2)", 3.0),
        ("=SUM(A3)", "#VALUE!"),
        ("=AVERAGE(D1:D4)", "#DIV/0!"),
        ("=COUNT(A1:B4,TRUE,\"5\",\"x\")", 7.0),
        ("=COUNTA(A1:B9)", 8.0),
        ("=COUNTBLANK(A1:B9)", 10.0),
        ("=MIN(D1:D2)", 0.0),
        ("=MEDIAN(B:B)", 20.0),
        ("=LARGE(B1:B3,2)", 20.0),
        ("=SMALL(B1:B3,4)", "#NUM!"),
        ("=ROUND(1.005,2)", 1.0),
        ("=ROUND(-2.5,0)", -3.0),
        ("=ROUNDUP(-1.1,0)", -2.0),
        ("=TRUNC(-1.9)", -1.0),
        ("=INT(-1.5)", -2.0),
        ("=MOD(3,-2)", -1.0),
        ("=MOD(1,0)", "#DIV/0!"),
        ("=POWER(0,-1)", "#DIV/0!"),
        ("=SQRT(-1)", "#NUM!"),
        ("=EXP(1000)", "#NUM!"),
        ("=LN(0)", "#NUM!"),
        ("=LOG(8,2)", 3.0),
        ("=LOG(8,1)", "#NUM!"),
        ("=CEILING(-2.5,1)", -2.0),
        ("=FLOOR(2.5,-1)", "#NUM!"),
        ("=FLOOR(2.5,0)", 0.0),
        ("=SUMPRODUCT(A1:A2,B1:B2)", 50.0),
        ("=SUMPRODUCT(A1:A2,B1:B3)", "#VALUE!"),
        ("=SUMPRODUCT(A1:A4)", 3.0),
        ('=IF(A1>0,"y","n")', "y"),
        ("=IF(FALSE,1)", False),
        ('=IF("x",1,2)', "#VALUE!"),
        ("=IF(TRUE,1,1/0)", 1.0),
        ("=IFERROR(1/0,5)", 5.0),
        ("=IFNA(1/0,5)", "#DIV/0!"),
        ("=SUM(IFERROR(A1:A2,0))", 3.0),
        ("=IFS(FALSE,1)", "#N/A"),
        ('=SWITCH(2,1,"a",2,"b","c")', "b"),
        ('=SWITCH(9,1,"a","c")', "c"),
        ("=CHOOSE(3,1,2)", "#VALUE!"),
        ("=AND(A1:A4)", True),
        ("=OR(D1:D4)", "#VALUE!"),
        ("=XOR(TRUE,FALSE,TRUE)", False),
        ('=NOT("x")', "#VALUE!"),
        ("=VLOOKUP(2,A1:B3,2,FALSE)", 20.0),
        ("=VLOOKUP(2.5,A1:B3,2)", 20.0),
        ("=VLOOKUP(0,A1:B3,2)", "#N/A"),
        ("=VLOOKUP(1,A1:B3,3)", "#REF!"),
        ("=VLOOKUP(1,A1:B3,0)", "#VALUE!"),
        ('=VLOOKUP("X*",A1:B3,2,FALSE)', 30.0),
        ("=HLOOKUP(10,A1:B3,2,FALSE)", 20.0),
        ('=MATCH("x",A1:A4,0)', 3.0),
        ("=MATCH(25,B1:B3)", 2.0),
        ("=MATCH(15,B1:B3,-1)", "#N/A"),
        ("=INDEX(A1:B4,2,2)", 20.0),
        ("=INDEX(A1:B4,2)", "#REF!"),
        ("=INDEX(A1:B4,0,1)", "#REF!"),
        ("=INDEX(D1:D4,2)", 0.0),
        ("=ROWS(A1:B4)*COLUMNS(A1:B4)", 8.0),
        ('=COUNTIF(A1:A9,"<>x")', 8.0),
        ('=COUNTIF(A1:A4,"<>1")', 1.0),
        ('=COUNTIF(A1:A4,">1")', 1.0),
        ('=COUNTIF(A1:A4,TRUE)', 1.0),
        ('=SUMIF(A1:A4,"<>x",B1:B4)', 30.0),
        ('=SUMIFS(B1:B4,A1:A4,">0",B1:B4,"<15")', 10.0),
        ('=AVERAGEIF(A1:A4,"z",B1:B4)', "#DIV/0!"),
        ('=COUNTIFS(A1:A4,"?",B1:B4,">5")', 3.0),
        ('=TEXTJOIN(",",TRUE,A1:B4)', "1,10,2,20,x,30,TRUE,7"),
        ('=CONCAT(A1:A4,"!")', "12xTRUE!"),
        ('=LEN("a😀")', 3.0),
        ('=LEFT("hello",9)', "hello"),
        ('=RIGHT("hello",0)', ""),
        ('=MID("hello",9,2)', ""),
        ('=MID("hello",0,2)', "#VALUE!"),
        ('=TRIM("  a   b ")', "a b"),
        ('=PROPER("o\'neil a1b")', "O'Neil A1B"),
        ('=REPT("ab",3)', "ababab"),
        ('=REPT("ab",20000)', "#VALUE!"),
        ('=EXACT("a","A")', False),
        ("=CHAR(200)", "È"),
        ("=CHAR(0)", "#VALUE!"),
        ('=CODE("")', "#VALUE!"),
        ('=VALUE("$1,234.5%")', 12.345),
        ("=VALUE(TRUE)", "#VALUE!"),
        ('=SUBSTITUTE("aXbXc","X","-",2)', "aXb-c"),
        ('=SUBSTITUTE("aXbXc","X","-",3)', "aXbXc"),
        ('=REPLACE("abcdef",2,3,"*")', "a*ef"),
        ('=FIND("","abc",4)', 4.0),
        ('=FIND("","abc",5)', "#VALUE!"),
        ('=SEARCH("B","aabc")', 3.0),
        ("=ISBLANK(D9)", True),
        ("=ISERROR(A1:A3)", True),
        ("=ISERR(NA())", False),
        ("=N(TRUE)+N(\"x\")", 1.0),
        ("=T(5)", ""),
        ("=ERROR.TYPE(NA())", 7.0),
        ("=ERROR.TYPE(1)", "#N/A"),
        ("=DATE(2020,13,1)", 44197.0),
        ("=DATE(20,1,1)", 7306.0),
        ("=DATE(1900,1,-5)", "#NUM!"),
        ("=EDATE(DATE(2020,1,31),1)", 43890.0),
        ("=EOMONTH(DATE(2020,1,15),-1)", 43830.0),
        ("=YEAR(2958466)", "#NUM!"),
        ("=HOUR(0.75)", 18.0),
        ("=WEEKDAY(1,2)", 7.0),
        ("=WEEKDAY(1,9)", "#NUM!"),
        ("=TIME(25,0,0)", 1 / 24),
        ("=DAYS(10.9,1.1)", 9.0),
        ('=1="1"', False),
        ('=1<"1"', True),
        ("=D9=0", True),
        ('=D9=""', True),
        ('="abc"="ABC"', True),
        ('=""+1', "#VALUE!"),
        ('="3"+1', 4.0),
        ("=0.1+0.2&\"\"", "0.3"),
        ('=1/3&""', "0.333333333333333"),
        ("=50%", 0.5),
        ("=A1:B2", 1.0),
        ("=(A1,B1)", "#VALUE!"),
        ("=A1#", "#REF!"),
        ("=Nope!A1", "#REF!"),
        ("=FOO(1)", "#NAME?"),
        ("=ABS(1,2)", "#VALUE!"),
        ("=A1 B1", "#VALUE!"),
        ("=-2^2", 4.0),
    ],
)
def test_formula(formula, value):
    got = run(formula, DATA)
    assert got == value and isinstance(got, bool) == isinstance(value, bool)


def test_cycles_depend_on_where_they_start():
    g = grid({"A1": "=IFERROR(B1,1)", "B1": "=A1+1"})
    assert [v for *_, v in g.all()] == [1.0, "#CYCLE!"]
    g = grid({"A1": "=IFERROR(B1,1)", "B1": "=A1+1"})
    assert g.evaluate("S", "B1") == 2.0
    assert run("=Z99:Z99") == "#CYCLE!"
    assert run("=IF(TRUE,1,Z99)") == 1.0
    assert grid({"A1": "=SUM(A1:A3)", "A2": 1}).evaluate("S", "A1") == "#CYCLE!"


def test_long_chain():
    cells = {"A1": 1} | {f"A{i}": f"=A{i - 1}+1" for i in range(2, 30001)}
    assert grid(cells).evaluate("S", "A30000") == 30000.0


def test_resources():
    with pytest.raises(FormulaError) as e:
        grid({f"A{i}": f"=A{i - 1}+1" for i in range(2, 50)}, fuel=10).evaluate("S", "A49")
    assert e.value.code == "budget-exceeded"
    with pytest.raises(FormulaError) as e:
        run("+".join(["=1"] + ["1"] * 4000))
    assert e.value.code == "depth-exceeded"
    with pytest.raises(FormulaError) as e:
        run("=NOW()")
    assert e.value.code == "volatile-unconfigured"
    assert run("=TODAY()", now=dt.datetime(2024, 2, 29, 12)) == 45351.0
    assert run("=RANDBETWEEN(1,6)", random=lambda: 0.99) == 6.0


def test_names_and_functions():
    names = [Name("Rate", "0.5"), Name("Minus", "-3"), Name("Block", "S!$A$1:$A$2"), Name("Bad", "1+1"), Name("Rate", "7", 0)]
    assert run("=Rate", DATA, names=names) == 7.0
    assert run("=S!Rate", DATA, names=names) == 0.5
    assert run("=SUM(Block)+Minus", DATA, names=names) == 0.0
    assert run("=Bad", DATA, names=names) == "#NAME?"
    twice = user_function(lambda x: x * 2, 1, 1)
    assert run("=TWICE(4)", functions={"twice": twice}) == 8.0
    assert run("=ODD()", functions={"odd": user_function(lambda: object())}) == "#VALUE!"
    assert run("=SUM(1)", functions={"sum": user_function(lambda x: 42, 1, 1)}) == 42.0


def test_globs_are_linear():
    assert glob_matches("a*b", "a~*b") and not glob_matches("axb", "a~*b")
    assert glob_matches("abcabc", "*c") and glob_matches("", "*") and not glob_matches("", "?")
    assert not glob_matches("a" * 30000 + "b", "*a" * 30 + "c")
