"""The column compiler against the exact evaluator."""

import datetime as dt

import pytest
from tests.grid import run

from cellwright.errors import FormulaError
from cellwright.operators import columns as C

ROWS = [(1, 2.5, "Apple pie", True, dt.date(2024, 2, 29)), (2, -7.25, "b", False, dt.date(1999, 12, 31)), (3, 0.0, "", True, dt.date(2020, 1, 31)), (4, None, None, None, None), (5, 1e15 + 0.5, "12", False, dt.date(1900, 3, 1)), (6, 3.0, "o'neil x1y", True, dt.date(9999, 12, 31))]
FORMULAS = """=[x]+1|=[x]*[x]-2|=1/[x]|=[x]^2|=[x]^-1|=[x]^0.5|=-[x]|=[x]%|=[x]&"z"|=[s]&[b]|=[s]+1|=[s]=""|=[x]=0|=[x]>[s]|=[b]>[x]|=[s]<>"B"|=[x]<=2.5|=ROUND([x],1)|=ROUND([x]*1.1,-1)|=ROUNDUP([x],0)|=ROUNDDOWN([x],0)
=TRUNC([x])|=INT([x])|=ABS([x])|=SIGN([x])|=MOD([x],2)|=MOD([x],-3)|=MOD([x],0)|=POWER([x],3)|=SQRT([x])|=LN([x])|=LOG([x])|=LOG([x],2)|=LOG10([x])|=EXP([x])|=CEILING([x],2)|=FLOOR([x],2)|=FLOOR([x],-2)
=IF([b],[x],[s])|=IF([s],1,2)|=IFERROR([s]+1,"bad")|=IFNA(NA(),[x])|=IFS([x]>1,"a",[x]<0,"b")|=SWITCH([s],"B",1,"",2,3)|=SWITCH([x],0,"zero")|=CHOOSE([i],"a",[x],TRUE)|=AND([b],[x]>0)|=OR([b],[x])|=XOR([b],TRUE)|=NOT([x])|=AND([s])
=LEN([s])|=LEFT([s],3)|=LEFT([s],-1)|=RIGHT([s],2)|=RIGHT([s],0)|=MID([s],2,3)|=MID([s],0,1)|=TRIM("  "&[s]&"  q ")|=UPPER([s])|=LOWER([s])|=PROPER([s])|=REPT([s],2)|=EXACT([s],"b")|=CHAR(64+[i])|=CODE([s])|=VALUE([s])|=VALUE("$1,2"&[i]&"%")
=SUBSTITUTE([s],"p","q")|=SUBSTITUTE([s],"p","q",2)|=SUBSTITUTE([s],"","q",0)|=REPLACE([s],2,2,"--")|=FIND("p",[s])|=FIND("",[s],2)|=SEARCH("P",[s],3)|=CONCAT([s],[x],[b])|=TEXTJOIN("-",TRUE,[s],[x],"")|=TEXTJOIN("-",FALSE,[s],[x],"")
=ISBLANK([x])|=ISNUMBER([x])|=ISTEXT([s])|=ISLOGICAL([b])|=ISERROR(1/[x])|=ISERR(NA())|=ISNA(NA())|=N([b])|=T([s])|=ERROR.TYPE(1/[x])|=NA()
=YEAR([d])|=MONTH([d])|=DAY([d])|=HOUR([d]+0.6)|=MINUTE([x])|=SECOND(0.123456)|=WEEKDAY([d])|=WEEKDAY([d],2)|=WEEKDAY([d],16)|=WEEKDAY([d],4)|=DAYS([d],10)|=EDATE([d],1)|=EDATE([d],[x])|=EOMONTH([d],-2)|=DATE([i]+2000,[i]*5,[i]*20)|=DATE([x],1,1)|=TIME([i],90,[x])
={1,2}|=@[x]|=#REF!|=FOO([x])|=ABS()|=[nope]|=IF([b],[x])+IF([b],1,[s])|=(IF([b],[x],[s]))&"|"|=IF([b],[x],[s])=[x]|=IF([b],[x],[s])>2"""


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, "i int, x double, s string, b boolean, d date").cache()


def by_hand(formula, row):
    serial = None if row[4] is None else float((row[4] - dt.date(1899, 12, 30)).days)
    cells = {"A1": float(row[0]), "B1": row[1], "C1": row[2], "D1": row[3], "E1": serial}
    text = formula
    for name, ref in (("i", "A1"), ("x", "B1"), ("s", "C1"), ("b", "D1"), ("d", "E1"), ("nope", "Nope!A1")):
        text = text.replace(f"[{name}]", ref)
    return run(text, {k: v for k, v in cells.items() if v is not None})


@pytest.mark.parametrize("line", FORMULAS.split("\n"))
def test_like_the_evaluator(frame, line):
    formulas = {f"f{i}": f for i, f in enumerate(p for p in line.split("|") if p.startswith("="))}
    if '&"|"' in line:
        formulas = {f"f{i}": f for i, f in enumerate(["={1,2}", "=@[x]", "=#REF!", "=FOO([x])", "=ABS()", "=[nope]", "=IF([b],[x])+IF([b],1,[s])", '=IF([b],[x],[s])&"!"', "=IF([b],[x],[s])=[x]", "=IF([b],[x],[s])>2"])}
    got = C.with_formulas(frame, formulas, errors=True).orderBy("i").collect()
    for row, out in zip(ROWS, got, strict=True):
        for name, formula in formulas.items():
            want, v, err = by_hand(formula, row), out[name], out[name + "_err"]
            if hasattr(v, "asDict"):
                v = next((v[k] for k in ("num", "text", "bool") if v[k] is not None), None)
            assert (err or v) == want or (isinstance(want, float) and isinstance(v, float) and abs(v - want) <= 1e-9 * max(1, abs(want))), (formula, row, v, err, want)


def test_aggregates_like_the_evaluator(frame):
    formulas = {"a": "=SUM([x])/COUNT([x])", "b": "=COUNTA([s])", "c": "=COUNTBLANK([s])", "d": '=SUMIF([s],"b",[x])', "e": '=COUNTIF([x],"<>5")', "f": "=MEDIAN([i])", "g": "=AND([b])", "h": '=COUNTIFS([b],TRUE,[i],">2")', "j": "=SUM([s])", "k": '=AVERAGEIF([i],">99")', "m": "=MAX([x],7,1E16)", "n": "=SUMPRODUCT([i],[b])"}
    out = C.aggregate(frame, formulas, errors=True).first()
    cells = {f"{c}{r}": v for r, row in enumerate(ROWS, 1) for c, v in zip("ABCD", (float(row[0]), *row[1:4]), strict=True) if v is not None}
    for name, f in formulas.items():
        text = f
        for k, ref in (("i", "A1:A6"), ("x", "B1:B6"), ("s", "C1:C6"), ("b", "D1:D6")):
            text = text.replace(f"[{k}]", ref)
        assert (out[name + "_err"] or out[name]) == run(text, cells), f


def test_rank_and_text(spark, frame):
    assert C.aggregate(frame, {"v": "=LARGE([i],2)"}, errors=False).first().v == 5.0
    assert C.aggregate(frame, {"v": "=SMALL([i],9)"}).first().v_err == "#NUM!"
    assert C.aggregate(frame, {"v": '=TEXTJOIN("-",TRUE,[s])'}, order=["i"], errors=False).first().v == "Apple pie-b-12-o'neil x1y"
    with pytest.raises(FormulaError):
        C.aggregate(frame, {"v": "=CONCAT([s])"})


def test_lookups(spark):
    df = spark.createDataFrame([(1, "B"), (2, "zz"), (3, None)], "i int, k string")
    dim = spark.createDataFrame([(1, "b", 10.0), (2, "B", 20.0), (3, "c", None)], "p int, k string, v double")
    got = {r.i: (r.v, r.v_err) for r in C.lookup(df, "v", "=[k]", dim, "k", "v", "p").collect()}
    assert got == {1: (10.0, None), 2: (None, "#N/A"), 3: (None, "#N/A")}
    bands = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.0), (4, 22.0)], "p int, k double")
    keys = spark.createDataFrame([(float(x),) for x in (5, 10, 25, 30, 99)], "x double")
    got = {r.x: (r.m, r.m_err) for r in C.match(keys, "m", "=[x]", bands, "k", "p", 1).collect()}
    assert got == {5.0: (None, "#N/A"), 10.0: (1.0, None), 25.0: (2.0, None), 30.0: (4.0, None), 99.0: (4.0, None)}
    assert C.lookup_wildcard(dim, "C*", "k", "p", "p").first().p == 3


def test_approximate_lookup_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(C, "MOST_BROADCAST", 2)
    bands = spark.createDataFrame([(i, float(i * 10)) for i in range(1, 9)], "p int, k double")
    keys = spark.createDataFrame([(float(x),) for x in (5, 10, 25, 85)], "x double")
    got = {r.x: r.m for r in C.match(keys, "m", "=[x]", bands, "k", "p", 1).collect()}
    assert got == {5.0: None, 10.0: 1.0, 25.0: 2.0, 85.0: 8.0}


def test_approximate_lookup_over_many_ranges(spark, monkeypatch):
    from pyspark.sql import functions as F

    bands = spark.range(120_000).select(F.col("id").alias("p"), (F.col("id") * 10.0).alias("k"), F.md5(F.col("id").cast("string")).alias("note"))
    keys = spark.range(300_000).select("id", ((F.col("id") * 7919 % 1_300_000) - 50_000.5).alias("x"), F.sha2(F.col("id").cast("string"), 256).alias("note")).repartition(6)
    got = C.match(keys, "m", "=[x]", bands, "k", "p", 1).selectExpr("id", "x", "m", "m_err")
    right = F.col("m").eqNullSafe(F.when(F.col("x") >= 0, F.floor(F.least(F.col("x") / 10, F.lit(119_999))).cast("double"))) & F.col("m_err").eqNullSafe(F.when(F.col("x") < 0, "#N/A"))
    found = got.agg(F.count(F.lit(1)), F.count_distinct("id"), F.count_if(right)).first()
    assert tuple(found) == (300_000, 300_000, 300_000)
    sample = keys.where("id % 100 = 0")
    by_ranges = C.match(sample, "m", "=[x]", bands, "k", "p", 1).select("id", "m", "m_err").collect()
    monkeypatch.setattr(C, "MOST_BROADCAST", 130_000)
    assert sorted(by_ranges) == sorted(C.match(sample, "m", "=[x]", bands, "k", "p", 1).select("id", "m", "m_err").collect())


def test_conditional_column(spark):
    df = spark.createDataFrame([("a",), ("A*",), (">1",), ("zz",), (None,)], "k string")
    table = spark.createDataFrame([("a", 1.0), ("A", 2.0), ("ab", 4.0), (None, 8.0)], "k string, v double")
    got = {r.k: r.s for r in C.conditional_column(df, "s", "SUMIF", "=[k]", table, "k", "v").collect()}
    assert got == {"a": 3.0, "A*": 7.0, ">1": 0.0, "zz": 0.0, None: 8.0}


def test_conditional_column_of_numeric_texts(spark):
    from pyspark.sql import functions as F

    ids = spark.range(3000).select(F.format_string("%07d", "id").alias("k"))
    table = spark.range(6000).select((F.col("id") % 2500).cast("double").alias("k"), F.col("id").cast("double").alias("v"))
    got = {int(r.k): r.s for r in C.conditional_column(ids, "s", "SUMIF", "=[k]", table, "k", "v").collect()}
    assert got == {i: float(sum(range(i, 6000, 2500))) if i < 2500 else 0.0 for i in range(3000)}


def test_conditional_column_of_odd_texts(spark):
    odd = spark.createDataFrame([("TRUE",), ("false",), (" 1.0",), ("1e0",), ("-0",), ("100%",), ("",), (None,), (">0",), ("x",)], "k string")
    for kind, rows, want in (
        ("boolean", [(True,), (True,), (False,), (None,)], {"TRUE": 2, "false": 1, "": 1, None: 1}),
        ("double", [(1.0,), (0.0,), (None,)], {" 1.0": 1, "1e0": 1, "-0": 1, ">0": 1, "": 1, None: 1}),
        ("string", [("TRUE",), ("1",), ("",), ("X",), (None,)], {"x": 1, "": 2, None: 2}),
    ):
        got = {r.k: r.n for r in C.conditional_column(odd, "n", "COUNTIF", "=[k]", spark.createDataFrame(rows, f"t {kind}"), "t").collect()}
        assert got == {r.k: float(want.get(r.k, 0)) for r in odd.collect()}, kind


def test_fill(spark):
    df = spark.createDataFrame([(i, float(i * i)) for i in range(1, 6)], "i int, v double")
    got = C.fill(df, "r", "=SUM(A$1:A2)", {"A": "v"}, ["i"], row=2, errors=False).orderBy("i").collect()
    assert [r.r for r in got] == [1.0, 5.0, 14.0, 30.0, 55.0]
    got = C.fill(df, "r", "=A2-A1", {"A": "v"}, ["i"], row=2, errors=False).orderBy("i").collect()
    assert [r.r for r in got] == [1.0, 3.0, 5.0, 7.0, 9.0]
    got = C.fill(df, "r", "=A2/A$1", {"A": "v"}, ["i"], row=2, errors=False).orderBy("i").collect()
    assert [r.r for r in got] == [1.0, 4.0, 9.0, 16.0, 25.0]


def test_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "cast(id as double) x", "cast(id as string) s").write.parquet(path)
    plan = C.with_formula(C.filter_formula(spark.read.parquet(path), "=[x]>50"), "y", "=[x]*2").select("y")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<x:double>" in text and plan.count() == 49


def test_volatile_and_functions(frame):
    with pytest.raises(FormulaError):
        C.with_formula(frame, "v", "=NOW()")
    assert C.with_formula(frame, "v", "=TODAY()", now=10.5).first().v == 10.0
    from cellwright.plans.lanes import Lane, to_num

    double = lambda x: Lane("num", to_num(x)[0] * 2, x.err, False)
    assert C.with_formula(frame, "v", "=TWICE([i])", functions={"twice": double}).orderBy("i").first().v == 2.0


@pytest.mark.parametrize("most", [100_000, 2])
def test_approximate_lookup_of_unsorted_tables(spark, monkeypatch, most):
    import random

    monkeypatch.setattr(C, "MOST_BROADCAST", most)
    rng = random.Random(1)
    table = [(i, float(i + rng.choice([0, 0, 0, 40, -30]))) for i in range(300)]
    keys = [float(rng.randint(-40, 350)) for _ in range(200)]
    bands = spark.createDataFrame(table, "p int, k double").repartition(5)
    df = C.match(spark.createDataFrame([(x,) for x in keys], "x double").repartition(3), "m", "=[x]", bands, "k", "p", 1)
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString() or most > 2

    def by_rule(x):
        best = None
        for p, k in table:
            if k > x:
                break
            best = float(p)
        return best

    assert sorted((r.x, r.m or 0.0, r.m_err) for r in df.collect()) == sorted((x, by_rule(x) or 0.0, None if by_rule(x) is not None else "#N/A") for x in keys)


def first_before(table, x, falling=False):
    """The rule, row by row: the last value before the first that is out of order."""
    best = None
    for p, k in table:
        if k is None:
            continue
        if (k < x) if falling else (k > x):
            break
        best = p
    return best


@pytest.mark.parametrize("most", [100_000, 3])
@pytest.mark.parametrize("few", [16, 2])
def test_approximate_lookups_of_all_kinds(spark, monkeypatch, most, few):
    import random

    monkeypatch.setattr(C, "MOST_BROADCAST", most)
    monkeypatch.setattr(C, "FEW", few)
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(1, 4))) for _ in range(60)}, key=lambda w: w.upper().encode())
    texts = [(i, w) for i, w in enumerate(words)]
    texts[7], texts[20] = (7, None), (20, "zz")
    numbers = [(i, float(200 - 3 * i + rng.choice([0, 0, 40]))) for i in range(50)]
    keys = [(w.upper() if i % 2 else w + "x", float(rng.randint(-20, 260))) for i, w in enumerate(words)] + [("", 0.0), (None, None)]
    df = spark.createDataFrame(keys, "s string, x double").repartition(3)
    t, n = spark.createDataFrame(texts, "p int, k string").repartition(4), spark.createDataFrame(numbers, "p int, k double").repartition(4)
    got = {(r.s, r.x): (r.m, r.m_err) for r in C.match(df, "m", "=[s]", t, "k", "p", 1).collect()}
    upper = [(p, k and k.upper().encode()) for p, k in texts]
    want = {(s, x): first_before(upper, (s or "").upper().encode()) for s, x in keys}
    assert got == {k: (None if v is None else float(v), "#N/A" if v is None else None) for k, v in want.items()}
    for column, table, of in (("x", numbers, lambda k: k[1] or 0.0), ("s", [(p, k and k.upper().encode()) for p, k in reversed(texts)], lambda k: (k[0] or "").upper().encode())):
        frame = n if column == "x" else spark.createDataFrame([(len(texts) - p, k) for p, k in texts], "p int, k string").repartition(4)
        place = (lambda p: float(p)) if column == "x" else (lambda p: float(len(texts) - p))
        got = {(r.s, r.x): (r.m, r.m_err) for r in C.match(df, "m", f"=[{column}]", frame, "k", "p", -1).collect()}
        want = {k: first_before(table, of(k), True) for k in keys}
        assert got == {k: (None if v is None else place(v), "#N/A" if v is None else None) for k, v in want.items()}
    # keys of another kind come before or after all
    assert {r.m for r in C.match(df, "m", "=[s]", n, "k", "p", 1).collect()} == {49.0}
    assert {r.m_err for r in C.match(df, "m", "=[x]", t, "k", "p", 1).collect()} == {"#N/A"}
    assert {r.m_err for r in C.match(df, "m", "=[s]", n, "k", "p", -1).collect()} == {"#N/A"}


def test_wildcard_keys_by_row(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 2)
    table = spark.createDataFrame([(3, "banana", 1.0), (1, "apple", 2.0), (2, "Apricot", None), (4, "a*", 4.0), (5, None, 5.0)], "p int, k string, v double")
    keys = ["a*", "AP?icot", "*an*", "z*", "a~*", "apple", "", None, "????????", "b?nana", "~"]
    got = {r.s: (r.v, r.v_err) for r in C.lookup(spark.createDataFrame([(k,) for k in keys], "s string"), "v", "=[s]", table, "k", "v", "p").collect()}
    miss = (None, "#N/A")
    assert got == {"a*": (2.0, None), "AP?icot": (0.0, None), "*an*": (1.0, None), "z*": miss, "a~*": (4.0, None), "apple": (2.0, None), "": miss, None: miss, "????????": miss, "b?nana": (1.0, None), "~": miss}


def test_index_hlookup_and_position(spark):
    table = spark.createDataFrame([(30, "c"), (10, "a"), (20, None)], "k int, v string")
    keys = spark.createDataFrame([(0.0,), (1.9,), (2.0,), (3.0,), (4.0,), (-1.0,)], "x double")
    got = {r.x: (r.v, r.v_err) for r in C.index(keys, "v", "=[x]", table, "v", ["k"]).collect()}
    assert got == {0.0: (None, "#REF!"), 1.9: ("a", None), 2.0: (None, None), 3.0: ("c", None), 4.0: (None, "#REF!"), -1.0: (None, "#REF!")}
    wide = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, None)], "i int, jan double, feb double")
    names = spark.createDataFrame([("FEB",), ("jan",), ("f*",), ("x",)], "s string")
    got = {r.s: (r.v, r.v_err) for r in C.hlookup(names, "v", "=[s]", wide, 3, ["i"], ["jan", "feb"]).collect()}
    assert got == {"FEB": (0.0, None), "jan": (3.0, None), "f*": (0.0, None), "x": (None, "#N/A")}
    a, b = spark.createDataFrame([(i, float(i)) for i in range(5)], "i int, x double"), spark.createDataFrame([(9 - i, float(i)) for i in range(3)], "j int, y double")
    rows = C.side_by_side(a, b, ["i"], ["j"]).orderBy("i").collect()
    assert [(r.x, r.y) for r in rows] == [(0.0, 2.0), (1.0, 1.0), (2.0, 0.0), (3.0, None), (4.0, None)]


def test_recursive_columns(spark):
    df = spark.createDataFrame([("a", i, float(i * i) if i != 4 else None, "x" if i == 5 else "1") for i in range(1, 7)] + [("b", 1, 7.0, "1")], "g string, i int, v double, s string")
    run = lambda f, start=10.0, **c: [r for r in C.recur(df, "r", f, "D", start, c, ["i"], ["g"]).where("g = 'a'").orderBy("i").collect()]
    assert [r.r for r in run("=D1+B2", B="v")] == [10.0, 14.0, 23.0, 23.0, 48.0, 84.0]
    assert [r.r for r in run("=1+(D1-B1)", B="v")] == [10.0, 10.0, 7.0, -1.0, 0.0, -24.0]
    assert [(r.r, r.r_err) for r in run("=D1+C2", C="s")][3:] == [(13.0, None), (None, "#VALUE!"), (None, "#VALUE!")]
    assert [r.r for r in run("=D1*3", 1.0)] == [1.0, 3.0, 9.0, 27.0, 81.0, 243.0] and [r.r for r in run("=D1/2", 8.0)][:3] == [8.0, 4.0, 2.0]
    for bad in ("=D1*D1", "=B2-D1", "=D1+D1", "=D1*B2", "=SUM(D$1:D1)", "=2/D1"):
        with pytest.raises(FormulaError):
            run(bad, B="v")


def test_running_sums(spark):
    import random

    from cellwright.plans.fills import running_sum

    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.randint(-5, 9)) for i in range(3000)]
    got = {r.i: r.s for r in running_sum(spark.createDataFrame(rows, "g string, i int, v int").repartition(5), ["i"], "v", "s", ["g"]).collect()}
    sums = {}
    for g, i, v in rows:
        assert got[i] == sums.get(g, 0)
        sums[g] = sums.get(g, 0) + v
    every = {r.i: r.s for r in running_sum(spark.createDataFrame(rows, "g string, i int, v int").repartition(5), ["i"], "v", "s").collect()}
    assert every[0] == 0 and every[2999] == sum(v for *_, v in rows[:-1])


def test_many_odd_criteria(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 40)
    df = spark.range(130).selectExpr("concat('>=', id) k").union(spark.createDataFrame([("1*",), (None,), ("",)], "k string"))
    table = spark.range(100).selectExpr("cast(id as double) v")
    got = {r.k: r.n for r in C.conditional_column(df, "n", "COUNTIF", "=[k]", table, "v").collect()}
    assert got == {**{f">={i}": float(max(0, 100 - i)) for i in range(130)}, "1*": 11.0, None: 0.0, "": 0.0}


def test_medians_by_ranks_and_blocks(spark):
    import random
    import statistics

    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", "b", None, "none"]), i, float(rng.randint(0, 40))) for i in range(1500)]
    rows = [(g, i, None if g == "none" or i % 17 == 0 else v) for g, i, v in rows]
    df = spark.createDataFrame(rows, "g string, i int, v double").repartition(4)
    got = {r.g: (r.m, r.m_err) for r in C.aggregate(df, {"m": "=MEDIAN([v])", "n": "=COUNT([v])"}, ["g"], ranks=True).collect()}
    for g in ("a", "b", None):
        assert got[g] == (statistics.median(v for h, _, v in rows if h == g and v is not None), None)
    assert got["none"] == (None, "#NUM!")
    assert C.aggregate(df, {"m": "=MEDIAN([v])"}, ranks=True, errors=False).first().m == statistics.median(v for *_, v in rows if v is not None)
    one = {r.i: (r.x, r.y) for r in C.fill(C.fill(df, "x", "=A4-A2+A6", {"A": "v"}, ["i"], row=4, errors=False), "y", "=COUNT(A1:A7)+MAX(A3:A4)", {"A": "v"}, ["i"], row=4, errors=False).collect()}
    for block in (2, 7, 5000):
        many = C.fill_blocks(C.fill_blocks(df, "x", "=A4-A2+A6", {"A": "v"}, ["i"], 4, False, block), "y", "=COUNT(A1:A7)+MAX(A3:A4)", {"A": "v"}, ["i"], 4, False, block)
        assert {r.i: (r.x, r.y) for r in many.collect()} == one
    formula = "=SUM(A$1:A4)-MIN(A$1:A4)+MAX(A$1:A3)*COUNT(A$1:A2)+A5"
    one = {r.i: r.x for r in C.fill(df, "x", formula, {"A": "v"}, ["i"], row=4, errors=False).collect()}
    mean = {r.i: (r.x, r.x_err) for r in C.fill(df, "x", "=AVERAGE(A$1:A4)", {"A": "v"}, ["i"], row=4).collect()}
    for block in (7, 5000):
        assert {r.i: r.x for r in C.fill_blocks(df, "x", formula, {"A": "v"}, ["i"], 4, False, block).collect()} == one
        for r in C.fill_blocks(df, "x", "=AVERAGE(A$1:A4)", {"A": "v"}, ["i"], 4, None, block).collect():
            assert r.x_err == mean[r.i][1] and (r.x == mean[r.i][0] or abs(r.x - mean[r.i][0]) < 1e-9)
    for bad in ("=SUM(A$2:A4)", "=SUM(A$1:A5)", "=A$1", "=SUM(A$1:A$4)"):
        with pytest.raises(FormulaError):
            C.fill_blocks(df, "x", bad, {"A": "v"}, ["i"], 4)


def test_many_comparisons_by_running_sums(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 5)
    rows = [(float(i % 13) if i % 7 else None, float(i) if i % 5 else None) for i in range(400)]
    table = spark.createDataFrame(rows, "v double, x double").repartition(3)
    keys = [f"{op}{n}" for op in ("<", "<=", ">", ">=", "<>") for n in ("-1", "0", "3", "3.5", "12", "99", " 1e1")] + ["<x", ">=", "1*", "5"]
    tests = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<>": lambda a, b: a != b}
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    out = {f: {r.k: r for r in C.conditional_column(df, "r", f, "=[k]", table, "v", "x").collect()} for f in ("COUNTIF", "SUMIF", "AVERAGEIF")}
    monkeypatch.setattr(C, "BLOCK", 500)
    for f, got in out.items():
        for r in C.conditional_column(df, "r", f, "=[k]", table, "v", "x").collect():
            assert got[r.k].r == r.r or abs(got[r.k].r - r.r) < 1e-6, (f, r.k)
    for op, test in tests.items():
        for n in ("-1", "0", "3", "3.5", "12", "99", " 1e1"):
            hit = [x for v, x in rows if v is not None and test(v, float(n))]
            assert out["COUNTIF"][op + n].r == float(len(hit)) and abs(out["SUMIF"][op + n].r - sum(x for x in hit if x is not None)) < 1e-6
