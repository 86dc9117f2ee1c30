"""Queries over the star-schema tables, one per group of functions or operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import columns as C
from .operators import files
from .plans.fills import numbered, running_sum
from .plans.lanes import Lane, part, to_num

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _columns(name: str, table: str, keys: list[str], formulas: dict[str, str], sql: dict[str, str], errors: bool | None = False, **options: object) -> None:
    """Calculated columns next to key columns."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = C.with_formulas(load(spark, sf_dir, table), formulas, errors, **options)
        return out.select(*keys, *[c for c in out.columns if c in sql])

    QUERIES[name] = run
    SQL[name] = f"SELECT {', '.join([*keys, *[f'{e} AS {c}' for c, e in sql.items()]])} FROM {table}"


def _aggregate(name: str, table: str, by: list[str], formulas: dict[str, str], sql: dict[str, str], where: str | None = None, **options: object) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = load(spark, sf_dir, table)
        return C.aggregate(C.filter_formula(df, where) if where else df, formulas, by, errors=False, **options)

    QUERIES[name] = run
    group = f" GROUP BY {', '.join(by)}" if by else ""
    SQL[name] = f"SELECT {', '.join([*by, *[f'{e} AS {c}' for c, e in sql.items()]])} FROM {table}{group}"


def _half(x: str, digits: int) -> str:
    f = f"{10.0**digits}::DOUBLE"
    return f"(sign({x}) * (floor(abs({x}) * {f} + 0.5) / {f}))"


_LINE = ["l_orderkey", "l_linenumber"]
_P, _D, _Q, _T = "l_extendedprice::DOUBLE", "l_discount::DOUBLE", "l_quantity::DOUBLE", "l_tax::DOUBLE"

# --- operators ------------------------------------------------------------------------------------

_columns(
    "op_arithmetic",
    "lineitem",
    _LINE,
    {"net": "=[l_extendedprice]*(1-[l_discount])", "gross": "=[l_extendedprice]*(1-[l_discount])*(1+[l_tax])", "unit": "=[l_extendedprice]/[l_quantity]", "power": "=-[l_quantity]^2", "pct": "=[l_quantity]%+50%", "chain": "=2^3^2-[l_linenumber]"},
    {"net": f"{_P} * (1 - {_D})", "gross": f"{_P} * (1 - {_D}) * (1 + {_T})", "unit": f"{_P} / {_Q}", "power": f"pow({_Q}, 2)", "pct": f"{_Q} / 100 + 50::DOUBLE / 100", "chain": "64::DOUBLE - l_linenumber"},
)
_columns(
    "op_divide_error",
    "lineitem",
    _LINE,
    {"ratio": "=[l_extendedprice]/([l_linenumber]-1)", "root": "=SQRT([l_linenumber]-3)", "kind": "=ERROR.TYPE([l_extendedprice]/([l_linenumber]-1))"},
    {
        "ratio": f"CASE WHEN l_linenumber <> 1 THEN {_P} / (l_linenumber - 1)::DOUBLE END",
        "ratio_err": "CASE WHEN l_linenumber = 1 THEN '#DIV/0!' END",
        "root": "CASE WHEN l_linenumber >= 3 THEN sqrt((l_linenumber - 3)::DOUBLE) END",
        "root_err": "CASE WHEN l_linenumber < 3 THEN '#NUM!' END",
        "kind": "CASE WHEN l_linenumber = 1 THEN 2.0::DOUBLE END",
        "kind_err": "CASE WHEN l_linenumber <> 1 THEN '#N/A' END",
    },
    errors=True,
)
_columns(
    "op_compare",
    "lineitem",
    _LINE,
    {"gt": "=[l_quantity]>24", "eq": '=[l_returnflag]="r"', "num_text": '=IF([l_linenumber]=1,[l_returnflag],[l_quantity])<[l_linestatus]', "num_bool": "=IF([l_linenumber]=1,[l_quantity]>0,[l_quantity])>TRUE", "ne": "=[l_linestatus]<>[l_returnflag]", "between": "=AND([l_quantity]>=10,[l_quantity]<=20)"},
    {"gt": f"{_Q} > 24", "eq": "upper(l_returnflag) = 'R'", "num_text": "l_linenumber <> 1 OR upper(l_returnflag) < upper(l_linestatus)", "num_bool": "false", "ne": "upper(l_linestatus) <> upper(l_returnflag)", "between": f"{_Q} >= 10 AND {_Q} <= 20"},
)
_columns("op_concat", "customer", ["c_custkey"], {"label": '=[c_name]&"/"&[c_nationkey]&"/"&TRUE'}, {"label": "c_name || '/' || CAST(c_nationkey AS VARCHAR) || '/TRUE'"})

# --- scalar functions -----------------------------------------------------------------------------

_columns(
    "fn_round_family",
    "lineitem",
    _LINE,
    {"r": "=ROUND([l_extendedprice]*[l_discount],1)", "up": "=ROUNDUP([l_extendedprice]/7,0)", "down": "=ROUNDDOWN(-[l_extendedprice]/7,0)", "tr": "=TRUNC([l_extendedprice]/7)", "i": "=INT(-[l_extendedprice]/7)"},
    {"r": _half(f"{_P} * {_D}", 1), "up": f"ceil({_P} / 7)", "down": f"-floor({_P} / 7)", "tr": f"floor({_P} / 7)", "i": f"floor(-{_P} / 7)"},
)
_columns(
    "fn_mod_step",
    "lineitem",
    _LINE,
    {"m": "=MOD(-[l_quantity],7)", "c": "=CEILING([l_quantity],5)", "f": "=FLOOR(-[l_quantity],5)", "s": "=SIGN([l_quantity]-25)", "a": "=ABS([l_quantity]-25)"},
    {"m": f"-{_Q} - 7 * floor(-{_Q} / 7)", "c": f"ceil({_Q} / 5) * 5", "f": f"floor(-{_Q} / 5) * 5", "s": f"sign({_Q} - 25)::DOUBLE", "a": f"abs({_Q} - 25)"},
)
_columns(
    "fn_math",
    "lineitem",
    _LINE,
    {"root": "=ROUND(SQRT([l_extendedprice]),6)", "ln": "=ROUND(LN([l_quantity]),6)", "lg": "=ROUND(LOG10([l_quantity]),6)", "lb": "=ROUND(LOG([l_quantity],2),6)", "ex": "=ROUND(EXP([l_discount]),6)", "pw": "=POWER([l_quantity],2)", "pi": "=ROUND(PI()*[l_quantity],6)"},
    {"root": _half(f"sqrt({_P})", 6), "ln": _half(f"ln({_Q})", 6), "lg": _half(f"log10({_Q})", 6), "lb": _half(f"(ln({_Q}) / ln(2))", 6), "ex": _half(f"exp({_D})", 6), "pw": f"pow({_Q}, 2)", "pi": _half(f"(pi() * {_Q})", 6)},
)
_columns(
    "fn_logic",
    "orders",
    ["o_orderkey"],
    {
        "cond": '=IF([o_totalprice]>100000,"big","small")',
        "ifs": '=IFS([o_totalprice]>200000,3,[o_totalprice]>100000,2,TRUE,1)',
        "sw": '=SWITCH([o_orderstatus],"f","done","o","open","other")',
        "ch": '=CHOOSE(MOD([o_orderkey],3)+1,"a","b","c")',
        "safe": "=IFERROR([o_totalprice]/MOD([o_orderkey],2),-1)",
        "na": '=IFNA(IF(MOD([o_orderkey],2)=0,NA(),"ok"),"none")',
        "x": "=XOR([o_totalprice]>100000,MOD([o_orderkey],2)=1,TRUE)",
        "o": "=OR([o_totalprice]>400000,NOT(MOD([o_orderkey],5)))",
    },
    {
        "cond": "CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END",
        "ifs": "CASE WHEN o_totalprice > 200000 THEN 3.0 WHEN o_totalprice > 100000 THEN 2.0 ELSE 1.0 END::DOUBLE",
        "sw": "CASE upper(o_orderstatus) WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END",
        "ch": "CASE o_orderkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END",
        "safe": "CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice::DOUBLE ELSE -1 END",
        "na": "CASE WHEN o_orderkey % 2 = 0 THEN 'none' ELSE 'ok' END",
        "x": "((o_totalprice > 100000)::INT + (o_orderkey % 2 = 1)::INT + 1) % 2 = 1",
        "o": "o_totalprice > 400000 OR o_orderkey % 5 = 0",
    },
)
_columns(
    "fn_text_parts",
    "part",
    ["p_partkey"],
    {"l": "=LEFT([p_name],5)", "r": "=RIGHT([p_name],4)", "m": "=MID([p_name],3,6)", "n": "=LEN([p_name])", "rp": '=REPLACE([p_name],2,3,"***")', "rept": '=REPT("ab",MOD([p_partkey],4))', "cut": "=LEFT([p_name])"},
    {"l": "left(p_name, 5)", "r": "right(p_name, 4)", "m": "substr(p_name, 3, 6)", "n": "length(p_name)::DOUBLE", "rp": "left(p_name, 1) || '***' || substr(p_name, 5)", "rept": "repeat('ab', (p_partkey % 4)::INT)", "cut": "left(p_name, 1)"},
)
_columns(
    "fn_text_case",
    "nation",
    ["n_nationkey"],
    {"u": "=UPPER([n_name])", "lo": "=LOWER([n_name])", "t": '=TRIM("  "&[n_name]&"   x ")', "e": "=EXACT(UPPER([n_name]),[n_name])", "code": "=CODE([n_name])", "ch": "=CHAR(65+MOD([n_nationkey],26))", "p": '=PROPER("o\'neil a1b")'},
    {"u": "upper(n_name)", "lo": "lower(n_name)", "t": "n_name || ' x'", "e": "upper(n_name) = n_name", "code": "unicode(n_name)::DOUBLE", "ch": "chr((65 + n_nationkey % 26)::INT)", "p": "'O''Neil A1B'"},
)
_columns(
    "fn_text_search",
    "part",
    ["p_partkey"],
    {"f": '=IFERROR(FIND("a",[p_name]),0)', "s": '=IFERROR(SEARCH("E",[p_name],2),0)', "sub": '=SUBSTITUTE([p_name],"a","@")', "sub2": '=SUBSTITUTE([p_name],"e","#",1)', "j": '=TEXTJOIN("-",TRUE,[p_brand],"",[p_partkey])', "c": '=CONCAT([p_brand],1.5,TRUE)'},
    {
        "f": "instr(p_name, 'a')::DOUBLE",
        "s": "CASE WHEN instr(upper(substr(p_name, 2)), 'E') > 0 THEN instr(upper(substr(p_name, 2)), 'E') + 1 ELSE 0 END::DOUBLE",
        "sub": "replace(p_name, 'a', '@')",
        "sub2": "CASE WHEN instr(p_name, 'e') > 0 THEN left(p_name, instr(p_name, 'e') - 1) || '#' || substr(p_name, instr(p_name, 'e') + 1) ELSE p_name END",
        "j": "p_brand || '-' || CAST(p_partkey AS VARCHAR)",
        "c": "p_brand || '1.5TRUE'",
    },
)
_columns(
    "fn_text_value",
    "customer",
    ["c_custkey"],
    {"v": '=VALUE("$"&ROUND([c_acctbal],0)&"%")', "n": "=N([c_acctbal]>0)", "t": "=T([c_name])&T([c_acctbal])", "num": '=("0"&MOD([c_custkey],10))+1', "bad": "=IFERROR([c_name]+1,-1)"},
    {"v": f"{_half('c_acctbal::DOUBLE', 0)} * 0.01::DOUBLE", "n": "(c_acctbal > 0)::INT::DOUBLE", "t": "c_name", "num": "(c_custkey % 10 + 1)::DOUBLE", "bad": "-1.0::DOUBLE"},
)
_columns(
    "fn_information",
    "customer",
    ["c_custkey"],
    {"isn": "=ISNUMBER([c_acctbal])", "ist": "=ISTEXT([c_acctbal])", "isl": "=ISLOGICAL([c_acctbal]>0)", "isb": "=ISBLANK([c_name])", "ise": "=ISERROR(1/([c_nationkey]-3))", "isr": "=ISERR(1/([c_nationkey]-3))", "isna": "=ISNA(IF([c_nationkey]=3,NA(),1))"},
    {"isn": "true", "ist": "false", "isl": "true", "isb": "c_name IS NULL", "ise": "c_nationkey = 3", "isr": "c_nationkey = 3", "isna": "c_nationkey = 3"},
)
_S = "date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE))"
_columns(
    "fn_date_parts",
    "orders",
    ["o_orderkey"],
    {"y": "=YEAR([o_orderdate])", "m": "=MONTH([o_orderdate])", "d": "=DAY([o_orderdate])", "w1": "=WEEKDAY([o_orderdate])", "w2": "=WEEKDAY([o_orderdate],2)", "w3": "=WEEKDAY([o_orderdate],3)", "w15": "=WEEKDAY([o_orderdate],15)", "days": "=DAYS([o_orderdate],DATE(1992,1,1))"},
    {
        "y": "year(o_orderdate)::DOUBLE",
        "m": "month(o_orderdate)::DOUBLE",
        "d": "day(o_orderdate)::DOUBLE",
        "w1": "(dayofweek(o_orderdate) + 1)::DOUBLE",
        "w2": "isodow(o_orderdate)::DOUBLE",
        "w3": "(isodow(o_orderdate) - 1)::DOUBLE",
        "w15": "((dayofweek(o_orderdate) - 5 + 7) % 7 + 1)::DOUBLE",
        "days": "date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE))::DOUBLE",
    },
)
_columns(
    "fn_date_shift",
    "orders",
    ["o_orderkey"],
    {"e": "=EDATE([o_orderdate],MOD([o_orderkey],13)-6)", "eo": "=EOMONTH([o_orderdate],1)", "dt": "=DATE(YEAR([o_orderdate]),MONTH([o_orderdate])+14,40)", "t": "=ROUND(TIME(MOD([o_orderkey],30),15,30),9)", "h": "=HOUR(0.75)+MINUTE([o_orderdate]+0.5104167)"},
    {
        "e": "date_diff('day', DATE '1899-12-30', CAST(CAST(o_orderdate AS DATE) + to_months(CAST(o_orderkey % 13 - 6 AS INT)) AS DATE))::DOUBLE",
        "eo": "date_diff('day', DATE '1899-12-30', last_day(CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE)))::DOUBLE",
        "dt": "date_diff('day', DATE '1899-12-30', CAST(date_trunc('month', CAST(o_orderdate AS DATE)) + INTERVAL 14 MONTH + INTERVAL 39 DAY AS DATE))::DOUBLE",
        "t": _half("(((o_orderkey % 30) * 3600 + 930) % 86400) / 86400::DOUBLE", 9),
        "h": "(18 + 15)::DOUBLE",
    },
)
_columns("fn_volatile", "orders", ["o_orderkey"], {"age": "=TODAY()-INT(NOW())+45000-[o_orderkey]", "lo": "=RANDBETWEEN(3,3)", "r": "=IF(AND(RAND()>=0,RAND()<1),1,0)"}, {"age": "45000::DOUBLE - o_orderkey", "lo": "3.0::DOUBLE", "r": "1.0::DOUBLE"}, now=45000.5, seed=7)

# --- aggregates -----------------------------------------------------------------------------------

_aggregate(
    "agg_basic",
    "lineitem",
    ["l_returnflag", "l_linestatus"],
    {"s": "=ROUND(SUM([l_extendedprice]),2)", "a": "=ROUND(AVERAGE([l_quantity]),6)", "n": "=COUNT([l_quantity])", "na": "=COUNTA([l_shipdate])", "nb": "=COUNTBLANK([l_shipdate])", "lo": "=MIN([l_extendedprice])", "hi": "=MAX([l_extendedprice])", "rows": "=ROWS([l_tax])", "cols": "=COLUMNS([l_tax])"},
    {"s": _half(f"sum({_P})", 2), "a": _half(f"avg({_Q})", 6), "n": "count(l_quantity)::DOUBLE", "na": "count(l_shipdate)::DOUBLE", "nb": "(count(*) - count(l_shipdate))::DOUBLE", "lo": f"min({_P})", "hi": f"max({_P})", "rows": "count(*)::DOUBLE", "cols": "1.0::DOUBLE"},
)
_aggregate("agg_median", "lineitem", ["l_linenumber"], {"m": "=MEDIAN([l_quantity])", "p": "=MEDIAN([l_extendedprice])"}, {"m": f"quantile_cont({_Q}, 0.5)", "p": f"quantile_cont({_P}, 0.5)"})
_aggregate("agg_logic", "orders", ["o_orderstatus"], {"a": "=AND([o_totalprice]>900)", "o": "=OR([o_totalprice]>500000)", "x": "=XOR([o_totalprice]>100000)"}, {"a": "bool_and(o_totalprice > 900)", "o": "bool_or(o_totalprice > 500000)", "x": "count(*) FILTER (WHERE o_totalprice > 100000) % 2 = 1"})
_aggregate("sumproduct", "lineitem", ["l_returnflag"], {"rev": "=ROUND(SUMPRODUCT([l_extendedprice],1-[l_discount]),2)", "cond": '=SUMPRODUCT(N([l_quantity]>24)*[l_linenumber])'}, {"rev": _half(f"sum({_P} * (1 - {_D}))", 2), "cond": f"sum(CASE WHEN {_Q} > 24 THEN l_linenumber ELSE 0 END)::DOUBLE"})
_aggregate(
    "conditional",
    "lineitem",
    ["l_returnflag"],
    {
        "s1": '=ROUND(SUMIF([l_quantity],">24",[l_extendedprice]),2)',
        "s2": '=ROUND(SUMIFS([l_extendedprice],[l_quantity],">10",[l_returnflag],"*r*"),2)',
        "c1": '=COUNTIF([l_linestatus],"<>f")',
        "c2": '=COUNTIFS([l_linestatus],"o",[l_discount],"<=0.05")',
        "a1": '=ROUND(AVERAGEIF([l_quantity],">=25",[l_tax]),6)',
        "a2": '=ROUND(AVERAGEIFS([l_quantity],[l_linestatus],"?*"),6)',
        "own": '=SUMIF([l_quantity],"<5")',
        "text": '=COUNTIF([l_quantity],"abc")',
    },
    {
        "s1": _half(f"coalesce(sum({_P}) FILTER (WHERE {_Q} > 24), 0)", 2),
        "s2": _half(f"coalesce(sum({_P}) FILTER (WHERE {_Q} > 10 AND upper(l_returnflag) LIKE '%R%'), 0)", 2),
        "c1": "(count(*) FILTER (WHERE upper(l_linestatus) <> 'F'))::DOUBLE",
        "c2": "(count(*) FILTER (WHERE upper(l_linestatus) = 'O' AND l_discount::DOUBLE <= 0.05))::DOUBLE",
        "a1": _half(f"avg({_T}) FILTER (WHERE {_Q} >= 25)", 6),
        "a2": _half(f"avg({_Q}) FILTER (WHERE upper(l_linestatus) LIKE '_%')", 6),
        "own": f"coalesce(sum({_Q}) FILTER (WHERE {_Q} < 5), 0)",
        "text": "0.0::DOUBLE",
    },
)
_aggregate("agg_textjoin", "nation", ["n_regionkey"], {"names": '=TEXTJOIN(", ",TRUE,[n_name])', "every": "=CONCAT([n_name])"}, {"names": "string_agg(n_name, ', ' ORDER BY n_nationkey)", "every": "string_agg(n_name, '' ORDER BY n_nationkey)"}, order=["n_nationkey"])
_aggregate("flagship", "lineitem", ["l_returnflag"], {"big": '=ROUND(SUMIFS([l_extendedprice],[l_quantity],">24"),2)', "share": '=ROUND(SUMIFS([l_extendedprice],[l_quantity],">24")/SUM([l_extendedprice]),6)'}, {"big": _half(f"sum({_P}) FILTER (WHERE {_Q} > 24)", 2), "share": _half(f"(sum({_P}) FILTER (WHERE {_Q} > 24) / sum({_P}))", 6)})


def _query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


@_query(
    "agg_rank",
    f"""SELECT l_returnflag, max(CASE WHEN a = 3 THEN {_P} END) AS third, max(CASE WHEN b = 2 THEN {_P} END) AS low2 FROM
    (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC) AS a, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS b FROM lineitem) GROUP BY l_returnflag""",
)
def agg_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.aggregate(load(spark, sf_dir, "lineitem"), {"third": "=LARGE([l_extendedprice],3)", "low2": "=SMALL([l_extendedprice],2)"}, ["l_returnflag"], errors=False)


@_query("agg_rank_all", f"SELECT (SELECT {_P} FROM lineitem ORDER BY 1 DESC LIMIT 1 OFFSET 9) AS top10")
def agg_rank_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.aggregate(load(spark, sf_dir, "lineitem"), {"top10": "=LARGE([l_extendedprice],10)"}, errors=False)


@_query("filter_pushdown", f"SELECT l_orderkey, l_linenumber, {_P} * {_D} AS v FROM lineitem WHERE {_Q} > 45 AND upper(l_returnflag) = 'A'")
def filter_pushdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = C.filter_formula(load(spark, sf_dir, "lineitem"), '=AND([l_quantity]>45,[l_returnflag]="a")')
    return C.with_formula(df, "v", "=[l_extendedprice]*[l_discount]").select("l_orderkey", "l_linenumber", "v")


@_query("vlookup_exact", "SELECT c_custkey, n_name AS nation, CAST(NULL AS VARCHAR) AS nation_err FROM customer JOIN nation ON c_nationkey = n_nationkey")
def vlookup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.lookup(load(spark, sf_dir, "customer"), "nation", "=[c_nationkey]", load(spark, sf_dir, "nation"), "n_nationkey", "n_name", "n_nationkey").select("c_custkey", "nation", "nation_err")


@_query(
    "vlookup_missing",
    "SELECT o_orderkey, c_acctbal::DOUBLE AS bal, CASE WHEN c_custkey IS NULL THEN '#N/A' END AS bal_err FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey",
)
def vlookup_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = C.filter_formula(load(spark, sf_dir, "customer"), "=[c_acctbal]>0")
    return C.lookup(load(spark, sf_dir, "orders"), "bal", "=[o_custkey]", rich, "c_custkey", "c_acctbal", "c_custkey").select("o_orderkey", "bal", "bal_err")


@_query("match_text", "SELECT c_custkey, (r_regionkey + 1)::DOUBLE AS pos FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def match_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region").withColumn("i", F.col("r_regionkey") + 1)
    c = C.lookup(load(spark, sf_dir, "customer"), "rk", "=[c_nationkey]", nation, "n_nationkey", "n_regionkey", "n_nationkey").drop("rk_err")
    c = C.lookup(c, "rn", "=[rk]", region, "r_regionkey", "r_name", "r_regionkey")
    return C.match(c.drop("rn_err"), "pos", "=LOWER([rn])", region, "r_name", "i").select("c_custkey", "pos")


_BANDS = "(VALUES (0, 'a'), (20000, 'b'), (50000, 'c'), (90000, 'd'))"


@_query("vlookup_approximate", f"SELECT l_orderkey, l_linenumber, band FROM lineitem ASOF LEFT JOIN {_BANDS} b(lo, band) ON {_P} >= lo")
def vlookup_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = spark.sql(f"SELECT * FROM {_BANDS} AS b(lo, band)")
    return C.lookup(load(spark, sf_dir, "lineitem"), "band", "=[l_extendedprice]", bands, "lo", "band", "lo", approximate=True).select("l_orderkey", "l_linenumber", "band")


@_query(
    "vlookup_unsorted",
    "SELECT p_partkey, CASE WHEN k < 10 THEN NULL WHEN k < 20 THEN 1.0 WHEN k < 30 THEN 2.0 ELSE 4.0 END::DOUBLE AS v, CASE WHEN k < 10 THEN '#N/A' END AS v_err FROM (SELECT p_partkey, p_partkey % 40 AS k FROM part)",
)
def vlookup_unsorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.sql("SELECT * FROM (VALUES (1, 10, 1), (2, 20, 2), (3, 30, 3), (4, 22, 4)) AS t(i, k, v)")
    return C.lookup(load(spark, sf_dir, "part"), "v", "=MOD([p_partkey],40)", table, "k", "v", "i", approximate=True).select("p_partkey", "v", "v_err")


@_query(
    "sumif_column",
    f"SELECT c_custkey, {_half('coalesce(s, 0)', 2)} AS spent, coalesce(n, 0)::DOUBLE AS n FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice::DOUBLE) AS s, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey",
)
def sumif_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    c = C.conditional_column(load(spark, sf_dir, "customer").select("c_custkey"), "s", "SUMIF", "=[c_custkey]", orders, "o_custkey", "o_totalprice")
    c = C.conditional_column(c, "n", "COUNTIF", "=[c_custkey]", orders, "o_custkey")
    return C.with_formula(c, "spent", "=ROUND([s],2)", errors=False).select("c_custkey", "spent", "n")


@_query("countif_patterns", "SELECT pat, (SELECT count(*) FROM part WHERE upper(p_type) LIKE lk)::DOUBLE AS n FROM (VALUES ('*steel*', '%STEEL%'), ('small*', 'SMALL%'), ('x', 'X')) v(pat, lk)")
def countif_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = spark.sql("SELECT * FROM (VALUES ('*steel*'), ('small*'), ('x')) AS v(pat)")
    return C.conditional_column(patterns, "n", "COUNTIF", "=[pat]", load(spark, sf_dir, "part"), "p_type").select("pat", "n")


@_query(
    "fill_running",
    """SELECT o_orderkey, floor(run) AS run, delta, n, CASE WHEN prior IS NULL THEN 0 ELSE prior END AS prior FROM (SELECT *,
      sum(o_totalprice::DOUBLE) OVER w AS run, count(*) OVER w AS n0, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)::DOUBLE AS n,
      o_totalprice::DOUBLE - coalesce(lag(o_totalprice::DOUBLE) OVER w, 0) AS delta, lag(o_totalprice::DOUBLE) OVER w AS prior
      FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))""",
)
def fill_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    where = {"columns": {"A": "o_totalprice"}, "order": ["o_orderkey"], "by": ["o_custkey"], "row": 3, "errors": False}
    for name, formula in {"run": "=INT(SUM(A$1:A3))", "delta": "=A3-A2", "n": "=COUNT(A1:A3)", "prior": "=A2+0"}.items():
        df = C.fill(df, name, formula, **where)
    return df.select("o_orderkey", "run", "delta", "n", "prior")


# --- lookups over tables of any size and kind -------------------------------------------------------------


@_query("row_numbers", "SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS nr FROM lineitem")
def row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers over an order of all rows, range by range."""
    df = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return numbered(df, ["l_extendedprice", "l_orderkey", "l_linenumber"], "nr")


@_query("running_totals", f"SELECT l_orderkey, l_linenumber, coalesce(sum({_Q}) OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lineitem")
def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What comes before each row within a flag, of which there are few: their sums go on from range to range."""
    df = load(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"))
    return running_sum(df, ["l_orderkey", "l_linenumber", "q"], "q", "before", ["l_returnflag"]).select("l_orderkey", "l_linenumber", "before")


_MANY = "(SELECT i * 0.75::DOUBLE AS lo, 'band-' || (i * 7919 % 150000) AS band FROM range(150000) t(i))"


def _many_bands(spark: SparkSession) -> DataFrame:
    return spark.range(150_000).select((F.col("id") * 0.75).alias("lo"), F.concat(F.lit("band-"), F.col("id") * 7919 % 150_000).alias("band"))


@_query("vlookup_many_bands", f"SELECT l_orderkey, l_linenumber, band, CASE WHEN band IS NULL THEN '#N/A' END AS band_err FROM (SELECT l_orderkey, l_linenumber, {_P} - 1000 AS x FROM lineitem) l ASOF LEFT JOIN {_MANY} b ON x >= lo")
def vlookup_many_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More bands than are broadcast: both sides meet range by range."""
    df = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return C.lookup(df, "band", "=[l_extendedprice]-1000", _many_bands(spark), "lo", "band", "lo", approximate=True).drop("l_extendedprice")


@_query("vlookup_thousands", f"SELECT l_orderkey, l_linenumber, band FROM lineitem ASOF LEFT JOIN (SELECT * FROM {_MANY} WHERE lo < 30000) b ON {_P} >= lo")
def vlookup_thousands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thousands of bands, found by bisection."""
    bands = _many_bands(spark).where("lo < 30000")
    df = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return C.lookup(df, "band", "=[l_extendedprice]", bands, "lo", "band", "lo", approximate=True).select("l_orderkey", "l_linenumber", "band")


@_query("index_match", "SELECT o_orderkey, p_retailprice::DOUBLE AS price, CASE WHEN p_partkey IS NULL THEN '#REF!' END AS price_err FROM orders LEFT JOIN (SELECT *, row_number() OVER (ORDER BY p_partkey DESC) AS nr FROM part) ON nr = o_custkey * 3 % 2500")
def index_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INDEX by a computed position, in descending order of the table's key; beyond its end #REF!."""
    part = load(spark, sf_dir, "part").withColumn("place", -F.col("p_partkey"))
    return C.index(load(spark, sf_dir, "orders"), "price", "=MOD([o_custkey]*3,2500)", part, "p_retailprice", ["place"]).select("o_orderkey", "price", "price_err")


@_query("match_desc", f"SELECT l_orderkey, l_linenumber, CASE WHEN {_Q} > 50 THEN NULL WHEN {_Q} > 40 THEN 1 WHEN {_Q} > 20 THEN 2 ELSE 3 END::DOUBLE AS pos FROM lineitem")
def match_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MATCH with -1: the last value, downwards, that isn't below the key."""
    table = spark.sql("SELECT * FROM (VALUES (1, 50.0D), (2, 40.0D), (3, 20.0D)) AS t(i, v)")
    return C.match(load(spark, sf_dir, "lineitem"), "pos", "=[l_quantity]", table, "v", "i", -1).select("l_orderkey", "l_linenumber", "pos")


@_query(
    "lookup_text_sorted",
    "SELECT c_custkey, n_name AS nation, CASE WHEN n_name IS NULL THEN '#N/A' END AS nation_err FROM (SELECT c_custkey, upper(substr(c_mktsegment, 1 + c_custkey::INT % 3, 4)) AS k FROM customer) ASOF LEFT JOIN (SELECT n_name, upper(n_name) AS u FROM nation) ON k >= u",
)
def lookup_text_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VLOOKUP(..., TRUE) with texts in alphabetical order."""
    nation = load(spark, sf_dir, "nation").withColumn("place", F.upper("n_name"))
    return C.lookup(load(spark, sf_dir, "customer"), "nation", "=MID([c_mktsegment],1+MOD([c_custkey],3),4)", nation, "n_name", "n_name", "place", approximate=True).select("c_custkey", "nation", "nation_err")


@_query(
    "lookup_wildcard",
    """SELECT p_partkey, pat, (SELECT min(t.p_partkey)::DOUBLE FROM part t WHERE upper(t.p_type) LIKE replace(replace(upper(pat), '*', '%'), '?', '_')) AS first FROM
    (SELECT p_partkey, left(p_type, 2 + p_partkey::INT % 4) || '*' || right(p_type, p_partkey::INT % 3) || CASE WHEN p_partkey % 5 = 0 THEN '?' ELSE '' END AS pat FROM part)""",
)
def lookup_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern of its own in every row: the first text that each fits."""
    part = load(spark, sf_dir, "part")
    keys = C.with_formula(part, "pat", '=LEFT([p_type],2+MOD([p_partkey],4))&"*"&RIGHT([p_type],MOD([p_partkey],3))&IF(MOD([p_partkey],5)=0,"?","")', errors=False)
    return C.lookup(keys, "first", "=[pat]", part.select("p_partkey", "p_type"), "p_type", "p_partkey", "p_partkey").select("p_partkey", "pat", "first")


@_query("hlookup", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 10.0 WHEN 'O' THEN 20.0 WHEN 'P' THEN 30.0 END::DOUBLE AS v, CASE WHEN o_orderstatus NOT IN ('F', 'O', 'P') THEN '#N/A' END AS v_err FROM orders")
def hlookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HLOOKUP in a wide table: names are the first row, values come from the third."""
    wide = spark.sql("SELECT * FROM (VALUES (1, 1.0D, 2.0D, 3.0D), (2, 10.0D, 20.0D, 30.0D)) AS t(i, f, o, p)")
    return C.hlookup(load(spark, sf_dir, "orders"), "v", "=[o_orderstatus]", wide, 3, ["i"], ["f", "o", "p"]).select("o_orderkey", "v", "v_err")


@_query(
    "sumifs_by_position",
    f"""SELECT l_returnflag, {_half('coalesce(sum(o_totalprice::DOUBLE) FILTER (WHERE l_quantity::DOUBLE > 24), 0)', 2)} AS s, count(*) FILTER (WHERE upper(o_orderstatus) = 'F')::DOUBLE AS n,
    {_half('coalesce(sum(l_quantity::DOUBLE * o_totalprice::DOUBLE), 0)', 2)} AS p FROM
    (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_quantity, l_returnflag) AS a FROM lineitem) FULL JOIN (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS b FROM orders) ON a = b GROUP BY l_returnflag""",
)
def sumifs_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SUMIFS, COUNTIF and SUMPRODUCT over ranges of two tables, row by row."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    both = C.side_by_side(lines, load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"], ["o_orderkey"])
    formulas = {"s": '=ROUND(SUMIFS([o_totalprice],[l_quantity],">24"),2)', "n": '=COUNTIF([o_orderstatus],"f")', "p": "=ROUND(SUMPRODUCT([l_quantity],[o_totalprice]),2)"}
    return C.aggregate(both, formulas, ["l_returnflag"], errors=False)


@_query(
    "countif_many_criteria",
    "SELECT p_partkey, (SELECT count(*) FROM part t WHERE t.p_retailprice::DOUBLE >= p.p_partkey)::DOUBLE AS n FROM part p",
)
def countif_many_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comparison of its own in every row."""
    part = load(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    keys = C.with_formula(part, "crit", '=">="&[p_partkey]', errors=False)
    return C.conditional_column(keys, "n", "COUNTIF", "=[crit]", part, "p_retailprice").select("p_partkey", "n")


@_query(
    "fill_recursive",
    f"SELECT o_orderkey, {_half('bal', 2)} AS bal, pow(2, nr - 1) AS twice FROM (SELECT o_orderkey, row_number() OVER w AS nr, 100 + sum(CASE WHEN first THEN 0 ELSE p END) OVER w AS bal FROM (SELECT o_custkey, o_orderkey, o_totalprice::DOUBLE - 5 AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 AS first FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))",
)
def fill_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that refer to their own cell above: a running balance and a doubling."""
    df = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    where = {"order": ["o_orderkey"], "by": ["o_custkey"]}
    df = C.recur(df, "b", "=B1+A2-5", "B", 100.0, columns={"A": "o_totalprice"}, **where)
    df = C.recur(df, "twice", "=C1*2", "C", 1.0, columns={}, **where)
    return C.with_formula(df, "bal", "=ROUND([b],2)", errors=False).select("o_orderkey", "bal", "twice")


@_query("median_by_ranks", f"SELECT l_returnflag, quantile_cont({_P}, 0.5) AS m, quantile_cont({_Q}, 0.5) AS q FROM lineitem GROUP BY 1")
def median_by_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of few large groups, by ranks over ranges of all values."""
    return C.aggregate(load(spark, sf_dir, "lineitem"), {"m": "=MEDIAN([l_extendedprice])", "q": "=MEDIAN([l_quantity])"}, ["l_returnflag"], errors=False, ranks=True)


@_query("user_functions", f"SELECT l_returnflag, {_half(f'exp(avg(ln({_Q})))', 6)} AS geo, {_half(f'(max({_P}) - min({_P}))', 2)} AS spread, count(*) FILTER (WHERE {_Q} * 2 > 60)::DOUBLE AS big FROM lineitem GROUP BY 1")
def user_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of one's own: of a row's values, and of ranges."""
    geomean = lambda x: Lane("num", F.exp(F.avg(F.ln(part(x, "num")))), None, False)
    spread = lambda x: Lane("num", F.max(part(x, "num")) - F.min(part(x, "num")), None, False)
    twice = lambda x: Lane("num", to_num(x)[0] * 2, x.err, False)
    df = C.with_formula(load(spark, sf_dir, "lineitem"), "double_q", "=TWICE([l_quantity])", errors=False, functions={"twice": twice})
    formulas = {"geo": "=ROUND(GEOMEAN([l_quantity]),6)", "spread": "=ROUND(SPREAD([l_extendedprice]),2)", "big": '=COUNTIF([double_q],">60")'}
    return C.aggregate(df, formulas, ["l_returnflag"], errors=False, aggregates={"geomean": geomean, "spread": spread})


@_query(
    "fill_one_order",
    f"""SELECT l_orderkey, l_linenumber, l_extendedprice, {_P} - lag({_P}, 1, 0) OVER w AS step, {_half(f"(sum({_P}) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING))", 2)} AS near, sum({_Q}) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - max({_P}) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far FROM lineitem WINDOW w AS (ORDER BY l_orderkey, l_linenumber, l_extendedprice)""",
)
def fill_one_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences, sliding and running sums over one order of all rows, block by block."""
    df = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    order = ["l_orderkey", "l_linenumber", "l_extendedprice"]
    df = C.fill_blocks(df, "so_far", "=SUM(B$1:B5)-MAX(A$1:A5)", {"A": "l_extendedprice", "B": "l_quantity"}, order, 5, False, block=1000).drop("l_quantity")
    df = C.fill_blocks(df, "step", "=A5-A4", {"A": "l_extendedprice"}, order, 5, False, block=1000)
    return C.fill_blocks(df, "near", "=ROUND(SUM(A3:A6),2)", {"A": "l_extendedprice"}, order, 5, False, block=1000)


_columns(
    "fn_more",
    "orders",
    ["o_orderkey"],
    {"c": '=CONCATENATE([o_orderstatus],"-",[o_custkey],TRUE)', "s": "=SECOND([o_orderkey]/86400)", "at": "=@[o_custkey]+0", "un": "=-(+[o_custkey])%"},
    {"c": "o_orderstatus || '-' || o_custkey || 'TRUE'", "s": "(o_orderkey % 60)::DOUBLE", "at": "o_custkey::DOUBLE", "un": "-o_custkey::DOUBLE / 100"},
)
_columns(
    "fn_random",
    "orders",
    ["o_orderkey"],
    {"whole": "=MOD(RANDBETWEEN(3,9),1)=0", "low": "=RANDBETWEEN(5,12)>=5", "high": "=RANDBETWEEN(5,12)<=12", "part": "=INT(RAND())"},
    {"whole": "true", "low": "true", "high": "true", "part": "0.0::DOUBLE"},
    seed=11,
)


QUERIES |= files.QUERIES
SQL |= files.SQL
