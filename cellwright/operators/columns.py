"""Formulas over DataFrames: calculated columns, aggregates, lookups, order statistics and fills.

``[column]`` in a formula names a column of the DataFrame.  Results come as a value column and, where the formula
can fail, an error column ``<name>_err``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..errors import FormulaError
from ..functions.criteria import parse_criterion
from ..functions.refs import MAX_COL, column_letters, column_number
from ..functions.values import Err, Stop
from ..functions.values import num as number
from ..plans import lanes as L
from ..plans.aggregates import RANGE_FUNCTIONS, Ranges, constant, fits, glob_like, has_field
from ..plans.fills import last_at_or_before, numbered, running_extreme, running_sum
from ..plans.lanes import Lane
from ..plans.scalars import Compiler
from ..plans.scratch import materialize, new_path
from ..plans.syntax import children, parse

#: Lookup tables with at most so many keys are broadcast after a count; larger ones are joined by shuffle.
MOST_BROADCAST = 100_000
#: Patterns and comparisons that one pass over a table answers.
BLOCK = 100
#: Up to so many bands of an approximate lookup are tested one by one.
FEW = 16


def row_compiler(df: DataFrame, **options: object) -> Compiler:
    kinds = {f.name.lower(): f for f in df.schema.fields}

    def resolve(tree: tuple) -> Lane | None:
        if tree[0] != "field" or tree[1] is not None or tree[2].lower() not in kinds:
            return None
        f = kinds[tree[2].lower()]
        return L.field(df[f"`{f.name}`"], f.dataType)._replace(nullable=f.nullable)

    return Compiler(resolve, **options)


def _outputs(name: str, x: Lane, errors: bool | None) -> dict[str, Column]:
    v, err = L.shown(x)
    with_error = x.err is not None if errors is None else errors
    return {name: v} | ({f"{name}_err": err} if with_error else {})


def with_formulas(df: DataFrame, formulas: dict[str, str], errors: bool | None = None, **options: object) -> DataFrame:
    """``df`` with a column for each formula.  ``errors``: error columns always, never, or where one can occur."""
    compiler = row_compiler(df, **options)
    compiler.keeps = True
    out: dict[str, Column] = {}
    for name, formula in formulas.items():
        x = compiler.lane(parse(formula))
        out |= _outputs(name, compiler.held(x) if x.err is not None else x, errors)
    return _with_steps(df, compiler).withColumns(out).drop(*[n for n, _ in compiler.steps])


def _with_steps(df: DataFrame, compiler: Compiler) -> DataFrame:
    for name, column in compiler.steps:
        df = df.withColumn(name, column)
    return df


def with_formula(df: DataFrame, name: str, formula: str, errors: bool | None = None, **options: object) -> DataFrame:
    return with_formulas(df, {name: formula}, errors, **options)


def filter_formula(df: DataFrame, formula: str, **options: object) -> DataFrame:
    """Rows for which the formula is TRUE (not blank, not 0, no error)."""
    x = row_compiler(df, **options).lane(parse(formula))
    b, err = L.to_bool(x)
    return df.where(b if err is None else b & err.isNull())


# --- aggregates -----------------------------------------------------------------------------------


def aggregate(
    df: DataFrame,
    formulas: dict[str, str],
    by: list[str] | None = None,
    order: list[str] | None = None,
    errors: bool | None = None,
    ranks: bool = False,
    aggregates: dict[str, Callable[..., Lane]] | None = None,
    **options: object,
) -> DataFrame:
    """One row per group (or one in all) with a value for each formula of range functions.

    ``aggregates``: range functions of one's own, from the lanes of their arguments to the lane of an aggregate.

    ``ranks``: find medians by the ranks of values over ranges of all of them.  Otherwise a task holds the distinct values of a group,
    which is faster where they are not many.
    """
    by = by or []
    row = row_compiler(df, **options)
    row.keeps = True
    ranked: dict[tuple, str] = {}
    extra: list[tuple[str, tuple]] = []
    own = {name.upper(): run for name, run in (aggregates or {}).items()}

    class Ordered(Ranges):
        def _special(self, tree: tuple) -> Lane | None:
            median = ranks and tree[0] == "call" and tree[1] == "MEDIAN" and len(tree[2]) == 1 and has_field(tree[2][0])
            if median or tree[0] == "call" and tree[1] in ("LARGE", "SMALL") and len(tree[2]) == 2 and has_field(tree[2][0]):
                if tree not in ranked:
                    ranked[tree] = f"__nth{len(ranked)}"
                    extra.append((ranked[tree], tree))
                raise _Later
            if tree[0] == "call" and tree[1] in own:
                return own[tree[1]](*[self.row.lane(a) if has_field(a) else self.lane(a) for a in tree[2]])
            return super()._special(tree)

    ranges = Ordered(row, [F.col(f"`{o}`") for o in order or []], **{k: v for k, v in options.items() if k != "functions"})
    columns: dict[str, Column] = {}
    for name, formula in formulas.items():
        tree = parse(formula)
        try:
            columns |= _outputs(name, ranges.lane(tree), errors)
        except _Later:
            if tree not in ranked:
                raise FormulaError("unsupported", "LARGE and SMALL, and MEDIAN by ranks, stand alone in an aggregate") from None
            columns[name] = F.lit(None).cast("double")
            columns[f"{name}_err"] = F.lit(None).cast("string")
    df = _with_steps(df, row)
    out = df.groupBy(*by).agg(*[c.alias(n) for n, c in columns.items()])
    for name, formula in formulas.items():
        tree = parse(formula)
        if tree in ranked:
            out = _with_nth(df, out, name, tree, by, row, errors)
    return out


class _Later(Exception):
    pass


def _with_nth(df: DataFrame, out: DataFrame, name: str, tree: tuple, by: list[str], row: Compiler, errors: bool | None) -> DataFrame:
    code = None
    x = row.lane(tree[2][0])
    values = df.select(*[F.col(f"`{b}`") for b in by], L.part(x, "num").alias("__v"))
    if tree[1] == "MEDIAN":
        found = median_by_ranks(values, "__v", by).withColumnRenamed("median", "__n")
    else:
        try:
            k = int(number(constant(tree[2][1])))
            code = "#NUM!" if k < 1 else None
        except Stop as e:
            k, code = 1, str(e.err)
        found = nth_value(values, "__v", max(k, 1), tree[1] == "LARGE", by).withColumnRenamed("nth", "__n")
    keep = [c for c in out.columns if c not in (name, f"{name}_err")]
    if by:
        match = None
        for b in by:
            same = F.col(f"`__{b}`").eqNullSafe(F.col(f"`{b}`"))
            match = same if match is None else match & same
        joined = out.join(found.select(*[F.col(f"`{b}`").alias(f"__{b}") for b in by], "__n"), match, "left")
    else:
        joined = out.crossJoin(found.agg(F.max("__n").alias("__n")))
    value = F.lit(None).cast("double") if code else F.col("__n")
    err = F.lit(code) if code else F.when(F.col("__n").isNull(), F.lit("#NUM!"))
    return joined.select(*keep, value.alias(name), *([] if errors is False else [err.cast("string").alias(f"{name}_err")]))


def median_by_ranks(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """The median of each group's numbers as ``median``: equal values are counted first, then ranked range by range."""
    counted = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("__c"))
    ranked = running_sum(counted, [column], "__c", "__below", by)
    total = ranked.groupBy(*by).agg(F.sum("__c").alias("__all")) if by else ranked.agg(F.sum("__c").alias("__all"))
    first, last = F.floor((F.col("__all") - 1) / 2), F.floor(F.col("__all") / 2)
    if by:
        totals = total.select(*[F.col(f"`{b}`").alias(f"__of_{b}") for b in by], "__all")
        same = None
        for b in by:
            one = F.col(f"`__of_{b}`").eqNullSafe(F.col(f"`{b}`"))
            same = one if same is None else same & one
        ranked = ranked.join(totals, same)
    else:
        ranked = ranked.crossJoin(F.broadcast(total))
    has = lambda at: (F.col("__below") <= at) & (at < F.col("__below") + F.col("__c"))
    low, high = F.max(F.when(has(first), F.col(column))), F.max(F.when(has(last), F.col(column)))
    middle = ranked.where(has(first) | has(last))
    return (middle.groupBy(*by) if by else middle).agg(((low + high) / 2).alias("median")).where("median IS NOT NULL")


def nth_value(df: DataFrame, column: str, k: int, largest: bool, by: list[str]) -> DataFrame:
    """The k-th largest or smallest value of each group, as ``nth``.

    Without groups it is a top-k of which each task keeps k rows; with groups the window's limit does the same.
    """
    v = df.where(F.col(column).isNotNull())
    order = F.col(column).desc() if largest else F.col(column).asc()
    if not by:
        top = v.select(column).orderBy(order).limit(k)
        return top.agg(F.count(F.lit(1)).alias("n"), (F.min if largest else F.max)(column).alias("nth")).where(F.col("n") == k).select("nth")
    w = Window.partitionBy(*by).orderBy(order)
    ranked = v.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k)
    return ranked.where(F.col("__rn") == k).select(*by, F.col(column).alias("nth"))


# --- lookups --------------------------------------------------------------------------------------


def _key(x: Lane) -> Column:
    """Equal keys for values that are equal under ``=``: kind, number, upper-cased text."""
    return F.struct(L.tag(x).alias("k"), L.part(x, "num").alias("n"), F.upper(L.part(x, "text")).alias("s"), L.part(x, "bool").alias("b"))


def _small(table: DataFrame) -> DataFrame:
    """Broadcast if its rows are few, after a count that stops at the limit."""
    return F.broadcast(table) if table.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else table


def lookup(df: DataFrame, name: str, key: str, table: DataFrame, column: str, value: str, position: str | list[str], approximate: bool = False, falling: bool = False) -> DataFrame:
    """VLOOKUP / INDEX(MATCH): ``df`` with the value of the table's matching row as ``name``, and ``name_err``.

    ``key`` is a formula over ``df``; ``column`` and ``value`` are columns of ``table`` and ``position`` gives its row order.
    Exact: the first row whose ``column`` equals the key, or fits it if the key is a text with ``*`` or ``?``.  Approximate: the last
    row before the first that exceeds the key (``falling``: that is below it).  A miss is #N/A and a blank result 0.
    """
    x = row_compiler(df).lane(parse(key))
    position = [position] if isinstance(position, str) else position
    t_key = row_compiler(table).lane(("field", None, column))
    t_val = row_compiler(table).lane(("field", None, value))
    if approximate:
        return _approximate(df, name, x, table, t_key, t_val, position, falling)
    place = F.struct(*[table[f"`{p}`"] for p in position])
    first = table.select(_key(t_key).alias("__k"), t_val.value.alias("__v"), place.alias("__p")).where(F.col("__k.k").isNotNull())
    first = first.groupBy("__k").agg(F.min_by(F.struct("__v"), "__p").alias("__r"))
    text = L.part(x, "text")
    wild = F.coalesce(text.rlike("[*?]"), F.lit(False))
    joined = df.withColumn("__q", _key(x)).withColumn("__w", F.when(wild, text)).join(_small(first), F.col("__q") == F.col("__k"), "left")
    found = F.col("__r")
    if x.kind in ("text", "mixed") and t_key.kind in ("text", "mixed"):
        some = df.where(wild).select(text.alias("t")).distinct()
        rows = _first_fits(some, table, t_key, t_val, place)
        if rows is not None:
            joined = joined.join(_small(rows.select(F.col("t").alias("__t"), F.col("r").alias("__wr"))), F.col("__w") == F.col("__t"), "left")
            found = F.when(F.col("__w").isNotNull(), F.col("__wr")).otherwise(found)
    joined = joined.withColumn("__found", found)
    err = L.errors(x, F.when(F.col("__found").isNull(), F.lit("#N/A")))
    v = _filled(F.col("__found.__v"), t_val)
    return joined.withColumns({name: F.when(err.isNull(), v), f"{name}_err": err}).drop("__q", "__k", "__r", "__w", "__t", "__wr", "__found")


def _filled(v: Column, x: Lane) -> Column:
    """A blank result is 0, where the column has numbers."""
    return F.coalesce(v, F.lit(0.0)) if x.kind == "num" else v


def _blocks(distinct: DataFrame) -> Iterator[list[Row]]:
    """Rows in blocks of ``BLOCK``, however many there are."""
    held: list[Row] = []
    for r in distinct.toLocalIterator():
        held.append(r)
        if len(held) == BLOCK:
            yield held
            held = []
    if held:
        yield held


def _per_criterion(distinct: DataFrame, table: DataFrame, answer: Callable[[Row], Column], schema: str) -> DataFrame | None:
    """One row of ``schema`` for each row of ``distinct``: the row and its aggregate over ``table``, a block of rows with each pass."""
    spark = table.sparkSession

    def answered(rows: list[Row]) -> DataFrame:
        got = table.agg(*[answer(r).alias(f"a{i}") for i, r in enumerate(rows)]).first()
        return spark.createDataFrame([(*r, got[i]) for i, r in enumerate(rows)], schema)

    few = distinct.limit(BLOCK + 1).collect()
    if len(few) <= BLOCK:
        return answered(few) if few else None
    path = new_path(spark, "criteria")
    for rows in _blocks(distinct):
        answered(rows).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(spark.createDataFrame([], schema).schema).parquet(path)


def _first_fits(patterns: DataFrame, table: DataFrame, t_key: Lane, t_val: Lane, place: Column) -> DataFrame | None:
    """(t, r) of each pattern: the value of the first text that it fits, in a struct."""
    kind = table.select(t_val.value).schema[0].dataType.simpleString()
    is_text = L.tag(t_key) == 1

    def first(r: Row) -> Column:
        hit = F.coalesce(is_text & F.upper(L.part(t_key, "text")).like(glob_like(r.t)), F.lit(False))
        return F.min_by(F.struct(t_val.value.alias("__v")), F.when(hit, place))

    return _per_criterion(patterns, table, first, f"t string, r struct<__v:{kind}>")


def _approximate(df: DataFrame, name: str, x: Lane, table: DataFrame, t_key: Lane, t_val: Lane, position: list[str], falling: bool) -> DataFrame:
    """Bands: rows that are the running maximum so far; in a sorted table each row is one.

    The answer for a key is the last row before the first that exceeds it.  With m the running maximum by position, rows
    with m <= key are exactly those before the first that exceeds it, so bands of m are disjoint and the last row of each is
    what a key within the band gets.  Falling tables have the running minimum instead.  Up to ``MOST_BROADCAST`` rows make a constant
    array of bounds, in which each key finds its band by bisection, and a broadcast table of answers; more are met range by range.
    Numbers are below texts, and texts below booleans: a key of another kind comes before or after all rows.
    A value that leaves the answer blank is kept apart from no answer by being in a struct.
    """
    if x.kind == "mixed" or t_key.kind == "mixed":
        raise FormulaError("unsupported", "approximate lookups among values of several kinds")
    kind = t_key.kind if x.kind == "blank" else x.kind
    none = F.lit(None).cast("string") if x.err is None else x.err
    if kind != t_key.kind:
        after = (L.KINDS.index(kind) > L.KINDS.index(t_key.kind)) != falling
        last = table.where(L.tag(t_key).isNotNull()).agg(F.max_by(F.struct(t_val.value.alias("__v")), F.struct(*position)).alias("__r"))
        joined = df.crossJoin(F.broadcast(last)) if after else df.withColumn("__r", F.lit(None).cast(last.schema["__r"].dataType))
        return _answered(joined.withColumn("__qe", none), name, t_val)
    fold, blank = {"num": (lambda c: c, 0.0), "text": (F.upper, ""), "bool": (lambda c: c, False)}[kind]
    rows = table.select(fold(t_key.value).alias("__m"), t_val.value.alias("__v"), *[F.col(f"`{p}`").alias(f"__p{i}") for i, p in enumerate(position)]).where(F.col("__m").isNotNull())
    order = [f"__p{i}" for i in range(len(position))]
    small = rows.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    of = F.min if falling else F.max
    if small:
        rising = rows.withColumn("__top", of("__m").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    else:
        rising = running_extreme(rows, order, "__m", "__top", falling)
    bands = rising.groupBy(F.col("__top").alias("__m")).agg(F.max_by(F.struct("__v"), F.struct(*order)).alias("__r"))
    q = df.withColumns({"__q": F.coalesce(F.lit(blank) if x.kind == "blank" else fold(x.value), F.lit(blank)), "__qe": none})
    if not small:
        return _answered(last_at_or_before(q, "__q", bands, "__m", "__r", "__r", falling), name, t_val)
    found = materialize(bands, "lookup-bands")
    bounds = sorted((r[0] for r in found.select("__m").collect()), reverse=falling, key=lambda b: b.encode() if isinstance(b, str) else b)
    step = F.lit(None).cast("int")
    if len(bounds) <= FEW:
        for i, b in enumerate(bounds):
            reached = F.col("__q") <= F.lit(b) if falling else F.col("__q") >= F.lit(b)
            step = F.when(reached, F.lit(i)).otherwise(step)
    else:
        kind_of = {"num": "double", "text": "string", "bool": "boolean"}[kind]
        table_of = F.from_json(F.lit(json.dumps([repr(b) if kind == "num" else b for b in bounds])), "array<string>").cast(f"array<{kind_of}>")
        middle = lambda a: F.floor((a.lo + a.hi) / 2).cast("int")
        reached = lambda a: (F.get(table_of, middle(a)) >= F.col("__q")) if falling else (F.get(table_of, middle(a)) <= F.col("__q"))
        at = F.aggregate(
            F.sequence(F.lit(1), F.lit(len(bounds).bit_length())),
            F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")),
            lambda a, _: F.when(a.lo >= a.hi, a).otherwise(F.when(reached(a), F.struct((middle(a) + 1).alias("lo"), a.hi.alias("hi"))).otherwise(F.struct(a.lo.alias("lo"), middle(a).alias("hi")))),
            lambda a: a.lo,
        )
        step = at - 1
    w = Window.orderBy(F.col("__m").desc() if falling else F.col("__m").asc())
    numbered_bands = found.select((F.row_number().over(w) - 1).alias("__i"), "__r")
    joined = q.withColumn("__step", step).join(F.broadcast(numbered_bands), F.col("__step") == F.col("__i"), "left")
    return _answered(joined, name, t_val)


def _answered(joined: DataFrame, name: str, t_val: Lane) -> DataFrame:
    err = F.coalesce("__qe", F.when(F.col("__r").isNull(), F.lit("#N/A")))
    return joined.withColumns({name: F.when(err.isNull(), _filled(F.col("__r.__v"), t_val)), f"{name}_err": err}).drop("__q", "__qe", "__r", "__step", "__i")


def lookup_wildcard(table: DataFrame, pattern: str, column: str, value: str, position: str) -> DataFrame:
    """The first row whose text matches the pattern: one row with ``value``, or none."""
    x = row_compiler(table).lane(("field", None, column))
    hit = fits(x._replace(value=x.value), parse_criterion(pattern)) & (L.tag(x) == 1)
    return table.where(hit).orderBy(position).limit(1).select(value)


def match(df: DataFrame, name: str, key: str, table: DataFrame, column: str, position: str, kind: int = 0) -> DataFrame:
    """MATCH: the 1-based ``position`` value; kind 0 exact, 1 ascending, -1 descending."""
    placed = table.withColumn("__pos", F.col(f"`{position}`").cast("double"))
    return lookup(df, name, key, placed, column, "__pos", position, approximate=kind != 0, falling=kind < 0)


def index(df: DataFrame, name: str, row: str, table: DataFrame, value: str, order: list[str]) -> DataFrame:
    """INDEX(table[value], row): the value of the row of that number by ``order``; #REF! if there is none."""
    x = row_compiler(df).lane(parse(row))
    n, err = L.to_num(x)
    t_val = row_compiler(table).lane(("field", None, value))
    rows = table.select(t_val.value.alias("__v"), *[F.col(f"`{o}`").alias(f"__o{i}") for i, o in enumerate(order)])
    placed = numbered(rows, [f"__o{i}" for i in range(len(order))], "__nr").select("__nr", F.struct("__v").alias("__r"))
    joined = df.withColumn("__q", L.whole(n).cast("long")).join(_small(placed), F.col("__q") == F.col("__nr"), "left")
    err = L.errors(err, F.when(F.col("__r").isNull(), F.lit("#REF!")))
    return joined.withColumns({name: F.when(err.isNull(), _filled(F.col("__r.__v"), t_val)), f"{name}_err": err}).drop("__q", "__nr", "__r")


def hlookup(df: DataFrame, name: str, key: str, table: DataFrame, row: int, order: list[str], columns: list[str], approximate: bool = False) -> DataFrame:
    """HLOOKUP over the wide ``columns`` of ``table``: their names are its first row, and row ``row`` - 1 by ``order`` has the values."""
    if row < 2 or len({table.schema[c].dataType for c in columns}) > 1:
        raise FormulaError("unsupported", "a row of values below the names, all of one type")
    picked = table.orderBy(*order).offset(row - 2).limit(1)
    across = picked.select(F.explode(F.array(*[F.struct(F.lit(i).alias("__at"), F.lit(c).alias("__title"), F.col(f"`{c}`").alias("__value")) for i, c in enumerate(columns)])).alias("x")).select("x.*")
    return lookup(df, name, key, across, "__title", "__value", "__at", approximate)


def side_by_side(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows of two tables by position, for range functions over ranges of both; the longer one's rest has blanks.  Column names must differ."""
    a, b = numbered(left, left_order, "__row_a"), numbered(right, right_order, "__row_b")
    return a.join(b, F.col("__row_a") == F.col("__row_b"), "full").drop("__row_a", "__row_b")


def _compared(criteria: DataFrame, table: DataFrame) -> DataFrame:
    """(t, a) of criteria (t, op, x) that compare with numbers, over the numbers ``v`` of a table with values ``x``: from running sums over v."""
    at = table.where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("c"), F.coalesce(F.sum("x"), F.lit(0.0)).alias("s"), F.count("x").alias("n"))
    upto = at
    for k in ("c", "s", "n"):
        upto = running_sum(upto, ["v"], k, f"below_{k}")
    upto = materialize(upto.select("v", *[F.struct(F.col(f"below_{k}").alias("below"), F.col(k).alias("here")).alias(k) for k in ("c", "s", "n")]), "criteria-sums")
    total = upto.agg(*[F.coalesce(F.sum(f"{k}.here"), F.lit(0)).alias(k) for k in ("c", "s", "n")]).first()
    steps = upto.select("v", F.struct("v", "c", "s", "n").alias("step"))
    found = last_at_or_before(criteria, "x", steps, "v", "step", "step")
    same = F.coalesce(F.col("step.v") == F.col("x"), F.lit(False))

    def answer(k: str) -> Column:
        here = F.when(same, F.col(f"step.{k}.here")).otherwise(0)
        most = F.coalesce(F.col(f"step.{k}.below") + F.col(f"step.{k}.here"), F.lit(0))
        everything = F.lit(total[k])
        cases = {"<=": most, "<": most - here, ">": everything - most, ">=": everything - most + here, "<>": everything - here}
        out = F.lit(None)
        for op, v in cases.items():
            out = F.when(F.col("op") == op, v).otherwise(out)
        return out

    return found.select("t", F.struct(answer("c").cast("long").alias("c"), answer("s").cast("double").alias("s"), answer("n").cast("long").alias("n")).alias("a"))


def conditional_column(df: DataFrame, name: str, function: str, key: str, table: DataFrame, column: str, value: str | None = None) -> DataFrame:
    """A filled-down column of SUMIF / COUNTIF / AVERAGEIF(table[column], key, table[value]).

    Keys that mean equality, texts that spell a number or a boolean among them, are answered by one aggregation and a join;
    keys that are patterns or comparisons (">5", "a*") are few distinct ones as a rule: each distinct one is an aggregate of its own
    over the table, ``BLOCK`` of them with each pass.  More comparisons with numbers than that come from running sums over the numbers.
    """
    x = row_compiler(df).lane(parse(key))
    t_key = row_compiler(table).lane(("field", None, column))
    t_val = None if value is None else row_compiler(table).lane(("field", None, value))
    text = L.part(x, "text")
    special = F.coalesce(text.rlike(r"^[<>=]") | text.rlike(r"[*?~]") | (text == ""), F.lit(False)) | L.tag(x).isNull()
    v = t_key if t_val is None else t_val
    sums = table.select(_plain_key(t_key).alias("__k"), L.part(v, "num").alias("__v")).groupBy("__k").agg(F.count(F.lit(1)).alias("__c"), F.sum("__v").alias("__s"), F.count("__v").alias("__n"))
    written = F.when(L.tag(x).isNull(), F.lit("b")).otherwise(F.concat(F.lit("t"), L.to_text(x)[0]))
    number = L.part(v, "num")

    def answer(r: Row) -> Column:
        t = fits(t_key, parse_criterion(None if r.t == "b" else r.t[1:]))
        return F.struct(F.count_if(t).alias("c"), F.coalesce(F.sum(F.when(t, number)), F.lit(0.0)).cast("double").alias("s"), F.count(F.when(t, number)).alias("n"))

    distinct = df.where(special).select(written.alias("t")).distinct()
    schema = "t string, a struct<c:long,s:double,n:long>"
    compared = F.regexp_extract("t", r"^t(<=|>=|<>|<|>)", 1)
    operand = L.numeric_text(F.regexp_extract("t", r"^t(?:<=|>=|<>|<|>)([\s\S]*)$", 1))
    many = distinct.limit(BLOCK + 1).count() > BLOCK
    if many:
        distinct = materialize(distinct.select("t", F.when(operand.isNotNull() & (compared != ""), compared).alias("op"), operand.alias("x")), "criteria")
    if many and distinct.where("op IS NOT NULL").count() > BLOCK:
        odd = _per_criterion(distinct.where("op IS NULL").select("t"), table, answer, schema)
        by_ranges = _compared(distinct.where("op IS NOT NULL"), table.select(L.part(t_key, "num").alias("v"), number.alias("x")))
        odd = by_ranges if odd is None else odd.union(by_ranges)
    else:
        odd = _per_criterion(distinct.select("t"), table, answer, schema)
    joined = df.withColumn("__q", F.when(~special, _criterion_key(x))).join(_small(sums), F.col("__q") == F.col("__k"), "left")
    parts = {n: F.col(n) for n in ("__c", "__s", "__n")}
    if odd is not None:
        joined = joined.withColumn("__w", F.when(special, written)).join(_small(odd.select(F.col("t").alias("__t"), F.col("a").alias("__a"))), F.col("__w") == F.col("__t"), "left")
        parts = {n: F.coalesce(F.col(f"__a.{n[2:]}"), c) for n, c in parts.items()}
    parts = {n: F.coalesce(c, F.lit(0)) for n, c in parts.items()}
    err = x.err
    if function == "COUNTIF":
        out = parts["__c"].cast("double")
    elif function == "SUMIF":
        out = parts["__s"].cast("double")
    else:
        out = F.try_divide(parts["__s"].cast("double"), parts["__n"].cast("double"))
        err = L.errors(err, F.when(parts["__n"] == 0, F.lit("#DIV/0!")))
    return joined.withColumns(_outputs(name, Lane("num", out, err, False), None)).drop("__q", "__k", "__c", "__s", "__n", "__w", "__t", "__a")


def _plain_key(x: Lane) -> Column:
    """As ``_key``, with numbers and booleans apart from text: a criterion of one kind matches only that kind."""
    return F.when(L.tag(x).isNotNull(), _key(x))


def _criterion_key(x: Lane) -> Column:
    """The ``_plain_key`` of the values that equal a criterion: a text that spells a number or a boolean means that."""
    text = L.part(x, "text")
    n = L.numeric_text(text)
    key = lambda k, n, b: F.struct(F.lit(k).alias("k"), n.cast("double").alias("n"), F.lit(None).cast("string").alias("s"), b.cast("boolean").alias("b"))
    none = F.lit(None)
    return F.when(n.isNotNull(), key(0, n, none)).when(F.lower(text).isin("true", "false"), key(2, none, F.lower(text) == "true")).otherwise(_plain_key(x))


# --- fills: relative references become windows --------------------------------------------------------


def fill(df: DataFrame, name: str, formula: str | tuple, columns: dict[str, str], order: list[str], by: list[str] | None = None, row: int = 1, errors: bool | None = None) -> DataFrame:
    """A formula of row ``row`` filled down a table whose rows are ordered by ``order`` within ``by``.

    ``columns`` maps column letters to DataFrame columns.  ``A2`` in row 2 is the row's own value, ``A1`` the one before
    (blank before the first row); range functions over ``A$1:A2`` run from the start and over ``A1:A3`` slide.
    The first row of the table is row 1.  Without ``by`` one task orders all rows; ``fill_blocks`` is for tables that are too large for that.
    """
    w = Window.partitionBy(*[F.col(f"`{b}`") for b in by or []]).orderBy(*[F.col(f"`{o}`") for o in order])
    base = row_compiler(df)

    def column_of(n: int) -> Lane:
        letter = next((a for a in columns if column_number(a) == n), None)
        return L.literal(Err("#REF!")) if letter is None else base.lane(("field", None, columns[letter]))

    def resolve(tree: tuple) -> Lane | None:
        if tree[0] != "cell" or tree[5] is not None:
            return base.resolve(tree)
        x = column_of(tree[1])
        if x.value is None:
            return x
        if tree[4]:  # an absolute row
            v = F.nth_value(x.value, tree[2]).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
            return x._replace(value=v, nullable=True)
        by_rows = tree[2] - row
        return x if not by_rows else x._replace(value=F.lag(x.value, -by_rows).over(w), nullable=True)

    def special(tree: tuple) -> Lane | None:
        if tree[0] != "call" or tree[1] not in _FRAMED or len(tree[2]) != 1 or tree[2][0][0] != "range":
            return None
        a, b = tree[2][0][1:]
        if a[0] != "cell" or b[0] != "cell" or a[1] != b[1] or a[5] is not None or b[5] is not None:
            raise FormulaError("unsupported", "a range over several columns or sheets")
        x = column_of(a[1])
        if x.value is None:
            return x
        if a[4] and a[2] != 1:
            raise FormulaError("unsupported", "a range that starts at a fixed row other than the first")
        start = Window.unboundedPreceding if a[4] else a[2] - row
        stop = Window.unboundedFollowing if b[4] else b[2] - row
        return _FRAMED[tree[1]](L.part(x, "num"), L.tag(x), w.rowsBetween(start, stop))

    compiler = Compiler(resolve, special=special)
    return df.withColumns(_outputs(name, compiler.lane(formula if isinstance(formula, tuple) else parse(formula)), errors))


def fill_blocks(df: DataFrame, name: str, formula: str, columns: dict[str, str], order: list[str], row: int = 1, errors: bool | None = None, block: int = 1_000_000) -> DataFrame:
    """``fill`` over one order of all rows: they are numbered range by range and dealt to blocks, each with the rows before and after it that
    relative references reach.  Range functions from row 1 (``SUM(A$1:A2)``, up to the own row at most) are sums and extremes that go on
    from range to range; other absolute references aren't supported."""
    rows = numbered(df, order, "__nr").withColumn("__nr", F.col("__nr") - 1)
    columns, added = dict(columns), {}

    def replaced(t: tuple) -> tuple:
        """Calls over ranges from row 1 become references to columns of running values."""
        nonlocal rows
        if not isinstance(t, tuple) or not t or not isinstance(t[0], str):
            return tuple(map(replaced, t)) if isinstance(t, tuple) else t
        if t[0] == "call" and t[1] in ("SUM", "COUNT", "AVERAGE", "MIN", "MAX") and len(t[2]) == 1 and t[2][0][0] == "range":
            a, b = t[2][0][1:]
            if a[0] == b[0] == "cell" and a[4] and not b[4] and a[2] == 1 and a[1] == b[1] and a[5] is b[5] is None and b[2] <= row:
                if t[1] == "AVERAGE":
                    return ("binary", "/", replaced(("call", "SUM", t[2])), replaced(("call", "COUNT", t[2])))
                if (t[1], a[1]) not in added:
                    added[t[1], a[1]] = letter = column_letters(MAX_COL - len(added))
                    columns[letter] = f"__so_far{len(added)}"
                    rows = _so_far(rows, columns[letter], t[1], columns[next(c for c in columns if column_number(c) == a[1])])
                return ("cell", column_number(added[t[1], a[1]]), b[2], False, False, None)
        return tuple(replaced(c) if isinstance(c, tuple) else c for c in t)

    tree = replaced(parse(formula))
    cells = [t for t in _all(tree) if t[0] == "cell"]
    if any(t[4] for t in cells) or any(t[0] in ("name", "spill") for t in _all(tree)):
        raise FormulaError("unsupported", "a reference that is not relative")
    above = max([row - t[2] for t in cells] + [0])
    below = max([t[2] - row for t in cells] + [0])
    own = F.floor(F.col("__nr") / block)
    # the blocks that a row belongs to or is in reach of
    first, last = F.floor((F.col("__nr") - below) / block), F.floor((F.col("__nr") + above) / block)
    spread = rows.withColumn("__own", own).withColumn("__block", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    out = fill(spread, name, tree, columns, ["__nr"], ["__block"], row, errors)
    return out.where(F.col("__own") == F.col("__block")).drop("__nr", "__own", "__block", *[c for c in columns.values() if c.startswith("__so_far")])


def _so_far(rows: DataFrame, name: str, function: str, column: str) -> DataFrame:
    """``rows`` with SUM, COUNT, MIN or MAX of the numbers of a column down to each row."""
    v = L.part(row_compiler(rows).lane(("field", None, column)), "num")
    if function in ("MIN", "MAX"):
        return running_extreme(rows.withColumn("__x", v), ["__nr"], "__x", name, function == "MIN").drop("__x")
    rows = rows.withColumn("__x", F.coalesce(v, F.lit(0.0)) if function == "SUM" else F.when(v.isNotNull(), 1.0).otherwise(0.0))
    return running_sum(rows, ["__nr"], "__x", "__before_x").withColumn(name, F.col("__before_x") + F.col("__x")).drop("__x", "__before_x")


def _all(tree: tuple) -> Iterator[tuple]:
    yield tree
    for c in children(tree):
        yield from _all(c)


def recur(df: DataFrame, name: str, formula: str, own: str, start: float, columns: dict[str, str], order: list[str], by: list[str] | None = None, row: int = 2) -> DataFrame:
    """A column that refers to its own cell above, in closed form: ``start`` in the first row, then ``formula`` of row ``row``.

    ``own`` is the column's letter.  The formula is a sum with the cell above as one term (a running sum of the others), or the cell above
    times or divided by a constant (powers of it).  Errors go on downwards.
    """
    tree, above = parse(formula), ("cell", column_number(own), row - 1, False, False, None)
    w = Window.partitionBy(*[F.col(f"`{b}`") for b in by or []]).orderBy(*[F.col(f"`{o}`") for o in order])
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    place = F.row_number().over(w)
    if tree[0] == "binary" and tree[1] in "*/" and above in tree[2:]:
        other = tree[3] if tree[2] == above else tree[2]
        if not has_field(other) and not _mentions(other) and (tree[1] == "*" or tree[2] == above):
            factor = number(constant(other))
            if tree[1] == "/" and factor == 0:
                return df.withColumns({name: F.when(place == 1, F.lit(float(start))), f"{name}_err": F.when(place > 1, F.lit("#DIV/0!"))})
            powers = F.pow(F.lit(factor), (place - 1).cast("double"))
            x = L.guard(F.lit(float(start)) * powers if tree[1] == "*" else F.lit(float(start)) / powers, None)
            return df.withColumns(_outputs(name, x, None))
    terms = _terms(tree)
    if [t for t in terms if t[1] == above] != [(1, above)] or any(_mentions(t, above) for _, t in terms if t != above):
        raise FormulaError("unsupported", "a recursion that is neither a sum nor a constant multiple")
    rest: tuple = ("value", 0.0)
    for sign, t in terms:
        if t != above:
            rest = ("binary", "+" if sign > 0 else "-", rest, t)
    stepped = fill(df, "__step", rest, columns, order, by, row, errors=True)
    later = F.col("__place") > 1
    stepped = stepped.withColumn("__place", place)
    total = F.sum(F.when(later, F.col("__step"))).over(so_far)
    err = F.first(F.when(later, F.col("__step_err")), ignorenulls=True).over(so_far)
    value = F.lit(float(start)) + F.coalesce(total, F.lit(0.0))
    return stepped.withColumns({name: value, f"{name}_err": err}).withColumn(name, F.when(F.col(f"{name}_err").isNull(), F.col(name))).drop("__step", "__step_err", "__place")


def _mentions(tree: tuple, cell: tuple | None = None) -> bool:
    """Whether a tree has the cell, or any."""
    return (tree == cell if cell else tree[0] == "cell") or any(_mentions(c, cell) for c in children(tree))


def _terms(tree: tuple, sign: int = 1) -> list[tuple[int, tuple]]:
    if tree[0] == "binary" and tree[1] in "+-":
        return _terms(tree[2], sign) + _terms(tree[3], sign if tree[1] == "+" else -sign)
    if tree[0] == "prefix" and tree[1] in "+-":
        return _terms(tree[2], sign if tree[1] == "+" else -sign)
    return [(sign, tree)]


def _framed(of: Callable[[Column], Column], empty: object) -> Callable[[Column, Column, object], Lane]:
    def run(v: Column, _: Column, frame: object) -> Lane:
        got = of(v).over(frame)
        if isinstance(empty, Err):
            return Lane("num", got, F.when(F.count(v).over(frame) == 0, F.lit(str(empty))), False)
        return Lane("num", F.coalesce(got, F.lit(empty)), None, False)

    return run


_FRAMED: dict[str, Callable[..., Lane]] = {
    "SUM": _framed(F.sum, 0.0),
    "AVERAGE": _framed(F.avg, Err("#DIV/0!")),
    "MIN": _framed(F.min, 0.0),
    "MAX": _framed(F.max, 0.0),
    "COUNT": lambda v, _, frame: Lane("num", F.count(v).over(frame).cast("double"), None, False),
    "COUNTA": lambda _, tag, frame: Lane("num", F.count(tag).over(frame).cast("double"), None, False),
}

__all__ = [
    "RANGE_FUNCTIONS",
    *("aggregate", "conditional_column", "filter_formula", "median_by_ranks", "nth_value", "side_by_side", "with_formula", "with_formulas"),
    *("hlookup", "index", "lookup", "lookup_wildcard", "match"),
    *("fill", "fill_blocks", "recur"),
]
