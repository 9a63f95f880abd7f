"""Cubes on small tables with known results, and invariants on a larger one."""

import io
import zipfile
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gridlark.exports.config import CubeJson, FormatError
from gridlark.exports.files import cube_to_ods, cube_to_xlsx
from gridlark.exports.grid import CsvExportOptions, format_number, grid_of, json_records, to_csv, to_html, to_json
from gridlark.operators.aggregates import COUNT, DISPLAYS, NEXT, PREVIOUS, CombinedAggregate, CustomAggregate, CustomLayoutAggregate, DifferenceFrom, FormulaAggregate, Item, PercentOf, Rank, RunningTotal, average_of, build, count_values, distinct_count, max_of, std_dev, sum_of, variance
from gridlark.operators.dimensions import ColumnDimension, DatePartDimension, ExpressionDimension, ExpressionMeasure, MappedDimension, standard_dimensions
from gridlark.operators.facts import FactTable
from gridlark.operators.filters import AndFilter, CompareFilter, EmptyFilter, ExpressionFilter, NotFilter, OrFilter, PredicateFilter, RangeFilter, TextFilter, ValueFilter
from gridlark.plans import AxisDimension, AxisSort, Cube, CubeAxis, CubeSpec, Expansion
from gridlark.plans.charts import chart_from_cell, chart_from_cube, chart_from_facts, scatter_from_cell, scatter_from_cube, scatter_from_facts, transposed, with_period_start, without_empty

REGION, COUNTRY, CATEGORY = ColumnDimension("region"), ColumnDimension("country"), ColumnDimension("category")
QTY = sum_of("qty")
E = "Europe"


def d(text):
    return None if text is None else date.fromisoformat(text)


@pytest.fixture(scope="module")
def f1(spark):
    rows = [
        (E, "Germany", "A", d("2024-01-05"), 1, 10.0),
        (E, "Germany", "B", d("2024-03-05"), 2, 20.0),
        (E, "Hungary", "A", d("2025-01-05"), 3, 30.0),
        (E, None, "A", d("2025-02-05"), 4, None),
        ("Asia", "Japan", "B", d("2024-06-05"), 5, 50.0),
        ("Asia", "Japan", None, d("2025-06-05"), 6, 60.0),
        (None, "Iceland", "A", d("2024-09-05"), 7, 70.0),
        (None, None, None, None, None, 80.0),
    ]
    return FactTable.of(spark.createDataFrame(rows, "region string, country string, category string, date date, qty int, price double"))


@pytest.fixture(scope="module")
def f2(spark):
    rows = [
        (E, "Germany", d("2024-01-05"), 1),
        (E, "Hungary", d("2024-03-05"), 2),
        (E, "Germany", d("2025-01-05"), 4),
        ("Asia", "Japan", d("2024-06-05"), 8),
        ("Asia", "Japan", d("2025-06-05"), 16),
        (None, "Iceland", d("2024-02-01"), 32),
    ]
    return FactTable.of(spark.createDataFrame(rows, "region string, country string, date date, qty int"))


def matrix(cube, aggregate, blank=False):
    name = cube._name(aggregate)
    rows = cube.grid.where("rpos is not null and cpos is not null").select("rpos", "cpos", "facts", F.col(name).alias("v")).collect()
    out = [[None] * (1 + max(r["cpos"] for r in rows)) for _ in range(1 + max(r["rpos"] for r in rows))]
    for r in rows:
        out[r["rpos"]][r["cpos"]] = None if blank and not r["facts"] else r["v"]
    return out


def labels(entries, side="r"):
    """Each entry's own value, in display order; the summary is Σ."""
    rows = entries.where("has_entry").orderBy("pos").collect()
    return ["Σ" if r["depth"] == 0 else r[f"{side}{r['depth'] - 1}"] for r in rows]


def test_totals_and_the_empty_group(f1):
    cube = Cube(f1, CubeSpec(CubeAxis.of(REGION, COUNTRY), CubeAxis.of(CATEGORY), (QTY, COUNT)))
    assert labels(cube.row_entries) == [None, "Asia", E, "Σ"]
    assert labels(cube.column_entries, "c") == [None, "A", "B", "Σ"]
    assert matrix(cube, QTY) == [[None, 7, None, 7], [6, None, 5, 11], [None, 8, 2, 10], [6, 15, 7, 28]]
    assert matrix(cube, COUNT) == [[1, 1, 0, 2], [1, 0, 1, 2], [0, 3, 1, 4], [2, 4, 2, 8]]
    assert sorted(r["qty"] for r in cube.fact_rows((E,), ("A",)).collect()) == [1, 3, 4]


def test_sort_by_aggregate(f1):
    by = lambda descending: AxisSort("aggregate", QTY, descending=descending)
    spec = CubeSpec(CubeAxis.of(AxisDimension(REGION, by(True)), COUNTRY), CubeAxis.of(AxisDimension(CATEGORY, by(False))), (QTY,))
    cube = Cube(f1, spec)
    assert labels(cube.row_entries) == ["Asia", E, None, "Σ"]
    assert labels(cube.column_entries, "c") == [None, "B", "A", "Σ"]
    opened = cube.expand_to_depth(rows=2)
    assert labels(opened.row_entries) == ["Asia", "Japan", E, None, "Germany", "Hungary", None, "Iceland", None, "Σ"]
    with pytest.raises(ValueError):
        Cube(f1, spec.copy_with(aggregates=(COUNT,))).row_entries


def test_key_path_falls_back_to_the_summary(f1):
    def rows(path):
        sort = AxisSort("aggregate", QTY, path, descending=True)
        return labels(Cube(f1, CubeSpec(CubeAxis.of(AxisDimension(REGION, sort)), CubeAxis.of(CATEGORY), (QTY,))).row_entries)

    assert rows(("A",)) == [E, None, "Asia", "Σ"]
    assert rows(("B",)) == ["Asia", E, None, "Σ"]
    assert rows(("nowhere",)) == rows(None) == ["Asia", E, None, "Σ"]


def test_nulls_position_and_direction(f1):
    for descending in (False, True):
        for last in (False, True):
            spec = CubeSpec(CubeAxis.of(AxisDimension(REGION, AxisSort(descending=descending, nulls_last=last))))
            values = [E, "Asia"] if descending else ["Asia", E]
            assert labels(Cube(f1, spec).row_entries) == ([*values, None] if last else [None, *values]) + ["Σ"]


@pytest.mark.parametrize(
    "summary,subtotals,expected",
    [
        ("end", "top", [None, "Asia", E, None, "Germany", "Hungary", "Σ"]),
        ("start", "bottom", ["Σ", None, "Asia", None, "Germany", "Hungary", E]),
        ("hidden", "hidden", [None, "Asia", None, "Germany", "Hungary"]),
    ],
)
def test_positions(f1, summary, subtotals, expected):
    spec = CubeSpec(CubeAxis.of(REGION, COUNTRY, summary=summary, subtotals=subtotals), aggregates=(QTY, PercentOf(QTY, "parentRow")))
    cube = Cube(f1, spec, Expansion.of([(E,)]))
    assert labels(cube.row_entries) == expected
    shares = cube.grid.where("rd = 2").select(F.col(cube._name(spec.aggregates[1])).alias("v")).collect()
    assert sum(r["v"] or 0 for r in shares) == pytest.approx(100)  # hidden groups still count


def test_expansion():
    e = Expansion.of([("a", "b")])
    assert e.paths == {(), ("a",), ("a", "b")} and e.is_open(("a",))
    assert e.collapse(("a",)).paths == {()}
    assert e.toggle(("a", "b")).paths == {(), ("a",)}
    assert Expansion().toggle(("x",)).paths == {(), ("x",)}
    assert e.collapse_level(1).paths == {()} and Expansion.to_depth(3).collapse_level(1).depth == 1
    assert e.retain(lambda p: len(p) < 2).paths == {(), ("a",)}
    assert Expansion.collapsed().visible_depth(3) == 0 and e.visible_depth(2) == 2


def test_collapsed_filtered_and_empty(f1):
    spec = CubeSpec(CubeAxis.of(REGION), CubeAxis.of(CATEGORY), (QTY, COUNT))
    assert matrix(Cube(f1, spec, Expansion.collapsed(), Expansion.collapsed()), QTY) == [[28]]
    assert labels(Cube(f1, spec.copy_with(filter=ExpressionFilter("qty > 4"))).row_entries) == [None, "Asia", "Σ"]
    nothing = Cube(f1, spec.copy_with(filter=ExpressionFilter("qty > 99")))
    assert nothing.cells.count() == 0 and nothing.grid.count() == 0
    with pytest.raises(ValueError):
        CubeSpec(CubeAxis.of(REGION), CubeAxis.of(REGION))


def test_unknown_paths_are_ignored(f1):
    cube = Cube(f1, CubeSpec(CubeAxis.of(REGION, COUNTRY)), Expansion.of([("Atlantis",), (None,)]))
    assert labels(cube.row_entries) == [None, None, "Iceland", "Asia", E, "Σ"]
    assert {(r["depth"], r["children"]) for r in cube.child_counts().where("depth = 0").collect()} == {(0, 3)}


@pytest.fixture(scope="module")
def shown(f2):
    def of(aggregate):
        spec = CubeSpec(CubeAxis.of(REGION, COUNTRY), CubeAxis.of(DatePartDimension("date", "year")), (QTY, aggregate))
        return [list(c) for c in zip(*matrix(Cube(f2, spec, Expansion.of([(E,)])), aggregate), strict=True)]

    return of


N = None


@pytest.mark.parametrize(
    "aggregate,first,second",
    [
        (QTY, [32, 8, 3, 1, 2, 43], [N, 16, 4, 4, N, 20]),
        (DifferenceFrom(QTY, "rows", PREVIOUS), [N, -24, -5, N, 1, N], [N, N, -12, N, N, N]),
        (DifferenceFrom(QTY, "rows", NEXT), [24, 5, N, -1, N, N], N),
        (DifferenceFrom(QTY, "rows", Item("value", "Asia")), [24, 0, -5, N, N, N], N),
        (RunningTotal(QTY, "rows"), [32, 40, 43, 1, 3, 43], [N, 16, 20, 4, 4, 20]),
        (Rank(QTY, "rows"), [1, 2, 3, 2, 1, N], [N, 1, 2, 1, N, N]),
        (Rank(QTY, "rows", True), [3, 2, 1, 1, 2, N], N),
        (DifferenceFrom(RunningTotal(QTY, "rows"), "rows", PREVIOUS), [N, 8, 3, N, 2, N], N),
    ],
)
def test_values_shown_as(shown, aggregate, first, second):
    found = shown(aggregate)
    assert found[0] == first
    if second is not None:
        assert found[1] == second


def test_values_across_columns(shown):
    europe = lambda a: [c[2] for c in shown(a)]
    assert europe(RunningTotal(QTY, "columns")) == [3, 7, 7]
    assert europe(Rank(QTY, "columns")) == [2, 1, None]
    assert europe(PercentOf(QTY, "row")) == pytest.approx([3 / 7 * 100, 4 / 7 * 100, 100])
    assert europe(DifferenceFrom(QTY, "columns", PREVIOUS, True))[:1] == [None]
    assert europe(DifferenceFrom(QTY, "columns", PREVIOUS, True))[1] == pytest.approx(100 / 3)


def test_ties_rank_alike(spark):
    f = FactTable.of(spark.createDataFrame([("a", 5), ("b", 5), ("c", 3), ("d", 5)], "k string, v int"))
    r = Rank(sum_of("v"), "rows")
    assert [x[0] for x in matrix(Cube(f, CubeSpec(CubeAxis.of(ColumnDimension("k")), aggregates=(r,))), r)] == [1, 1, 4, 1, None]


def test_statistics(spark):
    rows = [("a", 2.0), ("a", 4.0), ("a", None), ("a", 4.0), ("b", 4.0), ("b", 5.0), ("b", 5.0), ("b", 7.0), ("b", 9.0)]
    f = FactTable.of(spark.createDataFrame(rows, "g string, x double"))
    parts = (variance("x", True), std_dev("x", True), variance("x"), std_dev("x"), average_of("x"), count_values("x"), max_of("x"))
    cube = Cube(f, CubeSpec(CubeAxis.of(ColumnDimension("g")), aggregates=parts))
    a, _, total = zip(*(list(zip(*matrix(cube, p), strict=True))[0] for p in parts), strict=True)
    assert a[:3] == pytest.approx((8 / 9, (8 / 9) ** 0.5, 4 / 3)) and total[:2] == pytest.approx((4, 2)) and a[5:] == (3, 4)
    one = Cube(FactTable.of(spark.createDataFrame([("a", 1.0)], "g string, x double")), CubeSpec(aggregates=parts))
    assert [matrix(one, p)[0][0] for p in parts[:4]] == [0, 0, None, None]
    far = FactTable.of(spark.range(2000).selectExpr("id % 20 as g", "1e9 + cast(id / 20 as int) % 10 as x"))
    v = variance("x", True)
    assert all(x[0] == pytest.approx(8.25, rel=1e-6) for x in matrix(Cube(far, CubeSpec(CubeAxis.of(ColumnDimension("g")), aggregates=(v,))), v))


def test_formulas_and_custom_aggregates(f1):
    share = FormulaAggregate("sum(qty) / count")
    expression = FormulaAggregate("sum(qty * price) + max(1, 2)")
    plus = FormulaAggregate("count + 1")
    spread = CombinedAggregate("spread", (max_of("qty"), QTY), lambda a, b: b - a)
    last = CustomAggregate("last", lambda f: F.max(F.struct(f.column("date").alias("date"), f.column("qty").alias("qty"))), F.max, lambda s: s["qty"])
    kinds = distinct_count(CATEGORY)
    shown = CustomLayoutAggregate("deep", QTY, lambda v, rows, columns: v + rows.depth)
    aggregates = (share, expression, plus, spread, last, kinds, shown)
    cube = Cube(f1, CubeSpec(CubeAxis.of(REGION), CubeAxis.of(CATEGORY), aggregates))
    assert [r[-1] for r in matrix(cube, share)] == [3.5, 5.5, 2.5, 3.5]
    assert [r[-1] for r in matrix(cube, expression)] == [492, 612, 142, 1242]
    assert matrix(cube, plus)[0] == [2, 2, 1, 3]  # an empty cell's count is 0
    assert matrix(cube, spread)[2] == [None, 4, 0, 6]
    assert [r[-1] for r in matrix(cube, last)] == [7, 6, 4, 6]
    assert [r[-1] for r in matrix(cube, kinds)] == [1, 1, 2, 2]
    assert [r[-1] for r in matrix(cube, shown)] == [8, 12, 11, 28]
    with pytest.raises(ValueError):
        FormulaAggregate("sum(region)").dependencies(f1)


def test_kinds_and_displays():
    assert build("average", "x").id == "avg(x)" and build("distinctCount", "x").id == "distinct(x)" and build("count") is COUNT
    assert DISPLAYS["rankColumns"](QTY).id == "rank(columns, sum(qty))"
    assert Rank(QTY, "rows", True).id == "rank(rows.ascending, sum(qty))"


FILTERS = {
    "value": (ValueFilter(REGION, (E, None)), {0, 1, 2, 3, 6, 7}),
    "none": (ValueFilter(REGION, ()), set()),
    "compare": (CompareFilter("price", "greater", 15.0), {1, 2, 4, 5, 6, 7}),
    "not": (NotFilter(CompareFilter("price", "greater", 15.0)), {0, 3}),
    "not expression": (ExpressionFilter("not (price > 15)"), {0}),
    "range": (RangeFilter("date", d("2024-03-05"), d("2025-01-05")), {1, 2, 4, 6}),
    "text": (TextFilter("country", "startsWith", "J"), {4, 5}),
    "empty": (EmptyFilter("country"), {3, 7}),
    "and": (AndFilter((EmptyFilter("country", True), CompareFilter("qty", "less", 3))), {0, 1}),
    "or": (OrFilter(()), set()),
    "all": (AndFilter(()), set(range(8))),
    "predicate": (PredicateFilter(lambda r: r["qty"] is None, ("qty",)), {7}),
    "part": (ValueFilter(DatePartDimension("date", "year"), (2025,)), {2, 3, 5}),
}


@pytest.mark.parametrize("name", FILTERS)
def test_filters(f1, name):
    f, expected = FILTERS[name]
    prices = [10.0, 20.0, 30.0, None, 50.0, 60.0, 70.0, 80.0]
    kept = {prices.index(r["price"]) for r in f1.where(f.condition(f1)).rows(["price"]).collect()}
    assert kept == expected
    source = f.to_expression_source()
    if source is not None and name not in ("not", "none"):
        again = ExpressionFilter(source)
        assert {prices.index(r["price"]) for r in f1.where(again.condition(f1)).rows(["price"]).collect()} == expected


def test_filters_reach_the_scan(spark):
    f = FactTable.of(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"))
    cube = Cube(f, CubeSpec(CubeAxis.of(ColumnDimension("l_returnflag")), aggregates=(sum_of("l_quantity"),), filter=CompareFilter("l_quantity", "greater", 40.0)))
    plan = cube.cells._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and plan.count("Expand") == 1
    assert plan.rindex("HashAggregate") > plan.index("Expand")  # facts are grouped before they are multiplied


def test_parents_equal_the_sum_of_their_children(spark):
    f = FactTable.of(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"))
    q = sum_of("l_quantity")
    cube = Cube(f, CubeSpec(CubeAxis.of(ColumnDimension("l_returnflag"), ColumnDimension("l_linestatus")), CubeAxis.of(DatePartDimension("l_shipdate", "year"), DatePartDimension("l_shipdate", "quarter")), (q,)), Expansion.to_depth(2), Expansion.to_depth(2))
    rows = cube.grid.select("ro", "co", F.col(cube._name(q)).alias("v")).collect()
    of = {(tuple(r["ro"]), tuple(r["co"])): r["v"] or 0 for r in rows}
    for (ro, co), v in of.items():
        if len(ro) < 2:
            assert v == sum(x for (a, b), x in of.items() if b == co and len(a) == len(ro) + 1 and a[: len(ro)] == ro)
        if len(co) < 2:
            assert v == sum(x for (a, b), x in of.items() if a == ro and len(b) == len(co) + 1 and b[: len(co)] == co)


def test_dimensions(f1):
    bucket = MappedDimension("size", "qty", lambda c: F.when(c > 3, "big").otherwise("small"))
    assert labels(Cube(f1, CubeSpec(CubeAxis.of(bucket))).row_entries) == [None, "big", "small", "Σ"]
    assert labels(Cube(f1, CubeSpec(CubeAxis.of(ExpressionDimension("qty % 2")))).row_entries) == [None, 0, 1, "Σ"]
    assert [x.id for x in standard_dimensions(f1)][3:10] == ["date", "date.year", "date.quarter", "date.month", "date.week", "date.day", "date.weekday"]
    assert f1.count_where(REGION, None) == 2 and [r[0] for r in f1.distinct_values(CATEGORY).collect()] == [None, "A", "B"]
    stats = {r["name"]: (r["null_count"], r["distinct_count"]) for r in f1.statistics().collect()}
    assert stats["region"] == (2, 2) and stats["price"] == (1, 7)
    with pytest.raises(TypeError):
        Cube(f1, CubeSpec(aggregates=(sum_of("region"),))).cells


def test_charts(f1):
    chart = chart_from_facts(f1, REGION, QTY, CATEGORY)
    values = {(r["category"], r["series"]): r["value"] for r in chart.collect()}
    assert values[E, "A"] == 8 and values[E, None] is None and len(values) == 9
    assert {(r["series"], r["category"]) for r in transposed(chart).collect()} == set(values)
    assert without_empty(chart).count() == 6
    cube = Cube(f1, CubeSpec(CubeAxis.of(REGION, COUNTRY), CubeAxis.of(CATEGORY), (QTY,)), Expansion.of([(E,)]))
    leaves = chart_from_cube(cube, QTY).collect()
    assert {tuple(r["category"]) for r in leaves} == {(None,), ("Asia",), (E, None), (E, "Germany"), (E, "Hungary")}
    drilled = chart_from_cell(cube, COUNTRY, QTY, (E,), ("A",))
    assert {r["category"]: r["value"] for r in drilled.collect()} == {None: 4, "Germany": 1, "Hungary": 3}
    assert scatter_from_facts(f1, "qty", "price", order="qty", limit=3).collect() == scatter_from_facts(f1, "qty", "price", order="qty").collect()[:3]


def test_period_starts(spark):
    df = spark.createDataFrame([(2021, 53), (2024, 1)], "year int, week int")
    assert [r["period_start"].date() for r in with_period_start(df, ["year", "week"]).collect()] == [date(2022, 1, 3), date(2024, 1, 1)]
    df = spark.createDataFrame([(2024, 2, 29, 13)], "year int, month int, day int, hour int")
    assert str(with_period_start(df, ["year", "month", "day", "hour"]).first()["period_start"]) == "2024-02-29 13:00:00"


@pytest.fixture(scope="module")
def f5(spark):
    rows = [(E, "Germany", "A", 1.0), (E, "Germany", "B", 2.0), (E, "Hungary", "A", 3.0), (E, None, "A", 4.0), ("Asia", "Japan", "B", 5.0), ("Asia", "Japan", None, 6.0), (None, 'Ice, "land"', "A", 7.5)]
    return FactTable.of(spark.createDataFrame(rows, "region string, country string, category string, qty double"))


def test_csv_grid(f5):
    spec = CubeSpec(CubeAxis.of(REGION, COUNTRY), CubeAxis.of(CATEGORY), (QTY,))
    text = to_csv(Cube(f5, spec, Expansion.of([(E,)])), options=CsvExportOptions(line_ending="\n"))
    assert text.split("\n") == [
        "category,,(empty),A,B,Total",
        "region,country,sum of qty,sum of qty,sum of qty,sum of qty",
        "(empty),,,7.5,,7.5",
        "Asia,,6,,5,11",
        "Europe,,,8,2,10",
        ",(empty),,4,,4",
        ",Germany,,1,2,3",
        ",Hungary,,3,,3",
        "Total,,6,15.5,7,28.5",
        "",
    ]
    plain = to_csv(Cube(f5, CubeSpec(CubeAxis.of(REGION, COUNTRY), aggregates=(QTY,)), Expansion.to_depth(2)), options=CsvExportOptions(";", line_ending="\n", decimal=",", repeat_labels=True))
    assert '(empty);"Ice, ""land""";7,5' in plain.split("\n") and "Asia;Japan;11" in plain.split("\n")
    assert [format_number(x) for x in (10.0, 3, 0.1 + 0.2, 2.5)] == ["10", "3", "0.3", "2.5"] and format_number(135034.64000000004, ",") == "135034,64"


def test_json_and_html_grids(f5):
    cube = Cube(f5, CubeSpec(CubeAxis.of(REGION), CubeAxis.of(CATEGORY), (QTY, COUNT)))
    records = json_records(cube)
    assert records[1] == {"region": "Asia", "(empty) / sum of qty": 6.0, "(empty) / count": 1, "A / sum of qty": None, "A / count": None, "B / sum of qty": 5.0, "B / count": 1, "Total / sum of qty": 11.0, "Total / count": 2}
    assert to_json(cube, lines=True).count("\n") == len(records)
    page = to_html(cube)
    assert page.count("<tr>") == 2 + 4 and '<th colspan="2">A</th>' in page and "<style>" not in to_html(cube, stylesheet=False)


def test_merged_headers(f5):
    spec = CubeSpec(CubeAxis.of(REGION, COUNTRY), CubeAxis.of(CATEGORY), (QTY, COUNT))
    cube = Cube(f5, spec, Expansion.of([(E,)]))
    page = to_html(cube, stylesheet=False)
    assert f'<th rowspan="4">{E}</th>' in page and '<th colspan="2">Asia</th>' in page and '<th colspan="2">Total</th>' in page
    table = grid_of(cube).table()
    taken = [[0] * len(row) for row in table]
    for y, row in enumerate(table):
        for x, c in enumerate(row):
            for i in range(c.row_span if c.origin else 0):
                for j in range(c.column_span):
                    taken[y + i][x + j] += 1
    assert {n for row in taken for n in row} == {1}  # areas cover each place once
    with zipfile.ZipFile(io.BytesIO(cube_to_xlsx(cube))) as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert '<mergeCell ref="A5:A8"/>' in sheet
    with zipfile.ZipFile(io.BytesIO(cube_to_ods(cube))) as z:
        assert 'table:number-rows-spanned="4"' in z.read("content.xml").decode()


def test_configurations_come_back(f1):
    aggregates = (QTY, COUNT, distinct_count(CATEGORY), FormulaAggregate("sum(qty) / count", "share", "Share"), sum_of(ExpressionMeasure("qty * price", "worth")), PercentOf(QTY, "grand"), DifferenceFrom(QTY, "rows", Item("value", E), True), DifferenceFrom(COUNT, "columns", NEXT), RunningTotal(QTY, "columns"), Rank(QTY, "rows", True), count_values("price"))
    f = AndFilter((ValueFilter(REGION, (E, None)), OrFilter((CompareFilter("date", "less", d("2025-01-01")), NotFilter(EmptyFilter("qty")))), RangeFilter("qty", 1, 9), TextFilter("country", "contains", "a"), ExpressionFilter("qty > 0", "some")))
    spec = CubeSpec(CubeAxis.of(AxisDimension(REGION, AxisSort("aggregate", QTY, ("A",), True)), COUNTRY, summary="start", subtotals="bottom"), CubeAxis.of(CATEGORY, DatePartDimension("date", "year"), ExpressionDimension("qty % 2", "odd")), aggregates, f)
    cube = Cube(f1, spec, Expansion.of([(E,), (None,)]), Expansion.to_depth(2))
    codec = CubeJson()
    j = codec.config(cube)
    again = codec.to_cube(j, f1)
    assert codec.config(again) == j and [a.id for a in again.spec.aggregates] == [a.id for a in aggregates]
    assert again.spec.rows.sort_at(1).key_path == ("A",) and again.row_expansion == cube.row_expansion
    for bad in ({}, {"version": 2}, {"version": 1, "spec": {}}, {"version": 1, "spec": {"rows": 1, "columns": {}, "aggregates": []}}, []):
        with pytest.raises(FormatError):
            codec.to_cube(bad, f1)
    with pytest.raises(TypeError):
        codec.filter(PredicateFilter(lambda r: True, ("qty",)))


def test_looking_up_entries_and_cells(f1):
    spec = CubeSpec(CubeAxis.of(REGION, COUNTRY), CubeAxis.of(CATEGORY), (QTY,))
    cube = Cube(f1, spec, Expansion.of([(E,)]))
    # (empty), Asia, Europe, -, Germany, Hungary, total
    assert [cube.index_of("rows", p) for p in ((), (None,), (E,), (E, "Hungary"), ("Asia", "Japan"), ("Mars",))] == [6, 0, 2, 5, -1, -1]
    assert cube.entry_for("rows", (E,))["facts"] == 4 and cube.entry_for("rows", ("Asia", "Japan")) is None
    assert cube.cell_at(2, 1)[QTY.id] == 8 and cube.cell_for((E, "Germany"), ("B",))[QTY.id] == 2
    assert cube.cell_for((E,), ("C",)) is None and cube.cell_at(0, 99) is None
    assert {r["pos"]: r["descendants"] for r in cube.descendant_counts("rows").collect()} == {0: 0, 1: 0, 2: 3, 3: 0, 4: 0, 5: 0, 6: 0}
    hidden = Cube(f1, spec.copy_with(rows=CubeAxis.of(REGION, COUNTRY, subtotals="hidden")), Expansion.of([(E,)]))
    assert hidden.index_of("rows", (E,)) == -1 and hidden.entry_for("rows", (E,))["facts"] == 4


def test_header_areas(f1):
    cube = Cube(f1, CubeSpec(CubeAxis.of(REGION, COUNTRY), aggregates=(QTY,)), Expansion.of([(E,)]))
    areas = {(r["level"], r["pos"]): tuple(r)[2:] for r in cube.header_areas("rows").collect()}
    # depth, entry, level_start, level_span, entry_start, entry_span, is_label
    assert areas[0, 1] == areas[1, 1] == (1, 1, 0, 2, 1, 1, True)  # a closed group goes down to the last level
    assert areas[0, 2] == areas[0, 4] == areas[0, 5] == (1, 2, 0, 1, 2, 4, True)
    assert areas[1, 2] == (1, 2, 1, 1, 2, 1, False)  # the leg beside the open group's own row
    assert areas[1, 4] == (2, 4, 1, 1, 4, 1, True)
    assert areas[0, 6] == areas[1, 6] == (0, 6, 0, 2, 6, 1, True)
    bare = Cube(f1, CubeSpec(CubeAxis.of(REGION, COUNTRY, subtotals="hidden"), aggregates=(QTY,)), Expansion.of([(E,)]))
    areas = {(r["level"], r["pos"]): tuple(r)[2:] for r in bare.header_areas("rows").collect()}
    assert areas[0, 3] == (1, -1, 0, 1, 2, 3, True)


def test_levels_open_and_close(f1):
    spec = CubeSpec(CubeAxis.of(REGION, COUNTRY), CubeAxis.of(CATEGORY), (QTY,))
    cube = Cube(f1, spec, Expansion.of([(E,)]))
    opened = cube.expand_level("rows", 0)
    assert labels(opened.row_entries) == labels(cube.expand_to_depth(rows=2).row_entries)
    assert cube.added_by_expanding_level("rows", 0) == 3 and opened.added_by_expanding_level("rows", 0) == 0
    assert labels(opened.collapse_level("rows", 0).row_entries) == [None, "Asia", E, "Σ"]
    mixed = Expansion.of([(E, "Germany")]).expand_level(0)
    assert mixed.is_open(()) and mixed.is_open((E,)) and mixed.is_open((E, "Germany")) and not mixed.is_open(("Asia",))


def test_prepared_cubes(f1):
    aggregates = (QTY, COUNT, distinct_count(CATEGORY), distinct_count("qty"), std_dev("price"), average_of("price"))
    spec = CubeSpec(CubeAxis.of(REGION, COUNTRY), CubeAxis.of(DatePartDimension("date", "year")), aggregates)
    cube = Cube(f1, spec)
    ready = cube.prepared()
    for step in (lambda c: c, lambda c: c.toggle_row((E,)), lambda c: c.expand_to_depth(rows=2, columns=1)):
        rows = lambda c: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in step(c).table().collect())  # noqa: E731, B023
        assert rows(ready) == rows(cube)
    assert "csv" not in ready.table()._jdf.queryExecution().toString() and ready.child_counts().count() == cube.child_counts().count()


def test_moments_and_distinct_counts_at_every_level(spark):
    rows = [(k % 3, k % 2, 1e9 + k * 0.25 if k % 11 else None, k % 5, k % 7) for k in range(400)]
    f = FactTable.of(spark.createDataFrame(rows, "a int, b int, x double, y int, z int"))
    spread, both = variance("x"), (distinct_count("y"), distinct_count("z"))
    cube = Cube(f, CubeSpec(CubeAxis.of(ColumnDimension("a")), CubeAxis.of(ColumnDimension("b")), (spread, *both)))
    for r in cube.table().collect():
        kept = [x for x in rows if r["a"] in (None, x[0]) and r["b"] in (None, x[1])]
        values = [x[2] for x in kept if x[2] is not None]
        mean = sum(v - 1e9 for v in values) / len(values)
        assert r[spread.id] == pytest.approx(sum((v - 1e9 - mean) ** 2 for v in values) / (len(values) - 1), rel=1e-7)
        assert [r[d.id] for d in both] == [len({x[3] for x in kept}), len({x[4] for x in kept})]


def test_distinct_values_are_not_expanded_by_the_grouping_sets(spark):
    """A task holds runs of 64 whole numbers, or values, of one grouping set at a time."""
    facts = FactTable.of(spark.range(6400).selectExpr("cast(id % 2 as int) a", "cast(id % 3 as int) b", "id - 3200 as n", "cast(id as string) t"))
    for counts in ((distinct_count("n"), distinct_count("t")), (distinct_count("n"),), (distinct_count("t"),)):
        cube = Cube(facts, CubeSpec(CubeAxis.of(ColumnDimension("a")), CubeAxis.of(ColumnDimension("b")), counts))
        plan = cube.table()._jdf.queryExecution().optimizedPlan().toString()
        expanded = [line for line in plan.splitlines() if "Expand [" in line]
        assert not [line for line in expanded for a in counts if f"{cube._name(a)}#" in line]
        assert {(r["row_depth"], r["column_depth"], *(r[a.id] for a in counts)) for r in cube.table().collect() if r["row_depth"] + r["column_depth"] < 2} == {
            (d, e, *[n] * len(counts)) for d, e, n in ((0, 0, 6400), (1, 0, 3200), (0, 1, 2133), (0, 1, 2134))
        }
    ready = Cube(facts, CubeSpec(aggregates=(distinct_count("n"), distinct_count("t"))))
    assert ready._of_counted(distinct_count("n")).count() == 100


_COUNTED = [None, -(2**63), -(2**63) + 1, -65, -64, -63, -1, 0, 1, 63, 64, 65, 2**63 - 64, 2**63 - 1]


def test_distinct_counts_of_any_type(spark):
    """One alone and several, of facts and of stored groups, with values at the ends of runs, copies and nulls."""
    rows = [(k % 3 if k % 7 else None, k % 2, _COUNTED[k * k % 14], k % 5 - 2 if k % 4 else None, [0.0, -0.0, float("nan"), None][k % 4], date(2020, 1, 1 + k % 9), f"t{k % 70}", k % 3 == 0, Decimal(k % 6) / 2) for k in range(300)]
    frame = spark.createDataFrame(rows, "a int, b int, l long, s short, d double, day date, t string, yes boolean, m decimal(9,1)")
    frame = frame.union(frame)
    names = ["l", "s", "d", "day", "t", "yes", "m"]
    total = CustomAggregate("total", lambda f: F.sum(f.column("m")), F.sum)
    own = (variance("s"), sum_of("s"), total)
    axes = CubeAxis.of(ColumnDimension("a")), CubeAxis.of(ColumnDimension("b"))
    same = lambda v: None if v != v else v
    expected = {}
    for r in rows:
        for i, a in ((0, None), (1, r[0])):
            for j, b in ((0, None), (1, r[1])):
                cell = expected.setdefault((i, a, j, b), [set() for _ in names])
                for values, v in zip(cell, r[2:], strict=True):
                    values.add(same(v))
    expected = {at: [len(v - {None}) for v in cell] for at, cell in expected.items()}
    at = lambda r: (r["row_depth"], r["a"], r["column_depth"], r["b"])
    facts = FactTable.of(frame)
    counts = [distinct_count(n) for n in names]
    plain = Cube(facts, CubeSpec(*axes, own)).table()
    sums = {at(r): r for r in plain.collect()}
    several = Cube(facts, CubeSpec(*axes, tuple(counts)))
    for cube in (several, several.prepared()):
        assert {at(r): [r[c.id] for c in counts] for r in cube.table().collect()} == expected
    for k in (0, 2, 4, 6):
        cube = Cube(facts, CubeSpec(*axes, (counts[k], *own)))
        for one in (cube, cube.prepared()):
            table = one.table()
            found = {at(r): r for r in table.collect()}
            assert {at: r[counts[k].id] for at, r in found.items()} == {at: cell[k] for at, cell in expected.items()}
            assert all(found[i]["total"] == r["total"] and found[i][own[1].id] == r[own[1].id] and found[i][own[0].id] == pytest.approx(r[own[0].id]) for i, r in sums.items())
            assert table.schema["total"].dataType == plain.schema["total"].dataType
    lone = Cube(facts, CubeSpec(aggregates=(counts[0], counts[4]))).table().collect()
    assert [(r[counts[0].id], r[counts[4].id]) for r in lone] == [(expected[0, None, 0, None][0], expected[0, None, 0, None][4])]
    assert Cube(facts, CubeSpec(aggregates=(counts[0],))).table().first()[counts[0].id] == expected[0, None, 0, None][0]
    assert Cube(FactTable.of(frame.where("false")), CubeSpec(aggregates=(counts[0],))).table().count() == 0


def test_charts_of_paths_and_scatters(f1):
    cube = Cube(f1, CubeSpec(CubeAxis.of(REGION, COUNTRY), CubeAxis.of(CATEGORY), (QTY, COUNT)), Expansion.of([(E,)]))
    chart = chart_from_cube(cube, QTY, [(E, "Hungary"), ("Mars",), ("Asia",)], [()])
    assert [(r["category_pos"], r["category"], r["value"]) for r in chart.orderBy("category_pos").collect()] == [(0, [E, "Hungary"], 3), (2, ["Asia"], 11)]
    points = scatter_from_cube(cube, QTY, COUNT).where("facts > 0").collect()
    assert {(tuple(r["point"]), tuple(r["series"]), r["x"], r["y"]) for r in points if r["point"] == ["Asia"]} == {(("Asia",), (None,), 6.0, 1.0), (("Asia",), ("B",), 5.0, 1.0)}
    turned = scatter_from_cube(cube, QTY, COUNT, transpose=True)
    assert turned.count() == len(points)
    assert {(r["point"], r["x"]) for r in scatter_from_cell(cube, COUNTRY, QTY, COUNT, (E,)).collect()} == {(None, 4.0), ("Germany", 3.0), ("Hungary", 3.0)}
    lone = Cube(f1, CubeSpec(aggregates=(QTY,)))
    assert [r["value"] for r in chart_from_cube(lone, QTY).collect()] == [28]


def test_large_layouts_are_dealt_out(f1, monkeypatch):
    monkeypatch.setattr("gridlark.plans.cube.SMALL_LAYOUT", 3)
    spec = CubeSpec(CubeAxis.of(AxisDimension(REGION, AxisSort("aggregate", QTY, descending=True)), COUNTRY, subtotals="hidden"), CubeAxis.of(CATEGORY), (QTY,))
    cube = Cube(f1, spec, Expansion.of([(E,)]))
    assert labels(cube.row_entries) == ["Asia", None, "Germany", "Hungary", None, "Σ"]
    assert matrix(cube, QTY) == [[6, None, 5, 11], [None, 4, None, 4], [None, 1, 2, 3], [None, 3, None, 3], [None, 7, None, 7], [6, 15, 7, 28]]


def test_grids_are_bounded(f1, monkeypatch):
    monkeypatch.setattr("gridlark.exports.grid.MOST_CELLS", 3)
    with pytest.raises(ValueError):
        to_csv(Cube(f1, CubeSpec(CubeAxis.of(REGION), CubeAxis.of(CATEGORY), (QTY,))))
