"""Registered queries of the cube engine, each with DuckDB SQL for the same rows.

Both sides cast what they return to the same types; sums are over whole numbers
or rounded at the summands' scale, so that the order of summing can't show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.functions.types import ExprType
from gridlark.operators.aggregates import (
    COUNT,
    NEXT,
    PREVIOUS,
    DifferenceFrom,
    FormulaAggregate,
    Item,
    PercentOf,
    Rank,
    RunningTotal,
    average_of,
    count_values,
    distinct_count,
    max_of,
    min_of,
    std_dev,
    sum_of,
    variance,
)
from gridlark.operators.dimensions import ColumnDimension, DatePartDimension, ExpressionDimension, ExpressionMeasure, MappedDimension
from gridlark.operators.facts import FactTable
from gridlark.operators.filters import AndFilter, CompareFilter, EmptyFilter, ExpressionFilter, FactFilter, NotFilter, OrFilter, PredicateFilter, RangeFilter, TextFilter, ValueFilter
from gridlark.plans.charts import chart_from_facts, scatter_from_facts, scatter_of_groups, with_period_start
from gridlark.plans.cube import AxisDimension, AxisSort, Cube, CubeAxis, CubeSpec, Expansion

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def star(spark: SparkSession, sf_dir: str) -> FactTable:
    """lineitem with its order, customer, nation and region."""
    t = lambda n: read(spark, sf_dir, n)
    joined = (
        t("lineitem")
        .join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return FactTable.of(joined)


STAR = (
    "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey "
    "JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
)


def events(spark: SparkSession, sf_dir: str) -> FactTable:
    """events with a column that is missing for errors, and one missing above 400."""
    e = read(spark, sf_dir, "events")
    return FactTable.of(e.withColumns({"kind": F.nullif("event_type", F.lit("purchase")), "small": F.when(F.col("value") <= 400, F.col("value"))}))


EVENTS = "(SELECT *, nullif(event_type, 'purchase') AS kind, CASE WHEN value <= 400 THEN value END AS small FROM events) e"

REGION, NATION = ColumnDimension("r_name"), ColumnDimension("n_name")
YEAR, QUARTER = DatePartDimension("o_orderdate", "year"), DatePartDimension("o_orderdate", "quarter")
QTY = sum_of("l_quantity")


# Dimensions


@query("SELECT DISTINCT o_orderpriority AS value FROM orders")
def dim_column_distinct(spark, sf_dir):
    return FactTable.of(read(spark, sf_dir, "orders")).distinct_values(ColumnDimension("o_orderpriority"))


@query(
    "SELECT event_id, year(ts)::BIGINT AS y, quarter(ts)::BIGINT AS q, month(ts)::BIGINT AS m, weekofyear(ts)::BIGINT AS w, "
    "day(ts)::BIGINT AS d, isodow(ts)::BIGINT AS wd, hour(ts)::BIGINT AS h FROM events"
)
def dim_date_parts(spark, sf_dir):
    f = events(spark, sf_dir)
    parts = {"y": "year", "q": "quarter", "m": "month", "w": "week", "d": "day", "wd": "weekday", "h": "hour"}
    return f.frame.select(f.column("event_id").alias("event_id"), *(DatePartDimension("ts", p).column(f).alias(n) for n, p in parts.items()))


@query(
    "SELECT CASE WHEN l_quantity < 10 THEN 'few' WHEN l_quantity < 30 THEN 'some' ELSE 'many' END AS bucket, count(*)::BIGINT AS n FROM lineitem GROUP BY 1"
)
def dim_mapped_bucket(spark, sf_dir):
    f = FactTable.of(read(spark, sf_dir, "lineitem"))
    bucket = MappedDimension("bucket", "l_quantity", lambda c: F.when(c < 10, "few").when(c < 30, "some").otherwise("many"))
    return Cube(f, CubeSpec(CubeAxis.of(bucket)), Expansion.to_depth(1)).table({"count": "n"}).where("row_depth = 1").select("bucket", "n")


@query("SELECT CASE l_returnflag WHEN 'A' THEN 'yes' WHEN 'R' THEN 'back' END AS flag, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def dim_mapped_lookup(spark, sf_dir):
    f = FactTable.of(read(spark, sf_dir, "lineitem"))
    flag = MappedDimension("flag", "l_returnflag", {"A": "yes", "R": "back"})
    return Cube(f, CubeSpec(CubeAxis.of(flag)), Expansion.to_depth(1)).table({"count": "n"}).where("row_depth = 1").select("flag", "n")


@query("SELECT CASE WHEN l_extendedprice > 30000 THEN 'big' ELSE 'small' END AS size, sum(l_quantity) AS qty FROM lineitem GROUP BY 1")
def dim_expression_text(spark, sf_dir):
    f = FactTable.of(read(spark, sf_dir, "lineitem"))
    size = ExpressionDimension('if(l_extendedprice > 30000, "big", "small")', "size")
    return Cube(f, CubeSpec(CubeAxis.of(size), aggregates=(QTY,)), Expansion.to_depth(1)).table({QTY.id: "qty"}).where("row_depth = 1").select("size", "qty")


@query("SELECT floor(l_quantity / 10)::DOUBLE AS tens, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def dim_expression_number(spark, sf_dir):
    f = FactTable.of(read(spark, sf_dir, "lineitem"))
    tens = ExpressionDimension("floor(l_quantity / 10)", "tens")
    return Cube(f, CubeSpec(CubeAxis.of(tens)), Expansion.to_depth(1)).table({"count": "n"}).where("row_depth = 1").select("tens", "n")


@query(
    "SELECT * FROM (SELECT 'o_orderstatus' AS name, count(DISTINCT o_orderstatus)::BIGINT AS distinct_count, count(*) FILTER (o_orderstatus IS NULL)::BIGINT AS null_count FROM orders "
    "UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority)::BIGINT, count(*) FILTER (o_orderpriority IS NULL)::BIGINT FROM orders "
    "UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey)::BIGINT, count(*) FILTER (o_custkey IS NULL)::BIGINT FROM orders)"
)
def facts_statistics(spark, sf_dir):
    f = FactTable.of(read(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", "o_custkey"))
    return f.statistics().select("name", "distinct_count", "null_count")


# Filters


def _kept(spark, sf_dir, filter_: FactFilter) -> DataFrame:
    f = events(spark, sf_dir)
    return f.where(filter_.condition(f)).rows(["event_id", "event_type"])


def _filter_query(name: str, filter_: FactFilter, condition: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: _kept(spark, sf_dir, filter_)
    SQL[name] = f"SELECT event_id, event_type FROM {EVENTS} WHERE {condition}"


_KIND = ColumnDimension("kind")
_filter_query("filter_value_set", ValueFilter(_KIND, ("click", "view")), "kind IN ('click', 'view')")
_filter_query("filter_value_with_empty", ValueFilter(_KIND, ("click", None)), "kind = 'click' OR kind IS NULL")
_filter_query("filter_compare", CompareFilter("value", "greater", 100.0), "value > 100")
_filter_query("filter_range", RangeFilter("value", 50.0, 60.0), "value BETWEEN 50 AND 60")
_filter_query("filter_text_contains", TextFilter("event_type", "contains", "i"), "contains(event_type, 'i')")
_filter_query("filter_text_prefix_suffix", OrFilter((TextFilter("event_type", "startsWith", "c"), TextFilter("event_type", "endsWith", "w"))), "event_type LIKE 'c%' OR event_type LIKE '%w'")
_filter_query("filter_empty", EmptyFilter("kind"), "kind IS NULL")
_filter_query("filter_not_empty", EmptyFilter("small", negated=True), "small IS NOT NULL")
_filter_query("filter_and_or_not", AndFilter((CompareFilter("small", "less", 300.0), OrFilter((NotFilter(EmptyFilter("kind")), CompareFilter("value", "less", 20.0))))), "small < 300 AND (kind IS NOT NULL OR value < 20)")
_filter_query("filter_not_two_valued", NotFilter(CompareFilter("small", "greater", 100.0)), "NOT coalesce(small > 100, false)")
_filter_query("filter_not_expression", ExpressionFilter("not (small > 100)"), "NOT (small > 100)")
_filter_query("filter_expression", ExpressionFilter('value > 100 and kind = "click" and year(ts) = 2024'), "value > 100 AND kind = 'click' AND year(ts) = 2024")
_filter_query("filter_predicate", PredicateFilter(lambda row: row["event_id"] % 3 == 0, ("event_id",)), "event_id % 3 = 0")


# Aggregates


def _by_flag(spark, sf_dir, aggregates, names) -> DataFrame:
    f = FactTable.of(read(spark, sf_dir, "lineitem"))
    flag = ColumnDimension("l_returnflag")
    return Cube(f, CubeSpec(CubeAxis.of(flag), aggregates=tuple(aggregates)), Expansion.to_depth(1)).table(names).drop("column_depth")


def _by_flag_sql(columns: str, source: str = "lineitem") -> str:
    return f"SELECT (1 - grouping(l_returnflag))::INTEGER AS row_depth, l_returnflag, {columns} FROM {source} GROUP BY ROLLUP (l_returnflag)"


@query(_by_flag_sql("sum(l_quantity) AS s"))
def agg_sum(spark, sf_dir):
    return _by_flag(spark, sf_dir, [QTY], {QTY.id: "s"})


@query(_by_flag_sql("round(avg(l_quantity), 6) AS a"))
def agg_avg(spark, sf_dir):
    a = average_of("l_quantity")
    return _by_flag(spark, sf_dir, [a], {a.id: "a"}).withColumn("a", F.round("a", 6))


@query(_by_flag_sql("min(l_extendedprice) AS lo, max(l_extendedprice) AS hi"))
def agg_min_max(spark, sf_dir):
    a, b = min_of("l_extendedprice"), max_of("l_extendedprice")
    return _by_flag(spark, sf_dir, [a, b], {a.id: "lo", b.id: "hi"})


@query(_by_flag_sql("count(*)::BIGINT AS n"))
def agg_count(spark, sf_dir):
    return _by_flag(spark, sf_dir, [COUNT], {"count": "n"})


@query(
    f"SELECT (1 - grouping(kind))::INTEGER AS row_depth, kind, count(small)::BIGINT AS n, count(*)::BIGINT AS all_facts FROM {EVENTS} GROUP BY ROLLUP (kind)"
)
def agg_count_nonnull(spark, sf_dir):
    n = count_values("small")
    return Cube(events(spark, sf_dir), CubeSpec(CubeAxis.of(_KIND), aggregates=(n, COUNT)), Expansion.to_depth(1)).table({n.id: "n", "count": "all_facts"}).drop("column_depth")


@query(_by_flag_sql("round(stddev_samp(l_quantity), 6) AS s, round(stddev_pop(l_quantity), 6) AS p"))
def agg_stddev_samp_pop(spark, sf_dir):
    a, b = std_dev("l_quantity"), std_dev("l_quantity", population=True)
    return _by_flag(spark, sf_dir, [a, b], {a.id: "s", b.id: "p"}).withColumns({"s": F.round("s", 6), "p": F.round("p", 6)})


@query(_by_flag_sql("round(var_samp(l_quantity), 6) AS s, round(var_pop(l_quantity), 6) AS p"))
def agg_variance_samp_pop(spark, sf_dir):
    a, b = variance("l_quantity"), variance("l_quantity", population=True)
    return _by_flag(spark, sf_dir, [a, b], {a.id: "s", b.id: "p"}).withColumns({"s": F.round("s", 6), "p": F.round("p", 6)})


@query(_by_flag_sql("count(DISTINCT l_suppkey)::BIGINT AS n, sum(l_quantity) AS s"))
def agg_distinct(spark, sf_dir):
    a = distinct_count("l_suppkey")
    return _by_flag(spark, sf_dir, [a, QTY], {a.id: "n", QTY.id: "s"})


@query(_by_flag_sql("round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue"))
def agg_expression_measure(spark, sf_dir):
    a = sum_of(ExpressionMeasure("l_extendedprice * (1 - coalesce(l_discount, 0))"))
    return _by_flag(spark, sf_dir, [a], {a.id: "revenue"}).withColumn("revenue", F.round("revenue", 4))


@query(_by_flag_sql("round(sum(l_quantity) / count(*) + max(l_linenumber) * 2, 6) AS f, round(sum(l_quantity * 2) / nullif(count(DISTINCT l_linestatus) - 2, 0), 6) AS g"))
def agg_cell_formula(spark, sf_dir):
    a = FormulaAggregate("sum(l_quantity) / count + max(l_linenumber) * 2")
    b = FormulaAggregate("sum(l_quantity * 2) / (distinct(l_linestatus) - 2)")
    return _by_flag(spark, sf_dir, [a, b], {a.id: "f", b.id: "g"}).withColumns({"f": F.round("f", 6), "g": F.round("g", 6)})


# Cubes


def cube_sql(rows: dict[str, str], columns: dict[str, str], values: str, source: str = STAR, where: str = "true", keep: str = "true") -> str:
    """Both axes rolled up and crossed: {name: expression} from the outermost level in."""
    inner = ", ".join([f"{e} AS {n}" for n, e in (rows | columns).items()] + ["*"])
    r, c = list(rows), list(columns)
    sets = ", ".join("(" + ", ".join(r[:i] + c[:j]) + ")" for i in range(len(r) + 1) for j in range(len(c) + 1))
    depth = lambda names: "(" + (" + ".join(f"(1 - grouping({n}))" for n in names) or "0") + ")::INTEGER"
    keys = "".join(f", {n}" for n in r + c)
    return (
        f"SELECT * FROM (SELECT {depth(r)} AS row_depth, {depth(c)} AS column_depth{keys}, {values} "
        f"FROM (SELECT {inner} FROM {source} WHERE {where}) f GROUP BY GROUPING SETS ({sets})) cells WHERE {keep}"
    )


_RN = {"region": "r_name", "nation": "n_name"}
_YQ = {"y": "year(o_orderdate)::BIGINT", "q": "quarter(o_orderdate)::BIGINT"}
_NAMES = {"r_name": "region", "n_name": "nation", "o_orderdate.year": "y", "o_orderdate.quarter": "q", QTY.id: "qty", "count": "n"}
_REVENUE = sum_of(ExpressionMeasure("l_extendedprice * (1 - l_discount)", "revenue"))


@query(cube_sql({"region": "r_name"}, {"y": _YQ["y"]}, "round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, count(*)::BIGINT AS n"))
def cube_flagship(spark, sf_dir):
    spec = CubeSpec(CubeAxis.of(REGION, NATION), CubeAxis.of(YEAR), (_REVENUE, COUNT))
    found = Cube(star(spark, sf_dir), spec).table(_NAMES | {_REVENUE.id: "revenue"})
    return found.withColumn("revenue", F.round("revenue", 4))


@query(cube_sql(_RN, {}, "sum(l_quantity) AS qty"))
def cube_rows_only(spark, sf_dir):
    return Cube(star(spark, sf_dir), CubeSpec(CubeAxis.of(REGION, NATION), aggregates=(QTY,)), Expansion.to_depth(2)).table(_NAMES)


@query(cube_sql({"region": "r_name"}, {"flag": "l_returnflag"}, "sum(l_quantity) AS qty, count(*)::BIGINT AS n"))
def cube_rows_columns_totals(spark, sf_dir):
    spec = CubeSpec(CubeAxis.of(REGION), CubeAxis.of(ColumnDimension("l_returnflag")), (QTY, COUNT))
    return Cube(star(spark, sf_dir), spec).table(_NAMES | {"l_returnflag": "flag"})


@query(cube_sql(_RN, _YQ, "sum(l_quantity) AS qty, count(*)::BIGINT AS n"))
def cube_two_level_both_axes(spark, sf_dir):
    spec = CubeSpec(CubeAxis.of(REGION, NATION), CubeAxis.of(YEAR, QUARTER), (QTY, COUNT))
    return Cube(star(spark, sf_dir), spec, Expansion.to_depth(2), Expansion.to_depth(2)).table(_NAMES)


@query(cube_sql(_RN, {"y": _YQ["y"]}, "sum(l_quantity) AS qty", keep="row_depth < 2 OR region = 'EUROPE'"))
def cube_partial_expansion(spark, sf_dir):
    spec = CubeSpec(CubeAxis.of(REGION, NATION), CubeAxis.of(YEAR), (QTY,))
    return Cube(star(spark, sf_dir), spec, Expansion.of([("EUROPE",)])).table(_NAMES)


@query(cube_sql({"kind": "kind"}, {"h": "hour(ts)::BIGINT"}, "count(*)::BIGINT AS n", EVENTS))
def cube_empty_group(spark, sf_dir):
    spec = CubeSpec(CubeAxis.of(_KIND), CubeAxis.of(DatePartDimension("ts", "hour")))
    return Cube(events(spark, sf_dir), spec).table({"count": "n", "ts.hour": "h"})


@query("SELECT 0::INTEGER AS row_depth, 0::INTEGER AS column_depth, sum(l_quantity) AS qty FROM lineitem")
def cube_collapsed_root(spark, sf_dir):
    f = FactTable.of(read(spark, sf_dir, "lineitem"))
    spec = CubeSpec(CubeAxis.of(ColumnDimension("l_returnflag")), aggregates=(QTY,))
    return Cube(f, spec, Expansion.collapsed(), Expansion.collapsed()).table(_NAMES)


@query(cube_sql({"region": "r_name"}, {"y": _YQ["y"]}, "sum(l_quantity) AS qty", where="l_quantity > 25 AND r_name <> 'ASIA'"))
def cube_filtered(spark, sf_dir):
    spec = CubeSpec(CubeAxis.of(REGION), CubeAxis.of(YEAR), (QTY,), ExpressionFilter('l_quantity > 25 and r_name <> "ASIA"'))
    return Cube(star(spark, sf_dir), spec).table(_NAMES)


# Order and layout

_ROOT = 2147483647


def _axis_rows(cube: Cube, names=("region", "nation")) -> DataFrame:
    e = cube.row_entries
    return e.where("has_entry").select(F.col("depth").alias("row_depth"), *(F.col(f"r{k}").alias(n) for k, n in enumerate(names)), "facts", "pos")


def _order_sql(order: str, where_entry: str = "true", source: str = STAR, rows: dict[str, str] | None = None, extra: str = "") -> str:
    """Groups of a row axis in display order; order may use the columns of cells."""
    rows = rows or _RN
    cells = cube_sql(rows, {}, f"count(*)::BIGINT AS facts, sum(l_quantity) AS qty{extra}", source)
    keys = ", ".join(rows)
    return f"SELECT row_depth, {keys}, facts, (row_number() OVER (ORDER BY {order}) - 1)::INTEGER AS pos FROM ({cells}) x WHERE {where_entry}"


@query(_order_sql("row_depth = 0, region DESC NULLS LAST", rows={"region": "r_name"}))
def axis_sort_value_desc(spark, sf_dir):
    spec = CubeSpec(CubeAxis.of(AxisDimension(REGION, AxisSort(descending=True))))
    return _axis_rows(Cube(star(spark, sf_dir), spec), ("region",))


@query(
    f"SELECT kind, count(*)::BIGINT AS facts, (row_number() OVER (ORDER BY kind IS NULL, kind DESC) - 1)::INTEGER AS pos FROM {EVENTS} GROUP BY kind"
)
def axis_sort_value_desc_nulls_last(spark, sf_dir):
    spec = CubeSpec(CubeAxis.of(AxisDimension(_KIND, AxisSort(descending=True, nulls_last=True))))
    return Cube(events(spark, sf_dir), spec).row_entries.where("depth = 1").select(F.col("r0").alias("kind"), "facts", "pos")


@query(_order_sql("row_depth = 0, qty DESC, region", rows={"region": "r_name"}))
def axis_sort_by_aggregate(spark, sf_dir):
    spec = CubeSpec(CubeAxis.of(AxisDimension(REGION, AxisSort("aggregate", QTY, descending=True))), aggregates=(QTY,))
    return _axis_rows(Cube(star(spark, sf_dir), spec), ("region",))


@query(_order_sql("row_depth = 0, old DESC, region", rows={"region": "r_name"}, extra=", sum(CASE WHEN year(o_orderdate) = 1996 THEN l_quantity END) AS old"))
def axis_sort_keypath(spark, sf_dir):
    spec = CubeSpec(CubeAxis.of(AxisDimension(REGION, AxisSort("aggregate", QTY, (1996,), descending=True))), CubeAxis.of(YEAR), (QTY,))
    return _axis_rows(Cube(star(spark, sf_dir), spec), ("region",))


@query(
    f"SELECT row_depth, region, nation, facts, (row_number() OVER (ORDER BY row_depth = 0, of_region DESC, region, row_depth, qty DESC, nation) - 1)::INTEGER AS pos "
    f"FROM (SELECT *, max(CASE WHEN row_depth = 1 THEN qty END) OVER (PARTITION BY region) AS of_region FROM ({cube_sql(_RN, {}, 'count(*)::BIGINT AS facts, sum(l_quantity) AS qty')}) c) x"
)
def axis_sort_inherited(spark, sf_dir):
    spec = CubeSpec(CubeAxis.of(AxisDimension(REGION, AxisSort("aggregate", QTY, descending=True)), NATION), aggregates=(QTY,))
    return _axis_rows(Cube(star(spark, sf_dir), spec, Expansion.to_depth(2)))


def _positions(spark, sf_dir, **more) -> DataFrame:
    return _axis_rows(Cube(star(spark, sf_dir), CubeSpec(CubeAxis.of(REGION, NATION, **more)), Expansion.to_depth(2)))


@query(_order_sql("row_depth = 0, region, row_depth, nation"))
def axis_positions_subtotal_top(spark, sf_dir):
    return _positions(spark, sf_dir)


@query(_order_sql("row_depth = 0, region, row_depth = 1, nation"))
def axis_positions_subtotal_bottom(spark, sf_dir):
    return _positions(spark, sf_dir, subtotals="bottom")


@query(_order_sql("row_depth = 0, region, nation", "row_depth <> 1"))
def axis_positions_subtotal_hidden(spark, sf_dir):
    return _positions(spark, sf_dir, subtotals="hidden")


@query(_order_sql("row_depth > 0, region, row_depth, nation"))
def axis_summary_start(spark, sf_dir):
    return _positions(spark, sf_dir, summary="start")


@query(_order_sql("region, row_depth, nation", "row_depth > 0"))
def axis_summary_hidden(spark, sf_dir):
    return _positions(spark, sf_dir, summary="hidden")


@query(
    f"SELECT 0::INTEGER AS depth, NULL AS region, count(DISTINCT r_name)::BIGINT AS children FROM {STAR} "
    f"UNION ALL SELECT 1::INTEGER, r_name, count(DISTINCT n_name)::BIGINT FROM {STAR} GROUP BY r_name"
)
def axis_child_count(spark, sf_dir):
    found = Cube(star(spark, sf_dir), CubeSpec(CubeAxis.of(REGION, NATION))).child_counts()
    return found.select("depth", F.col("r0").alias("region"), "children")


@query(f"SELECT count(*)::BIGINT AS added FROM (SELECT DISTINCT r_name, n_name FROM {STAR})")
def axis_expand_level_count(spark, sf_dir):
    found = Cube(star(spark, sf_dir), CubeSpec(CubeAxis.of(REGION, NATION))).child_counts()
    return found.where("depth = 1").agg(F.sum("children").alias("added"))


# Values shown as

_GRID = f"SELECT r_name AS region, n_name AS nation, year(o_orderdate)::BIGINT AS y, l_quantity AS q FROM {STAR}"


def _shown(spark, sf_dir, aggregate, decimals: int | None = 6) -> DataFrame:
    spec = CubeSpec(CubeAxis.of(REGION, NATION), CubeAxis.of(YEAR), (QTY, aggregate))
    found = Cube(star(spark, sf_dir), spec, Expansion.of([("EUROPE",)])).result(_NAMES | {aggregate.id: "v"})
    found = found.select("row_depth", "region", "nation", "column_depth", "y", "qty", F.col("v"))
    return found.withColumn("v", F.round("v", decimals)) if decimals is not None else found


def _shown_sql(value: str) -> str:
    """value over g: the dense grid with qty, keys rk and ck, sibling windows named by axis and order."""
    cells = cube_sql(_RN, {"y": _YQ["y"]}, "sum(l_quantity) AS qty", keep="row_depth < 2 OR region = 'EUROPE'")
    return f"""WITH cells AS ({cells}),
        r AS (SELECT row_depth, region, nation FROM cells WHERE column_depth = 0),
        c AS (SELECT column_depth, y FROM cells WHERE row_depth = 0),
        g AS (SELECT r.row_depth, r.region, r.nation, c.column_depth, c.y, cells.qty FROM r CROSS JOIN c LEFT JOIN cells
            ON cells.row_depth = r.row_depth AND cells.column_depth = c.column_depth AND cells.region IS NOT DISTINCT FROM r.region
            AND cells.nation IS NOT DISTINCT FROM r.nation AND cells.y IS NOT DISTINCT FROM c.y)
        SELECT g.*, {value} AS v FROM g
        WINDOW rows_ AS (PARTITION BY row_depth, CASE WHEN row_depth = 2 THEN region END, column_depth, y ORDER BY region, nation),
            rows_all AS (PARTITION BY row_depth, CASE WHEN row_depth = 2 THEN region END, column_depth, y),
            columns_ AS (PARTITION BY row_depth, region, nation, column_depth ORDER BY y),
            row_ AS (PARTITION BY row_depth, region, nation), column_ AS (PARTITION BY column_depth, y), all_ AS (),
            parents AS (PARTITION BY CASE WHEN row_depth = 2 THEN region END, column_depth, y)"""


@query(_shown_sql("round(qty / max(CASE WHEN column_depth = 0 THEN qty END) OVER row_ * 100, 6)"))
def pct_of_row(spark, sf_dir):
    return _shown(spark, sf_dir, PercentOf(QTY, "row"))


@query(_shown_sql("round(qty / max(CASE WHEN row_depth = 0 THEN qty END) OVER column_ * 100, 6)"))
def pct_of_column(spark, sf_dir):
    return _shown(spark, sf_dir, PercentOf(QTY, "column"))


@query(_shown_sql("round(qty / max(CASE WHEN row_depth = 0 AND column_depth = 0 THEN qty END) OVER all_ * 100, 6)"))
def pct_of_grand(spark, sf_dir):
    return _shown(spark, sf_dir, PercentOf(QTY, "grand"))


@query(
    _shown_sql(
        "CASE row_depth WHEN 1 THEN round(qty / max(CASE WHEN row_depth = 0 THEN qty END) OVER column_ * 100, 6) "
        "WHEN 2 THEN round(qty / (SELECT p.qty FROM g p WHERE p.row_depth = 1 AND p.region = g.region AND p.column_depth = g.column_depth AND p.y IS NOT DISTINCT FROM g.y) * 100, 6) END"
    )
)
def pct_of_parent_row(spark, sf_dir):
    return _shown(spark, sf_dir, PercentOf(QTY, "parentRow"))


@query(_shown_sql("CASE WHEN column_depth = 1 THEN round(qty / max(CASE WHEN column_depth = 0 THEN qty END) OVER row_ * 100, 6) END"))
def pct_of_parent_column(spark, sf_dir):
    return _shown(spark, sf_dir, PercentOf(QTY, "parentColumn"))


@query(_shown_sql("CASE WHEN row_depth > 0 THEN qty - lag(qty) OVER rows_ END"))
def diff_previous(spark, sf_dir):
    return _shown(spark, sf_dir, DifferenceFrom(QTY, "rows", PREVIOUS), None)


@query(_shown_sql("CASE WHEN row_depth > 0 THEN qty - lead(qty) OVER rows_ END"))
def diff_next(spark, sf_dir):
    return _shown(spark, sf_dir, DifferenceFrom(QTY, "rows", NEXT), None)


@query(_shown_sql("CASE WHEN row_depth > 0 THEN qty - max(CASE WHEN row_depth = 1 AND region = 'ASIA' THEN qty END) OVER rows_all END"))
def diff_from_value(spark, sf_dir):
    return _shown(spark, sf_dir, DifferenceFrom(QTY, "rows", Item("value", "ASIA")), None)


@query(_shown_sql("CASE WHEN column_depth > 0 THEN round((qty - lag(qty) OVER columns_) / nullif(lag(qty) OVER columns_, 0) * 100, 6) END"))
def pct_diff_previous(spark, sf_dir):
    return _shown(spark, sf_dir, DifferenceFrom(QTY, "columns", PREVIOUS, percent=True))


@query(_shown_sql("CASE WHEN row_depth > 0 THEN sum(qty) OVER (rows_ ROWS UNBOUNDED PRECEDING) ELSE qty END"))
def running_total_rows(spark, sf_dir):
    return _shown(spark, sf_dir, RunningTotal(QTY, "rows"), None)


@query(_shown_sql("CASE WHEN column_depth > 0 THEN sum(qty) OVER (columns_ ROWS UNBOUNDED PRECEDING) ELSE qty END"))
def running_total_columns(spark, sf_dir):
    return _shown(spark, sf_dir, RunningTotal(QTY, "columns"), None)


def _rank_sql(direction: str) -> str:
    w = f"(PARTITION BY row_depth, CASE WHEN row_depth = 2 THEN region END, column_depth, y ORDER BY qty {direction} NULLS LAST)"
    return _shown_sql(f"(CASE WHEN row_depth > 0 AND qty IS NOT NULL THEN rank() OVER {w} END)::INTEGER")


@query(_rank_sql("DESC"))
def rank_desc(spark, sf_dir):
    return _shown(spark, sf_dir, Rank(QTY, "rows"), None)


@query(_rank_sql("ASC"))
def rank_asc(spark, sf_dir):
    return _shown(spark, sf_dir, Rank(QTY, "rows", ascending=True), None)


@query(
    "WITH n AS (" + _shown_sql("CASE WHEN column_depth > 0 THEN sum(qty) OVER (columns_ ROWS UNBOUNDED PRECEDING) ELSE qty END") + ") "
    "SELECT row_depth, region, nation, column_depth, y, qty, CASE WHEN column_depth > 0 THEN v - lag(v) OVER "
    "(PARTITION BY row_depth, region, nation, column_depth ORDER BY y) END AS v FROM n"
)
def layout_nested(spark, sf_dir):
    return _shown(spark, sf_dir, DifferenceFrom(RunningTotal(QTY, "columns"), "columns", PREVIOUS), None)


# Scalar functions: the expression on one side, plain SQL on the other


def _functions(name: str, table: str, key: str, pairs: dict[str, tuple[str, str]], with_sql: str = "") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = events(spark, sf_dir) if table == "events" else FactTable.of(read(spark, sf_dir, table))
        made = []
        for column, (source, _) in pairs.items():
            compiled = f.compile(source)
            made.append((compiled.column().cast("timestamp_ntz") if compiled.type is ExprType.DATE else compiled.column()).alias(column))
        return f.frame.select(f.column(key).alias(key), *made)

    QUERIES[name] = run
    source = EVENTS if table == "events" else table
    SQL[name] = f"SELECT {key}, " + ", ".join(f"{sql} AS {column}" for column, (_, sql) in pairs.items()) + f" FROM {source}"


_functions(
    "fn_math",
    "events",
    "event_id",
    {
        "a": ("abs(value - 250)", "abs(value - 250)"),
        "b": ("floor(value / 7)", "floor(value / 7)::DOUBLE"),
        "c": ("ceil(value / 7)", "ceil(value / 7)::DOUBLE"),
        "d": ("sqrt(value - 250)", "CASE WHEN value >= 250 THEN sqrt(value - 250) END"),
        "e": ("min(value, small, 99)", "least(value, small, 99::DOUBLE)"),
        "f": ("max(small, 99)", "greatest(small, 99::DOUBLE)"),
        "g": ("value / (event_id - event_id)", "NULL::DOUBLE"),
    },
)
_functions(
    "fn_round_mod",
    "events",
    "event_id",
    {
        "a": ("round(value)", "floor(value + 0.5::DOUBLE)"),
        "b": ("round(-value)", "-floor(value + 0.5::DOUBLE)"),
        "c": ("round(value, 1)", "floor(value * 10::DOUBLE + 0.5::DOUBLE) / 10::DOUBLE"),
        "d": ("event_id % 7", "(event_id % 7)::DOUBLE"),
        "e": ("-event_id % -7", "(((-event_id) % 7 + 7) % 7)::DOUBLE"),
        "f": ("event_id % 0", "NULL::DOUBLE"),
    },
)
_functions(
    "fn_text",
    "events",
    "event_id",
    {
        "a": ("upper(event_type)", "upper(event_type)"),
        "b": ("len(event_type)", "length(event_type)::DOUBLE"),
        "c": ('concat(kind, "-", event_type)', "concat(kind, '-', event_type)"),
        "d": ('replace(event_type, "i", "!")', "replace(event_type, 'i', '!')"),
        "e": ('trim(concat("  ", event_type, " "))', "event_type"),
        "f": ('contains(kind, "c")', "contains(kind, 'c')"),
        "g": ('startswith(kind, "v")', "starts_with(kind, 'v')"),
        "h": ("text(event_id)", "event_id::VARCHAR"),
        "i": ("number(text(event_id)) + 1", "event_id::DOUBLE + 1"),
        "j": ("lower(upper(kind))", "kind"),
        "k": ('endswith(kind, "k")', "suffix(kind, 'k')"),
    },
)
_functions(
    "fn_text_slice",
    "events",
    "event_id",
    {
        "a": ("left(event_type, 2)", "left(event_type, 2)"),
        "b": ("right(event_type, 3)", "right(event_type, 3)"),
        "c": ("left(event_type, -1)", "''"),
        "d": ("substring(event_type, 2)", "substring(event_type, 2)"),
        "e": ("substring(event_type, 0, 2)", "substring(event_type, 1, 2)"),
        "f": ("substring(event_type, 3, -1)", "''"),
        "g": ("substring(event_type, 50)", "''"),
    },
)
_functions(
    "fn_dates",
    "events",
    "event_id",
    {
        "a": ("year(ts)", "year(ts)::DOUBLE"),
        "b": ("week(ts)", "weekofyear(ts)::DOUBLE"),
        "c": ("weekday(ts)", "isodow(ts)::DOUBLE"),
        "d": ("hour(ts)", "hour(ts)::DOUBLE"),
        "e": ('date("2024-02-30")', "NULL::TIMESTAMP"),
        "f": ("date(2024, 13, event_id % 40)", "(DATE '2025-01-01' + ((event_id % 40) - 1)::INTEGER)::TIMESTAMP"),
        "g": ('date("2024-03-05 10:30")', "TIMESTAMP '2024-03-05 10:30:00'"),
        "h": ("text(date(2024, month(ts), 5))", "strftime(make_date(2024, month(ts)::INTEGER, 5), '%Y-%m-%d')"),
        "i": ("quarter(ts) + month(ts) + day(ts)", "(quarter(ts) + month(ts) + day(ts))::DOUBLE"),
    },
)
_functions(
    "fn_date_arith",
    "events",
    "event_id",
    {
        "a": ("#2024-01-10# + event_id % 5", "TIMESTAMP '2024-01-10' + to_days((event_id % 5)::INTEGER)"),
        "b": ("#2024-01-10# - 0.5", "TIMESTAMP '2024-01-09 12:00:00'"),
        "c": ("(date(2024, 3, event_id % 28) - #2024-01-01#) * 2", "((DATE '2024-03-01' + ((event_id % 28) - 1)::INTEGER) - DATE '2024-01-01')::DOUBLE * 2"),
        "d": ("ts >= #2024-01-15 12:00#", "ts >= TIMESTAMP '2024-01-15 12:00:00'"),
        "e": ("ts between #2024-01-05# and #2024-01-06#", "date_trunc('millisecond', ts) BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06'"),
    },
)
_functions(
    "fn_null_logic",
    "events",
    "event_id",
    {
        "a": ("small > 100 and value > 200", "small > 100 AND value > 200"),
        "b": ("small > 100 or value > 300", "small > 100 OR value > 300"),
        "c": ("not (small > 100)", "NOT (small > 100)"),
        "d": ("small is empty", "small IS NULL"),
        "e": ("isempty(kind) = (kind is null)", "true"),
        "f": ('kind in ("click", null)', "kind IN ('click', NULL)"),
        "g": ('kind not in ("click", "view")', "kind NOT IN ('click', 'view')"),
        "h": ("kind in ()", "CASE WHEN kind IS NOT NULL THEN false END"),
        "i": ("small not between 100 and 200", "small NOT BETWEEN 100 AND 200"),
        "j": ("kind <> event_type", "kind <> event_type"),
    },
)
_functions(
    "fn_conditional",
    "events",
    "event_id",
    {
        "a": ('if(small > 100, "big", "small")', "CASE WHEN small > 100 THEN 'big' ELSE 'small' END"),
        "b": ("coalesce(small, -1)", "coalesce(small, -1)"),
        "c": ('coalesce(kind, "none")', "coalesce(kind, 'none')"),
        "d": ("if(kind is empty, null, value)", "CASE WHEN kind IS NULL THEN NULL ELSE value END"),
        "e": ("if(value > 100, ts, null)", "CASE WHEN value > 100 THEN date_trunc('millisecond', ts) END"),
    },
)


# Charts and drill-through


@query("SELECT o_orderpriority AS category, o_orderstatus AS series, count(*)::BIGINT AS value FROM orders GROUP BY 1, 2")
def chart_category_series(spark, sf_dir):
    f = FactTable.of(read(spark, sf_dir, "orders"))
    found = chart_from_facts(f, ColumnDimension("o_orderpriority"), COUNT, ColumnDimension("o_orderstatus"))
    return found.select("category", "series", "value").where("value is not null")


@query(
    "SELECT make_date(year(o_orderdate)::INTEGER, (quarter(o_orderdate)::INTEGER - 1) * 3 + 1, 1)::TIMESTAMP AS period_start, count(*)::BIGINT AS value FROM orders GROUP BY 1"
)
def chart_period_start(spark, sf_dir):
    f = FactTable.of(read(spark, sf_dir, "orders"))
    spec = CubeSpec(CubeAxis.of(YEAR, QUARTER))
    cells = Cube(f, spec, Expansion.to_depth(2)).table({"count": "value", "o_orderdate.year": "year", "o_orderdate.quarter": "quarter"})
    return with_period_start(cells.where("row_depth = 2"), ["year", "quarter"]).select("period_start", "value")


@query(f"SELECT n_name AS point, sum(l_quantity) AS x, count(*)::DOUBLE AS y FROM {STAR} GROUP BY 1")
def scatter_groups(spark, sf_dir):
    return scatter_of_groups(star(spark, sf_dir), NATION, QTY, COUNT)


@query(f"SELECT event_id AS point, small AS x, value AS y FROM {EVENTS} WHERE small IS NOT NULL ORDER BY event_id LIMIT 100")
def scatter_facts_limit(spark, sf_dir):
    return scatter_from_facts(events(spark, sf_dir), "small", "value", point="event_id", order="event_id", limit=100)


@query(
    f"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity FROM {STAR} WHERE r_name = 'ASIA' AND year(o_orderdate) = 1997 AND l_quantity > 40"
)
def drill_through_cell(spark, sf_dir):
    spec = CubeSpec(CubeAxis.of(REGION), CubeAxis.of(YEAR), (QTY,), CompareFilter("l_quantity", "greater", 40.0))
    return Cube(star(spark, sf_dir), spec).fact_rows(("ASIA",), (1997,), ["l_orderkey", "l_linenumber", "l_quantity"])


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from gridlark import ingest_queries, layout_queries

    return QUERIES | ingest_queries.QUERIES | layout_queries.QUERIES


def all_sql() -> dict[str, str]:
    from gridlark import ingest_queries, layout_queries

    return SQL | ingest_queries.SQL | layout_queries.SQL

