"""Registered queries of sources, layouts, exports and charts that go over small tables or a cube's own cells."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable

from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.exports.config import CubeJson
from gridlark.exports.files import cube_to_ods, cube_to_svg, cube_to_xlsx, facts_to_ods, facts_to_xlsx
from gridlark.exports.grid import to_csv, to_html
from gridlark.functions.registry import STANDARD, ExpressionFunction
from gridlark.functions.syntax import ExpressionError
from gridlark.functions.types import ExprType
from gridlark.operators.aggregates import (
    COUNT,
    DISPLAYS,
    CombinedAggregate,
    CustomAggregate,
    CustomLayoutAggregate,
    FormulaAggregate,
    build,
    distinct_count,
    max_of,
    min_of,
    std_dev,
)
from gridlark.operators.dimensions import ColumnDimension, ExpressionMeasure, standard_dimensions
from gridlark.operators.facts import ColumnType, FactTable
from gridlark.operators.filters import AndFilter, CompareFilter, EmptyFilter, ExpressionFilter, NotFilter, OrFilter, TextFilter, ValueFilter
from gridlark.plans.charts import chart_from_cell, chart_from_cube, scatter_from_cell, scatter_from_cube, transposed, without_empty
from gridlark.plans.cube import Cube, CubeAxis, CubeSpec, Expansion
from gridlark.queries import _KIND, _NAMES, _RN, _YQ, EVENTS, NATION, QTY, REGION, STAR, YEAR, _by_flag, _by_flag_sql, cube_sql, events, read, star
from gridlark.sources.folders import shared_folder
from gridlark.sources.ingest import ImportFailed, load_facts
from gridlark.sources.readers import JsonOptions, read_json, read_jsonl, read_rows
from gridlark.sources.schema import ColumnSpec, Schema
from gridlark.sources.sheets import SheetOptions, date_of_serial, read_ods, read_xlsx, sheets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _nations(spark: SparkSession, sf_dir: str) -> FactTable:
    joined = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return FactTable.of(joined.select("n_nationkey", "n_name", "r_name"))


_NATIONS = "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"


# Sources


@query("SELECT n_nationkey::BIGINT AS key, n_name AS name, n_nationkey / 2.0::DOUBLE AS half FROM nation")
def source_rows(spark, sf_dir):
    rows = [[r["n_nationkey"], r["n_name"], r["n_nationkey"] / 2 if r["n_nationkey"] % 2 else r["n_nationkey"] // 2] for r in read(spark, sf_dir, "nation").collect()]
    return read_rows(spark, ["key", "name", "half"], rows)


@query(_NATIONS)
def source_json_array(spark, sf_dir):
    path = shared_folder(spark)
    rows = _nations(spark, sf_dir).rows()
    rows.agg(F.to_json(F.collect_list(F.struct(F.struct("n_nationkey", "n_name").alias("n"), "r_name"))).alias("value")).coalesce(1).write.text(path)
    found = read_json(spark, path, JsonOptions(separator="/"))
    return found.select(F.col("`n/n_nationkey`").alias("n_nationkey"), F.col("`n/n_name`").alias("n_name"), "r_name")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type END AS late FROM events")
def source_jsonl_all_rows(spark, sf_dir):
    path = shared_folder(spark)
    rows = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("late"))
    rows.write.json(path)
    return read_jsonl(spark, path, JsonOptions(scan_all_rows=True)).select("event_id", "late")


@query(_NATIONS)
def source_xlsx(spark, sf_dir):
    return read_xlsx(spark, io.BytesIO(facts_to_xlsx(_nations(spark, sf_dir))))


@query(_NATIONS)
def source_ods(spark, sf_dir):
    return read_ods(spark, io.BytesIO(facts_to_ods(_nations(spark, sf_dir))))


@query("SELECT 'Sheet1' AS name, false AS hidden, false AS empty, true AS active")
def source_sheets(spark, sf_dir):
    found = sheets(io.BytesIO(facts_to_xlsx(_nations(spark, sf_dir))))
    return spark.createDataFrame([(s.name, s.hidden, s.empty, s.active) for s in found], "name string, hidden boolean, empty boolean, active boolean")


@query("SELECT n_nationkey::BIGINT AS days, (DATE '1900-03-01' + n_nationkey::INTEGER)::TIMESTAMP AS day FROM nation")
def source_excel_dates(spark, sf_dir):
    rows = [(k := r["n_nationkey"], date_of_serial(61 + k)) for r in read(spark, sf_dir, "nation").select("n_nationkey").collect()]
    return spark.createDataFrame(rows, "days bigint, day timestamp_ntz")


@query("SELECT count(*)::BIGINT AS misfits, count(*) > 0 AS failed FROM events WHERE value > 200")
def import_fail(spark, sf_dir):
    raw = events(spark, sf_dir).rows(["value"]).select(F.when(F.col("value") <= 200, F.col("value").cast("string")).otherwise("much").alias("value"))
    failed = False
    try:
        load_facts(raw, Schema((ColumnSpec("value", ColumnType.NUMBER),)), "fail")
    except ImportFailed:
        failed = True
    _, report = load_facts(raw, Schema((ColumnSpec("value", ColumnType.NUMBER),)), "nullify")
    return spark.createDataFrame([(report.nullified.get("value", 0), failed)], "misfits bigint, failed boolean")


@query("SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN event_id * 2 END AS twice FROM events")
def column_spec_parser(spark, sf_dir):
    spec = ColumnSpec("n", ColumnType.INTEGER, parser=lambda raw: F.when(raw.startswith("x"), raw.substr(F.lit(2), F.length(raw)).try_cast("bigint") * 2))
    raw = read(spark, sf_dir, "events").select(F.col("event_id"), F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("x"), "event_id")).alias("n"))
    facts, _ = load_facts(raw, Schema((ColumnSpec("event_id", ColumnType.INTEGER), spec)))
    return facts.rows().withColumnRenamed("n", "twice")


@query("SELECT CASE WHEN event_id % 2 = 0 THEN event_id::VARCHAR ELSE 'n' || event_id END AS mixed FROM events")
def import_widen_typed(spark, sf_dir):
    """Cells that had the narrower type are told by their values: 007 is 7."""
    raw = read(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("00"), "event_id")).otherwise(F.concat(F.lit("n"), "event_id")).alias("mixed")
    )
    return load_facts(raw, Schema((ColumnSpec("mixed", ColumnType.INTEGER),)))[0].rows()


# Facts and dimensions


@query("SELECT count(*) FILTER (kind = 'click')::BIGINT AS clicks, count(*) FILTER (kind IS NULL)::BIGINT AS empty FROM " + EVENTS)
def facts_count_where(spark, sf_dir):
    f = events(spark, sf_dir)
    return spark.createDataFrame([(f.count_where(_KIND, "click"), f.count_where(_KIND, None))], "clicks bigint, empty bigint")


@query("SELECT event_id, event_type, value FROM events WHERE event_id IN (3, 5)")
def facts_value_at(spark, sf_dir):
    f = events(spark, sf_dir).with_labels({"value": "Worth"})
    found = f.where(ValueFilter(ColumnDimension("event_id"), (3, 5)).condition(f))
    assert f["value"].label == "Worth"
    return found.rows(["event_id", "event_type", "value"])


@query("SELECT unnest(['event_id', 'ts', 'ts.year', 'ts.quarter', 'ts.month', 'ts.week', 'ts.day', 'ts.weekday', 'ts.hour', 'event_type']) AS id")
def facts_standard_dimensions(spark, sf_dir):
    f = FactTable.of(read(spark, sf_dir, "events").select("event_id", "ts", "event_type"))
    return spark.createDataFrame([(d.id,) for d in standard_dimensions(f)], "id string")


@query(f"SELECT event_id FROM {EVENTS} WHERE (kind IN ('click', 'view') AND value > 100) OR (kind IS NULL AND NOT (value < 300)) OR contains(kind, 'gnu')")
def filter_as_expression(spark, sf_dir):
    """The filter is written as an expression and read back."""
    f = events(spark, sf_dir)
    tree = OrFilter(
        (
            AndFilter((ValueFilter(_KIND, ("click", "view")), CompareFilter("value", "greater", 100.0))),
            AndFilter((EmptyFilter("kind"), NotFilter(CompareFilter("value", "less", 300.0)))),
            TextFilter("kind", "contains", "gnu"),
        )
    )
    again = ExpressionFilter(tree.to_expression_source())
    return f.where(again.condition(f)).rows(["event_id"])


@query("SELECT event_id, event_id * 3 + 1 AS a, year(current_date)::DOUBLE AS y FROM events")
def fn_registered_and_today(spark, sf_dir):
    f = events(spark, sf_dir)
    triple = ExpressionFunction("triple", (ExprType.NUMBER,), ExprType.NUMBER, lambda x: x * 3)
    functions = STANDARD.with_functions(triple)
    a, y = f.compile("triple(event_id) + 1", functions=functions), f.compile("year(today())")
    return f.frame.select(f.column("event_id").alias("event_id"), a.column().cast("bigint").alias("a"), y.column().alias("y"))


@query("SELECT * FROM (VALUES ('value +', true), ('nope > 1', true), ('value + kind', true), ('value + 1', false)) t(source, wrong)")
def fn_errors(spark, sf_dir):
    f = events(spark, sf_dir)

    def wrong(source: str) -> bool:
        try:
            f.compile(source)
        except ExpressionError:
            return True
        return False

    return spark.createDataFrame([(s, wrong(s)) for s in ("value +", "nope > 1", "value + kind", "value + 1")], "source string, wrong boolean")


# Aggregates


@query(_by_flag_sql("round(stddev_samp(l_quantity + 1000000000), 4) AS s, round(var_pop(l_quantity + 1000000000), 4) AS p"))
def agg_stddev_large_mean(spark, sf_dir):
    far = ExpressionMeasure("l_quantity + 1000000000", "far")
    a, b = std_dev(far), build("variancePopulation", far)
    return _by_flag(spark, sf_dir, [a, b], {a.id: "s", b.id: "p"}).withColumns({"s": F.round("s", 4), "p": F.round("p", 4)})


@query(cube_sql({"flag": "l_returnflag"}, {"y": "year(l_shipdate)::BIGINT"}, "count(DISTINCT l_suppkey)::BIGINT AS suppliers, count(DISTINCT l_partkey)::BIGINT AS parts, count(*)::BIGINT AS n", "lineitem"))
def agg_two_distincts(spark, sf_dir):
    from gridlark.operators.dimensions import DatePartDimension

    a, b = distinct_count("l_suppkey"), distinct_count("l_partkey")
    spec = CubeSpec(CubeAxis.of(ColumnDimension("l_returnflag")), CubeAxis.of(DatePartDimension("l_shipdate", "year")), (a, b, COUNT))
    found = Cube(FactTable.of(read(spark, sf_dir, "lineitem")), spec).table({a.id: "suppliers", b.id: "parts", "count": "n", "l_returnflag": "flag", "l_shipdate.year": "y"})
    return found


@query(_by_flag_sql("max(l_quantity) - min(l_quantity) AS spread, max(l_shipdate) AS latest, least(sum(l_linenumber), count(*) * 2)::DOUBLE AS least_"))
def agg_own(spark, sf_dir):
    """A combined aggregate, a custom one with its own state, and min of two values in a formula."""
    spread = CombinedAggregate("spread", (min_of("l_quantity"), max_of("l_quantity")), lambda low, high: high - low)
    latest = CustomAggregate("latest", lambda f: F.max(f.column("l_shipdate")), F.max)
    least = FormulaAggregate("min(sum(l_linenumber), count * 2)")
    return _by_flag(spark, sf_dir, [spread, latest, least], {"spread": "spread", "latest": "latest", least.id: "least_"})


@query(_by_flag_sql("count(*)::BIGINT AS a, sum(l_quantity) AS b, avg(l_quantity) AS c, min(l_quantity) AS d, count(l_quantity)::BIGINT AS e, count(DISTINCT l_linestatus)::BIGINT AS f"))
def agg_by_kind(spark, sf_dir):
    made = [build(k, None if k == "count" else "l_linestatus" if k == "distinctCount" else "l_quantity") for k in ("count", "sum", "average", "min", "countNonNull", "distinctCount")]
    return _by_flag(spark, sf_dir, made, dict(zip((a.id for a in made), "abcdef", strict=True)))


# Layouts

_SPEC = CubeSpec(CubeAxis.of(REGION, NATION), CubeAxis.of(YEAR), (QTY, COUNT))
_CELLS = cube_sql(_RN, {"y": _YQ["y"]}, "sum(l_quantity) AS qty, count(*)::BIGINT AS n", keep="row_depth < 2 OR region = 'EUROPE'")


def _opened(spark: SparkSession, sf_dir: str) -> Cube:
    return Cube(star(spark, sf_dir), _SPEC, Expansion.of([("EUROPE",)]))


@query(_CELLS)
def cube_prepared_toggle(spark, sf_dir):
    """Opened from stored groups, without a look at the facts."""
    return Cube(star(spark, sf_dir), _SPEC).prepared().toggle_row(("EUROPE",)).table(_NAMES)


@query(f"SELECT qty, n FROM ({_CELLS}) x WHERE region = 'EUROPE' AND nation = 'FRANCE' AND y = 1995")
def layout_cell_for(spark, sf_dir):
    found = _opened(spark, sf_dir).cell_for(("EUROPE", "FRANCE"), (1995,))
    rows = [] if found is None else [(found[QTY.id], found["count"])]
    return spark.createDataFrame(rows, "qty double, n bigint")


_SHOWN = f"SELECT *, (row_number() OVER (ORDER BY row_depth = 0, region, row_depth, nation) - 1)::INTEGER AS pos FROM (SELECT * FROM ({_CELLS}) y WHERE column_depth = 0) x"


@query(f"SELECT pos, (CASE WHEN row_depth = 1 AND region = 'EUROPE' THEN (SELECT count(*) FROM ({_SHOWN}) z WHERE row_depth = 2) ELSE 0 END)::INTEGER AS descendants FROM ({_SHOWN}) s")
def layout_descendants(spark, sf_dir):
    return _opened(spark, sf_dir).descendant_counts("rows")


@query(
    f"SELECT level, pos, entry_start, entry_span, is_label FROM (SELECT unnest([0, 1])::INTEGER AS level, pos, row_depth, region, nation, "
    f"min(pos) OVER (PARTITION BY region) AS first, count(*) OVER (PARTITION BY region)::INTEGER AS run FROM ({_SHOWN}) s), "
    "LATERAL (SELECT (row_depth > 0 AND region = 'EUROPE' AND level = 0) AS wide) w, "
    "LATERAL (SELECT CASE WHEN wide THEN first ELSE pos END AS entry_start, CASE WHEN wide THEN run ELSE 1 END AS entry_span, "
    "NOT (row_depth = 1 AND region = 'EUROPE' AND level = 1) AS is_label) a"
)
def layout_header_areas(spark, sf_dir):
    return _opened(spark, sf_dir).header_areas("rows").select("level", "pos", "entry_start", "entry_span", "is_label")


@query("SELECT (count(DISTINCT n_name) - count(DISTINCT CASE WHEN r_name = 'EUROPE' THEN n_name END))::BIGINT AS added FROM " + STAR)
def layout_added_by_level(spark, sf_dir):
    return spark.createDataFrame([(_opened(spark, sf_dir).added_by_expanding_level("rows", 0),)], "added bigint")


@query(f"SELECT row_depth, region, column_depth, y, qty * 2 + row_depth AS v FROM ({_CELLS}) x WHERE row_depth < 2")
def layout_custom(spark, sf_dir):
    own = CustomLayoutAggregate("own", QTY, lambda v, rows, columns: v * 2 + rows.depth)
    found = Cube(star(spark, sf_dir), _SPEC.copy_with(aggregates=(QTY, own)), columns=Expansion.to_depth(1)).result(_NAMES | {"own": "v"})
    return found.where("facts > 0").select("row_depth", "region", "column_depth", "y", "v")


@query(f"SELECT region, round(100 * qty / sum(qty) OVER (), 6) AS share FROM ({cube_sql({'region': 'r_name'}, {}, 'sum(l_quantity) AS qty')}) x WHERE row_depth = 1")
def layout_display(spark, sf_dir):
    share = DISPLAYS["percentOfColumn"](QTY)
    found = Cube(star(spark, sf_dir), CubeSpec(CubeAxis.of(REGION), aggregates=(QTY, share))).result({"r_name": "region", share.id: "share"})
    return found.where("row_depth = 1").select("region", F.round("share", 6).alias("share"))


# Exports: written, read back and taken apart

_TOTALS = "SELECT coalesce(r_name, 'Total') AS region, sum(l_quantity) AS total FROM " + STAR + " GROUP BY ROLLUP (r_name)"


def _totals(spark: SparkSession, sf_dir: str) -> Cube:
    return Cube(star(spark, sf_dir), CubeSpec(CubeAxis.of(REGION), CubeAxis.of(ColumnDimension("l_returnflag")), (QTY,)))


def _total_rows(spark: SparkSession, rows: list[list]) -> DataFrame:
    """Body rows of the exported grid: a label, the values, the total last."""
    return spark.createDataFrame([(str(r[0]), float(r[-1])) for r in rows], "region string, total double")


@query(_TOTALS)
def export_grid_csv(spark, sf_dir):
    return _total_rows(spark, list(csv.reader(io.StringIO(to_csv(_totals(spark, sf_dir)))))[2:])


@query(_TOTALS)
def export_grid_html(spark, sf_dir):
    page = ElementTree.fromstring("<page>" + to_html(_totals(spark, sf_dir), stylesheet=False) + "</page>")
    return _total_rows(spark, [[c.text for c in row] for row in page.iter("tr")][2:])


@query(_TOTALS)
def export_grid_xlsx(spark, sf_dir):
    found = read_xlsx(spark, io.BytesIO(cube_to_xlsx(_totals(spark, sf_dir))), SheetOptions(skip_rows=1))
    return _total_rows(spark, [list(r) for r in found.collect()])


@query(_TOTALS)
def export_grid_ods(spark, sf_dir):
    found = read_ods(spark, io.BytesIO(cube_to_ods(_totals(spark, sf_dir))), SheetOptions(skip_rows=1))
    return _total_rows(spark, [list(r) for r in found.collect()])


@query("SELECT DISTINCT r_name AS text FROM " + STAR + " UNION SELECT 'Total'")
def export_grid_svg(spark, sf_dir):
    picture = ElementTree.fromstring(cube_to_svg(_totals(spark, sf_dir)))
    texts = {t.text for t in picture.iter() if t.tag.endswith("text") and t.attrib["x"] == "6"} - {"l_returnflag", "r_name"}
    return spark.createDataFrame([(t,) for t in sorted(texts)], "text string")


@query(_CELLS)
def config_roundtrip(spark, sf_dir):
    """A cube that went through its JSON configuration."""
    cube = _opened(spark, sf_dir)
    codec = CubeJson()
    return codec.to_cube(json.loads(json.dumps(codec.config(cube))), cube.facts).table(_NAMES)


# Charts


@query(f"SELECT CASE row_depth WHEN 1 THEN region ELSE region || '/' || nation END AS category, y::VARCHAR AS series, qty AS value FROM ({_CELLS}) x WHERE column_depth = 1 AND (row_depth = 2 OR (row_depth = 1 AND region <> 'EUROPE'))")
def chart_layout_leaves(spark, sf_dir):
    found = chart_from_cube(_opened(spark, sf_dir), QTY).where("value is not null")
    return found.select(F.array_join("category", "/").alias("category"), F.col("series")[0].alias("series"), "value")


@query(f"SELECT region AS category, y::VARCHAR AS series, qty AS value FROM ({_CELLS}) x WHERE column_depth = 1 AND row_depth = 1 AND region IN ('ASIA', 'EUROPE')")
def chart_layout_paths_transposed(spark, sf_dir):
    found = transposed(chart_from_cube(_opened(spark, sf_dir), QTY, [("EUROPE",), ("ASIA",)], transpose=True))
    return found.where("value is not null").select(F.col("category")[0].alias("category"), F.col("series")[0].alias("series"), "value")


@query(f"SELECT n_name AS category, sum(l_quantity) AS value FROM {STAR} WHERE r_name = 'ASIA' GROUP BY 1")
def chart_cell(spark, sf_dir):
    return chart_from_cell(_opened(spark, sf_dir), NATION, QTY, ("ASIA",)).select("category", "value")


@query(f"SELECT kind AS category, count(*)::BIGINT AS value FROM {EVENTS} WHERE kind IS NOT NULL GROUP BY 1")
def chart_without_empty(spark, sf_dir):
    cube = Cube(events(spark, sf_dir), CubeSpec(CubeAxis.of(_KIND)))
    return without_empty(chart_from_cell(cube, _KIND, COUNT)).select("category", "value")


@query(f"SELECT CASE row_depth WHEN 1 THEN region ELSE region || '/' || nation END AS point, y::VARCHAR AS series, qty AS x, n::DOUBLE AS y FROM ({_CELLS}) x WHERE column_depth = 1 AND (row_depth = 2 OR (row_depth = 1 AND region <> 'EUROPE'))")
def scatter_layout(spark, sf_dir):
    found = scatter_from_cube(_opened(spark, sf_dir), QTY, COUNT)
    return found.select(F.array_join("point", "/").alias("point"), F.col("series")[0].alias("series"), "x", "y")


@query(f"SELECT n_name AS point, sum(l_quantity) AS x, count(*)::DOUBLE AS y FROM {STAR} WHERE r_name = 'ASIA' GROUP BY 1")
def scatter_cell(spark, sf_dir):
    return scatter_from_cell(_opened(spark, sf_dir), NATION, QTY, COUNT, ("ASIA",))


