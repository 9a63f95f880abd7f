"""Chart-ready frames: categories x series, scattered points, starts of periods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.operators.aggregates import Aggregate
from gridlark.operators.dimensions import ColumnMeasure, Dimension, Measure
from gridlark.operators.facts import FactTable, all_of
from gridlark.operators.filters import FactFilter, literal
from gridlark.plans.cube import AxisDimension, AxisSort, Cube, CubeAxis, CubeSpec, Expansion


def entries(axis: DataFrame, kind: str | list[tuple] = "leaves", level: int | None = None) -> DataFrame:
    """Entries of an axis frame: leaves (what isn't open, and the summary only if it stands alone), all, a level, or a list of paths.

    Those of a list have their place in it as place; paths without an entry are left out.
    """
    if not isinstance(kind, str):
        names = sorted(c for c in axis.columns if c[0] in "rc" and c[1:].isdigit())
        found = [
            axis.where(F.col("has_entry") & (F.col("depth") == len(path)) & all_of(F.col(n).eqNullSafe(literal(v)) for n, v in zip(names, path, strict=False))).withColumn("place", F.lit(k))
            for k, path in enumerate(kind)
            if len(path) <= len(names)
        ]
        return reduce(DataFrame.unionByName, found, axis.where(F.lit(False)).withColumn("place", F.lit(0)))
    if kind == "all":
        return axis.where("has_entry")
    if kind == "level":
        return axis.where(F.col("depth") == level)
    # The summary is a leaf only where it is all there is; that one row tells.
    below = axis.agg(F.coalesce(F.max(F.when(F.col("depth") > 0, 1)), F.lit(0)).alias("_below"))
    found = axis.join(F.broadcast(below), F.lit(True)).where(F.col("has_entry") & F.when(F.col("_below") == 1, ~F.col("open") & (F.col("depth") > 0)).otherwise(True))
    return found.drop("_below")


def _of_layout(cube: Cube, aggregates: dict[str, Aggregate], rows: str | list[tuple], columns: str | list[tuple], row_level: int | None, column_level: int | None) -> DataFrame:
    """rpos, row, cpos, column, facts and a column for each aggregate of the chosen entries; positions in a list are those of the list."""

    def keys(frame: DataFrame, kind: str | list[tuple], level: int | None, s: str) -> DataFrame:
        found = entries(frame, kind, level)
        return found.select(F.col("ord").alias(f"_{s}"), F.col("pos" if isinstance(kind, str) else "place").alias(f"_{s}pos"))

    kept = cube.grid.join(keys(cube.row_entries, rows, row_level, "r"), F.col("ro") == F.col("_r")).join(keys(cube.column_entries, columns, column_level, "c"), F.col("co") == F.col("_c"))
    path = lambda s, n: F.slice(F.array(*(F.col(f"{s}{k}").cast("string") for k in range(n)), F.lit(None).cast("string")), 1, F.col(f"{s}d"))
    values = [F.when(F.col("facts") > 0, F.col(cube._name(a))).alias(n) for n, a in aggregates.items()]
    return kept.select(F.col("_rpos").alias("rpos"), path("r", cube._rows.levels).alias("row"), F.col("_cpos").alias("cpos"), path("c", cube._columns.levels).alias("column"), "facts", *values)


def chart_from_cube(
    cube: Cube,
    aggregate: Aggregate,
    rows: str | list[tuple] = "leaves",
    columns: str | list[tuple] = "leaves",
    transpose: bool = False,
    row_level: int | None = None,
    column_level: int | None = None,
) -> DataFrame:
    """category_pos, category, series_pos, series, value: arrays of group values by entry; a cell without facts is a gap.

    rows and columns say which entries: see entries().
    """
    found = _of_layout(cube, {"value": aggregate}, rows, columns, row_level, column_level)
    (cp, c), (sp, s) = (("cpos", "column"), ("rpos", "row")) if transpose else (("rpos", "row"), ("cpos", "column"))
    return found.select(F.col(cp).alias("category_pos"), F.col(c).alias("category"), F.col(sp).alias("series_pos"), F.col(s).alias("series"), "value")


def scatter_from_cube(
    cube: Cube,
    x: Aggregate,
    y: Aggregate,
    points: str | list[tuple] = "leaves",
    series: str | list[tuple] = "leaves",
    transpose: bool = False,
) -> DataFrame:
    """point_pos, point, series_pos, series, x, y, facts: one point for each chosen row entry in each chosen column entry's series.

    Points without one of the coordinates are left out; transpose takes points from the columns.
    """
    found = _of_layout(cube, {"x": x, "y": y}, series if transpose else points, points if transpose else series, None, None)
    (pp, p), (sp, s) = (("cpos", "column"), ("rpos", "row")) if transpose else (("rpos", "row"), ("cpos", "column"))
    made = found.select(F.col(pp).alias("point_pos"), F.col(p).alias("point"), F.col(sp).alias("series_pos"), F.col(s).alias("series"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "facts")
    return made.where("x is not null and y is not null")


def chart_from_facts(
    facts: FactTable,
    category: Dimension,
    aggregate: Aggregate,
    series: Dimension | None = None,
    filter: FactFilter | None = None,
    sort: AxisSort | None = None,
    series_sort: AxisSort | None = None,
) -> DataFrame:
    """category_pos, category, series_pos, series (null without a series dimension), value."""
    spec = CubeSpec(
        CubeAxis.of(AxisDimension(category, sort)),
        CubeAxis.of(AxisDimension(series, series_sort)) if series else CubeAxis(),
        (aggregate,),
        filter,
    )
    cube = Cube(facts, spec, Expansion.to_depth(1), Expansion.to_depth(1 if series else 0))
    shown = cube.grid.where(F.col("rd") == 1).where(F.col("cd") == (1 if series else 0))
    value = F.when(F.col("facts") > 0, F.col(cube._name(aggregate)))
    return shown.select(
        F.col("rpos").alias("category_pos"),
        F.col("r0").alias("category"),
        F.col("cpos").alias("series_pos"),
        (F.col("c0") if series else F.lit(None).cast("string")).alias("series"),
        value.alias("value"),
    )


def chart_from_cell(cube: Cube, category: Dimension, aggregate: Aggregate, row: tuple = (), column: tuple = (), series: Dimension | None = None) -> DataFrame:
    """chart_from_facts over the facts of a cell."""
    return chart_from_facts(cube.facts, category, aggregate, series, cube.cell_filter(row, column))


def without_empty(chart: DataFrame) -> DataFrame:
    """Without the category of missing values."""
    return chart.where(F.col("category").isNotNull())


def transposed(chart: DataFrame) -> DataFrame:
    return chart.select(
        F.col("series_pos").alias("category_pos"), F.col("series").alias("category"), F.col("category_pos").alias("series_pos"), F.col("category").alias("series"), "value"
    )


def with_period_start(frame: DataFrame, parts: list[str], out: str = "period_start") -> DataFrame:
    """frame with the first moment of the period that its date-part columns name.

    parts are named by the date part: year is needed; quarter, month, week (its
    Monday, of the ISO year), day and hour narrow it down.
    """
    if "year" not in parts:
        raise ValueError("a period needs its year")
    of = lambda p: F.col(p).cast("int")
    month: Column = of("month") if "month" in parts else (of("quarter") - 1) * 3 + 1 if "quarter" in parts else F.lit(1)
    if "week" in parts:
        fourth = F.make_date(of("year"), F.lit(1), F.lit(4))
        start = F.date_add(F.date_sub(fourth, F.weekday(fourth)), (of("week") - 1) * 7)
    else:
        start = F.date_add(F.make_date(of("year"), month, F.lit(1)), (of("day") - 1) if "day" in parts else F.lit(0))
    moment = start.cast("timestamp_ntz")
    if "hour" in parts:
        moment = F.timestamp_add("HOUR", of("hour"), moment)
    return frame.withColumn(out, moment)


def scatter_of_groups(facts: FactTable, group: Dimension, x: Aggregate, y: Aggregate, filter: FactFilter | None = None) -> DataFrame:
    """(point, x, y): one point for each group that has both aggregates."""
    cube = Cube(facts, CubeSpec(CubeAxis.of(group), aggregates=(x, y), filter=filter), Expansion.to_depth(1))
    found = cube.table({group.id: "point", x.id: "x", y.id: "y"}).where("row_depth = 1")
    return found.select("point", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null")


def scatter_from_cell(cube: Cube, group: Dimension, x: Aggregate, y: Aggregate, row: tuple = (), column: tuple = ()) -> DataFrame:
    """scatter_of_groups over the facts of a cell."""
    return scatter_of_groups(cube.facts, group, x, y, cube.cell_filter(row, column))


def _measure(facts: FactTable, m: Measure | str) -> Column:
    return (ColumnMeasure(m) if isinstance(m, str) else m).column(facts)


def scatter_from_facts(
    facts: FactTable,
    x: Measure | str,
    y: Measure | str,
    series: Dimension | None = None,
    point: str | None = None,
    filter: FactFilter | None = None,
    order: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """One point for each fact with both measures: point, series and order are columns; limit counts kept points."""
    kept = facts.where(filter.condition(facts)) if filter else facts
    named = [_measure(kept, x).alias("x"), _measure(kept, y).alias("y")]
    if series:
        named.append(series.column(kept).alias("series"))
    if point:
        named.append(kept.column(point).alias("point"))
    if order:
        named.append(kept.column(order).alias("_order"))
    found = kept.frame.select(*named).where("x is not null and y is not null")
    if order:
        found = found.orderBy("_order")
    return (found.limit(limit) if limit is not None else found).drop("_order")
