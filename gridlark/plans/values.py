"""Values shown relative to other cells of the grid: shares, differences, running totals and ranks.

All frames are over siblings, the groups of one parent on one axis in display
order, at a fixed group of the other axis.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gridlark.operators.aggregates import Aggregate, CustomLayoutAggregate, DifferenceFrom, LayoutAggregate, PercentOf, Rank, RunningTotal
from gridlark.operators.filters import literal


@dataclass(frozen=True)
class Windows:
    """What the values of one axis are worked out over."""

    side: str
    other: str
    levels: int

    @property
    def depth(self) -> Column:
        return F.col(f"{self.side}d")

    @property
    def own_value(self) -> Column:
        """The group's value on its own level."""
        found = F.lit(None)
        for k in range(self.levels - 1, -1, -1):
            column = F.col(f"{self.side}{k}").cast("string")
            found = F.when(self.depth == k + 1, column).otherwise(found)
        return found

    @property
    def siblings(self) -> WindowSpec:
        parent = F.slice(f"{self.side}o", 1, F.greatest(self.depth - 1, F.lit(0)))
        return Window.partitionBy(self.depth, parent, f"{self.other}o")


def _ordinal(side: str) -> Column:
    o = F.col(f"{side}o")
    return F.when(F.size(o) > 0, F.get(o, F.size(o) - 1))


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part / whole * 100)


def _percent_of(grid: DataFrame, a: PercentOf, v: str, out: str) -> DataFrame:
    x = F.col(v).cast("double")
    if a.of in ("row", "column"):
        own, root = ("ro", "cd") if a.of == "row" else ("co", "rd")
        whole = F.max(F.when(F.col(root) == 0, x)).over(Window.partitionBy(own))
        return grid.withColumn(out, _percent(x, whole))
    if a.of == "grand":
        whole = grid.where("rd = 0 and cd = 0").select(x.alias("_whole"))  # one row
        return grid.join(F.broadcast(whole), F.lit(True), "left").withColumn(out, _percent(x, F.col("_whole"))).drop("_whole")
    side, other = ("r", "c") if a.of == "parentRow" else ("c", "r")
    path, depth = F.col(f"{side}o"), F.col(f"{side}d")
    above = grid.select(path.alias("_path"), F.col(f"{other}o").alias("_other"), x.alias("_whole"))
    on = (F.slice(path, 1, F.greatest(depth - 1, F.lit(0))) == F.col("_path")) & (F.col(f"{other}o") == F.col("_other")) & (depth > 0)
    return grid.join(above, on, "left").withColumn(out, _percent(x, F.col("_whole"))).drop("_path", "_other", "_whole")


def _difference(w: Windows, a: DifferenceFrom, v: str) -> Column:
    x = F.col(v)
    siblings = w.siblings
    if a.item.kind == "value":
        value = a.item.value
        same = w.own_value.eqNullSafe(literal(value).cast("string"))
        other = F.max(F.when(same, x)).over(siblings)
    else:
        order = siblings.orderBy(_ordinal(w.side))
        other = F.lag(x).over(order) if a.item.kind == "previous" else F.lead(x).over(order)
    apart = x - other
    if a.percent:
        apart = F.when(other != 0, apart / other * 100)
    return F.when(w.depth > 0, apart)


def _running(w: Windows, v: str) -> Column:
    x = F.col(v)
    total = F.sum(x).over(w.siblings.orderBy(_ordinal(w.side)).rowsBetween(Window.unboundedPreceding, 0))
    return F.when(w.depth > 0, total).otherwise(x)


def _rank(w: Windows, a: Rank, v: str) -> Column:
    x = F.col(v)
    order = x.asc_nulls_last() if a.ascending else x.desc_nulls_last()
    return F.when(x.isNotNull() & (w.depth > 0), F.rank().over(w.siblings.orderBy(order)))


def with_layout_values(grid: DataFrame, aggregates: list[LayoutAggregate], name: Callable[[Aggregate], str], row_levels: int, column_levels: int) -> DataFrame:
    """grid with a column for each layout aggregate, bases first."""
    for a in aggregates:
        out, v = name(a), name(a.base)
        if isinstance(a, PercentOf):
            grid = _percent_of(grid, a, v, out)
            continue
        axis = getattr(a, "axis", "rows")
        w = Windows("r", "c", row_levels) if axis == "rows" else Windows("c", "r", column_levels)
        if isinstance(a, DifferenceFrom):
            grid = grid.withColumn(out, _difference(w, a, v))
        elif isinstance(a, RunningTotal):
            grid = grid.withColumn(out, _running(w, v))
        elif isinstance(a, Rank):
            grid = grid.withColumn(out, _rank(w, a, v))
        elif isinstance(a, CustomLayoutAggregate):
            grid = grid.withColumn(out, a.compute(F.col(v), Windows("r", "c", row_levels), Windows("c", "r", column_levels)))
        else:
            raise TypeError(f"unknown layout aggregate {a.id}")
    return grid
