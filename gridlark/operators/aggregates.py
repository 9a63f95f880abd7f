"""Aggregates of three kinds.

Base aggregates have partial states that merge, so that cells of any level come
from the finest groups; derived ones are formulas over a cell's base aggregates;
layout ones look at other cells of the layout (see plans.values).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlark.functions.compile import Scope, compile_expression
from gridlark.functions.registry import STANDARD, FunctionRegistry
from gridlark.functions.syntax import Node, to_source
from gridlark.functions.types import ExprType
from gridlark.operators.dimensions import ColumnDimension, ColumnMeasure, Dimension, ExpressionDimension, ExpressionMeasure, Measure
from gridlark.operators.facts import FactTable


class Aggregate:
    """Known by its id."""

    id: str
    label: str

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Aggregate) and self.id == other.id

    def __hash__(self) -> int:
        return hash(self.id)

    def dependencies(self, facts: FactTable) -> list[Aggregate]:
        """What must be there before, in order of first use."""
        return []


# Function -> name in labels.
_LABELS = {
    "sum": "sum",
    "avg": "average",
    "min": "min",
    "max": "max",
    "count": "count",
    "stdev": "stdev",
    "stdevp": "stdevp",
    "var": "var",
    "varp": "varp",
}
_SPREAD = ("stdev", "stdevp", "var", "varp")


class BaseAggregate(Aggregate):
    #: 0 rather than null in a cell without facts.
    counts = False

    def partials(self, facts: FactTable) -> dict[str, tuple[Column, Callable[[Column], Column] | None]]:
        """State column -> (aggregate over facts, how states of several groups merge; None for moments).

        Moments are structs of n, mean and m2, the sum of squares about the mean.
        """
        raise NotImplementedError

    def result(self, state: Callable[[str], Column]) -> Column:
        """The aggregate's value from a cell's merged states."""
        raise NotImplementedError


@dataclass(frozen=True, eq=False)
class MeasureAggregate(BaseAggregate):
    function: str
    measure: Measure

    def __post_init__(self):
        if self.function not in _LABELS:
            raise ValueError(f"no aggregate {self.function!r}")

    @property
    def id(self) -> str:
        return f"{self.function}({self.measure.id})"

    @property
    def label(self) -> str:
        return f"{_LABELS[self.function]} of {self.measure.label}"

    @property
    def counts(self) -> bool:  # type: ignore[override]
        return self.function == "count"

    def partials(self, facts: FactTable) -> dict:
        x, m = self.measure.column(facts), self.measure.id
        number = {f"count {m}": (F.count(x), F.sum)}
        if self.function == "count":
            return number
        if self.function in ("min", "max"):
            pick = getattr(F, self.function)
            return {f"{self.function} {m}": (pick(x), pick)}
        total = {f"sum {m}": (F.sum(x), F.sum)}
        if self.function == "sum":
            return total
        if self.function == "avg":
            return number | total
        n = F.count(x)
        return {f"moments {m}": (F.struct(n.alias("n"), F.avg(x).cast("double").alias("mean"), (F.var_pop(x) * n).alias("m2")), None)}

    def result(self, state: Callable[[str], Column]) -> Column:
        m = self.measure.id
        if self.function in _SPREAD:
            s = state(f"moments {m}")
            n = s["n"] - 1 if self.function in ("stdev", "var") else s["n"]
            variance = F.when(n > 0, s["m2"] / n)
            return F.sqrt(variance) if self.function.startswith("stdev") else variance
        if self.function == "avg":
            return F.when(state(f"count {m}") > 0, state(f"sum {m}") / state(f"count {m}"))
        return state(f"{self.function} {m}")


@dataclass(frozen=True, eq=False)
class CountAggregate(BaseAggregate):
    counts = True
    id = "count"
    label = "count"

    def partials(self, facts: FactTable) -> dict:
        return {"facts": (F.count(F.lit(1)), F.sum)}

    def result(self, state: Callable[[str], Column]) -> Column:
        return state("facts")


@dataclass(frozen=True, eq=False)
class DistinctCountAggregate(BaseAggregate):
    """Exact; null is no value.  The finest groups are cut by the dimension, too, so that it is counted over them."""

    dimension: Dimension
    counts = True

    @property
    def id(self) -> str:
        return f"distinct({self.dimension.id})"

    @property
    def label(self) -> str:
        return f"distinct {self.dimension.label}"


@dataclass(frozen=True, eq=False)
class CustomAggregate(BaseAggregate):
    """A user's own: fold over facts gives one state column, merge joins states, finish gives the value."""

    id: str
    fold: Callable[[FactTable], Column]
    merge: Callable[[Column], Column]
    finish: Callable[[Column], Column] = lambda s: s
    given_label: str | None = None

    @property
    def label(self) -> str:
        return self.given_label or self.id

    def partials(self, facts: FactTable) -> dict:
        return {f"own {self.id}": (self.fold(facts), self.merge)}

    def result(self, state: Callable[[str], Column]) -> Column:
        return self.finish(state(f"own {self.id}"))


class DerivedAggregate(Aggregate):
    def value(self, facts: FactTable, of: Callable[[Aggregate], Column]) -> Column:
        """From the columns of its dependencies."""
        raise NotImplementedError


@dataclass(frozen=True, eq=False)
class FormulaAggregate(DerivedAggregate):
    """A cell formula, like sum(total) / count."""

    source: str
    given_id: str | None = None
    explicit_label: str | None = None
    functions: FunctionRegistry = field(default=STANDARD, repr=False)

    @property
    def id(self) -> str:
        return self.given_id or self.source

    @property
    def label(self) -> str:
        return self.explicit_label or self.source

    def _compiled(self, facts: FactTable, of: Callable[[Aggregate], Column]):
        found: list[Aggregate] = []

        def aggregate(name: str, argument: Node | None, scope: Scope):
            a = aggregate_of(name, argument, self.functions)
            found.append(a)
            return lambda: of(a).cast("double")

        scope = Scope(facts.scope(self.functions).columns, self.functions, aggregate)
        return compile_expression(self.source, scope, ExprType.NUMBER), list(dict.fromkeys(found))

    def dependencies(self, facts: FactTable) -> list[Aggregate]:
        return self._compiled(facts, lambda a: F.lit(None))[1]

    def value(self, facts: FactTable, of: Callable[[Aggregate], Column]) -> Column:
        return self._compiled(facts, of)[0].column()


@dataclass(frozen=True, eq=False)
class CombinedAggregate(DerivedAggregate):
    """A user's own function of other aggregates' columns."""

    id: str
    bases: tuple[Aggregate, ...]
    combine: Callable[..., Column]
    given_label: str | None = None

    @property
    def label(self) -> str:
        return self.given_label or self.id

    def dependencies(self, facts: FactTable) -> list[Aggregate]:
        return list(self.bases)

    def value(self, facts: FactTable, of: Callable[[Aggregate], Column]) -> Column:
        return self.combine(*map(of, self.bases))


def aggregate_of(name: str, argument: Node | None, functions: FunctionRegistry = STANDARD) -> Aggregate:
    """The aggregate that name(argument) stands for in a cell formula."""
    if argument is None:
        return COUNT
    column = argument.op == "name"
    text = str(argument.value) if column else to_source(argument)
    if name == "distinct":
        return DistinctCountAggregate(ColumnDimension(text) if column else ExpressionDimension(text, functions=functions))
    measure = ColumnMeasure(text) if column else ExpressionMeasure(text, functions=functions)
    return MeasureAggregate("avg" if name == "average" else name, measure)


COUNT = CountAggregate()


def _measure(m: Measure | str) -> Measure:
    return ColumnMeasure(m) if isinstance(m, str) else m


def sum_of(m: Measure | str) -> Aggregate:
    return MeasureAggregate("sum", _measure(m))


def average_of(m: Measure | str) -> Aggregate:
    return MeasureAggregate("avg", _measure(m))


def min_of(m: Measure | str) -> Aggregate:
    return MeasureAggregate("min", _measure(m))


def max_of(m: Measure | str) -> Aggregate:
    return MeasureAggregate("max", _measure(m))


def count_values(m: Measure | str) -> Aggregate:
    return MeasureAggregate("count", _measure(m))


def std_dev(m: Measure | str, population: bool = False) -> Aggregate:
    return MeasureAggregate("stdevp" if population else "stdev", _measure(m))


def variance(m: Measure | str, population: bool = False) -> Aggregate:
    return MeasureAggregate("varp" if population else "var", _measure(m))


def distinct_count(d: Dimension | str) -> Aggregate:
    return DistinctCountAggregate(ColumnDimension(d) if isinstance(d, str) else d)


#: The kinds a picker offers, and what each needs.
KINDS = {
    "count": None,
    "sum": "measure",
    "average": "measure",
    "min": "measure",
    "max": "measure",
    "countNonNull": "measure",
    "stdDev": "measure",
    "stdDevPopulation": "measure",
    "variance": "measure",
    "variancePopulation": "measure",
    "distinctCount": "dimension",
}


def build(kind: str, operand: Measure | Dimension | str | None = None) -> Aggregate:
    """The aggregate of a kind in KINDS."""
    makers = {
        "count": lambda _: COUNT,
        "sum": sum_of,
        "average": average_of,
        "min": min_of,
        "max": max_of,
        "countNonNull": count_values,
        "stdDev": std_dev,
        "stdDevPopulation": lambda m: std_dev(m, True),
        "variance": variance,
        "variancePopulation": lambda m: variance(m, True),
        "distinctCount": distinct_count,
    }
    return makers[kind](operand)


# Layout aggregates: values shown relative to other cells.

TOTALS = ("row", "column", "grand", "parentRow", "parentColumn")


class LayoutAggregate(Aggregate):
    base: Aggregate

    def dependencies(self, facts: FactTable) -> list[Aggregate]:
        return [self.base]


@dataclass(frozen=True, eq=False)
class PercentOf(LayoutAggregate):
    base: Aggregate
    of: str

    def __post_init__(self):
        if self.of not in TOTALS:
            raise ValueError(f"no total {self.of!r}")

    @property
    def id(self) -> str:
        return f"percentOf({self.of}, {self.base.id})"

    @property
    def label(self) -> str:
        return f"{self.base.label} % of {self.of}"


@dataclass(frozen=True)
class Item:
    """A sibling: the previous or next one, or the one of a value."""

    kind: str
    value: object = None

    @property
    def id(self) -> str:
        return self.kind if self.kind != "value" else f"value:{self.value}"


PREVIOUS, NEXT = Item("previous"), Item("next")


@dataclass(frozen=True, eq=False)
class DifferenceFrom(LayoutAggregate):
    base: Aggregate
    axis: str
    item: Item
    percent: bool = False

    @property
    def id(self) -> str:
        return f"{'percentDifferenceFrom' if self.percent else 'differenceFrom'}({self.axis}.{self.item.id}, {self.base.id})"

    @property
    def label(self) -> str:
        name = str(self.item.value) if self.item.kind == "value" else self.item.kind
        return f"{self.base.label} {'% ' if self.percent else ''}difference from {name}"


@dataclass(frozen=True, eq=False)
class RunningTotal(LayoutAggregate):
    base: Aggregate
    axis: str

    @property
    def id(self) -> str:
        return f"runningTotal({self.axis}, {self.base.id})"

    @property
    def label(self) -> str:
        return f"{self.base.label} running total"


@dataclass(frozen=True, eq=False)
class Rank(LayoutAggregate):
    base: Aggregate
    axis: str
    ascending: bool = False

    @property
    def id(self) -> str:
        return f"rank({self.axis}{'.ascending' if self.ascending else ''}, {self.base.id})"

    @property
    def label(self) -> str:
        return f"{self.base.label} rank"


@dataclass(frozen=True, eq=False)
class CustomLayoutAggregate(LayoutAggregate):
    """A user's own: compute gets the base's column and the windows of the layout (plans.values.Windows)."""

    id: str
    base: Aggregate
    compute: Callable
    given_label: str | None = None

    @property
    def label(self) -> str:
        return self.given_label or self.id


def innermost(a: Aggregate) -> Aggregate:
    while isinstance(a, LayoutAggregate):
        a = a.base
    return a


#: Ways to show a value, by name.
DISPLAYS: dict[str, Callable[[Aggregate], Aggregate]] = {
    "plain": lambda a: a,
    "percentOfRow": lambda a: PercentOf(a, "row"),
    "percentOfColumn": lambda a: PercentOf(a, "column"),
    "percentOfGrand": lambda a: PercentOf(a, "grand"),
    "percentOfParentRow": lambda a: PercentOf(a, "parentRow"),
    "percentOfParentColumn": lambda a: PercentOf(a, "parentColumn"),
    "differenceFromPreviousRow": lambda a: DifferenceFrom(a, "rows", PREVIOUS),
    "differenceFromPreviousColumn": lambda a: DifferenceFrom(a, "columns", PREVIOUS),
    "percentDifferenceFromPreviousRow": lambda a: DifferenceFrom(a, "rows", PREVIOUS, True),
    "percentDifferenceFromPreviousColumn": lambda a: DifferenceFrom(a, "columns", PREVIOUS, True),
    "runningTotalRows": lambda a: RunningTotal(a, "rows"),
    "runningTotalColumns": lambda a: RunningTotal(a, "columns"),
    "rankRows": lambda a: Rank(a, "rows"),
    "rankColumns": lambda a: Rank(a, "columns"),
}
