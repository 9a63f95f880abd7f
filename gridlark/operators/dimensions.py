"""What facts are grouped by and what is summed: views on columns, known by their id."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlark.functions.registry import DATE_PARTS, STANDARD, FunctionRegistry, date_part
from gridlark.functions.types import ExprType
from gridlark.operators.facts import ColumnType, FactTable


class _ById:
    """Equality by id."""

    id: str

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _ById) and _kind(self) is _kind(other) and self.id == other.id

    def __hash__(self) -> int:
        return hash(self.id)


def _kind(x: object) -> type:
    return next(t for t in type(x).__mro__ if t in (Dimension, Measure) or t is _ById)


class Dimension(_ById):
    explicit_label: str | None = None

    @property
    def label(self) -> str:
        return self.explicit_label or self.id

    def column(self, facts: FactTable) -> Column:
        raise NotImplementedError


@dataclass(frozen=True, eq=False)
class ColumnDimension(Dimension):
    source_column: str
    explicit_label: str | None = None

    @property
    def id(self) -> str:
        return self.source_column

    def column(self, facts: FactTable) -> Column:
        return facts.column(self.source_column)


@dataclass(frozen=True, eq=False)
class DatePartDimension(Dimension):
    """year, quarter, month, week (ISO), day, weekday (Monday is 1) or hour, as an integer."""

    source_column: str
    part: str
    explicit_label: str | None = None

    def __post_init__(self):
        if self.part not in DATE_PARTS:
            raise ValueError(f"no date part {self.part!r}")

    @property
    def id(self) -> str:
        return f"{self.source_column}.{self.part}"

    def column(self, facts: FactTable) -> Column:
        c = facts[self.source_column]
        if c.type.expression is not ExprType.DATE:
            raise TypeError(f"{c.name} has no date parts")
        if self.part == "hour" and c.type is ColumnType.DATE:
            return F.when(F.col(c.inner).isNotNull(), F.lit(0)).cast("long")
        return date_part(self.part, F.col(c.inner)).cast("long")


@dataclass(frozen=True, eq=False)
class MappedDimension(Dimension):
    """mapping turns the column into another, null staying null.

    A mapping of values (a dict) becomes a lookup, a callable gets the column
    and gives a column; wrap plain Python in a UDF for it.
    """

    id: str
    source_column: str
    mapping: Callable[[Column], Column] | dict
    explicit_label: str | None = None

    def column(self, facts: FactTable) -> Column:
        source = facts.column(self.source_column)
        if callable(self.mapping):
            return F.when(source.isNotNull(), self.mapping(source))
        chain = None
        for value, to in self.mapping.items():
            chain = F.when(source == F.lit(value), F.lit(to)) if chain is None else chain.when(source == F.lit(value), F.lit(to))
        return chain if chain is not None else F.lit(None).cast("string")


@dataclass(frozen=True, eq=False)
class ExpressionDimension(Dimension):
    source: str
    given_id: str | None = None
    explicit_label: str | None = None
    functions: FunctionRegistry = field(default=STANDARD, repr=False)

    @property
    def id(self) -> str:
        return self.given_id or self.source

    def column(self, facts: FactTable) -> Column:
        return facts.compile(self.source, functions=self.functions).column()


class Measure(_ById):
    explicit_label: str | None = None

    @property
    def label(self) -> str:
        return self.explicit_label or self.id

    def column(self, facts: FactTable) -> Column:
        """As a double; NaN is null."""
        raise NotImplementedError


@dataclass(frozen=True, eq=False)
class ColumnMeasure(Measure):
    source_column: str
    explicit_label: str | None = None

    @property
    def id(self) -> str:
        return self.source_column

    def column(self, facts: FactTable) -> Column:
        c = facts[self.source_column]
        if not c.type.numeric:
            raise TypeError(f"{c.name} is {c.type.value}, not a number")
        return F.col(c.inner).cast("double")


@dataclass(frozen=True, eq=False)
class ExpressionMeasure(Measure):
    source: str
    given_id: str | None = None
    explicit_label: str | None = None
    functions: FunctionRegistry = field(default=STANDARD, repr=False)

    @property
    def id(self) -> str:
        return self.given_id or self.source

    def column(self, facts: FactTable) -> Column:
        return facts.compile(self.source, ExprType.NUMBER, self.functions).column()


def standard_dimensions(facts: FactTable) -> list[Dimension]:
    """Every column, and the parts of each date: hours of date-times only."""
    found: list[Dimension] = []
    for c in facts.columns:
        found.append(ColumnDimension(c.name))
        if c.type.expression is ExprType.DATE:
            found += [DatePartDimension(c.name, p) for p in DATE_PARTS if p != "hour" or c.type is ColumnType.DATE_TIME]
    return found
