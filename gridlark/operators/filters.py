"""Filters: a fact stays only where the filter is true.

Each filter is two-valued on its own: an unknown comparison is false, so
NotFilter keeps the facts whose value is missing, while the expression language's
not stays unknown there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlark.functions.registry import STANDARD, FunctionRegistry
from gridlark.functions.syntax import literal_source, parse, quote_name, to_source
from gridlark.functions.types import ExprType
from gridlark.operators.dimensions import ColumnDimension, Dimension, ExpressionDimension
from gridlark.operators.facts import FactTable, all_of, any_of

# Comparisons by name.
OPERATORS = {"equal": "=", "notEqual": "<>", "less": "<", "lessOrEqual": "<=", "greater": ">", "greaterOrEqual": ">="}
TEXT_MATCHES = ("contains", "startsWith", "endsWith")


def literal(value: object) -> Column:
    if isinstance(value, datetime):
        return F.lit(value.isoformat(" ")).cast("timestamp_ntz")
    return F.lit(value)


def source_of(value: object) -> str:
    if isinstance(value, date) and not isinstance(value, datetime):
        value = datetime(value.year, value.month, value.day)
    return literal_source(value)


class FactFilter:
    def condition(self, facts: FactTable) -> Column:
        """True or false, never null."""
        raise NotImplementedError

    def to_expression_source(self) -> str | None:
        """The filter as an expression, where it has one."""
        return None


@dataclass(frozen=True)
class ValueFilter(FactFilter):
    """The dimension's value is one of values; None among them means the empty group."""

    dimension: Dimension
    values: tuple

    def condition(self, facts: FactTable) -> Column:
        c = self.dimension.column(facts)
        known = [literal(v) for v in self.values if v is not None]
        found = F.coalesce(c.isin(*known), F.lit(False)) if known else F.lit(False)
        return found | c.isNull() if None in self.values else found

    def to_expression_source(self) -> str | None:
        if isinstance(self.dimension, ColumnDimension):
            name = quote_name(self.dimension.source_column)
        elif isinstance(self.dimension, ExpressionDimension):
            name = f"({to_source(parse(self.dimension.source))})"
        elif hasattr(self.dimension, "part"):
            name = f"{self.dimension.part}({quote_name(self.dimension.source_column)})"
        else:
            return None
        known = ", ".join(source_of(v) for v in self.values if v is not None)
        parts = ([f"{name} in ({known})"] if known or not self.values else []) + ([f"{name} is empty"] if None in self.values else [])
        return " or ".join(parts)


@dataclass(frozen=True)
class CompareFilter(FactFilter):
    column: str
    op: str
    value: object

    def condition(self, facts: FactTable) -> Column:
        return ExpressionFilter(self.to_expression_source()).condition(facts)

    def to_expression_source(self) -> str:
        return f"{quote_name(self.column)} {OPERATORS[self.op]} {source_of(self.value)}"


@dataclass(frozen=True)
class RangeFilter(FactFilter):
    """low and high included."""

    column: str
    low: object
    high: object

    def condition(self, facts: FactTable) -> Column:
        return ExpressionFilter(self.to_expression_source()).condition(facts)

    def to_expression_source(self) -> str:
        return f"{quote_name(self.column)} between {source_of(self.low)} and {source_of(self.high)}"


@dataclass(frozen=True)
class TextFilter(FactFilter):
    """Case-sensitive."""

    column: str
    match: str
    text: str

    def condition(self, facts: FactTable) -> Column:
        return ExpressionFilter(self.to_expression_source()).condition(facts)

    def to_expression_source(self) -> str:
        return f"{self.match.lower()}({quote_name(self.column)}, {source_of(self.text)})"


@dataclass(frozen=True)
class EmptyFilter(FactFilter):
    column: str
    negated: bool = False

    def condition(self, facts: FactTable) -> Column:
        c = facts.column(self.column)
        return c.isNotNull() if self.negated else c.isNull()

    def to_expression_source(self) -> str:
        return f"{quote_name(self.column)} is {'not ' if self.negated else ''}empty"


def _joined(filters: tuple, word: str, none: str) -> str | None:
    parts = [f.to_expression_source() for f in filters]
    if any(p is None for p in parts):
        return None
    return f" {word} ".join(p if len(parts) == 1 else f"({p})" for p in parts) or none  # type: ignore[arg-type]


@dataclass(frozen=True)
class AndFilter(FactFilter):
    """True without filters."""

    filters: tuple[FactFilter, ...]

    def condition(self, facts: FactTable) -> Column:
        return all_of(f.condition(facts) for f in self.filters)

    def to_expression_source(self) -> str | None:
        return _joined(self.filters, "and", "true")


@dataclass(frozen=True)
class OrFilter(FactFilter):
    """False without filters."""

    filters: tuple[FactFilter, ...]

    def condition(self, facts: FactTable) -> Column:
        return any_of(f.condition(facts) for f in self.filters)

    def to_expression_source(self) -> str | None:
        return _joined(self.filters, "or", "false")


@dataclass(frozen=True)
class NotFilter(FactFilter):
    filter: FactFilter

    def condition(self, facts: FactTable) -> Column:
        return ~self.filter.condition(facts)

    def to_expression_source(self) -> str | None:
        inner = self.filter.to_expression_source()
        return None if inner is None else f"not ({inner})"


@dataclass(frozen=True)
class ExpressionFilter(FactFilter):
    source: str
    label: str | None = None
    functions: FunctionRegistry = field(default=STANDARD, repr=False, compare=False)

    def condition(self, facts: FactTable) -> Column:
        # Native comparisons reach the file scan: coalesce of a condition in a filter is simplified away.
        return F.coalesce(facts.compile(self.source, ExprType.BOOLEAN, self.functions).column(), F.lit(False))

    def to_expression_source(self) -> str:
        return to_source(parse(self.source))


@dataclass(frozen=True)
class PredicateFilter(FactFilter):
    """predicate gets a dict of the named columns, in a UDF; or, without names, the fact table, and gives a column."""

    predicate: Callable
    columns: tuple[str, ...] = ()

    def condition(self, facts: FactTable) -> Column:
        if not self.columns:
            return F.coalesce(self.predicate(facts), F.lit(False))
        test, names = self.predicate, self.columns
        keep = F.udf(lambda *values: bool(test(dict(zip(names, values, strict=True)))), "boolean", useArrow=True)
        return F.coalesce(keep(*(facts.column(n) for n in names)), F.lit(False))
