"""Fact tables: one DataFrame of typed columns under any names."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from enum import Enum
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlark.functions.compile import CompiledExpression, Scope, compile_expression
from gridlark.functions.registry import STANDARD, FunctionRegistry
from gridlark.functions.types import ExprType


class ColumnType(Enum):
    TEXT = "text"
    INTEGER = "integer"
    NUMBER = "number"
    BOOLEAN = "boolean"
    DATE = "date"
    DATE_TIME = "dateTime"

    @property
    def numeric(self) -> bool:
        return self in (ColumnType.INTEGER, ColumnType.NUMBER)

    @property
    def expression(self) -> ExprType:
        return _EXPRESSION[self]

    @property
    def spark(self) -> str:
        return _SPARK[self]

    def can_widen_to(self, other: ColumnType) -> bool:
        return other is self or other in _WIDER[self]


_EXPRESSION = dict(zip(ColumnType, (ExprType.TEXT, ExprType.NUMBER, ExprType.NUMBER, ExprType.BOOLEAN, ExprType.DATE, ExprType.DATE), strict=True))
_SPARK = dict(zip(ColumnType, ("string", "bigint", "double", "boolean", "date", "timestamp_ntz"), strict=True))
# What a column's type may be widened to.
_WIDER = {
    ColumnType.TEXT: (),
    ColumnType.INTEGER: (ColumnType.NUMBER, ColumnType.TEXT),
    ColumnType.NUMBER: (ColumnType.TEXT,),
    ColumnType.BOOLEAN: (ColumnType.TEXT,),
    ColumnType.DATE: (ColumnType.DATE_TIME, ColumnType.TEXT),
    ColumnType.DATE_TIME: (ColumnType.TEXT,),
}


@dataclass(frozen=True)
class FactColumn:
    name: str
    type: ColumnType
    label: str
    #: Its name in the frame, which any column name of the source would be unfit for.
    inner: str


def _typed(column: Column, kind: T.DataType) -> tuple[ColumnType, Column] | None:
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return ColumnType.TEXT, column
    if isinstance(kind, T.IntegralType):
        return ColumnType.INTEGER, column.cast("long")
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return ColumnType.NUMBER, F.nanvl(column.cast("double"), F.lit(None).cast("double"))
    if isinstance(kind, T.BooleanType):
        return ColumnType.BOOLEAN, column
    if isinstance(kind, T.DateType):
        return ColumnType.DATE, column
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return ColumnType.DATE_TIME, F.date_trunc("MILLISECOND", column.cast("timestamp_ntz")).cast("timestamp_ntz")
    return None


@dataclass(frozen=True)
class FactTable:
    """An immutable table; every query on it is a new lazy frame."""

    frame: DataFrame
    columns: tuple[FactColumn, ...]

    @classmethod
    def of(cls, df: DataFrame, labels: dict[str, str] | None = None) -> FactTable:
        """Columns of other types than the six (arrays, maps, binary) are left out."""
        found, made = [], []
        for k, field in enumerate(df.schema.fields):
            typed = _typed(df[f"`{field.name.replace('`', '``')}`"], field.dataType)
            if typed:
                found.append(FactColumn(field.name, typed[0], (labels or {}).get(field.name, field.name), f"f{k}"))
                made.append(typed[1].alias(f"f{k}"))
        return cls(df.select(*made), tuple(found))

    def __getitem__(self, name: str) -> FactColumn:
        for c in self.columns:
            if c.name == name:
                return c
        raise KeyError(f"no column {name!r}")

    def column(self, name: str) -> Column:
        return F.col(self[name].inner)

    def scope(self, functions: FunctionRegistry = STANDARD) -> Scope:
        """Columns as expressions see them: numbers are doubles, dates zoneless timestamps."""
        of = lambda c: (c.type.expression, lambda: F.col(c.inner).cast(c.type.expression.spark))
        return Scope({c.name: of(c) for c in self.columns}, functions)

    def compile(self, source: str, expected: ExprType | None = None, functions: FunctionRegistry = STANDARD) -> CompiledExpression:
        return compile_expression(source, self.scope(functions), expected)

    def where(self, condition: Column) -> FactTable:
        return replace(self, frame=self.frame.where(condition))

    def with_labels(self, labels: dict[str, str]) -> FactTable:
        return replace(self, columns=tuple(replace(c, label=labels.get(c.name, c.label)) for c in self.columns))

    def rows(self, names: Iterable[str] | None = None) -> DataFrame:
        """The facts under their own names."""
        wanted = [self[n] for n in names] if names is not None else self.columns
        return self.frame.select(*(F.col(c.inner).alias(c.name) for c in wanted))

    def statistics(self) -> DataFrame:
        """(name, type, null_count, distinct_count), one pass; nulls are no value."""
        per = [
            F.struct(
                F.lit(c.name).alias("name"),
                F.lit(c.type.value).alias("type"),
                F.count_if(F.col(c.inner).isNull()).alias("null_count"),
                F.count_distinct(F.col(c.inner)).alias("distinct_count"),
            )
            for c in self.columns
        ]
        return self.frame.agg(F.array(*per).alias("all")).select(F.inline("all"))

    def distinct_values(self, dimension) -> DataFrame:
        """(value), ascending, the empty value first."""
        return self.frame.select(dimension.column(self).alias("value")).distinct().orderBy(F.asc_nulls_first("value"))

    def count_where(self, dimension, value: object) -> int:
        return self.frame.where(dimension.column(self).eqNullSafe(F.lit(value))).count()


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
