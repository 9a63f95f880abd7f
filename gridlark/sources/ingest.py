"""Schema inference and import of text into typed fact tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlark.operators.facts import ColumnType, FactTable
from gridlark.sources.schema import DATE_FORMATS, NULL_VALUES, STANDARD, ColumnSpec, DatePattern, NumberSyntax, Schema, is_midnight, trimmed

#: Narrowest first.
_ORDER = (ColumnType.INTEGER, ColumnType.NUMBER, ColumnType.BOOLEAN, ColumnType.DATE, ColumnType.DATE_TIME, ColumnType.TEXT)


class ImportFailed(ValueError):
    """A cell didn't fit its column, and the policy is to fail."""


@dataclass(frozen=True)
class InferenceOptions:
    sample_rows: int = 1000
    null_values: tuple[str, ...] = NULL_VALUES
    date_formats: tuple[str, ...] = DATE_FORMATS
    number_syntax: NumberSyntax = STANDARD


def _inner(df: DataFrame) -> DataFrame:
    return df.toDF(*(f"x{k}" for k in range(len(df.columns))))


def _prepared(raw: DataFrame, specs: dict[int, ColumnSpec]) -> DataFrame:
    """raw with, for each column's place, its cleaned text p and the same, trimmed, t."""
    cleaned = raw.withColumns({f"p{k}": s.cleaned(F.col(f"x{k}").cast("string")) for k, s in specs.items()})
    return cleaned.withColumns({f"t{k}": trimmed(F.col(f"p{k}")) for k in specs})


def infer_schema(df: DataFrame, options: InferenceOptions = InferenceOptions()) -> Schema:
    """The narrowest type that fits every value of the first rows, by one aggregation; no value at all is text."""
    texts = {
        k: ColumnSpec(f.name, ColumnType.TEXT, number_syntax=options.number_syntax, null_values=options.null_values)
        for k, f in enumerate(df.schema.fields)
        if isinstance(f.dataType, T.StringType)
    }
    sample = _prepared(_inner(df.limit(options.sample_rows)), texts)
    tests: dict[str, Column] = {}
    for k, spec in texts.items():
        present, text = F.col(f"p{k}"), F.col(f"t{k}")
        every = lambda parsed, text=text: F.coalesce(F.bool_and(F.when(text.isNotNull(), parsed.isNotNull())), F.lit(False))
        for kind in (ColumnType.INTEGER, ColumnType.NUMBER, ColumnType.BOOLEAN):
            tests[f"{k} {kind.value}"] = every(spec.value_of(present, text, kind))
        for j, pattern in enumerate(options.date_formats):
            tests[f"{k} date {j}"] = every(DatePattern(pattern).parse(text))
    found = sample.agg(*(c.alias(n) for n, c in tests.items())).first().asDict() if tests else {}
    return Schema(tuple(_spec(k, f, found, options) for k, f in enumerate(df.schema.fields)))


def _spec(k: int, f: T.StructField, found: dict, options: InferenceOptions) -> ColumnSpec:
    make = lambda kind, pattern=None: ColumnSpec(f.name, kind, format=pattern, number_syntax=options.number_syntax, null_values=options.null_values)
    if not isinstance(f.dataType, T.StringType):
        return make(_declared(f.dataType))
    for kind in (ColumnType.INTEGER, ColumnType.NUMBER, ColumnType.BOOLEAN):
        if found[f"{k} {kind.value}"]:
            return make(kind)
    for j, pattern in enumerate(options.date_formats):
        if found[f"{k} date {j}"]:
            return make(ColumnType.DATE_TIME if DatePattern(pattern).has_time else ColumnType.DATE, pattern)
    return make(ColumnType.TEXT)


def _declared(kind: T.DataType) -> ColumnType:
    if isinstance(kind, T.IntegralType):
        return ColumnType.INTEGER
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return ColumnType.NUMBER
    if isinstance(kind, T.BooleanType):
        return ColumnType.BOOLEAN
    if isinstance(kind, T.DateType):
        return ColumnType.DATE
    return ColumnType.DATE_TIME if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else ColumnType.TEXT


class ImportIssue(NamedTuple):
    column: str
    raw: str
    message: str


@dataclass(frozen=True)
class ImportReport:
    rows: int
    #: Column -> cells that became null because they didn't fit.
    nullified: dict[str, int] = field(default_factory=dict)
    #: Column -> the type it was widened to.
    widened: dict[str, ColumnType] = field(default_factory=dict)
    #: Misfits, the least ones by column and text, as rows have no number here.
    issues: tuple[ImportIssue, ...] = ()
    truncated: bool = False


def _value(spec: ColumnSpec, k: int, kind: T.DataType) -> Column:
    """A text cell parsed; a typed one cast where nothing is lost."""
    if isinstance(kind, T.StringType):
        return spec.value_of(F.col(f"p{k}"), F.col(f"t{k}"))
    if spec.type is ColumnType.TEXT:
        return F.col(f"x{k}").cast("string")
    return F.col(f"x{k}").try_cast(spec.type.spark)


def load_facts(df: DataFrame, schema: Schema | None = None, on_mismatch: str = "widen", max_issues: int = 100) -> tuple[FactTable, ImportReport]:
    """Facts of a raw frame and what happened.

    A cell that doesn't fit its column's type widens the column (to the
    narrowest type that all its cells fit, else text), becomes null (nullify)
    or stops the import (fail).  In a column that became text, cells that had
    the type it was given are told by their values (007 is 7), others by their
    raw texts.
    """
    if on_mismatch not in ("widen", "nullify", "fail"):
        raise ValueError("a mismatch can widen, nullify or fail")
    schema = schema or infer_schema(df)
    place = {n: k for k, n in enumerate(df.columns)}
    specs = [s for s in schema.included if s.name in place]
    raw = _prepared(_inner(df), {place[s.name]: s for s in specs})
    present = {s.name: F.col(f"p{place[s.name]}") for s in specs}
    of = lambda s: _value(s, place[s.name], df.schema[place[s.name]].dataType)
    misfit = {s.name: present[s.name].isNotNull() & of(s).isNull() for s in specs if s.type is not ColumnType.TEXT}
    counts = raw.agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(c).alias(f"m{k}") for k, c in enumerate(misfit.values()))).first()
    bad = {n: counts[f"m{k}"] for k, n in enumerate(misfit) if counts[f"m{k}"]}
    issues = _issues(raw, {n: (misfit[n], present[n]) for n in bad}, {s.name: s.type for s in specs}, max_issues + 1)
    if bad and on_mismatch == "fail":
        raise ImportFailed(f"{issues[0].column}: {issues[0].message}: {issues[0].raw!r}")
    widened: dict[str, ColumnType] = {}
    given = {s.name: s for s in specs}
    if on_mismatch == "widen":
        for k, s in enumerate(specs):
            if s.name in bad:
                widened[s.name] = _widened(raw, place[s.name], s)
                specs[k] = s.copy_with(type=widened[s.name], format=None if widened[s.name] is not s.type else s.format)
    told = lambda s: F.coalesce(_told(of(given[s.name])), of(s)) if widened.get(s.name) is ColumnType.TEXT else of(s)
    values = [told(s).cast(s.type.spark).alias(s.name) for s in specs]
    facts = FactTable.of(raw.select(*values), {s.name: s.label for s in specs if s.label})
    nullified = bad if on_mismatch == "nullify" else {}
    return facts, ImportReport(counts["rows"], nullified, widened, tuple(issues[:max_issues]), len(issues) > max_issues)


def _told(value: Column) -> Column:
    """A typed value's own text, told by its type where the plan is analysed."""
    kind = F.typeof(value)
    moment = value.cast("string").try_cast("timestamp_ntz")
    dated = F.when(is_midnight(moment), F.date_format(moment, "yyyy-MM-dd")).otherwise(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSS"))
    number = value.cast("string").try_cast("double")
    return (
        F.when(kind.isin("date", "timestamp_ntz"), dated)
        .when(kind == "double", F.when((number == F.floor(number)) & (F.abs(number) < 1e15), number.cast("bigint").cast("string")).otherwise(F.lower(number.cast("string"))))
        .otherwise(value.cast("string"))
    )


def _issues(raw: DataFrame, of: dict[str, tuple[Column, Column]], types: dict[str, ColumnType], limit: int) -> list[ImportIssue]:
    if not of:
        return []
    cells = F.array(*(F.when(bad, F.struct(F.lit(n).alias("column"), text.alias("raw"))) for n, (bad, text) in of.items()))
    found = raw.select(F.explode(F.filter(cells, lambda c: c.isNotNull())).alias("c")).select("c.*")
    rows: list[Row] = found.orderBy("column", "raw").limit(limit).collect()
    return [ImportIssue(r["column"], r["raw"], f"not of type {types[r['column']].value}") for r in rows]


def _widened(raw: DataFrame, k: int, spec: ColumnSpec) -> ColumnType:
    loose = spec.copy_with(format=None)
    present, text = F.col(f"p{k}"), F.col(f"t{k}")
    options = [t for t in _ORDER if spec.type.can_widen_to(t) and t is not spec.type]
    fits = raw.agg(*(F.coalesce(F.bool_and(F.when(present.isNotNull(), loose.value_of(present, text, t).isNotNull())), F.lit(True)).alias(t.value) for t in options)).first()
    return next((t for t in options if fits[t.value]), ColumnType.TEXT)
